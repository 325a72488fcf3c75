"""Spark-first analytics operators: every public function maps DataFrames to DataFrames."""
