"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bagminhash, collinear, consensus_html, decontaminate, edit_walks, huffman_ids, licenses, line_frequency, packaged_warc, poisson_mix, rule_ensemble, token_alignment, turn_repair

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_frequency": line_frequency.op2_line_frequency,
    "op3_huffman_ids": huffman_ids.op3_huffman_ids,
    "op4_packaged_warc": packaged_warc.op4_packaged_warc,
    "op5_rule_ensemble": rule_ensemble.op5_rule_ensemble,
    "op6_poisson_mix": poisson_mix.op6_poisson_mix,
    "op7_bagminhash": bagminhash.op7_bagminhash,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_collinear": collinear.op9_collinear,
    "op10_consensus_html": consensus_html.op10_consensus_html,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_edit_walks": edit_walks.op12_edit_walks,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_line_frequency": line_frequency.SQL,
    "op6_poisson_mix": poisson_mix.SQL,
    "op11_turn_repair": turn_repair.SQL,
}
