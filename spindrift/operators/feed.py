"""Feed items: composite filters, named views, rankings, briefings, facets and story dedup."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_UNIT = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def since_bound(text: str, now: datetime, retention: timedelta) -> datetime:
    """"15m", "6h", "1d", "2w" before now or an ISO time, at the earliest now less the retention."""
    m = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    at = now - timedelta(seconds=int(m[1]) * _UNIT[m[2]]) if m else datetime.fromisoformat(text.strip())
    return max(at, now - retention)


def feed_filter(df: DataFrame, since: Column | None = None, any_of: dict[str, list] | None = None, min_score: int | None = None, words: str = "", haystack: list[str] = ("title",)) -> DataFrame:
    """Items after a time, with any of the listed values per column, a score and all words in the haystack columns."""
    tests = [F.col("ts") >= since] if since is not None else []
    tests += [F.col(c).isin(list(v)) for c, v in (any_of or {}).items() if v]
    tests += [F.col("score") >= min_score] if min_score is not None else []
    text = F.lower(F.concat_ws(" ", *haystack))
    tests += [text.contains(w) for w in words.lower().split()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def in_view(clauses: list[dict[str, list]]) -> Column:
    """A named view: any of the clauses, each of which wants all of its columns to have a listed value."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).isin(list(v)) for c, v in clause.items()]) for clause in clauses])


def ranked(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def briefing(df: DataFrame, per_topic: int) -> DataFrame:
    """Top items of each topic by score, each story once: under its topic with most stories.

    A story (title) in several topics is first assigned to one by size of topic; then each topic takes its best.
    """
    sizes = df.groupBy("topic").agg(F.count("*").alias("size"))
    ranked_ = df.join(sizes, "topic").groupBy("title").agg(F.max_by(F.struct("topic", "id", "score"), F.struct("size", "topic", "score", -F.col("id"))).alias("best")).select("best.*")
    rn = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "id"))
    return ranked_.withColumn("place", rn).where(F.col("place") <= per_topic)


def greedy_briefing(df: DataFrame, topics: str, key: str, order: list[Column], per_topic: int, most_topics: int = 200) -> DataFrame:
    """topic, place, key: topics in order of their counts (then names) each take their first items that no topic before took. topics: an array.

    The topic in place p can lose at most per_topic * p of its items to those before, so its first per_topic * (p + 1) items decide. Only these,
    at most per_topic * most_topics ** 2 / 2 rows whatever the table's size, come together in one group, where the topics take turns.
    """
    flat = df.select(key, F.explode(F.array_distinct(topics)).alias("topic"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    counts = flat.groupBy("topic").agg(F.count("*").alias("_n"))
    if counts.limit(most_topics + 1).count() > most_topics:
        raise ValueError(f"more than {most_topics} topics")
    turns = counts.withColumn("turn", F.row_number().over(W.orderBy(F.desc("_n"), "topic")) - 1).drop("_n")
    best = F.row_number().over(W.partitionBy("topic").orderBy(*[f"_o{i}" for i in range(len(order))], key))
    few = flat.withColumn("rank", best).join(F.broadcast(turns), "topic").where(F.col("rank") <= per_topic * (F.col("turn") + 1))  # most_topics rows

    def take(rows):
        taken, out = set(), []
        rows = rows.sort_values(["turn", "rank"])
        for topic, part in rows.groupby("topic", sort=False):
            mine = [k for k in part[key] if k not in taken][:per_topic]
            taken.update(mine)
            out += [(topic, i + 1, k) for i, k in enumerate(mine)]
        return type(rows)(out, columns=["topic", "place", key])

    schema = f"topic string, place int, {key} {dict(df.dtypes)[key]}"
    return few.select("topic", "turn", "rank", key, F.lit(True).alias("_all")).groupBy("_all").applyInPandas(take, schema)


def dedup_stories(df: DataFrame, title: str, quality: list[Column]) -> DataFrame:
    """One copy of each story: key is the title's letters and digits, the best quality stays."""
    key = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")
    return df.withColumn("story", key).withColumn("_rn", F.row_number().over(W.partitionBy("story").orderBy(*quality))).where("_rn = 1").drop("_rn")


def timeline(df: DataFrame, width: str, start: datetime, end: datetime, by: str = "source") -> DataFrame:
    """Counts per tumbling window and group, empty windows included."""
    hours = int(width.split()[0])
    bins = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end - timedelta(hours=hours)), F.expr(f"interval {width}"))).alias("bin"))
    grid = bins.join(F.broadcast(df.select(by).distinct()))  # bins by groups: the timeline's own size
    counts = df.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(F.window("ts", width)["start"].alias("bin"), by).agg(F.count("*").alias("n"))
    return grid.join(counts, ["bin", by], "left").select("bin", by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latest_update(items: DataFrame, acts: DataFrame, slack: str) -> DataFrame:
    """For each item the best activity within slack of its time: one with text before others, then the newest.

    items: id, who, ts; acts: who, at, act_id, has_text. Times are cut into slots of the slack, so the range join is an equi-join.
    """
    step = F.expr(f"interval {slack}")
    width = int(timedelta(**{slack.split()[1].rstrip("s") + "s": int(slack.split()[0])}).total_seconds())
    slot = lambda c: F.floor(F.unix_timestamp(c) / width)
    near = items.withColumn("slot", F.explode(F.array(slot("ts") - 1, slot("ts"), slot("ts") + 1)))
    joined = near.join(acts.withColumn("slot", slot("at")), ["who", "slot"]).where((F.col("at") >= F.col("ts") - step) & (F.col("at") <= F.col("ts") + step))
    best = F.max_by(F.struct("act_id", "at"), F.struct("has_text", "at", "act_id"))
    return joined.groupBy("id").agg(best.alias("best"), F.count("*").alias("candidates")).select("id", "best.act_id", "best.at", "candidates")
