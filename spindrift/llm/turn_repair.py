"""Conversation structure repair by secondary-sorted streaming.

A repaired conversation has an optional system turn and then pairs of user and assistant, or no turn at all. Edits are Keep
(free), Rerole to user or assistant (2), Delete (3; blank turns and repeated ones must go) and Insert of an empty user or
assistant turn (2); a truncated turn that stays costs 1. :func:`plan_edits` finds the cheapest edits, of equal ones those
whose initials come first in ASCII.

Rows go to their conversation's partition and are sorted by turn there; Python sees a stream of narrow rows (hashes and
flags, no texts). Four states (nothing yet, after system, after user, after assistant) carry their least cost and the rank of
their edits among the four over the Arrow batches. Edits that end with the same row never begin one another, so ranks decide
ties without the strings. Normalised states and row classes are few: a step is a look-up of a remembered transition, whose
number (two bytes) is the back-pointer of all four states. Every 65,536 pointers of one conversation are put into the shared
folder and taken back, last first, when the conversation ends; a retried task writes files of its own. The edits of such
blocks then meet the texts in a second sorted stream, where a block comes before its first row: texts move once, and no
conversation is ever held whole (but for its audit, which is one value).

Defined results: rows are taken by turn (nulls first), then role and hash of text; null roles and texts are one space, and a
role other than system, user and assistant (told by the first letter) cannot be kept; a null conv_id is one conversation;
repeated rows are duplicates; texts are taken whole at any length; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import deque

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, partitions, pick, work_dir, write_file, written

SPACES = " \t\n\x0b\x0c\r"
#: Rows of one conversation whose back-pointers are kept together.
BLOCK = 1 << 16
INITIALS = "sua?"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a new or reroled turn is after each state, and what may be kept.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LAST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
KEY = ["conv_null", "conv", "turn_set", "turn", "role", "k1", "k2"]
_KEY_TYPES = "conv_null boolean, conv long, turn_set boolean, turn long, role string, k1 long, k2 long"
_BLOCKS = f"{_KEY_TYPES}, block long, letters string, " + ", ".join(f"{c} long" for c in COUNTS)


def row_edits(state: int, initial: str, fault: int):
    """(letters, cost, state after) of every useful way to pass a row: up to two insertions, then the row's own edit."""
    letters, cost = "", 0
    for _ in range(3):
        yield letters + "D", cost + 3, state
        if fault not in (BLANK, DUPLICATE):
            late = cost + (fault == TRUNCATED)
            if (state, initial) in KEPT:
                yield letters + "K", late, KEPT[state, initial]
            yield letters + "R", late + 2, NEXT[state]
        letters, cost, state = letters + "I", cost + 2, NEXT[state]


class Steps:
    """Remembered transitions between normalised sets of states: (cost above the least, rank) of each, or None."""

    def __init__(self) -> None:
        self.sets = {((0, 0), None, None, None): 0}
        self.known, self.moves = {}, []

    def step(self, at: int, kind: int) -> tuple[int, int, int]:
        """(set after, cost that all states gained, number of the transition)."""
        if (at, kind) not in self.known:
            states = [*self.sets][at]
            best: dict[int, tuple] = {}
            for p, known in enumerate(states):
                for letters, cost, q in row_edits(p, INITIALS[kind % 4], kind // 4) if known else ():
                    best[q] = min(best.get(q, (1 << 60,)), (known[0] + cost, known[1], letters, p))
            least = min(b[0] for b in best.values())
            order = sorted(best, key=lambda q: best[q][1:3])
            after = tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(4))
            self.moves.append([(best[q][3], best[q][2]) if q in best else None for q in range(4)])
            self.known[at, kind] = self.sets.setdefault(after, len(self.sets)), least, len(self.moves) - 1
        return self.known[at, kind]

    def best_end(self, at: int) -> tuple[int, str, int]:
        """(cost above the set's, last insertions, state) of the cheapest end."""
        states = [*self.sets][at]
        cost, _, letters, p = min((known[0] + 2 * len(LAST[p]), known[1], LAST[p], p) for p, known in enumerate(states) if known)
        return cost, letters, p

    def back(self, pointers, state: int) -> tuple[str, int]:
        """The letters of these rows that lead to the state, and the state before them."""
        out = []
        for number in reversed(pointers):
            state, letters = self.moves[number][state]
            out.append(letters)
        return "".join(reversed(out)), state


class Conversation:
    """One conversation's stream: counts, states and back-pointers."""

    def __init__(self, steps: Steps, spill: str, block: int) -> None:
        self.steps, self.spill, self.block, self.at, self.cost = steps, spill, block, 0, 0
        self.keys, self.pointers = [], array("H")
        self.low = self.high = self.turn = None
        self.turns, self.faults, self.illegal, self.initial = 0, [0] * 4, 0, ""

    def add(self, key: tuple, kind: int) -> None:
        if len(self.pointers) == self.block:
            write_file(f"{self.spill}-{len(self.keys)}", self.pointers.tobytes())
            self.pointers = array("H")
        if not self.pointers:
            self.keys.append(key)
        if key[2] and key[3] != self.turn:
            self.turn = key[3]
            self.low = self.turn if self.low is None else self.low
            self.turns += 1
        initial = INITIALS[kind % 4]
        self.illegal += bool(self.initial) and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.faults[kind // 4] += 1
        self.at, gained, number = self.steps.step(self.at, kind)
        self.cost += gained
        self.pointers.append(number)

    def blocks(self):
        """The edits of each block of rows, the last first; the first block has the counts."""
        more, letters, state = self.steps.best_end(self.at)
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        counts = [gaps, *self.faults[1:], self.illegal, self.cost + more]
        for i in range(len(self.keys) - 1, -1, -1):
            if i < len(self.keys) - 1:
                fs, path = filesystem(f"{self.spill}-{i + 1}")
                with fs.open_input_file(path) as f:
                    self.pointers = array("H", f.read())
                fs.delete_file(path)
            head, state = self.steps.back(self.pointers, state)
            yield (*self.keys[i], i, head + letters, *(counts if i == 0 else [None] * len(COUNTS)))
            letters = ""


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """The rows with nullable integers, so that no long passes through a float."""
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    types = {"long": "Int64", "boolean": "boolean", "string": object}
    return pd.DataFrame({n: pd.array(list(c), dtype=types[k]) if k != "string" else pd.Series(list(c), dtype=object) for n, k, c in zip(names, kinds, cols, strict=True)})


def _plan(folder: str, block: int):
    def run(batches):
        steps, now, conversation, done = Steps(), None, None, 0
        for batch in batches:
            out = []
            for *key, kind in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if (key[0], key[1]) != now:
                    if conversation:
                        out += conversation.blocks()
                    now, done = (key[0], key[1]), done + 1
                    conversation = Conversation(steps, f"{folder}/{TaskContext.get().taskAttemptId()}-{done}", block)
                conversation.add(tuple(key), kind)
            yield _frame(out, _BLOCKS)
        if conversation:
            yield _frame([*conversation.blocks()], _BLOCKS)

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """The columns of :data:`KEY` and the text; nulls as this module's docstring says."""
    rows = pick(rows, "conv_id", "turn", "role", "text")
    text = F.coalesce("text", F.lit(" "))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    whole = rows.select(conv.isNull().alias("conv_null"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("turn_set"), F.coalesce(turn, F.lit(0)).alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    return whole.select("conv_null", "conv", "turn_set", "turn", "role", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")


def plan_edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A written row for each block of a conversation: its first row's key, the edits' letters, and counts on block 0."""
    spark, n = rows.sparkSession, partitions(rows)
    ends = F.rtrim("text", F.lit(SPACES))
    kind = F.when(ends == "", BLANK).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    narrow = keyed(rows).select(*KEY, kind.alias("fault"), initial.alias("initial")).repartition(n, "conv_null", "conv")
    again = F.row_number().over(Window.partitionBy("conv_null", "conv", "role", "k1", "k2").orderBy("turn_set", "turn")) > 1
    fault = F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault"))
    narrow = narrow.select(*KEY, (F.col("initial") + 4 * fault).cast("int").alias("kind"), again.alias("again")).sortWithinPartitions(*KEY, "again").drop("again")
    return written(narrow.mapInPandas(_plan(work_dir(spark, "pointers"), block), _BLOCKS), "edits")


class _Repair:
    """Applies the letters of one conversation's blocks to its rows, in order."""

    def __init__(self) -> None:
        self.blocks, self.at, self.state, self.made, self.audit, self.counts = deque(), 0, START, 0, [], None
        self.digest = hashlib.sha256()

    def letter(self) -> str | None:
        while self.blocks and self.at == len(self.blocks[0]):
            self.blocks.popleft()
            self.at = 0
        if not self.blocks:
            return None
        self.at += 1
        return self.blocks[0][self.at - 1]

    def turn(self, edit: str, role: str, text: str) -> tuple:
        self.state = KEPT[self.state, role[:1]] if edit == "K" else NEXT[self.state]
        if edit != "K":
            role = "user" if self.state == USER else "assistant"
        self.digest.update((("\n" if self.made else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.made += 1
        return self.made - 1, role, text, edit

    def passed(self, role: str, text: str):
        """The repaired turns up to and with this row."""
        while (edit := self.letter()) == "I":
            yield self.turn("I", "", "")
        if edit != "D":
            yield self.turn(edit, role, text)

    def rest(self):
        while self.letter():
            yield self.turn("I", "", "")


_TURNS = "conv_null boolean, conv long, position long, role string, text string, edit string"
_AUDITS = "conv_null boolean, conv long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _apply(turns: bool):
    def run(batches):
        now, one = None, None

        def closed() -> list[tuple]:
            if one is None:
                return []
            rest = [(*now, *t) for t in one.rest()]
            return rest if turns else [(*now, *one.counts, "".join(one.audit), one.digest.hexdigest())]

        for batch in batches:
            out = []
            counts = zip(*(batch[c].tolist() for c in COUNTS), strict=True)
            for null, conv, role, text, letters, count in zip(*(batch[c].tolist() for c in ("conv_null", "conv", "role", "text", "letters")), counts, strict=True):
                if (null, conv) != now:
                    out += closed()
                    now, one = (null, conv), _Repair()
                if letters is not None:
                    one.blocks.append(letters)
                    if not turns:
                        one.audit.append(letters)
                    one.counts = one.counts or [int(c) for c in count]
                else:
                    repaired = one.passed(role, text)
                    if turns:
                        out += [(*now, *t) for t in repaired]
                    else:
                        deque(repaired, 0)
            yield _frame(out, _TURNS if turns else _AUDITS)
        yield _frame(closed(), _TURNS if turns else _AUDITS)

    return run


def _applied(rows: DataFrame, turns: bool, block: int) -> DataFrame:
    edits = plan_edits(rows, block).withColumn("text", F.lit(None).cast("string"))
    texts = keyed(rows).withColumn("block", F.lit(1 << 62))
    both = edits.unionByName(texts, allowMissingColumns=True).repartition(partitions(rows), "conv_null", "conv").sortWithinPartitions(*KEY, "block")
    both = both.select("conv_null", "conv", "role", "text", "letters", *COUNTS)
    out = both.mapInPandas(_apply(turns), _TURNS if turns else _AUDITS)
    return out.select(F.when(~F.col("conv_null"), F.col("conv")).alias("conv_id"), *out.columns[2:])


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position, role, text, edit (K, R or I) of the repaired turns."""
    return _applied(rows, True, block)


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation: gaps, faults, illegal neighbours, cost and letters of the edits, hash of the repaired turns."""
    return _applied(rows, False, block)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with seeded faults: rows dropped, emptied, cut off, repeated, given to the user."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", cell("conv_id"), cell("turn")).cast("binary")) % 20
    rows = pick(rows, "conv_id", "turn", "role", "text").withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(cell("text"), "[.!?]", "")).otherwise(cell("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(cell("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = audits(damaged(rows)).withColumnRenamed("conv_id", "c")
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = out.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, n) AS c FROM range(256) r(n))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT)) % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM d),
f AS (SELECT *, substr(role, 1, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, max(i) AS last FROM f GROUP BY 1),
il AS (SELECT conv_id, count(*) FILTER (p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, c, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f) GROUP BY 1),
ins(p, q, made, letters) AS (VALUES (0, 0, []::VARCHAR[], ''), (1, 1, [], ''), (2, 2, [], ''), (3, 3, [], ''), (0, 2, ['user:'], 'I'), (1, 2, ['user:'], 'I'), (2, 3, ['assistant:'], 'I'), (3, 2, ['user:'], 'I'),
   (0, 3, ['user:', 'assistant:'], 'II'), (1, 3, ['user:', 'assistant:'], 'II'), (2, 2, ['assistant:', 'user:'], 'II'), (3, 3, ['user:', 'assistant:'], 'II')),
ed(p, letters, made, letter, q, c) AS (SELECT p, letters, made, 'D', q, '' FROM ins UNION ALL SELECT p, letters, made, 'R', CASE q WHEN 2 THEN 3 ELSE 2 END, '' FROM ins
   UNION ALL SELECT p, letters, made, 'K', x.r, x.c FROM ins, (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) x(m, c, r) WHERE x.m = q),
st AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]} AS b FROM g
   UNION ALL (SELECT st.conv_id, st.i + 1, ed.q, min({'cost': b.cost + 2 * length(letters) + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 3 THEN 1 ELSE 0 END, 'audit': b.audit || letters || letter,
      'made': list_concat(b.made, list_concat(ed.made, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ed.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END))})
   FROM st JOIN f ON f.conv_id = st.conv_id AND f.i = st.i + 1 JOIN ed ON ed.p = st.s WHERE (letter = 'D' OR fault IN (0, 3)) AND (letter <> 'K' OR ed.c = f.c) GROUP BY 1, 2, 3)),
e AS (SELECT conv_id, min({'cost': b.cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'made': list_concat(b.made, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
   FROM st JOIN g USING (conv_id) WHERE st.i = g.last GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
   coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g USING (conv_id) LEFT JOIN il USING (conv_id) LEFT JOIN e USING (conv_id)
"""
