"""Conversation repair against every sequence of edits, over random rows, in small blocks and on odd rows."""

import hashlib
import itertools
import random
import re

from spindrift.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = tr.BLANK if blank else tr.DUPLICATE if (role, text) in seen else tr.FINE if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else tr.TRUNCATED
        seen.add((role, text))
        out.append(fault)
    return out


def every_repair(rows, most=3):
    """(cost, letters, turns) of all edits with at most ``most`` insertions between rows."""
    kinds = faults(rows)

    def inserts(i):
        for n in range(most + 1):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                yield "I" * n, 2 * n, [(r, "") for r in roles]

    def walk(i):
        for letters, cost, made in inserts(i):
            if i == len(rows):
                yield cost, letters, made
                continue
            (role, text), late = rows[i], kinds[i] == tr.TRUNCATED
            own = [(3, "D", [])]
            if kinds[i] not in (tr.BLANK, tr.DUPLICATE):
                own += [(late, "K", [(role, text)]), (2 + late, "R", [("user", text)]), (2 + late, "R", [("assistant", text)])]
            for (c, x, m), (rest, tail, turns) in itertools.product(own, list(walk(i + 1))):
                yield cost + c + rest, letters + x + tail, made + m + turns

    return min((c, x, m) for c, x, m in walk(0) if re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in m)))


def by_states(rows):
    """The same by strings carried in full, for longer conversations."""
    kinds, best = faults(rows), {tr.START: (0, "", [])}
    for (role, text), fault in zip(rows, kinds, strict=True):
        new = {}
        for p, (cost, audit, made) in best.items():
            for letters, c, q in tr.row_edits(p, role[0] if role[0] in "sua" else "?", fault):
                state, turns = p, list(made)
                for x in letters:
                    if x == "D":
                        continue
                    state = tr.KEPT[state, role[0]] if x == "K" else tr.NEXT[state]
                    turns.append((role if x == "K" else "user" if state == tr.USER else "assistant", "" if x == "I" else text))
                new[q] = min(new.get(q, (1 << 60,)), (cost + c, audit + letters, turns))
        best = new
    ends = []
    for p, (cost, audit, made) in best.items():
        state, turns = p, list(made)
        for _ in tr.LAST[p]:
            state = tr.NEXT[state]
            turns.append(("user" if state == tr.USER else "assistant", ""))
        ends.append((cost + 2 * len(tr.LAST[p]), audit + tr.LAST[p], turns))
    return min(ends)


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["a.", "b!", "c", " \n", "", "d? \t", "e."])) for _ in range(n)]


def test_cheapest_edits_like_every_sequence():
    rng = random.Random(3)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(3))
        assert by_states(rows) == every_repair(rows)
    rows = [("user", "a."), ("user", "b."), ("system", "c.")]
    assert by_states(rows) == every_repair(rows, 2)


def test_audits_and_repaired_turns_of_random_conversations(spark):
    rng = random.Random(5)
    for block in (3, tr.BLOCK):
        talks = {i: random_rows(rng, rng.randrange(1, 40)) for i in range(120)}
        data = [(i, t, r, x) for i, rows in talks.items() for t, (r, x) in enumerate(rows)]
        rng.shuffle(data)
        df = spark.createDataFrame(data, SCHEMA)
        got = {r["conv_id"]: r for r in tr.audits(df, block).collect()}
        turns = {}
        for r in sorted(tr.repair(df, block).collect(), key=lambda r: (r["conv_id"], r["position"])):
            turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert got.keys() == talks.keys()
        for i, rows in talks.items():
            cost, audit, made = by_states(rows)
            assert (got[i]["cost"], got[i]["audit"], got[i]["repaired_sha256"]) == (cost, audit, sha(made)) and turns.get(i, []) == made
            kinds, initials = faults(rows), [r[0] for r, _ in rows]
            assert [got[i][c] for c in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in (1, 2, 3)] and got[i]["gaps"] == 0
            assert got[i]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))


def test_pointers_of_a_giant_conversation_are_spilled_and_taken_back(tmp_path):
    rng = random.Random(8)
    rows = random_rows(rng, 500)
    talk = tr.Conversation(tr.Steps(), f"file://{tmp_path}/p", 7)
    for i, ((role, _), fault) in enumerate(zip(rows, faults(rows), strict=True)):
        talk.add((False, 1, True, i, role, 0, i), "sua?".index(role[0] if role[0] in "sua" else "?") + 4 * fault)
    assert len(list(tmp_path.iterdir())) == 71
    blocks = list(talk.blocks())
    assert not list(tmp_path.iterdir()) and len(blocks) == 72 and blocks[-1][3] == 0
    cost, audit, _ = by_states(rows)
    assert "".join(b[8] for b in reversed(blocks)) == audit and blocks[-1][-1] == cost


def test_ties_gaps_and_nulls(spark):
    rows = [(1, 3, "user", "a."), (1, None, "system", "s."), (1, 9, "assistant", "b."), (1, 9, "assistant", "b."), (2, None, None, None), (None, 1, "user", "x"), (None, 2, "assistant", "y."), (3, 2**62 + 1, "user", "q?"), (3, 2**62 + 3, "assistant", "z" * 300_000 + ".")]
    got = {r["conv_id"]: r for r in tr.audits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["audit"], got[1]["gaps"], got[1]["duplicate"], got[1]["cost"]) == ("KKKD", 5, 1, 3)
    assert (got[2]["audit"], got[2]["blank"], got[2]["gaps"], got[2]["repaired_sha256"]) == ("D", 1, 0, sha([]))
    assert (got[None]["audit"], got[None]["truncated"], got[None]["cost"]) == ("KK", 1, 1)
    assert (got[3]["audit"], got[3]["gaps"]) == ("KK", 1)
    extra = spark.createDataFrame([(1, 1, "user", "a.", 5, "x", True)], SCHEMA + ", block int, letters string, conv_null boolean")
    assert [(r["role"], r["text"], r["edit"]) for r in tr.repair(extra).orderBy("position").collect()] == [("user", "a.", "K"), ("assistant", "", "I")]
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.audits(empty).count() == 0 and tr.repair(empty).count() == 0


def test_damage(spark):
    import zlib

    rows = [(i, t, "assistant", f"One. Two! {i}?") for i in range(20) for t in range(6)]
    got = {}
    for r in tr.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for i, t, role, text in rows:
        kind = zlib.crc32(f"{i}:{t}".encode()) % 20
        want = [] if kind == 0 else [(role, "")] if kind == 1 else [(role, re.sub("[.!?]", "", text))] if kind == 2 else [(role, text)] * 2 if kind == 3 else [("user" if kind == 4 else role, text)]
        assert got.get((i, t), []) == want
