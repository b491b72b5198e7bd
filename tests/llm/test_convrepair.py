import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import convrepair, queries
from tessera.llm.convrepair import Costs
from tests.conftest import SF_SMALL

LEGAL_END = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    """Rows of one conversation in order, and the fault of each."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        black = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, faults


def plain_repair(rows, faults, costs=Costs(), most=None):
    """Every edit sequence there is: ``(cost, letters, output)`` of the best one."""
    best = None
    most = len(rows) + 2 if most is None else most

    def go(i, cost, letters, out, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        roles = "".join(r[:1] or "?" for r, _ in out)
        if not any(LEGAL_END.match(roles + rest) for rest in ("", "a", "ua")):
            return
        if i == len(rows):
            if LEGAL_END.match(roles):
                best = min(best or (cost, letters, out), (cost, letters, out), key=lambda b: b[:2])
        else:
            role, text = rows[i][2:]
            go(i + 1, cost + costs.delete, letters + "D", out, left)
            if faults[i] not in ("blank", "duplicate"):
                more = costs.truncated if faults[i] == "truncated" else 0
                go(i + 1, cost + more, letters + "K", [*out, (role, text)], left)
                for to in ("user", "assistant"):
                    go(i + 1, cost + more + costs.rerole, letters + "R", [*out, (to, text)], left)
        if left:
            for to in ("user", "assistant"):
                go(i, cost + costs.insert, letters + "I", [*out, (to, "")], left - 1)

    go(0, 0, "", [], most)
    return best


def plain_row(rows, costs=Costs(), most=1):
    rows, faults = plain_faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    letters = [r[2][:1] for r in rows]
    cost, audit, out = plain_repair(rows, faults, costs, most)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def plain_query(rows, most=1):
    left = {}
    for r in plain_damage(rows):
        left.setdefault(r[0], []).append(r)
    return {c: plain_row(left.get(c, []), most=most) for c in {r[0] for r in rows}}


def run_query(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumns({c: F.lit("x") for c in extra}).write.parquet(str(tmp_path / "conversations.parquet"))
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}


def made_up(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 1, 4]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", ""]), rng.choice(["Yes.", "No!", "And then", " ", "Why? ", "Long.\n\t"])))
    return rows


def test_query_matches_trying_every_edit(spark, tmp_path):
    rows = made_up()
    assert run_query(spark, rows, tmp_path) == plain_query(rows)


def test_given_conversations_match_trying_every_edit(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op13_conversation_repair(spark, SF_SMALL).collect()}
    assert got == plain_query(rows, most=0)


ODD = [
    (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "assistant", "First."), (1, 0, "user", ""),
    (1, 0, "user", "Same turn."), (2, 5, "user", "Question?"), (2, -(1 << 63), "system", "Far."), (2, (1 << 63) - 1, "assistant", "Away."),
    (3, None, None, "No role."), (3, None, "assistant", None), (4, 0, "user", "é" * 200_000 + "."), (4, 1, "assistant", "😀!"), (5, 0, "user", "Nur das?\x0b\x0c"),
]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    got = run_query(spark, ODD, tmp_path, extra=["conv", "pos", "kind", "copy", "seg", "size", "code", "audit", "cost", "group_size"])
    assert got == {c: v | {"gaps": min(v["gaps"], (1 << 63) - 1)} for c, v in plain_query(ODD).items()}


def test_empty_table(spark, tmp_path):
    assert run_query(spark, [], tmp_path) == {}


def random_codes(rng, n):
    return [rng.choice("suax") + rng.choice("----bdt") for _ in range(n)]


def as_rows(codes):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    return [(0, i, names[c[0]], f"t{i}") for i, c in enumerate(codes)], [{"-": "", "b": "blank", "d": "duplicate", "t": "truncated"}[c[1]] for c in codes]


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(rerole=3, delete=3, insert=2, truncated=1), Costs(rerole=0, delete=2, insert=4, truncated=0)])
def test_inserts_where_they_can_pay(costs):
    """The integer path against trying everything, also where inserts are cheap; the
    production costs prove that none is needed though the plain version may insert."""
    rng = random.Random(5)
    for _ in range(80):
        codes = random_codes(rng, rng.randint(0, 5))
        cost, audit, _ = plain_repair(*as_rows(codes), costs, most=4)
        for segment in (1, 2, 100):
            assert convrepair.cheapest(codes, costs, segment) == (cost, audit)


def test_segments_do_not_matter():
    rng = random.Random(6)
    codes = random_codes(rng, 700)
    assert len({convrepair.cheapest(codes, segment=s) for s in (7, 64, 5000)}) == 1


def test_long_conversation_over_many_segments(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), f"Row {i % 900}" + rng.choice([".", ""])) for i in range(1000)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    cut = convrepair.find_repairs(turns, segment=64).collect()
    ordered, faults = plain_faults(rows)
    codes = [(r[2][0] if r[2][0] in "sua" else "x") + (f[:1] or "-") for r, f in zip(ordered, faults, strict=True)]
    assert [(r["cost"], r["audit"]) for r in cut] == [convrepair.cheapest(codes)]
    repairs, repaired = convrepair.repair(turns, segment=64)
    left = repaired.collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in left))
    kept = [o for o, e in zip(ordered, cut[0]["audit"], strict=True) if e != "D"]
    assert [r["text"] for r in left] == [o[3] for o in kept]


def test_inserted_turns_are_written(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Rules."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Eh?")], "conv long, turn long, role string, text string")
    repairs, repaired = convrepair.repair(turns, Costs(insert=1))
    assert {r["conv"]: r["audit"] for r in repairs.collect()} == {1: "KIK", 2: "KI"}
    rows = {}
    for r in repaired.collect():
        rows.setdefault(r["conv"], []).append((r["edit"], r["role"], r["text"]))
    assert rows == {1: [("K", "system", "Rules."), ("I", "user", ""), ("K", "assistant", "Yes.")], 2: [("K", "user", "Eh?"), ("I", "assistant", "")]}


def test_costs_are_checked():
    with pytest.raises(ValueError):
        Costs(insert=0)
