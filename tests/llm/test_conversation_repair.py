"""Conversation repair against a plain search over all edits."""
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import conversation_repair as repair
from tagflow.llm.queries import op11_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
NONBLANK = re.compile(r"[^\x20\x09-\x0D]")


def fault_of(rows):
    """(fault, initial) of each (role, text) by the rules' own words."""
    out, seen = [], set()
    for role, text in rows:
        marks = NONBLANK.findall(text)
        if not marks:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if marks[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((fault, role[:1] if role[:1] in ("s", "u", "a") else ""))
    return out


def search(rows):
    """(cost, audit, repaired lines): the least of all edit sequences, found one by one."""
    faults, best = fault_of(rows), [None]

    def on(i, cost, audit, initials, lines):
        bound = best[0][0] if best[0] else 4 * len(rows)
        if cost > bound:
            return
        if i == len(rows):
            if GRAMMAR.fullmatch(initials) and (best[0] is None or (cost, audit) < best[0][:2]):
                best[0] = (cost, audit, lines)
        if cost + 3 <= bound and len(initials) < 3 * len(rows) + 4:
            for role in ("user", "assistant"):
                on(i, cost + 3, audit + "I", initials + role[0], lines + [f"{role}:"])
        if i < len(rows):
            (fault, initial), (role, text) = faults[i], rows[i]
            on(i + 1, cost + 4, audit + "D", initials, lines)
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                on(i + 1, cost + late, audit + "K", initials + (initial or "?"), lines + [f"{role}:{text}"])
                for to in ("user", "assistant"):
                    on(i + 1, cost + 3 + late, audit + "R", initials + to[0], lines + [f"{to}:{text}"])

    on(0, 0, "", "", [])
    return best[0]


def conversations(n, longest, seed=3):
    """Random conversations with every fault."""
    draw = random.Random(seed)
    role = lambda: draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "unused"])
    text = lambda: draw.choice(["one.", "two!", "three", "", " \t", "four?", f"{draw.random()}.", "one."])
    return [[(role(), text()) for _ in range(draw.randint(1, longest))] for _ in range(n)]


def test_cheapest_edits_are_those_of_the_search(spark):
    cases = conversations(40, 5)
    rows = spark.createDataFrame([(c, t, *row) for c, rows in enumerate(cases) for t, row in enumerate(rows)], "conv_id long, turn long, role string, text string")
    for least in (4096, 1, 2):
        found = repair.digests(repair.edit_rows(rows, least=least))
        got = {r["_conv"]: (r.cost, r.audit, r.repaired_sha256) for r in found.collect()}
        for c, case in enumerate(cases):
            cost, audit, lines = search(case)
            assert got[c] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), case


def test_blocks_and_checkpoints_dont_change_the_walk():
    draw = np.random.default_rng(5)
    for n in (1, 7, 64, 301):
        codes = "".join(chr(65 + c) for c in draw.integers(0, 16, n))
        whole = repair.walk([codes], np.array([repair.FINISH]), np.array([True]))[1][0][repair.START]
        for size in (1, 5, 50):
            parts = [codes[i:i + size] for i in range(0, n, size)]
            rest = repair.behind(repair.passages(parts))
            last = np.arange(len(parts)) == len(parts) - 1
            exits, edits = repair.walk(parts, rest, last)
            state, out = repair.START, ""
            for k in range(len(parts)):
                out, state = out + edits[k][state], exits[k, state]
            assert out == whole


def test_cost_is_the_least_of_a_plain_table():
    draw = random.Random(9)
    for _ in range(30):
        codes = "".join(chr(65 + draw.randrange(16)) for _ in range(draw.randint(1, 40)))
        cost = repair.FINISH.copy()
        for c in reversed(codes):
            cost = (repair.PASS[ord(c) - 65] + cost).min(axis=1)
        edits = repair.walk([codes], np.array([repair.FINISH]), np.array([True]))[1][0][0]
        paid, rows = 0, iter(codes)
        for e in edits:
            c = ord(next(rows)) - 65 if e != "I" else None
            paid += {"K": 0, "R": 3, "D": 4, "I": 3}[e] + (3 if c is not None and 4 <= c < 8 and e != "D" else 0)
        assert paid == cost[0]


def test_one_long_conversation_among_short_ones(spark):
    draw = random.Random(4)
    rows = [(0, t, draw.choice(["user", "assistant"]), f"{t}.") for t in range(3000)] + [(c, t, r, "x.") for c in range(1, 60) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    one = {r["_conv"]: r for r in repair.digests(repair.edit_rows(df)).collect()}
    cut = {r["_conv"]: r for r in repair.digests(repair.edit_rows(df, least=16)).collect()}
    assert one == cut and one[5].audit == "KK" and one[5].cost == 0
    assert len(one[0].audit.replace("I", "")) == 3000


def test_repaired_rows_read_well(spark):
    df = spark.createDataFrame([(1, 0, "system", "be."), (1, 1, "assistant", "a."), (1, 2, "user", "q?"), (1, 3, "user", "q?"), (1, 4, "assistant", "cut")],
                               "conv_id long, turn long, role string, text string")
    got = [(r.edit, r.fault, r.role, r.text) for r in repair.repair(df).orderBy("step").collect()]
    kept = [g for g in got if g[0] != "D"]
    assert GRAMMAR.fullmatch("".join(g[2][0] for g in kept)) and ("D", "duplicate", "user", "q?") in got


@pytest.fixture(scope="module")
def edge_rows():
    return [(1, None, None, None), (1, None, "user", "hi."), (1, 5, "user", "hi."), (1, 5, "user", "hi."), (None, 0, "user", "q?"), (None, 1, "assistant", "a."),
            (2, 0, "", ""), (3, 0, "user", "long " * 100_000 + "."), (4, 7, "user", "é😀"), (4, 8, "assistant", "é.\n")]


def test_edge_cases(spark, edge_rows):
    df = spark.createDataFrame([(*r, "k", 1, True) for r in edge_rows], "conv_id long, turn long, role string, text string, _rank string, step int, _none boolean")
    got = {r["_conv"] if not r["_none"] else None: r for r in repair.digests(repair.edit_rows(df)).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    for c in got:
        rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for i, t, r, x in edge_rows if i == c))
        cost, audit, lines = search([r[2:] for r in rows])
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert repair.repair(df.limit(0)).count() == 0


def test_query_on_damaged_rows(spark, tmp_path, edge_rows):
    draw = random.Random(2)
    rows = [(c, t, r, x) for c, case in enumerate(conversations(60, 4, seed=8)) for t, (r, x) in enumerate(case)]
    rows += [(c + 100 if c is not None else None, t, r, x) for c, t, r, x in edge_rows] + [(500, 3 * t, draw.choice(["user", "assistant"]), "t.") for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        own = []
        for i, t, r, x in rows:
            if i != c:
                continue
            r, x = r if r is not None else " ", x if x is not None else " "
            kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
            if kind:
                x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
                own += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        pairs = [z[1:] for z in own]
        cost, audit, lines = search(pairs) if pairs else (0, "", [])
        faults = fault_of(pairs)
        turns = [z[0] for z in own if z[0] is not None]
        assert got[c].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [got[c].blank, got[c].duplicate, got[c].truncated] == [sum(f == k for f, _ in faults) for k in ("blank", "duplicate", "truncated")]
        assert got[c].illegal == sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), own
