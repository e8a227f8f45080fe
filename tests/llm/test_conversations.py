"""Repair of conversations against every script, and against a plain one row at a time."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.llm import conversations as C
from residuum.llm import repair_paths as R

from .conftest import clashing

FINAL = re.compile(r"(s?(ua)+)?")


def every_script(rows):
    """The least of the cheapest scripts, by trying all with few inserts."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            for roles in itertools.product("ua", repeat=edits.count("R") + sum(inserts)):
                pick, out, cost, audit = iter(roles), "", 0, ""
                for gap, row in zip(inserts, [*zip(edits, rows), None]):
                    out += "".join(next(pick) for _ in range(gap))
                    cost, audit = cost + 5 * gap, audit + "I" * gap
                    if row is None:
                        break
                    edit, (kind, fault) = row
                    audit += edit
                    if edit == "D":
                        cost += 2
                        continue
                    out += "sua?"[kind] if edit == "K" else next(pick)
                    cost += (edit == "R") + 5 * (fault == R.TRUNCATED) + 10**6 * (fault in (R.BLANK, R.DUPLICATE))
                if FINAL.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def plain(rows):
    """Cheapest costs and least script by state, one row after another."""
    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                r, v = int(R.NEXT[q]), (c + 5, a + "I")
                best[r] = min(best.get(r, v), v)
        return best

    best = inserted({0: (0, "")})
    for kind, fault in rows:
        new = {}
        for q, (c, a) in best.items():
            ways = [(q, 2, "D")]
            if fault not in (R.BLANK, R.DUPLICATE):
                cut = 5 * (fault == R.TRUNCATED)
                ways += [(int(R.NEXT[q]), 1 + cut, "R"), (int(R.KEPT[q][kind]), cut, "K")]
            for to, cost, edit in ways:
                if to >= 0:
                    new[to] = min(new.get(to, (R.NEVER, "")), (c + cost, a + edit))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def solve(seqs, at_end=None):
    codes = np.array([R.code(k, f) for s in seqs for k, f in s], np.int64)
    n = len(seqs)
    return R.least_paths(codes, np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), np.tile(R.AT_END, (n, 1)), np.ones(n, bool), np.ones((n, 4), bool))


def random_rows(rng, n):
    return [(rng.choice([0, 1, 1, 2, 2, 3]), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_least_cheapest_of_all_scripts():
    rng = random.Random(1)
    seqs = [random_rows(rng, n) for n in (1, 2, 3) for _ in range(12)]
    got = solve(seqs)
    for i, s in enumerate(seqs):
        assert (got.costs[i, 0], got.scripts[i][0]) == every_script(s) == plain(s)


def test_long_sequences_and_ties():
    rng = random.Random(2)
    seqs = [random_rows(rng, rng.choice([1, 5, 33, 300])) for _ in range(200)] + [[(2, 0)] * 40, [(1, 0)] * 41, [(0, 0)] * 9, [(3, 3)] * 17]
    got = solve(seqs)
    for i, s in enumerate(seqs):
        assert (got.costs[i, 0], got.scripts[i][0]) == plain(s)


def expected(rows):
    """The contract on (conv, turn, role, text) rows without ties of turns."""
    blank = lambda v: " " if v is None else v
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = blank(role), blank(text)
            d = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        seen, codes = set(), []
        for _, role, text in kept:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = R.BLANK if not solid else R.DUPLICATE if (role, text) in seen else R.NO_FAULT if solid[-1] in ".!?" else R.TRUNCATED
            seen.add((role, text))
            codes.append(((R.KINDS + role[:1]).index(role[:1]) if role else 3, fault))
        cost, audit = plain(codes)
        done, state, at = [], 0, 0
        for edit in audit:
            if edit in "IR":
                state = int(R.NEXT[state])
            elif edit == "K":
                state = int(R.KEPT[state][codes[at][0]])
            name = "assistant" if state == R.ASSISTANT else "user"
            if edit == "I":
                done.append(f"{name}:")
                continue
            if edit != "D":
                done.append(f"{kept[at][1] if edit == 'K' else name}:{kept[at][2]}")
            at += 1
        turns = [t for t, _, _ in kept if t is not None]
        faults = [f for _, f in codes]
        illegal = sum((a[0], b[0]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(R.BLANK), faults.count(R.DUPLICATE), faults.count(R.TRUNCATED),
                     illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def report(rows, work):
    got = C.repair_report(rows, C.damage(rows), work).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversations(rng, n, most):
    texts = ["Yes.", "no", "Why? Because!", " \t\n", "", "Wait\n", "End.\r\n", None, "a:b.", "é…", "日本。", "Hm.  "]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "usher"]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in sorted(rng.sample(range(2 * most), rng.randrange(1, most)))]


def test_report(spark, work):
    rng = random.Random(3)
    rows = conversations(rng, 120, 14) + [(None, t, "user", "Hi.") for t in range(6)] + [(500 + c, None, "user", "Only.") for c in range(30)] + [(900, -3, "system", "x" * 200_000 + "."), (900, 2**40, "user", "y" * 300_000)]
    assert report(clashing(frame(spark, rows)), work) == expected(rows)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_cut_conversations(spark, work, monkeypatch, size):
    monkeypatch.setattr(C, "SEGMENT", size)
    rng = random.Random(4)
    rows = conversations(rng, 4, 90) + [(7, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(300)] + [(8, t, "user", "Same.") for t in range(120)]
    assert report(frame(spark, rows), work) == expected(rows)


def test_sql(tmp_path):
    import duckdb
    import pyarrow as pa

    from residuum.llm.conversations_sql import ORACLE_SQL

    rows = conversations(random.Random(6), 80, 20) + [(None, t, "user", "Hi.") for t in range(6)]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", table)
    got = con.sql(ORACLE_SQL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: r[1:] for r in got.fetchall()} == expected(rows)


def test_whole_table(spark, work):
    t = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert report(t, work) == expected([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


def test_ties_repeats_and_empty(spark, work):
    assert C.repair_report(frame(spark, [(1, 1, "user", "a.")]).filter("turn = 2"), C.damage(frame(spark, [(1, 1, "user", "a.")]).filter("turn = 2")), work).count() == 0
    same = spark.createDataFrame([(3, 5, "user", "Hi.")] * 500 + [(3, 5, "assistant", "Ho.")], "conv_id long, turn long, role string, text string").repartition(4)
    row = C.Repair(same, work).conversations.first()
    assert (row.duplicate, row.gaps, row.illegal, row.cost) == (499, 0, 499, 2 * 499 + 2) and row.audit == "R" + "K" + "D" * 499 or row.cost < 2 * 500 + 3
    dropped = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = report(frame(spark, [(dropped, 0, "user", "Gone.")]), work)
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark, work):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 3, "assistant", "cut"), (2, 0, "user", "Q.")]
    done = C.Repair(frame(spark, rows), work)
    got = sorted(tuple(r) for r in done.rows().select("conv_id", F.coalesce("position", F.lit(-1)), "edit", "role", "text").collect())
    texts = {c: "\n".join(f"{r[3]}:{r[4]}" for r in got if r[0] == c and r[1] >= 0) for c in (1, 2)}
    assert {r.conv: r.sha256 for r in done.digests().collect()} == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in texts.items()}
    assert [r.audit for r in done.conversations.orderBy("conv").collect()] == [plain([(0, 0), (2, 0), (1, 0), (2, 3)])[1], plain([(1, 0)])[1]]
