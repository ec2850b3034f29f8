"""Conversation repair against a plain least-cost search, also where one conversation holds a third of all rows."""

import hashlib
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversations as C
from cohortlens.llm import queries

SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plainly(rows):
    """(counts, cost, audit, digest) of one conversation's (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("b" if not text.strip(SPACE) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    keeps = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            c, a = best(i, after[state], inserted + 1)
            found.append((c + 2, "I" + a))
        if i < len(rows):
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if faults[i] in ("", "t"):
                initial, late = rows[i][1][:1], faults[i] == "t"
                if (state, initial) in keeps:
                    c, a = best(i + 1, initial, 0)
                    found.append((c + late, "K" + a))
                c, a = best(i + 1, after[state], 0)
                found.append((c + 2 + late, "R" + a))
        return min(found, default=(10 ** 9, ""))

    for i in range(len(rows), 0, -1):                       # from the end, so that the recursion stays flat
        [best(i, state, 0) for state in ("", "s", "u", "a")]
    cost, audit = best(0, "", 0)
    state, i, lines = "", 0, []
    for e in audit:
        if e == "D":
            i += 1
            continue
        state = rows[i][1][:1] if e == "K" else after[state]
        lines.append(f"{rows[i][1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{'' if e == 'I' else rows[i][2]}")
        i += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in damaged([r for r in rows if r[0] == key])]
        # one turn's rows: by role, and the texts here differ in their first characters
        out[key] = plainly(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    return out


def made(seed, n, share=0.0):
    gen = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot = gen.random() < share
        c = 7 if hot else None if gen.random() < 0.01 else int(gen.integers(0, n // 5)) + 100
        role = gen.choice(["user", "assistant", "system", "tool", "u2", "", "Assistant"], p=[.4, .38, .1, .04, .03, .02, .03])
        text = gen.choice(["Yes.", "No", "Why? ", " ", "", "\n\t", "A b c!\u00a0", "long. " * 30, "é?", f"n{i}."])
        rows.append((c, None if gen.random() < 0.03 else int(gen.integers(0, 400 if hot else 12)),
                     None if gen.random() < 0.02 else str(role), None if gen.random() < 0.02 else str(text)))
    return rows


def check(found, rows):
    want = expected(rows)
    got = {r["conv_id"]: r.asDict() for r in found.collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert {k: got[key][k] for k in w} == w, key


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_repairs_are_the_cheapest_and_least(spark, share):
    rows = made(1, 900, share)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "ck": F.lit("x")})
    check(C.repair(C.faulty(df), block_rows=16), rows)


def test_turns_and_empty_tables(spark):
    rows = made(2, 120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in C.repair(C.faulty(df), turns=True, block_rows=4).collect():
        left = r["turns"] or []
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in left).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(t["edit"] for t in left) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in left))
    assert C.repair(C.faulty(df.where("1 = 0"))).count() == 0


def test_all_rows_dropped_and_whole_query(spark, tmp_path):
    gone = [(c, 0, "user", "x") for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    check(C.repair(C.faulty(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))), gone)
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op12_conversation_repair"](spark, path)
    check(found, rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{path}/conversations.parquet'")
    names = sorted(found.columns)
    assert sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op12_conversation_repair']})").fetchall()) == \
        sorted(tuple(r[c] for c in names) for r in found.collect())
