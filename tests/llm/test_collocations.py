"""Collocations against plain counting, and summaries against their bound."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cohortlens.llm import collocations as C
from cohortlens.llm import queries


def plainly(rows, top, threshold):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i:i + n])] += 1
    best = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= threshold:
            best[lang, p] = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, a, f[lang, p[:k]], f[lang, p[k:]])
                                for k in range(1, len(p)))
    inner = {}
    for (lang, p), b in best.items():
        for q in (p[:2], p[1:]) if len(p) == 3 else ():
            inner[lang, q] = max(inner.get((lang, q), 0), b[2])
    kept = [(k, b) for k, b in best.items() if not 100 * inner.get(k, 0) >= 50 * b[2]]
    out = []
    for lang in {k[0] for k, _ in kept}:
        own = sorted(((-b[0], -b[2], " ".join(k[1]).encode(), b) for k, b in kept if k[0] == lang))
        out += [(lang, i + 1, x[2].decode(), x[3][2], x[3][3], x[3][4], total[lang], x[3][0]) for i, x in enumerate(own[:top])]
    return sorted(out)


def made(seed, n):
    gen = np.random.default_rng(seed)
    vocabulary = ["the", "of", "The", "caf\u00e9", "\u00c9t\u00e9", "a\u00a0b", "x-y", "zz", "q", "\U0001f600"] + [f"w{i}" for i in range(30)]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for _ in range(n):
        words = gen.choice(vocabulary, gen.integers(0, 60), p=p / p.sum())
        gaps = gen.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b"], len(words))
        rows.append(("".join(w + g for w, g in zip(words, gaps)), str(gen.choice(["en", "fr", "d\u00e9"]))))
    return rows + [(None, "en"), ("", None), (" \t", "en"), ("new york city. " * 40 + "one two " * 12, None), ("Only here", "xx")]


@pytest.mark.parametrize("part_bytes", [1 << 24, 200])
def test_mined_phrases_match_plain_counts(spark, part_bytes):
    rows = made(4, 250)
    df = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, f int, phrase string")
    found = C.mine(df, top=60, part_bytes=part_bytes)
    assert sorted(tuple(r) for r in found.collect()) == plainly(rows, 60, C.THRESHOLD)
    assert C.mine(df.where("1 = 0")).count() == 0


def test_summaries_keep_what_is_frequent():
    gen = np.random.default_rng(1)
    for _ in range(20):
        items = np.concatenate([gen.integers(0, 1 << 30, 3000), np.repeat(gen.integers(0, 1 << 30, 20), gen.integers(5, 40, 20))]).astype(np.uint64)
        gen.shuffle(items)
        summary = C.Summary(len(items) // 10 + 1)
        for block in np.array_split(items, 17):
            summary.add([C.unpacked(C.packed(*C.counted(block)))])
        assert summary.error < 10 and len(summary.entries) <= summary.capacity
        left = dict(zip((summary.entries >> np.uint64(C.COUNT_BITS)).tolist(), summary.counts().tolist()))
        for h, n in zip(*(x.tolist() for x in C.counted(items))):
            assert n - summary.error <= left.get(h, 0) <= n


def test_a_summary_does_not_hold_its_entries_many_times():
    import tracemalloc
    gen = np.random.default_rng(2)
    summary, n = C.Summary(1 << 19), 1 << 19
    one = lambda: np.sort(gen.integers(0, 1 << 36, n).astype(np.uint64)) << np.uint64(C.COUNT_BITS) | np.uint64(1)
    summary.add([one()])
    tracemalloc.start()
    blocks = [one()]
    tracemalloc.reset_peak()
    summary.add(blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * n                              # of 2 n entries that were merged


def test_a_summary_that_is_too_small_still_keeps_what_is_frequent():
    """Its capacity is an estimate; what the estimate is must not matter to phrases at the threshold."""
    gen = np.random.default_rng(3)
    items = np.concatenate([gen.integers(0, 1 << 30, 20000), np.repeat(gen.integers(0, 1 << 30, 50), 10)]).astype(np.uint64)
    gen.shuffle(items)
    summary = C.Summary(3, most=9)
    for block in np.array_split(items, 40):
        summary.add([C.unpacked(C.packed(*C.counted(block)))])
    left = dict(zip((summary.entries >> np.uint64(C.COUNT_BITS)).tolist(), summary.counts().tolist()))
    assert summary.error <= 9 and all(left[h] + summary.error >= 10 for h, n in zip(*(x.tolist() for x in C.counted(items))) if n >= 10)


def test_counts_of_phrases_are_moved_once_and_narrow(spark, monkeypatch):
    names, kept = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: names.append(name) or kept(df, name))
    assert C.mine(spark.createDataFrame(made(5, 20), "text string, lang string")).count() > 0
    assert names == ["phrases"]
    low = np.unique(np.random.default_rng(6).integers(0, 1 << C.LOW_BITS, C.TASK_PHRASES // 64).astype(np.uint64))
    assert len(C.packed(low, np.ones(len(low), np.int64))) < 3.2 * len(low)          # a block's share of one of 64 partitions


def test_scores_pass_64_bits(spark):
    a = 10 ** 13 + 7
    row = spark.createDataFrame([(a, a + 5, a + 11)], "a long, l long, r long").select(C.score("a", "l", "r")).first()
    assert row[0] == 10 ** 6 * a * a // ((a + 5) * (a + 11))


def test_whole_query_matches_its_sql(spark):
    path = "/root/testdata/sf0.01"
    found = queries.QUERIES["op11_collocations"](spark, path)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'" if __import__("os").path.isdir(
        f"{path}/documents.parquet") else f"CREATE OR REPLACE VIEW documents AS FROM '{path}/documents.parquet'")
    names = sorted(found.columns)
    rows = sorted(tuple(r[c] for c in names) for r in found.collect())
    assert len(rows) > 100
    assert sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op11_collocations']})").fetchall()) == rows
