"""The n-gram join against all pairs: prefixes, k-token keys, groups of near copies."""

import os
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

from cohortlens.llm import common as C
from cohortlens.llm import ngram_join as J
from cohortlens.llm import queries


def plain_sets(texts, n=4):
    out = []
    for t in texts:
        w = re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(({tuple(w)} if w else set()) if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)})
    return out


def plain_components(ids, sets, percent=85):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def corpus(seed):
    gen = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["caf\u00e9", "\u00c9a", "a\u00a0b"]
    prose = lambda n: list(gen.choice(vocabulary, n))
    texts = []
    for size, copies, most in ((60, 40, 6), (200, 40, 9), (500, 30, 30), (12, 20, 2), (80, 30, 4)):
        base = prose(size)
        for _ in range(copies):
            own = list(base)
            for at in gen.integers(0, size, gen.integers(0, most)):
                own[at] = str(gen.choice(vocabulary))
            texts.append(" ".join(own))
    passage = prose(90)                                    # one that many documents share, with little of their own
    texts += [" ".join(passage + prose(int(gen.integers(0, 40)))) for _ in range(60)]
    texts += [" ".join(prose(int(gen.integers(1, 80)))) for _ in range(60)]
    texts += [None, "", " \t", "One two", "one  TWO\n", "one two three four", texts[0], texts[0].upper(), "\u00c9a b", "\u00e9a b", " ".join(prose(9000))]
    return texts


@pytest.mark.parametrize("seed, classes", [(1, (64, 4096)), (2, (4, 12)), (4, (0, 0))])
def test_no_link_is_lost(spark, monkeypatch, seed, classes):
    monkeypatch.setattr(J, "CLASS_FROM", classes)          # low bounds: most tokens are taken by two or three
    texts = corpus(seed)
    gen = np.random.default_rng(seed)
    ids = gen.permutation(len(texts)).tolist()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)] + [(None, texts[0], 1, 2), (ids[3], texts[3], 1, 2)],
                               "doc_id long, text string, n int, key int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(df).collect()}
    assert got == plain_components(ids, plain_sets(texts))


def test_similar_sets_share_a_key():
    gen = np.random.default_rng(5)
    for _ in range(300):
        n = int(gen.integers(1, 900))
        universe = gen.integers(0, 1 << 63, 3000).astype(np.uint64)
        kind = gen.integers(1, 4, 3000).astype(np.int8) if gen.random() < 0.7 else np.full(3000, gen.integers(1, 4), np.int8)
        by = np.lexsort((universe, kind))
        universe, kind = universe[by], kind[by]
        x = set(gen.choice(3000, n, replace=False).tolist())
        y = set(x)
        for at in gen.permutation(sorted(x))[:int(gen.integers(0, 1 + n // 12))]:
            y.discard(int(at))
            if gen.random() < 0.5:
                y.add(int(gen.integers(0, 3000)))
        if not y or 100 * len(x & y) < 85 * len(x | y):
            continue
        keys = [J.signatures(universe[sorted(s)], kind[sorted(s)], 85) for s in (x, y)]
        small = 0 if len(x) <= len(y) else 1
        light, heavy = keys[small], keys[1 - small]
        assert set(light[0][:light[1]].tolist()) & set(heavy[0].tolist())
        assert all(len(k) < 4 * len(s) + 4 for (k, _), s in zip(keys, (x, y)))


def test_empty_table_and_whole_query(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    path = "/root/testdata/sf0.01"
    found = queries.QUERIES["op13_ngram_join"](spark, path)
    files = f"{path}/documents.parquet" + ("/*.parquet" if os.path.isdir(f"{path}/documents.parquet") else "")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{files}'")
    names = sorted(found.columns)
    assert sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op13_ngram_join']})").fetchall()) == \
        sorted(tuple(r[c] for c in names) for r in found.collect())


def test_bitmaps_tell_large_sets_apart():
    """Two sets of 3000 hashes with most in common differ in no more bits than hashes; nor are the bits full."""
    gen = np.random.default_rng(3)
    both = gen.integers(0, 1 << 63, 2600).astype(np.uint64)
    own = gen.integers(0, 1 << 63, (2, 400)).astype(np.uint64)
    h = np.concatenate([both, own[0], both, own[1], both])
    maps = C.parities(h, np.repeat([0, 1, 3], [3000, 3000, 2600]), 4, J.BITS)
    differ = lambda i, j: int(np.bitwise_count((maps[i] ^ maps[j]).view(np.uint64)).sum())
    assert maps.shape == (4, J.BITS) and not maps[2].any()
    assert 300 < differ(0, 1) <= 800 and 0 < differ(0, 3) <= 400 and differ(1, 1) == 0


def test_unlike_members_of_a_bucket_are_no_pairs(spark, monkeypatch):
    """Texts with a shared passage, of a similarity of about 0.77, all meet in keys; the join of keys leaves few pairs of them."""
    gen = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{i}" for i in gen.integers(0, 100_000, n))
    passage = prose(260)
    rows = [(i, f"{passage} {prose(38)}") for i in range(40)]
    monkeypatch.setattr(J, "CLASS_FROM", (0, 1000))        # what all have is taken by two, and their prefixes reach into it
    met, plain = [], J.possible
    monkeypatch.setattr(J, "possible", lambda pairs, *a: (met.append(pairs.count()), plain(pairs, *a))[1])
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == set(range(40))
    assert met[0] <= 40 and met[1] <= 200                  # of 780
