"""Candidate pairs of near_dedup: every pair that shares a rare shingle, not once for each of them."""

import numpy as np

from cohortlens.llm import near_dedup as N


def test_pairs_meet_once_a_run_and_none_is_lost(spark):
    gen = np.random.default_rng(7)
    base = np.arange(60)
    lists = [sorted({*base[gen.random(60) < 0.8].tolist(), *gen.integers(1000 * i, 1000 * i + 900, 6).tolist()}) for i in range(1, 25)]
    lists += [[5], [7, 5000000], [5000000, 6000000], []]
    rows = [(x, i, i, N.SHORT + N.APART, [own[at - k] if at >= k else None for k in range(1, N.EARLIER + 1)], 100.0, 0, 0, 0, 0, 0, 0, 0, 0)
            for i, own in enumerate(lists) for at, x in enumerate(own)]
    names = ["shingle", "rep", "c", "marks", "earlier", "weight", *[f"s{i}" for i in range(4)],
             *[f"f{i}" for i in range(N.FOLDED)]]
    kind = {"marks": "int", "earlier": "array<long>", "weight": "double"}
    rare = spark.createDataFrame(rows, ", ".join(f"{n} {kind.get(n, 'long')}" for n in names))
    found = [tuple(r) for r in N.meetings(rare, 0.8).collect()]
    shared = {(i, j): len({*a} & {*b}) for i, a in enumerate(lists) for j, b in enumerate(lists) if i < j and {*a} & {*b}}
    assert set(found) == set(shared)
    assert len(found) < 2 * len(shared) < sum(shared.values()) / 10


def test_only_texts_of_bucket_members_are_moved(spark, monkeypatch):
    """The others are told apart by a bitmap, before anything is moved."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "z") for i in range(300)] + [(900 + i, " ".join(f"c{j}" for j in range(29 + i)), "z") for i in range(3)]
    seen, kept = {}, N.staged

    def noted(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(N, "staged", noted)
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert got == {i: min(i, 900) for i, _, _ in rows}
    assert "getbit" in seen["bucket-texts"]
