"""Exact search for the largest inner products: a KD-tree per shard, searched best first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import importable, staged

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 256, 512
TREE = "dim int, sid long, n int, ids binary, vectors binary, low binary, high binary, child binary"
FOUND = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, vec_id: str, embedding: str, factor: int) -> DataFrame:
    """(id, v): floor(factor * x) of every component; rows with a null id, a null vector or a null
    or non-finite component are left out."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(e, lambda x: F.floor(x.cast("double") * factor)).alias("v"))


def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's tree: points in leaf order, and for each node, from the root on, the box around its
    points and either its left child (the right one follows) or, as -1 - i, its leaf i."""
    rows = rows.sort_values("id")
    points = np.array(rows["v"].to_list(), np.int64).reshape(len(rows), -1)
    order, child, low, high, leaves = [], [0], [None], [None], 0
    todo = [(0, np.arange(len(points)))]
    for node, own in todo:
        box = points[own]
        low[node], high[node] = box.min(axis=0, initial=1 << 62), box.max(axis=0, initial=-(1 << 62))
        if len(own) <= LEAF_ROWS:
            child[node] = -1 - leaves
            leaves += 1
            order.append(own)
            continue
        axis = int((high[node].astype(float) - low[node]).argmax()) if points.shape[1] else 0
        by = own[np.argsort(box[:, axis], kind="stable")] if points.shape[1] else own
        child[node] = len(child)
        for part in (by[:len(by) // 2], by[len(by) // 2:]):      # halves by rank: equal points split too
            child.append(0)
            low.append(None)
            high.append(None)
            todo.append((len(child) - 1, part))
    at = np.concatenate(order)
    sizes = np.array([len(o) for o in order], np.int64)
    pack = lambda a: np.ascontiguousarray(a, np.int64).tobytes()
    return pd.DataFrame([{"dim": key[0], "sid": key[1], "n": len(rows), "ids": pack(rows["id"].to_numpy()[at]),
                          "vectors": pack(points[at]), "low": pack(low), "high": pack(high),
                          "child": pack(np.concatenate([[len(sizes)], sizes, child]))}])


def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    return pd.DataFrame([{"dim": key[0], "bid": key[1], "qids": rows["id"].to_numpy(np.int64).tobytes(),
                          "qs": np.array(rows["v"].to_list(), np.int64).tobytes()}])


def search(tree: dict, block: dict, k: int) -> Iterator[tuple[int, list]]:
    """(query, its best (score, -id) in the shard): nodes are opened in the order of the largest
    score that their box allows, until that is below the k-th best score known: the shard's, or
    the one that came with the query from a shard searched before. Products are exact: in
    doubles while no sum can pass 2^53, else in whole numbers of any size."""
    dim = block["dim"]
    load = lambda name: np.frombuffer(tree[name], np.int64)
    ids, head = load("ids"), load("child")
    n_nodes = len(head) - 1 - head[0]                  # rows are counted: vectors may have no components
    v, low, high = load("vectors").reshape(len(ids), dim), load("low").reshape(n_nodes, dim), load("high").reshape(n_nodes, dim)
    starts = np.concatenate([[0], np.cumsum(head[1:1 + head[0]])])
    child = head[1 + head[0]:]
    q_ids, q = np.frombuffer(block["qids"], np.int64), np.frombuffer(block["qs"], np.int64)
    q = q.reshape(len(q_ids), dim)
    known = np.frombuffer(block["kth"], np.float64) if block.get("kth") is not None else np.full(len(q_ids), -np.inf)
    largest = lambda a: float(np.abs(a.astype(float)).max(initial=0))
    kind = np.float64 if largest(v) * largest(q) * dim < 2 ** 52 else object
    v, q, low, high = (x.astype(kind) for x in (v, q, low, high))
    zero = kind(0) if kind is np.float64 else 0
    bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    for i, q_id in enumerate(q_ids.tolist()):
        best: list = []
        least = known[i]
        heap = [(-bound[i, 0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            if child[node] >= 0:
                for c in (int(child[node]), int(child[node]) + 1):
                    if bound[i, c] >= least:
                        heapq.heappush(heap, (-bound[i, c], c))
                continue
            a, b = starts[-1 - child[node]], starts[-child[node]]
            scores = v[a:b] @ q[i]
            for j in np.flatnonzero(scores >= least).tolist():
                item = (scores[j], -int(ids[a + j]))
                if -item[1] == q_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, best[0][0])
        yield q_id, best


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding",
          factor: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products
    with each row of ``queries`` (whole numbers, see ``scaled``), ties to the smaller vec_id; fewer if
    there are fewer. A row never finds its own vec_id, and only vectors of its own length
    (empty ones score 0 with each other). A repeated row counts once. An empty table on either side gives no rows.

    Rows are dealt by hash into shards of about SHARD_ROWS, queries into blocks of QUERY_ROWS.
    A block is first searched in one shard, and takes the k-th score found there along to all
    others. A task holds one tree and one block; a shard returns at most k rows for a query.
    """
    importable(vectors.sparkSession)
    rows = staged(scaled(vectors, vec_id, embedding, factor).distinct(), "vectors")
    asked = staged(scaled(queries, vec_id, embedding, factor).distinct(), "queries")
    n_shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    n_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).alias("sid"))
    trees = staged(dealt.groupBy("dim", "sid").applyInPandas(build, TREE), "trees")
    blocks = staged(asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).alias("bid"))
                    .groupBy("dim", "bid").applyInPandas(block, "dim int, bid long, qids binary, qs binary"), "query-blocks")
    home = F.pmod(F.col("bid"), F.lit(n_shards))

    def searched(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    flat = [(q, -i, int(s)) for q, best in search(row, row, k) for s, i in best]
                    columns = list(zip(*flat, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        return pairs.join(trees, ["dim", "sid"]).mapInArrow(run, FOUND)

    first = staged(searched(blocks.withColumn("sid", home)), "first-shard")
    kth = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k)

    def with_kth(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame([{"bid": key[1], "dim": key[0], "kth": rows["s"].fillna(-np.inf).to_numpy(np.float64).tobytes()}])

    bounds = (asked.select("id", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).alias("bid"))
              .join(kth.select(F.col("query_id").alias("id"), F.col("s").cast("double").alias("s")), "id", "left")
              .groupBy("dim", "bid").applyInPandas(with_kth, "bid long, dim int, kth binary"))
    shards = F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))
    others = blocks.join(bounds, ["dim", "bid"]).withColumn("home", home).withColumn("sid", F.explode(shards)).where("sid <> home")
    rest = searched(others.drop("home"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
