"""Benchmark decontamination: BM25 retrieval of test items for every passage, then overlap checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import SHINGLE_WORDS, append_columns, importable, row_blocks, shingles, text_array, words

PASSAGE_WORDS, STRIDE = 128, 64
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75
THRESHOLD = 0.6                               # of the score that an item has against itself
OVERLAP = 0.8                                 # of the shingles of question and answer together
PART = 0.5                                    # of those of either
WORD = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")  # as in common.words
SHARD_BYTES = 16 << 20                        # of item text in one index

HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                          ("question", pa.float64()), ("answer", pa.float64())]))


class Index(NamedTuple):
    """Inverted index of a shard of items, in entries: ascending term hashes, postings by term in the
    order of entries, and for each term its largest impact in each block of entries."""

    item_id: np.ndarray
    item_of: np.ndarray                       # item of each entry: its text in runs of STRIDE words
    terms: np.ndarray
    seen: np.ndarray                          # whether a term has these low 16 bits
    top: np.ndarray                           # largest impact of each term
    start: np.ndarray                         # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    shingle: np.ndarray                       # ascending (hash) with the item and part it is of
    shingle_part: np.ndarray                  # item * 2 + part (0 question, 1 answer)
    part_size: np.ndarray
    grams: tuple[int, ...]                    # lengths of the shingles, in words


def build(item_id: np.ndarray, texts: pa.Array, df: dict[int, int], n_items: int, mean_words: float) -> Index:
    """Impacts are BM25 scores divided by the entry's score against itself, so that one
    threshold serves all entries and a passage scores between 0 and 1."""
    h, row = words(texts)
    # an entry is a run of at most STRIDE words of an item, so that some passage holds all of it
    run = (np.arange(len(row)) - np.searchsorted(row, row)) // STRIDE
    _, first, row = np.unique(row * (run.max(initial=0) + 1) + run, return_index=True, return_inverse=True)
    item_of = words(texts)[1][first]
    n_entries = len(item_of)
    pairs, tf = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_counts=True)
    item, term = pairs[0].astype(np.int64), pairs[1]
    n_words = np.bincount(row, minlength=n_entries)
    d = np.array([df[int(t)] for t in term.view(np.int64)], float)
    score = np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / \
        (tf + K1 * (1 - B + B * n_words[item] / mean_words))
    impact = score / np.maximum(np.bincount(item, score, n_entries), 1e-12)[item]
    terms, number = np.unique(term, return_inverse=True)
    by = np.lexsort((item, number))
    number, item, impact = number[by], item[by], impact[by]
    cell = number * (item.max(initial=0) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    top_of = (lambda x, at: np.maximum.reduceat(x, at) if len(at) else x)
    bounds = np.arange(len(terms) + 1)
    start = np.searchsorted(number, bounds)
    seen = np.zeros(1 << 16, bool)
    seen[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    parts = [p for t in texts.to_pylist() for p in halves(t)]
    h, part = words(pa.array(parts, pa.string()))
    # five words each; a part of fewer words is one shingle of its own length
    length = np.minimum(np.bincount(part, minlength=2 * len(texts)), SHINGLE_WORDS)
    grams = tuple(int(n) for n in np.unique(length[length > 0]))
    found = [shingles(h[own], part[own], n) for n in grams for own in [length[part] == n]]
    s, part = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (h, part)
    own = np.unique(np.stack([s, part.astype(np.uint64)]), axis=1) if len(s) else np.zeros((2, 0), np.uint64)
    return Index(item_id, item_of, terms, seen, top_of(impact, start[:-1]), start, item, impact,
                 np.searchsorted(number[first], bounds), item[first] // BLOCK_ITEMS, top_of(impact, first),
                 own[0], own[1].astype(np.int64), np.bincount(own[1].astype(np.int64), minlength=2 * len(texts)), grams)


def halves(text: str) -> tuple[str, str]:
    """An item's question and answer. The tables hold one text; its answer is what
    follows the last sentence end that leaves words on both sides, if those are five
    or more; else the last third of the words."""
    cut = max(text.rfind(e, 0, len(text.rstrip()) - 1) for e in (".", "?", "!", "\n")) + 1
    if cut and len(WORD.findall(text[cut:])) >= 5 and len(WORD.findall(text[:cut])) >= 5:
        return text[:cut], text[cut:]
    own = [m.start() for m in WORD.finditer(text)]
    if len(own) < 3:
        return text, ""
    at = own[len(own) - len(own) // 3]
    return text[:at], text[at:]


def expand(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the postings of each of ``which``, and whose they are."""
    size = start[which + 1] - start[which]
    owner = np.repeat(np.arange(len(which)), size)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return start[which][owner] + offset, owner


def search(x: Index, h: np.ndarray, row: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
    """(row, item) and the best score of a passage, of all passages that reach ``threshold``.

    Block-max WAND over a batch: a passage whose terms' largest impacts do not
    reach the threshold is passed over; of the others, each block of items whose
    own largest impacts do not reach it; only what is left is scored in full. Both
    bounds are never below a true score, so nothing is missed.
    """
    near = np.flatnonzero(x.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(near) or not len(x.terms):
        return {}
    at = np.minimum(np.searchsorted(x.terms, h[near]), len(x.terms) - 1)
    known = x.terms[at] == h[near]
    near, term = near[known], at[known]
    if not len(near):
        return {}
    first = np.searchsorted(row, row[near])                       # word position in its own text
    place = (near - first) // STRIDE
    # a word lies in the passage that begins at its stride and in those before that still cover it
    reach = PASSAGE_WORDS // STRIDE
    passage = np.concatenate([place - k for k in range(reach)])
    owner, terms_of = np.tile(row[near], reach), np.tile(term, reach)
    ok = passage >= 0
    n = np.int64(len(x.terms))
    base = np.int64(passage.max() + 1)
    key = np.unique(((owner * base + passage) * n + terms_of)[ok])
    window, term = key // n, key % n
    start = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    good = np.add.reduceat(x.top[term], start) >= threshold
    keep = np.repeat(good, np.diff(np.append(start, len(window))))
    window, term = window[keep], term[keep]
    found: dict[tuple[int, int], float] = {}
    if not len(window):
        return found
    n_blocks = np.int64(len(x.item_of) // BLOCK_ITEMS + 1)
    step = 1 << 16                                                # bounds memory; cut between passages
    cuts = [0]
    edges = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1], [True]]))
    while cuts[-1] < len(window):
        cuts.append(int(edges[max(np.searchsorted(edges, cuts[-1] + step, side="right") - 1,
                                  np.searchsorted(edges, cuts[-1]) + 1)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w, t = window[a:b], term[a:b]
        pos, own = expand(x.block_start, t)
        cell, inverse = np.unique(w[own] * n_blocks + x.block[pos], return_inverse=True)
        left = cell[np.bincount(inverse, x.block_top[pos], len(cell)) >= threshold]
        if not len(left):
            continue
        live = np.isin(w, left // n_blocks)
        w, t = w[live], t[live]
        pos, own = expand(x.start, t)
        mine = np.isin(w[own] * n_blocks + x.item[pos] // BLOCK_ITEMS, left)
        pos, own = pos[mine], own[mine]
        n_entries = np.int64(len(x.item_of))
        pair, inverse = np.unique(w[own] * n_entries + x.item[pos], return_inverse=True)
        total = np.bincount(inverse, x.impact[pos], len(pair))
        for p, s in zip(pair[total >= threshold].tolist(), total[total >= threshold].tolist(), strict=True):
            where = (p // int(n_entries) // int(base), int(x.item_of[p % int(n_entries)]))
            found[where] = max(found.get(where, 0.0), s)
    return found


def verify(x: Index, h: np.ndarray, row: np.ndarray, pairs: dict[tuple[int, int], float], least: float,
           part: float):
    """(row, item, score, question, answer): the shares of question and answer shingles in the
    text, of pairs in which ``least`` of the whole item and ``part`` of each of the two is there."""
    out = []
    for r in sorted({r for r, _ in pairs}):
        a, b = np.searchsorted(row, [r, r + 1])
        s = np.unique(np.concatenate([shingles(h[a:b], row[a:b], n)[0] for n in x.grams]))
        lo, hi = np.searchsorted(x.shingle, s), np.searchsorted(x.shingle, s, side="right")
        hit = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi, strict=True) if j > i] or [np.zeros(0, np.int64)])
        share = np.bincount(x.shingle_part[hit], minlength=len(x.part_size))
        for item in sorted(i for q, i in pairs if q == r):
            q, w = share[2 * item], share[2 * item + 1]
            nq, nw = x.part_size[2 * item], x.part_size[2 * item + 1]
            if nq + nw and q >= part * nq and w >= part * nw and q + w >= least * (nq + nw):
                out.append((r, item, pairs[r, item], q / max(nq, 1), w / max(nw, 1)))
    return out


def indexes(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> list[Index]:
    """Indexes of all items, each of at most about SHARD_BYTES of text, so that one broadcast is
    bounded however large the benchmark is. Null and empty items match nothing and are
    left out, as are null ids; equal texts under several ids are all kept. Document
    frequencies, counts and the mean length are those of all items."""
    importable(benchmark.sparkSession)
    items = benchmark.where(benchmark[item_id].isNotNull() & (F.length(benchmark[text]) > 0)).select(
        benchmark[item_id].cast("long").alias("item_id"), benchmark[text].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_shards = max(1, math.ceil(size / SHARD_BYTES))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row = words(batch.column("text"))
            shard = np.asarray(batch.column("shard"))
            own, n = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard[own[0].astype(np.int64)]),
                                              pa.array(own[1].view(np.int64)), pa.array(n)], names=["shard", "term", "n"])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    found = dealt.select("shard", "text").mapInArrow(terms, "shard long, term long, n long")
    stats = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    n_items = items.count()
    if not n_items or not stats:
        return []
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    out = []
    for k in range(n_shards):
        own = dealt.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        own_df = (found.where(F.col("shard") == k).select("term").distinct().join(df, "term").collect()
                  if n_shards > 1 else df.collect())
        if own:
            out.append(build(np.array([r["item_id"] for r in own], np.int64), pa.array([r["text"] for r in own]),
                             {r["term"]: r["df"] for r in own_df}, n_items, stats / n_items))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "hits",
            threshold: float = THRESHOLD, least: float = OVERLAP, part: float = PART) -> DataFrame:
    """``docs`` with ``column``: the test items that a text contains, as an array of
    (item_id, score, question, answer), by item.

    Every passage of PASSAGE_WORDS words (one begins every STRIDE words) is a query
    against the whole index. An item counts where the text has ``least`` of its shingles and ``part``
    of those of its question and of its answer each (an empty part is always there). A null or empty text has no hits; repeated rows have the
    same ones; an empty benchmark gives none. Other columns pass through, and one
    named ``column`` is replaced. Documents are not shuffled; one pass over them
    for each index shard.
    """
    if column != text:
        docs = docs.drop(column)
    parts = indexes(benchmark)
    spark = docs.sparkSession
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType())] + [
        T.StructField(n, T.DoubleType()) for n in ("score", "question", "answer")]))
    if not parts:
        return docs.withColumn(column, F.array().cast(kind))
    names = []
    for k, index in enumerate(parts):
        sent = spark.sparkContext.broadcast(index)

        def hits(batch: pa.RecordBatch, sent=sent) -> list[pa.Array]:
            x, texts, out = sent.value, text_array(batch.column(text)), []
            for a, b in row_blocks(texts):
                h, row = words(texts[a:b])
                own: list[list] = [[] for _ in range(b - a)]
                for r, i, s, q, w in verify(x, h, row, search(x, h, row, threshold), least, part):
                    own[r].append({"item_id": int(x.item_id[i]), "score": s, "question": float(q), "answer": float(w)})
                out += own
            return [pa.array(out, HIT)]

        names.append(column if len(parts) == 1 else f"{column}__{k}")
        docs = append_columns(docs, [T.StructField(names[-1], kind)], hits)
    if len(parts) > 1:
        docs = docs.withColumn(column, F.array_sort(F.flatten(F.array(*names)))).drop(*names)
    return docs
