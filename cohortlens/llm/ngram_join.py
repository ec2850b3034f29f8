"""Similarity join of documents by their sets of word n-grams, exact, and its connected components.

Tokens (n-gram hashes) have one global order, rare ones first. Two sets of a similarity of at least t have so
much in common that their prefixes in that order meet. Rare tokens are indexed one by one; of frequent
classes, k tokens of one sub-class together, with prefixes extended so far that k common tokens of some
sub-class are certain (see ``signatures``). What meets is bounded by sizes and bitmaps, and
verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.collocations import Words
from cohortlens.llm.common import give_back, importable, mix, parities, release, row_blocks, shingles, staged, text_array
from cohortlens.llm.graph import components

PERCENT = 85                                  # least similarity
WORDS = 4
DF_BITS = 20                                  # cells of the frequency sketch
CLASS_FROM = (64, 4096)                       # documents from which on tokens are taken by two, by three, above the cells' noise
SMALL = 64                                    # sets below this size are indexed by single tokens
MEET_BITS = 28                                # cells of the sketch of keys that more than one set has
BITS = 16                                     # longs of a set's bitmap
FOLDED = 4                                    # longs of the one that goes with its keys

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_sets(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row): the distinct n-grams of each text, by row and hash. A text of fewer words has one, of all of them."""
    words = Words(texts, _SPACE, _SPACE)
    h, row = shingles(words.hash, words.row, n_words)
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    return h[keep], row[keep]


class Order(NamedTuple):
    """For each cell of the sketch: documents (an upper bound for each token in it), and how many of its tokens are taken together."""

    count: np.ndarray
    together: np.ndarray


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64)


def frequencies(texts: DataFrame, n_words: int) -> Order:
    """Counts over all of ``texts`` in 2^DF_BITS cells, added up in blocks: 8 MB at any size of the corpus."""
    size, n_blocks = 1 << DF_BITS, 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = text_array(batch.column(0))
            for a, b in row_blocks(column):
                total += np.bincount(cell(token_sets(column[a:b], n_words)[0]), minlength=size)
        if total.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(n_blocks), pa.int32()),
                                              "counts": pa.array([p.tobytes() for p in total.astype(np.int32).reshape(n_blocks, -1)], pa.binary())})
        give_back()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // n_blocks, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_py(), np.int32)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, counts binary"
    total = np.zeros((n_blocks, size // n_blocks), np.int64)
    for r in texts.mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect():
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    # rare tokens that share a cell make up its usual count
    noise = np.median(total) + 6 * np.sqrt(np.median(total))
    return Order(total, (1 + (total > noise + CLASS_FROM[0]) + (total > noise + CLASS_FROM[1])).astype(np.int8))


def level(n: int) -> int:
    return 0 if n < SMALL else n.bit_length() - 1


def _errors(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's n tokens a similar one may lack: one of any size, and one that is no smaller."""
    return n + (-percent * n // 100), n + (-2 * percent * n // (100 + percent))


def signatures(h: np.ndarray, together: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(keys, n_short): what a set with tokens ``h`` in the global order is found by, the n_short keys first
    that suffice where the other set is no smaller.

    A prefix in which c tokens fall into a sub-class of k-token keys can lose c - k + 1 of them before
    the two sets have no k in common there. So it ends where these numbers add up to one more than the
    set may lack. Of two prefixes, what is common within the one that ends first lies in both, hence
    so does a common key. Sub-classes go by the token's hash and by the size's power of two (more
    sub-classes in larger sets, so that the combinations stay in proportion to the set); a set also has the
    keys of the next power if a similar set may be as large. At most n / 4 tokens are lost to
    sub-classes, so the prefix always exists; sets under SMALL tokens use single ones."""
    n = len(h)
    least = [e + 1 for e in _errors(n, percent)]
    single = int(np.searchsorted(together, 2))
    if single >= least[0]:
        return h[:least[0]], least[1]
    keys: list[list[np.ndarray]] = [[], []]                       # [beyond the short prefix, within it]
    for lv in sorted({level(n), level(100 * n // percent)}):
        if not lv:
            keys[1].append(h[:least[1]])
            keys[0].append(h[least[1]:least[0]])
            continue
        keys[1].append(h[:min(single, least[1])])
        keys[0].append(h[min(single, least[1]):single])
        covered, subs, marks = single, {}, []
        for i in range(single, n):
            k = int(together[i])
            own = subs.setdefault((k, int(h[i]) & ((1 << lv - k - 1) - 1)), [])
            own.append(i)
            covered += len(own) >= k
            if covered >= least[1] and not marks:
                marks.append(i)
            if covered >= least[0]:
                break
        end = -1 if single >= least[1] else marks[0]              # last token of the short prefix
        for (k, _), own in subs.items():
            if len(own) >= k:
                met = np.array(list(combinations(own, k)))
                key = np.full(len(met), (lv << 8) + k, np.uint64)
                tokens = np.sort(h[met], axis=1)
                for j in range(k):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + tokens[:, j])
                short = met[:, -1] <= end
                keys[1].append(key[short])
                keys[0].append(key[~short])
    short, more = np.unique(np.concatenate(keys[1])), np.unique(np.concatenate(keys[0]))
    return np.concatenate([short, np.setdiff1d(more, short, assume_unique=True)]), len(short)


SETS = "doc_id long, n int, c1 long, c2 long, n_short int, keys array<long>, bits array<long>"


def indexed(docs: DataFrame, order: Broadcast, n_words: int, percent: int) -> DataFrame:
    """SETS: size, 128-bit hash, keys and bitmap of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = order.value
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in row_blocks(texts):
                h, row = token_sets(texts[a:b], n_words)
                m = b - a
                n = np.bincount(row, minlength=m)
                hashed = np.zeros((2, m), np.uint64)
                keys = [np.zeros(0, np.uint64)] * m
                n_short = np.zeros(m, np.int32)
                if len(h):
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    rows = row[starts]
                    hashed[0, rows], hashed[1, rows] = np.add.reduceat(mix(h), starts), np.add.reduceat(mix(h + np.uint64(9)), starts)
                    at = cell(h)
                    by = np.lexsort((h, by_cell.count[at], row))
                    ordered, together = h[by], by_cell.together[at[by]]
                    for r, s, e in zip(rows.tolist(), starts.tolist(), np.append(starts[1:], len(h)).tolist(), strict=True):
                        keys[r], n_short[r] = signatures(ordered[s:e], together[s:e], percent)
                sizes = np.cumsum([0] + [len(k) for k in keys])
                flat = np.concatenate(keys).view(np.int64)
                packed = parities(h, row, m, BITS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(n.astype(np.int32)), pa.array(hashed[0].view(np.int64)), pa.array(hashed[1].view(np.int64)),
                     pa.array(n_short), pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat)),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * BITS), pa.array(packed.ravel()))],
                    names=["doc_id", "n", "c1", "c2", "n_short", "keys", "bits"])
        give_back()

    return docs.mapInArrow(run, SETS)


def met_twice(sets: DataFrame) -> np.ndarray:
    """Bitmap of cells of keys that two sets or more fall into, added up in blocks: 32 MB at any size."""
    size, n_blocks = 1 << MEET_BITS, 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in batches:
            at, n = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - MEET_BITS), return_counts=True)
            at = at.astype(np.int64)
            byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
            again = (n > 1) | (once[byte] & bit > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        if once.any():
            once, twice = once.reshape(n_blocks, -1), twice.reshape(n_blocks, -1)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(n_blocks), pa.int32()), "once": pa.array([x.tobytes() for x in once], pa.binary()),
                                              "twice": pa.array([x.tobytes() for x in twice], pa.binary())})
        give_back()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // n_blocks // 8, np.uint8), np.zeros(size // n_blocks // 8, np.uint8)
        for batch in batches:
            for x, y in zip(batch.column("once"), batch.column("twice"), strict=True):
                own = np.frombuffer(x.as_py(), np.uint8)
                twice |= np.frombuffer(y.as_py(), np.uint8) | once & own
                once |= own
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "once": pa.array([b""], pa.binary()),
                                          "twice": pa.array([twice.tobytes()], pa.binary())})

    kind = "block int, once binary, twice binary"
    out = np.zeros((n_blocks, size // n_blocks // 8), np.uint8)
    for r in sets.select("keys").mapInArrow(mark, kind).groupBy("block").applyInArrow(add, kind).collect():
        out[r["block"]] = np.frombuffer(r["twice"], np.uint8)
    return out.ravel()


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, rep, n, short) of keys that may have another set."""
    twice = sets.sparkSession.sparkContext.broadcast(met_twice(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = (keys.view(np.uint64) >> np.uint64(64 - MEET_BITS)).astype(np.int64)
            keep = np.flatnonzero(twice.value[at >> 3] << (at & 7).astype(np.uint8) & 128)
            short = place < batch.column("n_short").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[keep]), pa.array(batch.column("doc_id").to_numpy()[row[keep]]), pa.array(batch.column("n").to_numpy()[row[keep]]),
                 pa.array(short[keep])], names=["key", "rep", "n", "short"])
        give_back()

    return sets.select("keys", "doc_id", "n", "n_short").mapInArrow(run, "key long, rep long, n int, short boolean")


def may_link(a: str, b: str, names: list[str], percent: int) -> F.Column:
    """Whether sizes ``n`` and bitmaps, in the columns ``names``, allow the similarity: as many bits as differ, as many tokens differ at least."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    differ = reduce(add, (F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in names))
    return ((100 + percent) * differ <= (100 - percent) * (n_a.cast("long") + n_b)) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that may link by their whole bitmaps."""
    names = [f"m{i}" for i in range(BITS)]
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), *[F.get("bits", F.lit(i)).alias(f"{c}_m{i}") for i in range(BITS)])
    return pairs.join(of("a"), "a").join(of("b"), "b").where(may_link("a_", "b_", names, percent)).select("a", "b")


def folded(sets: DataFrame) -> DataFrame:
    """(rep, f0, ...): bitmaps of FOLDED longs. Parities add up, so these are the parities of that many cells."""
    return sets.select(F.col("doc_id").alias("rep"), *[
        reduce(lambda x, y: x.bitwiseXOR(y), (F.get("bits", F.lit(i)) for i in range(j, BITS, FOLDED))).alias(f"f{j}") for j in range(FOLDED)])


def linked(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 |intersection| >= percent |union|."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = staged(texts.join(wanted, "doc_id", "left_semi"), "join-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            a_id = batch.column("a").to_pylist()
            ta, tb = text_array(batch.column("ta")), text_array(batch.column("tb"))
            good = np.zeros(len(a_id), bool)
            for lo, hi in row_blocks(tb):
                h, row = token_sets(tb[lo:hi], n_words)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    if a_id[i] not in last:                       # runs of one a are read once
                        last = {a_id[i]: token_sets(ta[i:i + 1], n_words)[0]}
                    own, other = last[a_id[i]], h[cuts[i - lo]:cuts[i - lo + 1]]
                    if len(own) and len(other):
                        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                        same = int((own[at] == other).sum())
                        good[i] = 100 * same >= percent * (len(own) + len(other) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], names=["a", "b", "good"])
        give_back()

    good = staged(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, good boolean").where("good").select("a", "b"), "linked-pairs")
    release(texts)
    return good


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, n_words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of a document's set and the least doc_id that links lead to.

    Equal sets are one node. In the bucket of a key, each member is first compared with one centre (the member
    with the most company in all buckets); then only members in different components of what that found
    are compared with each other, so a group of near copies gives as many pairs as members; a small bitmap
    goes with each of their keys, and what it tells apart never becomes a pair. Pairs
    are left out by exact bounds only (prefixes, sizes, bitmaps), so no link between components is lost.
    A null text has no words, and without words a document is linked with nothing. Rows with
    one doc_id are one document, whose least set hash stands for it; null doc_ids have no row. An
    empty table gives no rows; other columns are left out.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    spark = docs.sparkSession
    importable(spark)
    rows = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    order = spark.sparkContext.broadcast(frequencies(rows.select("text"), n_words))
    every = staged(indexed(rows, order, n_words, percent), "ngram-sets")
    one = staged(every.groupBy("doc_id").agg(F.min(F.struct("c1", "c2", "n")).alias("m")).select("doc_id", "m.*"), "set-of-document")
    sets = staged(every.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "n", "n_short", "keys", "bits")).alias("m"))
                  .select("c1", "c2", "m.*"), "distinct-sets")
    release(every)
    member = staged(shared_keys(sets), "ngram-keys")
    shared = staged(member.join(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "shared-keys")
    release(member)
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    centre = shared.join(company, "rep").groupBy("key").agg(F.min(F.struct(-F.col("company"), "rep", "n")).alias("m")).select(
        "key", F.col("m.rep").alias("a"), F.col("m.n").alias("n_a"))
    near = (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
    stars = shared.join(centre, "key").where((F.col("a") != F.col("rep")) & near).select(
        F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    stars = staged(possible(stars, sets, percent), "ngram-pairs")
    found = components(linked(stars, rows, n_words, percent))
    classed = shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = classed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_rows = staged(classed.join(mixed, "key", "left_semi").select("key", "rep", "n", "short", "c").join(folded(sets), "rep"), "open-keys")
    release(shared)
    light = open_rows.where("short").select(*[F.col(c).alias(f"l_{c}") for c in open_rows.columns])
    # the bounds are part of the join, so that only what may link becomes a pair
    meet = ((F.col("key") == F.col("l_key")) & (F.col("c") != F.col("l_c")) & may_link("", "l_", [f"f{i}" for i in range(FOLDED)], percent)
            & ((F.col("l_n") < F.col("n")) | ((F.col("l_n") == F.col("n")) & (F.col("l_rep") < F.col("rep")))))
    pairs = open_rows.join(light, meet).select(F.least("rep", "l_rep").alias("a"), F.greatest("rep", "l_rep").alias("b")).distinct()
    pairs = staged(possible(pairs, sets, percent).join(stars, ["a", "b"], "left_anti"), "ngram-pairs")
    release(open_rows)
    more = linked(pairs, rows, n_words, percent)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_set = sets.select("c1", "c2", F.col("doc_id").alias("rep")).join(found, F.col("rep") == F.col("node"), "left").select(
        "c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    full = one.where("n > 0").join(of_set, ["c1", "c2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.union(one.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
