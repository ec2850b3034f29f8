"""Phrase collocations: frequent phrases by Misra-Gries summaries, counted exactly, scored by their weakest cut.

Every task counts the hashes of its phrases and deals the counts out by hash partition. A partition's
summaries are merged into one of a capacity above mass / threshold, so that every phrase which
occurs as often as the threshold survives (each deletion takes as much from more than
``capacity`` others). A bitmap of the survivors goes to a second pass, which counts the phrases
themselves; what it lets through by chance is dropped by the exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import _powers, give_back, importable, joined_bytes, mix, row_blocks, staged, text_array

THRESHOLD = 10                                # least number of occurrences
MAX_WORDS = 3
PART_BYTES = 8 << 20                          # text for each hash partition of the summaries
SLACK = 4                                     # a capacity so many times mass / threshold: counts are at most threshold / SLACK too low
MAP_BITS = 28                                 # of the bitmap of survivors: 32 MB
TASK_PHRASES = 1 << 21                        # occurrences that a task holds before it hands counts on
# of a summary's entries. Phrases that share the bits of their hash survive together; these are 32 and the partition's, and differences
# between the hashes of one block take three bytes up to some 256 partitions
LOW_BITS, COUNT_BITS = 32, 28
MOST = (1 << COUNT_BITS - 1) - 1

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _PIECE_END.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of texts in order: their bounds in ``data``, text number, piece number and hash. ``gap`` says
    which bytes part words, ``piece_end`` which part pieces; a line end must be among them."""

    def __init__(self, texts: pa.Array, gap: np.ndarray = _GAP, piece_end: np.ndarray = _PIECE_END):
        raw, bounds = joined_bytes(texts, b"\n")
        self.data = _LOWER[raw]
        inside = ~gap[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if len(inside) and inside[0] else edge
        self.starts, self.ends = edge[0::2], edge[1::2]           # the last byte is a newline
        self.row = np.searchsorted(bounds, self.starts, side="right") - 1
        self.piece = np.cumsum(piece_end[self.data], dtype=np.int64)[self.starts] if len(self.starts) else self.starts
        self.hash = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            s0 = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, s0 + (1 << 20), side="right")))
            size = int(self.ends[to - 1] - s0)
            powers, inverse = _powers(max(size, 1))
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((self.data[s0:s0 + size].astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
            s, e = self.starts[at:to] - s0, self.ends[at:to] - s0
            self.hash[at:to] = mix((sums[e] - sums[s]) * inverse[s])
            at = to

    def phrases(self, langs: np.ndarray, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, hash) of all phrases of 1, 2, ... words within a piece; ``langs``: a hash by text."""
        run = mix(self.hash ^ langs[self.row]) if len(self.row) else self.hash
        first = np.arange(len(run))
        yield first, run
        for n in range(2, max_words + 1):
            keep = np.flatnonzero(self.piece[first] == self.piece[np.minimum(first + n - 1, len(self.piece) - 1)])
            keep = keep[first[keep] + n - 1 < len(self.piece)]
            first, run = first[keep], run[keep]
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + self.hash[first + n - 1])
            yield first, run


def lang_hashes(langs: list[str]) -> np.ndarray:
    known = {}
    for x in set(langs):
        n = int.from_bytes(x.encode("utf-8", "surrogatepass"), "little")
        known[x] = (n * 0xD6E8FEB86659FD93 + len(x)) % ((1 << 64) - 59)
    return mix(np.array([known[x] for x in langs], np.uint64))


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes below 2^LOW_BITS with counts: differences in as few bytes as do, a bit for
    each count above 1, and these counts."""
    step = np.diff(h, prepend=np.uint64(0))
    size = next(k for k in (3, 4, 5) if k == 5 or not len(step) or step.max() < 1 << 8 * k)
    many = n > 1
    return b"".join([np.array([len(h), size, many.sum()], np.int64).tobytes(), step.view(np.uint8).reshape(-1, 8)[:, :size].tobytes(),
                     np.packbits(many).tobytes(), np.minimum(n[many], MOST).astype(np.uint32).tobytes()])


def unpacked(raw: bytes) -> np.ndarray:
    """Hashes, each followed by its count in the low COUNT_BITS."""
    n, size, several = np.frombuffer(raw, np.int64, 3).tolist()
    step = np.zeros((n, 8), np.uint8)
    step[:, :size] = np.frombuffer(raw, np.uint8, n * size, 24).reshape(n, size)
    at = 24 + n * size
    many = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
    counts = np.ones(n, np.uint64)
    counts[many] = np.frombuffer(raw[at + -(-n // 8):], np.uint32, several)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(COUNT_BITS) | counts


class Summary:
    """A Misra-Gries summary: hashes with counts in their low bits, ascending. Counts are at most ``error``
    too low, and ``error`` is less than mass / capacity, however the counts are dealt out over what
    is added. A count from MOST on stays there; that is far above any threshold. ``most``: what ``error`` may
    come to; past that nothing is taken, and the entries may be more than ``capacity``."""

    def __init__(self, capacity: int, most: int = MOST):
        self.capacity, self.most, self.error, self.entries = capacity, most, 0, np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return (self.entries & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)

    def add(self, blocks: list[np.ndarray]) -> None:
        """Takes the entries of ``blocks``, which is left empty: as many tasks do this at a time as a worker has
        cores, so none of them holds its entries twice."""
        blocks.append(self.entries)
        self.entries = np.zeros(0, np.uint64)
        merged = np.concatenate(blocks)
        blocks.clear()
        merged.sort()
        counts = np.uint64((1 << COUNT_BITS) - 1)
        new = np.ones(len(merged), bool)
        np.greater(merged[1:] ^ merged[:-1], counts, out=new[1:])
        first = np.flatnonzero(new)
        h = merged[first] >> np.uint64(COUNT_BITS)
        merged &= counts
        n = (np.add.reduceat(merged, first) if len(first) else merged).view(np.int64)
        del merged, first, new
        if len(h) > self.capacity:
            # what the largest one that can't stay has is taken from all: from more than capacity counts
            less = min(int(np.partition(n, -self.capacity - 1)[-self.capacity - 1]), self.most - self.error)
            self.error += less
            h, n = h[n > less], n[n > less] - less
        self.entries = h << np.uint64(COUNT_BITS) | np.minimum(n, MOST).astype(np.uint64)


def _text_rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
                       F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))


def survivors(rows: DataFrame, threshold: int, max_words: int, parts: int, size: int) -> np.ndarray:
    """Bitmap by the top MAP_BITS of a hash: set for every phrase that occurs ``threshold`` times.

    Counts go once, from the tasks that make them to those that merge them. With each goes the number of bytes of text
    that it is of: a partition's mass so far tells by these and the table's ``size`` what it will come to. A
    capacity by that only bounds memory: errors stay below the threshold whatever the estimate is."""
    shift = 64 - parts.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, n_bytes = [], 0, 0

        def handed() -> pa.RecordBatch:
            h, n = counted(np.concatenate(held))
            cut = np.searchsorted(h >> np.uint64(shift), np.arange(parts + 1, dtype=np.uint64)).tolist()
            own = [p for p in range(parts) if cut[p] < cut[p + 1]]
            out, mass = [], []
            for p in own:
                # the bits after the partition's; hashes that share them are counted as one
                low, at = (h[cut[p]:cut[p + 1]] << np.uint64(64 - shift)) >> np.uint64(64 - LOW_BITS), n[cut[p]:cut[p + 1]]
                first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                out.append(packed(low[first], np.add.reduceat(at, first)))
                mass.append(int(at.sum()))
            return pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int32()), "mass": pa.array(mass, pa.int64()),
                                               "bytes": pa.array([n_bytes] * len(own), pa.int64()), "counts": pa.array(out, pa.binary())})

        for batch in batches:
            texts = text_array(batch.column(0))
            langs = lang_hashes(batch.column(1).to_pylist())
            for a, b in row_blocks(texts):
                for _, h in Words(texts[a:b]).phrases(langs[a:b], max_words):
                    held.append(h)
                    n_held += len(h)
                n_bytes += pc.sum(pc.binary_length(texts[a:b])).as_py()
                if n_held > TASK_PHRASES:
                    yield handed()
                    held, n_held, n_bytes = [], 0, 0
        if n_held:
            yield handed()
        give_back()

    blocks = rows.mapInArrow(count, "part int, mass long, bytes long, counts binary")
    bits = MAP_BITS - parts.bit_length() + 1

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, mass, seen = Summary(0, threshold - 1), [], 0, 0
        for batch in batches:
            for m, n_bytes, c in zip(batch.column("mass").to_pylist(), batch.column("bytes").to_pylist(), batch.column("counts"), strict=True):
                mass, seen = mass + m, seen + n_bytes
                summary.capacity = SLACK * (mass * max(size, seen) // seen) // threshold + 1
                held.append(unpacked(c.as_py()))
                if sum(map(len, held)) > max(summary.capacity, 1 << 18):
                    summary.add(held)
        summary.add(held)
        frequent = (summary.entries >> np.uint64(COUNT_BITS))[summary.counts() + summary.error >= threshold]
        marks = np.zeros(1 << max(bits - 3, 0), np.uint8)
        at = (frequent >> np.uint64(LOW_BITS - bits)).astype(np.int64)
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([marks.tobytes()], pa.binary())})
        give_back()

    found = blocks.groupBy("part").applyInArrow(merge, "part int, marks binary")
    out = np.zeros((parts, 1 << max(bits - 3, 0)), np.uint8)
    for r in found.collect():                                     # 32 MB at any size of the corpus
        out[r["part"]] = np.frombuffer(r["marks"], np.uint8)
    return out.ravel()


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD,
                  max_words: int = MAX_WORDS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, f) of all phrases of up to ``max_words`` words that occur
    ``threshold`` times or more in a language, and (lang, n), the number of words."""
    spark = docs.sparkSession
    importable(spark)
    rows = _text_rows(docs, text, lang)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # partitions grow in size, too, so that a task's counts for one don't become single entries
    parts = 1 << max(4, (size // max(part_bytes, 16 * math.isqrt(size))).bit_length())
    marks = spark.sparkContext.broadcast(survivors(rows, threshold, max_words, parts, size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_map = marks.value
        known: dict = {}

        def handed() -> pa.RecordBatch:
            keys = list(known)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array(list(known.values()), pa.int64())], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            texts = text_array(batch.column(0))
            names = batch.column(1).to_pylist()
            langs = lang_hashes(names)
            for a, b in row_blocks(texts, 2 << 20):
                words = Words(texts[a:b])
                raw = words.data.tobytes()
                per_lang: dict = {}
                for i, c in enumerate(np.bincount(words.row, minlength=b - a).tolist()):
                    per_lang[names[a + i]] = per_lang.get(names[a + i], 0) + c
                for x, c in per_lang.items():
                    known[x, b"", 0] = known.get((x, b"", 0), 0) + c
                for n, (first, h) in enumerate(words.phrases(langs[a:b], max_words), 1):
                    at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero(of_map[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    _, one, many = np.unique(h[hit], return_index=True, return_counts=True)
                    i = first[hit[one]]
                    s, e, row = words.starts, words.ends, words.row[i].tolist()
                    edges = [(s[i + j].tolist(), e[i + j].tolist()) for j in range(n)]
                    for k, c in enumerate(many.tolist()):
                        key = (names[a + row[k]], b" ".join([raw[x[k]:y[k]] for x, y in edges]), n)
                        known[key] = known.get(key, 0) + c
                if len(known) > 1 << 17:
                    yield handed()
                    known.clear()
        if known:
            yield handed()
        give_back()

    counted = staged(rows.mapInArrow(count, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words")
                     .agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("words") > 0, threshold).otherwise(1)), "phrases")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def score(a: str, left: str, right: str) -> F.Column:
    """floor(10^6 a a / (l r)), exactly for counts below 10^14: the products have 37 and 29 digits."""
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, threshold: int = THRESHOLD,
         max_words: int = MAX_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``max_words`` words of each language.

    A-Z count as a-z; words stand between spaces and tabs in pieces that [.,;:!?] and line ends part. a, l
    and r are the occurrences of a phrase and of the two parts that its lowest-scoring cut makes, n all words of the
    language; the score is floor(10^6 a a / (l r)), in wide decimals. A phrase inside a longer one that
    occurs at least half as often is left out. Ties go by a, then by the phrase's bytes. A null text is
    empty, a null language is ``und``; an empty table gives no rows. Other columns are left out.
    """
    counts, totals = phrase_counts(docs, text, lang, threshold, max_words, part_bytes)
    phrases = counts.where("words > 1")
    parts = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    # the two parts of a cut tell its phrase and k: these needn't be moved, too
    cuts = phrases.withColumn("w", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", F.col("f").alias("a"), part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda c, f: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).select(
        "lang", F.concat_ws(" ", "left", "right").alias("phrase"), score("a", "l", "r").alias("score"),
        F.size(F.split("left", " ", -1)).alias("k"), "a", "l", "r")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    # every shorter run of words of a longer phrase, with the most that such a phrase occurs
    inside = phrases.where("words > 2").withColumn("w", parts).select(
        "lang", "f", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")).select(
        "lang", "f", "m", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i")).select(
        "lang", part(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
