"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import give_back, importable, mix, parities, release, row_blocks, shingles, staged, text_array, words
from cohortlens.llm.graph import components
from cohortlens.llm.line_dedup import _cells as cells_for, bitmap, in_bitmap

BANDS, ROWS = 16, 4                           # a pair at 0.8 meets with probability 0.9998
SAMPLES = BANDS * ROWS
SIMILARITY = 0.8
DF_BITS = 20                                  # cells of the document-frequency sketch
SPREAD = 0.1                                  # of the weights by IDF
POOL_BITS = 15                                # rows of random draws, picked by shingle hash
MAX_DIFFERENT = 27                            # of 64 samples: five deviations from 0.8 similarity

SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("c1", T.LongType()),
                       T.StructField("c2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))] +
                      [T.StructField(f"s{i}", T.LongType()) for i in range(4)])


class Idf(NamedTuple):
    """Weights by cell of the document-frequency sketch: 1 + SPREAD ln((1+N)/(1+df)) / ln(1+N), so
    from 1 (in every document) to 1 + SPREAD (in none). 2^DF_BITS floats (4 MB) at any corpus
    size. The spread is small because copies lower the IDF of what they share: with the
    plain formula a text with 18 % of its shingles changed, copied thousands of times, falls
    from 0.82 to 0.5, and the largest groups are those that are missed."""

    weight: np.ndarray


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64)


def weighted(h: np.ndarray, row: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending in the row, with TF-IDF weights."""
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else by
    tf = np.diff(np.append(first, len(h)))
    h, row = h[first], row[first]
    return h, row, (tf * idf.weight[cell(h)]).astype(np.float32)


def document_frequency(texts: DataFrame) -> Idf:
    """Sketch of how many documents hold each shingle, over all of ``texts``: every task counts
    into the cells, and the counts are added up cell by cell in blocks. Shingles that share a
    cell share a count, which is then too high and their weight a little too low."""
    size, n_blocks = 1 << DF_BITS, 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            column = text_array(batch.column(0))
            n += len(column)
            for a, b in row_blocks(column):
                h, row = shingles(*words(column[a:b]))
                pairs = np.unique(row << np.int64(DF_BITS) | cell(h))
                total += np.bincount(pairs & (size - 1), minlength=size)
        if n:
            parts = total.astype(np.int32).reshape(n_blocks, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array(np.full(n_blocks, n, np.int64)),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "n", "counts"])
        give_back()

    def add(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size // n_blocks, np.int64), 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], names=["block", "n", "counts"])

    kind = "block int, n long, counts binary"
    rows = texts.mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect()
    df, n = np.zeros((n_blocks, size // n_blocks)), 0
    for r in rows:
        df[r["block"]], n = np.frombuffer(r["counts"], np.int64), r["n"]
    return Idf((1 + SPREAD * np.log((1 + n) / (1 + df.ravel())) / np.log(max(1 + n, 2))).astype(np.float32))


class Sampler:
    """Improved consistent weighted sampling: for each of SAMPLES draws, the shingle with the
    least a = c / (y e^r), where y = e^(r (t - b)) and t = floor(ln(w) / r + b); r and c come from
    Gamma(2, 1), b from the unit interval, all fixed by shingle and draw. Two documents agree in
    a draw (shingle and t) with the probability of their weighted Jaccard similarity."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        shape = (1 << POOL_BITS, SAMPLES)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.b = rng.random(shape, np.float32)

    def sample(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Chosen (shingle, t) as one hash for each row that begins at ``starts``."""
        out = np.empty((len(starts), SAMPLES), np.uint64)
        ends = np.append(starts[1:], len(h))
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            best = np.full(SAMPLES, np.inf, np.float32)
            pick = np.zeros(SAMPLES, np.uint64)
            for a in range(s, e, 4096):
                own = h[a:min(a + 4096, e)]
                at = (own & np.uint64((1 << POOL_BITS) - 1)).astype(np.int64)
                r, t = self.r[at], self.b[at]
                t += np.log(w[a:a + len(own)])[:, None] / r
                np.floor(t, out=t)
                y = (t - self.b[at] + 1)
                y *= -r
                y += self.ln_c[at]
                least = y.argmin(axis=0)
                value = y[least, np.arange(SAMPLES)]
                better = value < best
                chosen = mix(own[least] + t[least, np.arange(SAMPLES)].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                best, pick = np.where(better, value, best), np.where(better, chosen, pick)
            out[i] = pick
        return out


_SAMPLER: list[Sampler] = []


def sketches(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """SKETCH rows: a 128-bit hash of the weighted shingles, band keys, and the low four bits
    of each sample. A text without words has no bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SAMPLER:
            _SAMPLER.append(Sampler())
        salt = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        band_no = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        nibble = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in row_blocks(texts):
                h, row, w = weighted(*shingles(*words(texts[a:b])), idf.value)
                n = b - a
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(h) else np.zeros(0, np.int64)
                c = np.zeros((2, n), np.uint64)
                bands: list = [[] for _ in range(n)]
                low = np.zeros((n, 4), np.uint64)
                if len(h):
                    found = _SAMPLER[0].sample(h, w, starts)
                    rows = row[starts]
                    keyed = mix(h ^ w.view(np.uint32).astype(np.uint64))
                    c[0, rows], c[1, rows] = np.add.reduceat(keyed, starts), np.add.reduceat(mix(keyed + np.uint64(9)), starts)
                    keys = mix((found.reshape(-1, BANDS, ROWS) * salt).sum(axis=2, dtype=np.uint64) + band_no).view(np.int64)
                    low[rows] = ((found & np.uint64(15)).reshape(-1, 4, 16) << nibble).sum(axis=2, dtype=np.uint64)
                    for r, k in zip(rows.tolist(), keys, strict=True):
                        bands[r] = k
                ids = batch.column(0).slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), pa.array(bands, pa.list_(pa.int64()))] +
                    [pa.array(np.ascontiguousarray(low[:, i]).view(np.int64)) for i in range(4)], names=SKETCH.names)
        give_back()

    return docs.mapInArrow(sketch, SKETCH)


def similar_enough(a: str, b: str) -> F.Column:
    """Whether two sketches' samples differ in at most MAX_DIFFERENT places: a pair at 0.8 does
    with a probability of all but one in a million, a pair at 0.3 hardly ever."""
    ones = F.lit(0x1111111111111111)
    total = None
    for i in range(4):
        x = F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
        total = x if total is None else total + x
    return total <= MAX_DIFFERENT


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is ``least`` or more."""
    # the texts in question are picked once; a pair's two joins then move only those
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = staged(texts.join(wanted, "doc_id"), "pair-texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}
        for batch in batches:
            a_id, b_id = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = text_array(batch.column("ta")), text_array(batch.column("tb"))
            score = np.zeros(len(a_id))
            for lo, hi in row_blocks(tb):
                h, row, w = weighted(*shingles(*words(tb[lo:hi])), idf.value)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    if a_id[i] not in last:                       # runs of one a are sketched once
                        ha, _, wa = weighted(*shingles(*words(ta[i:i + 1])), idf.value)
                        last = {a_id[i]: (ha, wa, float(wa.sum(dtype=np.float64)))}
                    ha, wa, total = last[a_id[i]]
                    hb, wb = h[cuts[i - lo]:cuts[i - lo + 1]], w[cuts[i - lo]:cuts[i - lo + 1]]
                    if not len(ha) or not len(hb):
                        continue
                    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
                    same = ha[at] == hb
                    common = float(np.minimum(wa[at[same]], wb[same]).sum(dtype=np.float64))
                    score[i] = common / (total + float(wb.sum(dtype=np.float64)) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)],
                                             names=["a", "b", "similarity"])
        give_back()

    scored = both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, similarity double")
    scored = staged(scored.where(F.col("similarity") >= least), "verified-pairs")
    release(texts)
    return scored


def named_classes(bucketed: DataFrame, found: DataFrame) -> DataFrame:
    """``bucketed`` with the classes ``c`` of each member and ``ca`` of its bucket's centre."""
    of = lambda node, c: found.select(F.col("node").alias(node), F.col("component").alias(c))
    return (bucketed.join(of("rep", "c"), "rep", "left").join(of("a", "ca"), "a", "left")
            .withColumns({"c": F.coalesce("c", "rep"), "ca": F.coalesce("ca", "a")}))


BITS = 16                                     # longs of a document's bitmap of shingles
EARLIER = 3                                   # rare shingles before it that go with a shared one
SHORT, APART = 1, 2                           # marks of a shared shingle: among the first n_short; its document is not in its centre's class
FOLDED = 4                                    # longs of the one that goes with its shared shingles; parities add up
RARE = T.StructType([T.StructField("rep", T.LongType()), T.StructField("weight", T.DoubleType())] +
                    [T.StructField(f"m{i}", T.LongType()) for i in range(BITS)] +
                    [T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("n_short", T.IntegerType())])


def rarest(texts: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """RARE rows of texts with words: total weight W, a bitmap of all shingles, and the rarest shingles,
    those from which on the weights add up to at least ``least`` W. Two texts with a similarity of
    ``least`` have a common weight of at least ``least`` W, so the rarest shingle they have in common
    is among these for both. The lighter one has it among its first ``n_short``, from which on it has
    2 least / (1 + least) of its W."""
    strict = 2 * least / (1 + least)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in row_blocks(texts):
                h, row, w = weighted(*shingles(*words(texts[a:b])), idf.value)
                by = np.lexsort((h, -idf.value.weight[cell(h)], row))
                h, row, w = h[by], row[by], w[by].astype(np.float64)
                total = np.bincount(row, w, minlength=b - a)
                onward = (np.cumsum(total)[row] - np.cumsum(w) + w) / total[row] + 1e-9
                rows = np.unique(row)
                bits = parities(h, row, b - a, BITS)[rows]
                keep = onward >= least
                sizes = np.bincount(row[keep], minlength=b - a)[rows]
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                                pa.array(h[keep].view(np.int64)))
                short = np.bincount(row[onward >= strict], minlength=b - a)[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + rows], pa.int64()), pa.array(total[rows])] +
                    [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITS)] + [rare, pa.array(short.astype(np.int32))],
                    names=RARE.names)
        give_back()

    return texts.mapInArrow(pick, RARE)


def may_meet(a: str, b: str, name: str, n: int, least: float) -> F.Column:
    """Whether bitmaps and total weights leave it possible that two texts are ``least`` similar."""
    differ = reduce(add, (F.bit_count(F.col(f"{a}{name}{i}").bitwiseXOR(F.col(f"{b}{name}{i}"))) for i in range(n)))
    return differ <= (F.col(f"{a}weight") + F.col(f"{b}weight")) * ((1 - least) / (1 + least) + 1e-6)


def meetings(rare: DataFrame, least: float) -> DataFrame:
    """(a, b) of documents that have a rare shingle in common, the lighter one among its short ones, are in different
    classes, and may be similar. Two documents mostly share runs of shingles; where one of the EARLIER shingles
    before this one (``earlier``) is in both, they have met there, so here they don't: a pair comes
    once for each run, and at its first shingle in any case."""
    light = rare.where(F.col("marks").bitwiseAND(F.lit(SHORT)) > 0).select(*[F.col(c).alias(f"l_{c}") for c in rare.columns])
    met_before = F.coalesce(reduce(or_, (F.get("earlier", F.lit(i)) == F.get("l_earlier", F.lit(j))
                                         for i in range(EARLIER) for j in range(EARLIER))), F.lit(False))
    both = ((F.col("shingle") == F.col("l_shingle")) & (F.col("c") != F.col("l_c")) & (F.col("marks").bitwiseOR(F.col("l_marks")) >= APART)
            & ((F.col("l_weight") < F.col("weight")) | ((F.col("l_weight") == F.col("weight")) & (F.col("l_rep") < F.col("rep"))))
            & (F.col("l_weight") >= F.col("weight") * (least - 1e-6)) & ~met_before
            & may_meet("", "l_", "f", FOLDED, least) & similar_enough("", "l_"))
    return rare.join(light, both).select(F.least("rep", "l_rep").alias("a"), F.greatest("rep", "l_rep").alias("b"))


def rest(open_rows: DataFrame, texts: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """Pairs (a, b) in different classes that may be similar, of the documents of ``open_rows``: one of
    them is not in its bucket's centre's class, and both have a rare shingle in common. No pair at
    ``least`` is lost by that or by the bitmaps: every shingle weighs at least 1, so as many bits as
    differ is what the total weights differ by at least, and that is W1 + W2 times (1 - least) / (1 + least)
    at most."""
    docs = staged(open_rows.groupBy("rep").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("ca")).alias("apart"),
                                               *[F.first(f"s{i}").alias(f"s{i}") for i in range(4)]), "open-documents")
    picked = staged(rarest(texts.join(docs.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text"), idf, least),
                    "rare-shingles")
    of_document = picked.join(docs, "rep")
    # the rows of all shingles are narrow; what the bounds need goes with those of shared ones, the bitmaps folded, and the shingles before
    narrow = of_document.select("rep", "c", "apart", F.posexplode("rare").alias("at", "shingle"))
    met = (narrow.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("apart").alias("apart"))
           .where("lo < hi and apart").select("shingle"))
    folds = [reduce(lambda x, y: x.bitwiseXOR(y), (F.col(f"m{i}") for i in range(j, BITS, FOLDED))).alias(f"f{j}") for j in range(FOLDED)]
    side = of_document.select("rep", "weight", "n_short", "rare", *[f"s{i}" for i in range(4)], *folds)
    marks = F.when(F.col("at") < F.col("n_short"), SHORT).otherwise(0) + F.when(F.col("apart"), APART).otherwise(0)
    earlier = F.array(*[F.get("rare", F.col("at") - i) for i in range(1, EARLIER + 1)])
    rare = staged(narrow.join(met, "shingle", "left_semi").join(side, "rep").select(
        "shingle", "rep", "c", marks.alias("marks"), earlier.alias("earlier"), *[c for c in side.columns if c not in ("rep", "n_short", "rare")]),
        "shared-shingles")
    pairs = staged(meetings(rare, least).distinct(), "rare-pairs")
    release(rare)
    of = lambda c: picked.select(F.col("rep").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("weight", *(f"m{i}" for i in range(BITS)))])
    return pairs.join(of("a"), "a").join(of("b"), "b").where(may_meet("a_", "b_", "m", BITS, least)).select("a", "b")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, representative): ``class_id`` is the least doc_id of all documents that
    similar pairs connect; ``representative`` the least doc_id with the same weighted shingles.

    Texts with equal shingles (case, white space and punctuation aside) form one group at once,
    texts without words another; only a group's representative is compared. A bucket of a band
    never gives rise to all its pairs. Each member is compared with the bucket's centre. What then
    lies in different classes of one bucket is searched in full: for each document outside its centre's
    class by the rare shingles that similar texts must have in common (``rest``). So every pair that
    meets in a bucket is compared, in one class, or too different by an exact bound (or, with
    a probability of 10^-6 at 0.8, by its samples). Rows with one doc_id count as one document, whose least
    sketch stands for it; null doc_ids have no row. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("long").alias("doc_id"),
                                                       docs[text].cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(document_frequency(rows.select("text")))
    sketch = staged(sketches(rows, idf), "sketches")
    one = staged(sketch.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("c")).select("doc_id", "c.c1", "c.c2"), "sketch-of-document")
    groups = staged(sketch.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "bands", "s0", "s1", "s2", "s3")).alias("m"))
                    .select("c1", "c2", "m.*"), "sketch-groups")
    release(sketch)
    member = groups.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), "s0", "s1", "s2", "s3")
    shared = staged(member.join(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared-buckets")
    # a bucket's centre is its member with the most company in all bands: in a group of copies, the original
    company = shared.groupBy("rep").agg(F.sum("n").alias("company"))
    centre = (shared.join(company, "rep").groupBy("key")
              .agg(F.min(F.struct(-F.col("company"), "rep", "s0", "s1", "s2", "s3")).alias("m"))
              .select("key", F.col("m.rep").alias("a"), *[F.col(f"m.s{i}").alias(f"as{i}") for i in range(4)]))
    bucketed = staged(shared.drop("n").join(centre, "key"), "buckets")
    release(shared)
    # all that is compared below is in a bucket: these texts are moved once, and those that a bitmap leaves out not at all
    wanted = staged(bucketed.select(F.col("rep").alias("doc_id")).distinct(), "bucket-members")
    cells = cells_for(wanted.count())
    some = in_bitmap(rows.withColumn("key", F.xxhash64("doc_id")), bitmap(wanted.select(F.xxhash64("doc_id").alias("key")), cells), cells)
    texts = staged(some.drop("key").join(wanted, "doc_id", "left_semi"), "bucket-texts")
    release(wanted)
    stars = staged(bucketed.where((F.col("a") != F.col("rep")) & similar_enough("a", ""))
                   .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "pairs")
    found = components(verified(stars, texts, idf, least).select("a", "b"))
    named = named_classes(bucketed, found)
    # members of buckets that more than one class meets in
    mixed = named.where("c <> ca").select("key").distinct()
    open_rows = named.join(mixed, "key", "left_semi")
    pairs = staged(rest(open_rows, texts, idf, least).join(stars, ["a", "b"], "left_anti"), "pairs")
    release(bucketed)
    more = verified(pairs, texts, idf, least).select("a", "b")
    release(texts)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_group = groups.select("c1", "c2", F.col("doc_id").alias("representative")).join(
        found, F.col("representative") == F.col("node"), "left").select(
        "c1", "c2", "representative", F.coalesce("component", "representative").alias("class_id"))
    return one.join(of_group, ["c1", "c2"]).select("doc_id", "class_id", "representative")
