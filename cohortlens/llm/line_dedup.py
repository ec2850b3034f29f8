"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join.

DataFrame functions only. How many edits k a near copy may have follows the length of the
shorter line. Lines of one class of lengths are cut into k + 1 segments of one size at the same
places. Of two lines within k edits, the longer one holds a segment of the shorter one unchanged, moved
by no more than the edits before and after it allow: segment i by i to the right, by the lesser of i and
k - i to the left. So every line looks up those substrings in the index of its class, and in the next
lower class if that is within its edits. Substrings that no line has as a segment are dropped by a bitmap of the index
before anything is shuffled. What meets is verified by bit-parallel edit distance in a band of 2k + 1 diagonals.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import release, staged

# (least length of the shorter line, edits): about a tenth of it, up to a word with its space
MAX_EDITS = ((20, 2), (40, 4), (100, 6), (200, 8))
NEAR_CHARS = 20                               # shorter lines only count as copies when equal
CLASS = 8                                     # a class holds this many lengths for each edit
TAIL = 6                                      # low bits of a line's id that hold its length
BUCKET = 15                                   # bits of a cell number within one row of a bitmap
LANES = [*"abcdefghijklmnopqrstuvwxyz", "01", "23", "45", "67", "89", " "]   # characters that a line's signature counts
MAX_CELLS = 30                                # a bitmap has 2^30 cells at most: 128 MB


def _bands(max_edits, near_chars: int) -> list[tuple[int, int]]:
    """(least length, edits), ascending; a number stands for all lengths."""
    return [(near_chars, max_edits)] if isinstance(max_edits, int) else sorted(
        {max(least, near_chars): k for least, k in sorted(max_edits)}.items())


def _once(value: Column, fn) -> Column:
    """``fn(value)``; a lambda's argument is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _edits(n: Column, bands: list[tuple[int, int]]) -> Column:
    """Edits that a line of n characters may differ by from a longer one; -1 below the first band."""
    out = F.lit(-1)
    for least, k in bands:
        out = F.when(n >= least, k).otherwise(out)
    return out


def _class(n: Column, bands: list[tuple[int, int]]) -> Column:
    """The least length of n's class."""
    out = F.lit(0)
    for least, k in bands:
        width = max(CLASS * k, 1)
        out = F.when(n >= least, least + F.floor((n - least) / width).cast("int") * width).otherwise(out)
    return out


def _by_edits(k: Column, bands: list[tuple[int, int]], value) -> Column:
    """The array ``value(k)``, a list of numbers; none where no edit is allowed."""
    out = F.array().cast("array<int>")
    for each in sorted({k for _, k in bands if k}):
        out = F.when(k == each, F.array(*[F.lit(x) for x in value(each)]).cast("array<int>")).otherwise(out)
    return out


def _size(base: Column, k: Column) -> Column:
    return F.floor(base / (k + 1)).cast("int")


def own_keys(line: Column, n: Column, bands: list[tuple[int, int]]) -> Column:
    """Keys of a line's segments."""
    k, base = _edits(n, bands), _class(n, bands)
    return _once(F.struct(base.alias("base"), _size(base, k).alias("size")), lambda c: F.transform(
        _by_edits(k, bands, lambda k: range(k + 1)), lambda i: F.xxhash64(c["base"], i, F.substring(line, i * c["size"] + 1, c["size"]))))


def probes(lines: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """(key, id) of all moved substrings of ``lines`` (id, line, n) in their class, and all in the class below within reach."""
    n = F.col("n")
    own = lines.withColumns({"k": _edits(n, bands), "base": _class(n, bands), "moved": F.lit(True)})
    last = F.col("base") - 1                                           # the longest line of the class below
    below = own.withColumns({"k": _edits(last, bands), "base": _class(last, bands), "gap": n - last, "moved": F.lit(False)}).where(
        (F.col("k") > 0) & (F.col("gap") <= F.col("k"))).drop("gap")
    i, left, size = F.col("i"), F.col("left"), F.col("size")
    rows = own.unionByName(below).withColumn("size", _size(F.col("base"), F.col("k"))).select(
        "id", "line", "base", "k", "size", "moved", F.explode(_by_edits(F.col("k"), bands, lambda k: range(k + 1))).alias("i"))
    # what segment i may have moved over is cut out once
    over = rows.withColumn("left", F.least(i, F.col("k") - i)).select(
        "id", "base", "i", "size", "left", "moved", F.substring("line", i * size - left + 1, size + left + i).alias("over"))
    moves = over.select("*", F.explode(F.sequence(F.lit(0), left + i)).alias("at")).where((F.col("at") != left) | ~F.col("moved"))
    return moves.select(F.xxhash64("base", "i", F.substring("over", F.col("at") + 1, size)).alias("key"), "id")


def bitmap(keys: DataFrame, cells: int) -> DataFrame:
    """(bucket, words): which of 2^cells cells a key (column ``key``) falls into, 2^BUCKET cells a row. Its size
    is bounded by ``cells``, whatever the number of keys."""
    cell = F.col("key").bitwiseAND(F.lit((1 << cells) - 1))
    rows = keys.groupBy(F.shiftright(cell, BUCKET).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(cell.bitwiseAND(F.lit((1 << BUCKET) - 1))).alias("bits"))
    # eight bytes make a word, the first one highest
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, 8)), 16, -10).cast("long")
    return rows.select("bucket", F.transform(F.sequence(F.lit(0), F.lit((1 << BUCKET) // 64 - 1)), word).alias("words"))


def in_bitmap(rows: DataFrame, bits: DataFrame, cells: int) -> DataFrame:
    """The rows whose ``key`` falls into a cell of ``bits``: all with a key that was counted there, and some others."""
    cell = F.col("key").bitwiseAND(F.lit((1 << cells) - 1))
    at = cell.bitwiseAND(F.lit((1 << BUCKET) - 1)).cast("int")
    joined = rows.join(F.broadcast(bits.withColumnRenamed("bucket", "__bucket")), F.shiftright(cell, BUCKET).cast("int") == F.col("__bucket"))
    # within a word: the byte from the highest down, the bit from the lowest up
    shift = at.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))
    return joined.where(F.call_function("getbit", F.get("words", F.shiftright(at, 6)), shift) == 1).drop("__bucket", "words")


def _cells(n_keys: int, least: int = 20) -> int:
    """Cells for so many keys, as a power of 2: 16 to 32 a key up to MAX_CELLS."""
    return min(MAX_CELLS, max(least, (16 * n_keys).bit_length()))


def signature(line: Column) -> Column:
    """Parity of the number of words in each of 64 classes: one edit takes and gives three words at most."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w)))


def letters(line: Column) -> list[Column]:
    """Longs with eight bits for each of LANES: how many of its characters the line has, modulo 16, in a code of which one
    bit changes from each number to the next (and from 15 to 0). So as many bits as differ, that many characters at least two
    lines don't have in common; an edit takes one and gives one at most, and one of them only if it changes the length."""
    code = F.array(*[F.lit((1 << t) - 1 if t <= 8 else 0xFF & ~((1 << t - 8) - 1)).cast("long") for t in range(16)])
    out = []
    for at in range(0, len(LANES), 8):
        long = F.lit(0).cast("long")
        for i, lane in enumerate(LANES[at:at + 8]):
            without = line
            for c in lane:
                without = F.replace(without, F.lit(c), F.lit(""))
            n = (F.char_length(line) - F.char_length(without)).bitwiseAND(F.lit(15))
            long = long.bitwiseOR(F.shiftleft(F.get(code, n), 8 * i))
        out.append(long)
    return out


def keys(line: Column, n: Column, bands: list[tuple[int, int]]) -> Column:
    """(both, own, probe), all longs: what a line of n characters is found by (both, own), and looks
    up to find lines that are as long or shorter (both, probe)."""
    none = F.array().cast("array<bigint>")
    class_of = lambda m: F.floor(m / LENGTHS)
    k_of, below = _edits(n, bands), n - _edits(n, bands)
    own, probe = [], []
    for k in sorted({k for _, k in bands}):
        for shift in range(k + 1):
            t, looked = n - shift, []
            for i in range(k + 1):
                start, size = _segment(t, i, k)
                for at in range(max(-i, shift - (k - i)), min(i, shift + (k - i)) + 1):
                    looked.append(_key(line, t, i, start + at if at else start, size))
            probe.append(F.when(_edits(t, bands) == k, F.array(*looked)).otherwise(none))
        own.append(F.when(k_of == k, F.array(*[_key(line, n, i, *_segment(n, i, k)) for i in range(k + 1)])).otherwise(none))

    def of(x: Column) -> Column:
        named = lambda m: F.transform(x["pairs"], lambda v: F.xxhash64(class_of(m), v))
        other = F.when(class_of(below) != class_of(n), named(below)).otherwise(none)
        return F.struct(named(n).alias("both"), F.when(x["poor"], F.concat(*own)).otherwise(none).alias("own"),
                        F.when(x["poor"], F.concat(other, *probe)).otherwise(other).alias("probe"))

    return _once(_word_pairs(line, k_of), of)


def _common_start(x: Column, y: Column) -> Column:
    """Number of equal characters at the start, by bisection."""
    longer = lambda at, bit: at + F.when(F.substring(x, F.lit(1), at + bit) == F.substring(y, F.lit(1), at + bit), bit).otherwise(0)
    least = F.least(F.char_length(x), F.char_length(y))
    bits = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftleft", F.lit(1), 30 - i))
    return F.aggregate(F.filter(bits, lambda b: b <= least), F.lit(0), lambda at, b: F.when(at + b <= least, longer(at, b)).otherwise(at))


def _without_start(t: Column, k: Column) -> Column:
    """x and y of ``t``, backwards, without what both begin with; k + 1 characters of x stay for the band."""
    cut = lambda c, n: F.reverse(c.substr(n + 1, F.char_length(c)))
    same = F.greatest(F.lit(0), F.least(_common_start(t["x"], t["y"]), F.char_length(t["x"]) - k - 1))
    return _once(same, lambda n: F.struct(cut(t["x"], n).alias("x"), cut(t["y"], n).alias("y")))


def within(x: Column, y: Column, k: int) -> Column:
    """Whether x, the shorter text, and y are within k edits. Bit-parallel: one long holds the vertical differences of
    the 2k + 1 rows around the diagonal, and a character of y moves it on by one row. x has more than k characters."""
    width = 2 * k + 1
    mask = F.lit((1 << width) - 1)
    right = lambda v, by: F.shiftrightunsigned(v, by)
    bit = lambda v, at: F.call_function("shiftrightunsigned", v, at).bitwiseAND(F.lit(1))
    out = lambda v: F.bitwise_not(v).bitwiseAND(mask)

    def run(t: Column) -> Column:
        a, b = t["a"], t["b"]
        start = F.struct(F.lit(((1 << width) - 1) & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("n"))

        def step(s: Column, i: Column) -> Column:
            equal = lambda c: sum((F.when(F.get(a, i + (j - k)) == c, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j in range(width)),
                                  F.lit(0).cast("long"))

            def moved(eq: Column) -> Column:
                return ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(mask)

            def following(d0: Column) -> Column:
                h = F.struct(s["vn"].bitwiseOR(out(d0.bitwiseOR(s["vp"]))).alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"))
                past = i - (F.size(a) - k)                              # rows that the band's lower edge is past x's end
                row = F.greatest(F.lit(0), F.lit(width - 2) - past)
                n = lambda g: F.when(past < 0, s["n"] + 1 - bit(d0, F.lit(width - 1))).otherwise(s["n"] + bit(g["hp"], row) - bit(g["hn"], row))
                return _once(h, lambda g: F.struct(
                    g["hn"].bitwiseOR(out(right(d0, 1).bitwiseOR(g["hp"]))).alias("vp"), right(d0, 1).bitwiseAND(g["hp"]).alias("vn"), n(g).alias("n")))

            # what is over k by more than the last k + |y| - |x| steps can take off stays over it
            lost = s["n"] > 2 * k + F.size(b) - F.size(a)
            return F.when(lost, s).otherwise(_once(_once(_once(F.get(b, i), equal), moved), following))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s["n"] <= k)

    points = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c))
    return _once(F.struct(points(x).alias("a"), points(y).alias("b")), run)


def links(index: DataFrame, looked_up: DataFrame, texts, bands: list[tuple[int, int]]) -> DataFrame:
    """(a, b): ids of distinct lines within the edits that their lengths allow. ``index``: (key, id) of the segments,
    ``looked_up``: of the other substrings; ``texts``: from a table of ids to (id, line).

    Only rows of keys that two lines meet in go on. Their lines' lengths and signatures go with them, and the exact
    bounds are part of the join, so that what a bound tells apart never becomes a pair, however many lines share a segment."""
    rows = index.withColumn("own", F.lit(True)).unionByName(looked_up.select("key", "id", F.lit(False).alias("own")))
    # one move by key serves all: a substring in its own place is the segment, so it needn't be looked up, too
    rows = rows.repartition("key")
    keyed = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("any")).where("any and lo < hi").select("key")
    met = staged(rows.join(keyed.hint("shuffle_hash"), "key").groupBy("key", "id").agg(F.max("own").alias("own")), "line-keys")
    line = texts(met.select("id").distinct())
    line = line.select("id", "line", F.char_length("line").alias("n"), signature(F.col("line")).alias("sig"),
                       *[x.alias(f"c{i}") for i, x in enumerate(letters(F.col("line")))])
    line = staged(line, "line-texts")
    sided = met.join(line.drop("line"), "id")
    a, b = (sided.select(*[F.col(x).alias(f"{x}_{c}") for x in sided.columns]) for c in "ab")
    k = _edits(F.least("n_a", "n_b"), bands)
    bits = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    counts = reduce(add, (bits(c) for c in line.columns if c[0] == "c"))
    longer = F.col("n_b") - F.col("n_a")
    # the shorter line first
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    meet = ((F.col("key_a") == F.col("key_b")) & first & (F.col("own_a") | F.col("own_b")) & (longer <= k)
            & (counts <= 2 * k - longer) & (bits("sig") <= 3 * k))
    possible = staged(a.join(b, meet).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), k.alias("k")).distinct(), "line-candidates")
    text = lambda c: line.select(F.col("id").alias(c), F.col("line").alias(f"l{c}"))
    both = possible.join(text("a"), "a").join(text("b"), "b")
    pair = F.struct(F.col("la").alias("x"), F.col("lb").alias("y"))

    def near(t: Column) -> Column:
        out = F.lit(False)
        for each in sorted({k for _, k in bands if k}):
            out = F.when(F.col("k") == each, within(t["x"], t["y"], each)).otherwise(out)
        return out

    # what both begin and end with is left out
    shorter = lambda t: _without_start(t, F.col("k"))
    verified = both.where(_once(_once(_once(pair, shorter), shorter), near))
    result = staged(verified.select("a", "b"), "line-links")
    for done in (met, line, possible):
        release(done)
    return result


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_edits: int | tuple = MAX_EDITS,
           near_chars: int = NEAR_CHARS, counts: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, over all documents.

    Of equal lines only the first stays, in the order of doc_id and line number; a line of
    ``near_chars`` or more that is within ``max_edits`` characters of an earlier one goes
    too (a number, or the number by the shorter one's length, see MAX_EDITS). Blank lines stay. A text that loses all lines stays as an empty one; a null text
    stays null. Rows with one doc_id and different texts are documents of their own, in the order
    of their texts' hashes; null doc_ids come first. Rows equal in doc_id and text are one
    document and keep the same lines. Other columns pass through, whatever their names; an empty table stays empty.
    ``counts``: add (or replace) a struct column of this name with the numbers of lines, of exact and
    of near copies removed, and of links of the first lines found here.
    """
    bands = _bands(max_edits, near_chars)
    if any(not 0 <= k < min(least, 16) for least, k in bands) or [k for _, k in bands] != sorted(k for _, k in bands):
        raise ValueError("max_edits must be less than the lengths and than 16, and not fall with the length")
    # the columns of docs stand in one struct, so no name of theirs meets one used here
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].cast("long").alias("d"),
                       F.xxhash64(value).alias("h"), F.split(value, "\n").alias("ls"))
    body = rows.select("d", "h", "ls")
    occ = body.select("d", "h", F.posexplode("ls").alias("pos", "line")).where(F.trim("line") != "").withColumn("n", F.char_length("line"))
    # lengths meet modulo 64, which is more than two lines within reach can be apart
    tail = (1 << TAIL) - 1
    occ = occ.withColumn("id", F.xxhash64("line").bitwiseAND(F.lit(~tail)).bitwiseOR(F.col("n").cast("long").bitwiseAND(F.lit(tail))))
    near_line = F.col("n") >= bands[0][0]
    distinct = staged(occ.select(F.struct("d", "h", "pos").alias("place"), "id", F.xxhash64(F.lit(7), "line").alias("id2"),
                                 F.when(near_line, own_keys(F.col("line"), F.col("n"), bands)).alias("own"))
                      .groupBy("id", "id2").agg(F.min("place").alias("first"), F.any_value("own").alias("own")), "lines")
    place = distinct.select("id", "id2", "first", "first.*")

    def texts(ids: DataFrame) -> DataFrame:
        """The candidates' lines, cut out of the documents that have them first."""
        wanted = staged(ids.join(place, "id").groupBy(F.col("d").alias("wd"), F.col("h").alias("wh")).agg(
            F.collect_set(F.struct("pos", "id", "id2")).alias("at")), "line-places")
        cells = _cells(wanted.count())
        some = in_bitmap(body.withColumn("key", F.col("h")), bitmap(wanted.select(F.col("wh").alias("key")), cells), cells)
        found = some.join(wanted, some["d"].eqNullSafe(wanted["wd"]) & (some["h"] == wanted["wh"])).select(
            F.explode(F.transform("at", lambda a: F.struct(a["id"].alias("id"), a["id2"].alias("id2"),
                                                          F.get("ls", a["pos"]).alias("line")))).alias("x")).select("x.*")
        return found.where(F.xxhash64(F.lit(7), "line") == F.col("id2")).select("id", "line").distinct()

    index = distinct.select(F.explode("own").alias("key"), "id")
    cells = _cells(distinct.agg(F.sum(F.greatest(F.lit(0), F.coalesce(F.size("own"), F.lit(0))))).first()[0] or 0)
    looked_up = in_bitmap(probes(occ.where(near_line).select("id", "line", "n"), bands), bitmap(index, cells), cells)
    pairs = links(index, looked_up, texts, bands)
    ordered = (pairs.join(distinct.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a")
               .join(distinct.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b"))
    later = ordered.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), (F.col("fa") > F.col("fb")).cast("int").alias("late")),
        F.struct(F.col("b").alias("id"), (F.col("fb") > F.col("fa")).cast("int").alias("late")))).alias("x")).select("x.*")
    linked = later.groupBy("id").agg(F.max("late").alias("late"), F.count("*").alias("n"))
    kept = place.join(linked, "id", "left").groupBy(F.col("d").alias("kd"), F.col("h").alias("kh")).agg(
        F.collect_set(F.when(F.coalesce("late", F.lit(0)) == 0, F.col("pos"))).alias("kp"),
        F.sum(F.coalesce("late", F.lit(0))).alias("kn"), F.sum(F.coalesce("n", F.lit(0))).alias("kl"))
    # positions of blank lines and of the lines that stay, in order
    blank = F.filter(F.transform("ls", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    out = rows.join(kept, rows["d"].eqNullSafe(kept["kd"]) & (rows["h"] == kept["kh"]), "left").withColumn(
        "at", F.array_sort(F.array_distinct(F.concat(F.coalesce("kp", F.array().cast("array<int>")), blank))))
    picked = F.array_join(F.transform("at", lambda i: F.get("ls", i)), "\n")
    n_lines = F.size(F.filter("ls", lambda x: F.trim(x) != ""))
    n_kept = F.size(F.coalesce("kp", F.array().cast("array<int>")))
    near = F.coalesce("kn", F.lit(0)).cast("long")
    out = out.select("row", F.when(F.col("row").getField(text).isNotNull(), picked).alias("new"),
                     F.struct(n_lines.cast("long").alias("lines"), (n_lines - n_kept - near).cast("long").alias("exact"),
                              near.alias("near"), F.coalesce("kl", F.lit(0)).cast("long").alias("links")).alias("counts"))
    result = [(out["new"] if c == text else out["row"].getField(c)).alias(c) for c in docs.columns if c != counts]
    return out.select(*result, *[out["counts"].alias(c) for c in [counts] if c])
