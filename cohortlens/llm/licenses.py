"""License scan: MinHash bands of overlapping text windows find templates, shingle containment verifies.

DataFrame functions only, and no shuffle: a document is scanned within its row.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SHINGLE_WORDS

CONTAINMENT = 0.8
BANDS = 4                                     # of one row: a window at 0.8 collides with probability 0.998
# Window lengths in shingles, and the step from one window to the next. A template takes the
# longest window of which any place of its text in a document holds one in full.
WINDOWS = {1: 1, 4: 2, 16: 8}
_SALT = [random.Random(7).getrandbits(63) for _ in range(BANDS)]


def once(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: a lambda's argument is bound, whereas a column
    that several lambdas name may be computed again for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def with_shingles(text: Column, fn) -> Column:
    """``fn`` of the hashes of a text's five-word shingles, in order."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def shingles(h):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE_WORDS)]))
        return F.when(F.size(h) >= SHINGLE_WORDS, each).otherwise(F.array().cast("array<bigint>"))

    return once(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: once(shingles(h), fn))


def _each(size: Column, fn) -> Column:
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), fn)).otherwise(F.array().cast("array<bigint>"))


def window_of(n_shingles: int) -> int:
    return max(w for w, s in WINDOWS.items() if w + s - 1 <= n_shingles)


class Templates:
    """Shingles of each template and, by window length and band, the MinHash of each of its
    windows (at every place, so that the documents' step does not matter)."""

    def __init__(self, spark, templates: dict[str, str]):
        rows = spark.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in sorted(templates.items())])).alias("t")).select("t.*")
        self.shingles = {r["name"]: list(r["sh"]) for r in rows.select(
            "name", with_shingles(rows["text"], lambda sh: sh).alias("sh")).collect()}
        short = [n for n, s in self.shingles.items() if not s]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE_WORDS} words: {', '.join(short)}")
        self.keys: dict[tuple[int, int], dict[int, set[str]]] = {}
        for name, own in self.shingles.items():
            w = window_of(len(own))
            for band in range(BANDS if w > 1 else 1):
                for i in range(len(own) - w + 1):
                    least = min(x ^ _SALT[band] for x in own[i:i + w])
                    self.keys.setdefault((w, band), {}).setdefault(least, set()).add(name)


def scan(docs: DataFrame, templates: dict[str, str], text: str = "text", column: str = "licenses",
         containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with ``column``: the templates that a text holds, as an array of (name,
    containment), by name; containment is the share of the template's distinct five-word
    shingles in the stretch of text around a window that retrieved it, at best.

    Words are runs of letters and digits in lower case. Templates of fewer than five words are
    refused; no templates give empty arrays, and so do null, empty and shorter texts. Repeated
    rows match alike; other columns pass through, and one named ``column`` is replaced.
    """
    if column != text:
        docs = docs.drop(column)
    if not templates:
        return docs.withColumn(column, _none())
    known = Templates(docs.sparkSession, templates)

    def matches(sh: Column) -> Column:
        hits = {}
        for (w, band), wanted in sorted(known.keys.items()):
            if w == 1:
                keys = _hits(F.transform(sh, lambda x: x.bitwiseXOR(F.lit(_SALT[0]))), wanted)
            else:
                keys = _window_hits(sh, WINDOWS[w], F.lit(_SALT[band]), wanted)
            hits[f"h{w}_{band}"] = keys
        return once(F.struct(*[c.alias(n) for n, c in hits.items()]), lambda found: F.when(
            functools.reduce(Column.__or__, [F.size(found[n]) > 0 for n in hits]), listed(sh, found)).otherwise(_none()))

    def listed(sh: Column, found: Column) -> Column:
        names = []
        for name, own in sorted(known.shingles.items()):
            w = window_of(len(own))
            places = [_places(found[f"h{w}_{band}"], [k for k, x in known.keys[w, band].items() if name in x])
                      for band in range(BANDS if w > 1 else 1)]
            share = _share(sh, sorted(set(own)), w, len(own) + len(own) // 4)
            best = F.array_max(F.transform(F.array_distinct(F.concat(*places)), share))
            names.append(F.struct(F.lit(name).alias("name"), best.alias("containment")))
        return F.filter(F.array(*names), lambda x: x["containment"] >= containment)

    return docs.withColumn(column, with_shingles(docs[text], matches))


def _none() -> Column:
    return F.array().cast("array<struct<name:string,containment:double>>")


def _window_hits(sh: Column, step: int, salt: Column, wanted: dict[int, set[str]]) -> Column:
    """Hits of the windows, each a pair of neighbouring runs of ``step`` shingles."""
    runs = _each(F.ceil(F.size(sh) / step).cast("int"),
                 lambda i: F.least(*[F.get(sh, i * step + j).bitwiseXOR(salt) for j in range(step)]))
    return once(runs, lambda r: _hits(_each(F.size(r), lambda i: F.least(F.get(r, i), F.get(r, i + 1))), wanted))


def _places(hits: Column, keys: list[int]) -> Column:
    return F.transform(F.filter(hits, lambda x: x["key"].isin(keys)), lambda x: x["at"])


def _share(sh: Column, distinct: list[int], w: int, reach: int):
    """Share of a template's shingles in the text around the window at place i."""
    template = F.array(*map(F.lit, distinct))

    def share(i):
        start = F.greatest(F.lit(0), i * WINDOWS[w] - reach)
        near = F.slice(sh, start + 1, i * WINDOWS[w] - start + w + reach)
        return F.size(F.array_intersect(template, near)) / F.lit(float(len(distinct)))

    return share


def _hits(keys: Column, known: dict[int, set[str]]) -> Column:
    """(key, place) of the windows whose MinHash is one of a template's."""
    wanted = sorted(known)
    return F.filter(F.transform(keys, lambda k, i: F.when(k.isin(wanted), F.struct(k.alias("key"), i.alias("at")))), lambda x: x.isNotNull())
