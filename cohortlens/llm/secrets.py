"""Secret scan: all rules in one combined automaton, one pass over the bytes."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlens.llm.automaton import Automaton
from cohortlens.llm.common import append_columns, joined_bytes, row_blocks, text_array

STOP = 0xFF                                   # never occurs in UTF-8


class Rule(NamedTuple):
    """``pattern``, then ``tail``, of which a hit needs ``least`` characters; ``fold``:
    ASCII letters match in either case."""

    kind: str
    pattern: str
    tail: str = ""
    least: int = 0
    fold: bool = False
    base: bool = True


# The kinds, patterns and least lengths of the base rules, in reporting order.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=\\-]+", 8, fold=True),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", "gh[opsu]_", "[A-Za-z0-9]+", 36, fold=False, base=False),
)


class Scanner:
    """Finds the leftmost non-overlapping longest matches of each rule.

    The combined automaton gives every position where a rule's match ends. From
    the first such end the rule's backward automaton gives the leftmost start,
    and the forward one, anchored there, the longest end; the search goes on
    behind it. For a rule whose every run of characters is taken whole
    (``access``, ``hex``) the least length is part of the pattern, so ordinary
    text yields no ends at all; ``assign`` is matched at any length and short
    values are dropped afterwards, since a dropped match still uses up its text.
    This is right for rules where no match that begins later ends first.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [r.pattern + r.tail for r in rules]
        fold = [r.fold for r in rules]
        self.all = Automaton(whole, fold, search=True)
        self.forward = [Automaton([p], [f]) for p, f in zip(whole, fold, strict=True)]
        self.backward = [Automaton([p], [f], backwards=True) for p, f in zip(whole, fold, strict=True)]
        self.head = [Automaton([r.pattern], [r.fold]) if r.tail else None for r in rules]

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule, end) of each row's matches, as byte offsets in the row."""
        ends, marks = self.all.ends(data, STOP)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule in enumerate(self.rules):
            hits = ends[(marks >> k) & 1 == 1]
            rows = np.searchsorted(bounds, hits, side="left") - 1
            i, row, free = 0, -1, 0
            while i < len(hits):
                if rows[i] != row:
                    row = int(rows[i])
                    free = int(bounds[row])
                end = int(hits[i])
                size = self.backward[k].longest(data[free:end], -1)
                if not size:
                    i += 1
                    continue
                start = end - size
                free = start + self.forward[k].longest(data[start:bounds[row + 1]])
                if not rule.tail or free - start - self.head[k].longest(data[start:free]) >= rule.least:
                    out.setdefault(row, []).append((start - int(bounds[row]), k, free - int(bounds[row])))
                i = max(i + 1, int(np.searchsorted(hits, free, side="right")))
        return out


@functools.cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
         spans_column: str = "spans") -> DataFrame:
    """``docs`` with ``spans_column``: an array of (kind, start, end) of every secret.

    Positions are code points of the whole text, the end exclusive; spans are in
    the order of start, then of ``rules``. Null and empty texts have no spans.
    Repeated rows are scanned alike; other columns pass through, and one named
    like ``spans_column`` is replaced. No shuffle; memory is bounded by an Arrow
    batch plus one long text.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    kinds = [r.kind for r in rules]
    scanner = scanner_of(rules)               # compiled once on the driver; tasks get the arrays
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    if text != spans_column:
        docs = docs.drop(spans_column)

    def found(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, out = text_array(batch.column(text)), []
        for a, b in row_blocks(texts, 8 << 20):
            data, bounds = joined_bytes(texts[a:b], bytes([STOP]))
            spans = scanner.spans(data, bounds)
            for row in range(b - a):
                own = sorted(spans.get(row, ()))
                if own:
                    raw = data[bounds[row]:bounds[row + 1] - 1]
                    points = np.cumsum((raw & 0xC0) != 0x80)         # code points up to each byte
                    at = lambda p: int(points[p - 1]) if p else 0
                    out.append([{"kind": kinds[k], "start": at(s), "end": at(e)} for s, k, e in own])
                else:
                    out.append([])
        return [pa.array(out, arrow)]

    return append_columns(docs, [T.StructField(spans_column, T.ArrayType(span))], found)

