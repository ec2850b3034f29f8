"""Encoding with a given tokenizer file, one library call for each distinct word of a worker."""

from __future__ import annotations

import gc
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortlens.llm.common import row_blocks

END_ID = 2
CACHE_WORDS = 800_000


_ASCII_SPACE = np.array([chr(i).isspace() for i in range(128)])
_ASCII_ALNUM = np.array([chr(i).isalnum() for i in range(128)])


def _edges(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(safe, alnum, mark, bare) of each piece. Safe: it is a newline or, but for the space it may begin with, not empty and
    without white space at either end. By its outer bytes; where one isn't ASCII, by its characters."""
    array = pa.array(pieces, pa.large_string())
    start = np.frombuffer(array.buffers()[1], np.int64)[:len(pieces) + 1]
    data = np.append(np.frombuffer(array.buffers()[2] or b"", np.uint8)[:start[-1]], np.uint8(0))
    first, end = start[:-1], start[1:]
    filled = end > first
    first = first + (filled & (data[first] == 0x20))
    inner, one = end > first, end - start[:-1] == 1
    head, last = np.where(inner, data[first], 0), np.where(filled, data[end - 1], 0)
    safe = inner & ~_ASCII_SPACE[head & 127] & ~_ASCII_SPACE[last & 127] | one & (last == 0x0A)
    alnum = filled & _ASCII_ALNUM[last & 127]
    for i in np.flatnonzero(inner & ((head | last) > 127)).tolist():
        q = pieces[i][1:] if pieces[i][0] == " " else pieces[i]
        safe[i], alnum[i] = not q[0].isspace() and not q[-1].isspace(), q[-1].isalnum()
    return safe, alnum, one & ((last == 0x2C) | (last == 0x2E)), ~filled | one & (last == 0x0A)


class WordEncoder:
    """Ids of whole texts, put together from ids of their pieces.

    Both kinds of tokenizer cut a text before they merge: at white space, and between a letter or
    digit and punctuation. So a piece has the same ids alone as within its text if it begins at a
    single space or newline between two other characters, or is a comma or full stop that ends
    such a piece behind a letter or digit. Each distinct piece is encoded once by the library and
    kept; when more than ``CACHE_WORDS`` are held, those that were met once are dropped. A text
    with any other pattern (double, leading or trailing spaces, a space beside a newline, runs of
    punctuation before a space) is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.number: dict[str, int] = {}
        self.safe, self.alnum, self.mark, self.bare = (np.zeros(0, bool) for _ in range(4))
        self.start, self.uses = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keep the pieces met more than once, if they leave room, else none."""
        keep = self.uses > 1
        if keep.sum() > CACHE_WORDS // 2:
            keep[:] = False
        length = np.diff(self.start)
        self.ids = self.ids[np.repeat(keep, length)]
        self.start = np.concatenate([[0], np.cumsum(length[keep])])
        place = (np.cumsum(keep) - 1).tolist()
        self.number = {p: place[i] for p, i in self.number.items() if keep[i]}
        self.safe, self.alnum, self.mark, self.bare = (x[keep] for x in (self.safe, self.alnum, self.mark, self.bare))
        self.uses = np.ones(len(self.safe), np.int64)

    def _learn(self, pieces: list[str]) -> None:
        coded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        n = len(pieces)
        for name, flags in zip(("safe", "alnum", "mark", "bare"), _edges(pieces), strict=True):
            setattr(self, name, np.append(getattr(self, name), flags))
        self.uses = np.append(self.uses, np.zeros(n, np.int64))
        sizes = np.fromiter(map(len, coded), np.int64, n)
        self.start = np.append(self.start, self.start[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes.sum())))

    @staticmethod
    def _split(texts: pa.Array) -> pa.Array:
        """The pieces of each text."""
        marked = texts.cast(pa.large_string())              # of any size with the marks in it
        for old, new in ((" ", "\0 "), ("\n", "\0\n\0"), (",\0", "\0,\0"), (".\0", "\0.\0")):
            marked = pc.replace_substring(marked, old, new)
        return pc.split_pattern(marked, "\0")

    def encode(self, texts: pa.Array):
        """(ids, bounds) of each block of texts: int32 ids of all its texts, each with
        END_ID behind it, and the n + 1 bounds of the texts in them."""
        for a, b in row_blocks(texts, 1 << 20):
            if len(self.number) > CACHE_WORDS:
                self._trim()
            gc.disable()                        # many lists of strings and numbers, no cycles
            rows = texts[a:b]
            # a text with the mark in it is encoded whole, as it comes
            marked = pc.match_substring(rows, "\0").to_numpy(zero_copy_only=False)
            cut = ~marked & (pc.binary_length(rows).to_numpy(zero_copy_only=False) > 0)
            split = self._split(rows.filter(pa.array(cut)))
            sizes = np.zeros(len(rows), np.int64)
            sizes[cut] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            # a block's pieces become numbers in Arrow; only its distinct ones are looked up
            coded = split.flatten().dictionary_encode()
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            places = list(map(self.number.get, pieces))
            new = [p for p, place in zip(pieces, places, strict=True) if place is None]
            if new:
                self._learn(new)
                places = list(map(self.number.__getitem__, pieces))
            index = np.array(places, np.int64)[coded.indices.to_numpy()]
            self.uses += np.bincount(index, minlength=len(self.uses))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            wrong = ~self.safe[index]
            first = np.zeros(len(index), bool)
            first[bounds[:-1][sizes > 0]] = True
            wrong |= self.mark[index] & (first | ~np.append(False, self.alnum[index[:-1]]))
            last = bounds[1:][sizes > 0] - 1
            outer = np.concatenate([bounds[:-1][sizes > 0], last])
            wrong[outer[self.bare[index[outer]]]] = True
            unsafe = np.concatenate([[0], np.cumsum(wrong)])
            whole = marked | (unsafe[bounds[1:]] - unsafe[bounds[:-1]] > 0) & (sizes > 1)
            length = self.start[index + 1] - self.start[index]
            if whole.any():
                keep = ~np.repeat(whole, sizes)
                index, length, sizes = index[keep], length[keep], np.where(whole, 0, sizes)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            total = np.concatenate([[0], np.cumsum(length)])
            shift = np.repeat(self.start[index] - total[:-1], length)
            flat = self.ids[shift + np.arange(total[-1])]
            parts = {}
            if whole.any():
                at = np.flatnonzero(whole).tolist()
                for i, e in zip(at, self.library.encode_batch_fast(rows.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
                    parts[i] = np.array(e.ids, np.int32)
            own = total[cuts[1:]] - total[cuts[:-1]]
            for i, p in parts.items():
                own[i] = len(p)
            ends = np.cumsum(own + 1)
            out = np.full(int(ends[-1]), END_ID, np.int32)
            fill = np.ones(len(out), bool)
            fill[ends - 1] = False
            for i, p in parts.items():
                out[ends[i] - 1 - len(p):ends[i] - 1] = p
                fill[ends[i] - 1 - len(p):ends[i] - 1] = False
            out[fill] = flat
            gc.enable()
            yield out, np.concatenate([[0], ends])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
