"""One deterministic automaton for many patterns, run over bytes in one pass.

Patterns are compiled to a nondeterministic automaton, joined, made
deterministic by subset construction and minimised by partition refinement.
The result is a transition array over byte classes. A buffer is cut into lanes
that advance together, one array lookup a byte for all lanes; a lane whose
guessed first state proves wrong is run again from the right one, so the
result is that of a single left-to-right pass.

Pattern syntax: literals, ``[a-z]`` classes, ``(a|b)`` groups, ``\\xHH`` and
``\\`` escapes, and the suffixes ``?``, ``*``, ``+``, ``{m}``, ``{m,}``.
"""

from __future__ import annotations

import numpy as np

LANE = 2048


class _Nfa:
    def __init__(self, fold: bool):
        self.fold, self.moves, self.free = fold, [], []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


class _Parser:
    """Recursive descent over one pattern; each part is a function that adds its states."""

    def __init__(self, text: str, nfa: _Nfa):
        self.t, self.i, self.nfa = text, 0, nfa

    def either(self):
        parts = [self.sequence()]
        while self.i < len(self.t) and self.t[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())

        def add(a, b):
            for p in parts:
                p(a, b)
        return add

    def sequence(self):
        parts = []
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            parts.append(self.repeated())

        def add(a, b):
            for p in parts:
                c = self.nfa.state()
                p(a, c)
                a = c
            self.nfa.free[a].append(b)
        return add

    def repeated(self):
        part = self.one()
        c = self.t[self.i] if self.i < len(self.t) else ""
        least, more, extra = 1, False, 0
        if c and c in "?*+":
            self.i += 1
            least, more, extra = {"?": (0, False, 1), "*": (0, True, 0), "+": (1, True, 0)}[c]
        elif c == "{":
            end = self.t.index("}", self.i)
            low, comma, _ = self.t[self.i + 1:end].partition(",")
            self.i = end + 1
            least, more = int(low), bool(comma)

        def add(a, b):
            for _ in range(least):
                c = self.nfa.state()
                part(a, c)
                a = c
            if extra:
                part(a, b)
            if more:
                loop = self.nfa.state()
                self.nfa.free[a].append(loop)
                part(loop, loop)
                a = loop
            self.nfa.free[a].append(b)
        return add

    def escape(self) -> int:
        if self.t[self.i] == "x":
            self.i += 3
            return int(self.t[self.i - 2:self.i], 16)
        self.i += 1
        return ord(self.t[self.i - 1])

    def char(self) -> int:
        c = self.t[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)

    def one(self):
        c = self.t[self.i]
        if c == "(":
            self.i += 1
            inner = self.either()
            self.i += 1
            return inner
        if c == "[":
            self.i += 1
            chars = set()
            while self.t[self.i] != "]":
                low = high = self.char()
                if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                    self.i += 1
                    high = self.char()
                chars |= set(range(low, high + 1))
            self.i += 1
        else:
            chars = {self.char()}
        if self.nfa.fold:
            chars |= {x ^ 32 for x in chars if chr(x).isascii() and chr(x).isalpha()}
        found = frozenset(chars)

        def add(a, b):
            self.nfa.moves[a].append((found, b))
        return add


def _minimal(table: list[list[int]], marks: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Refine the partition by accept marks until no class can be split."""
    t = np.array(table)
    block = np.unique(np.array(marks), return_inverse=True)[1]
    while True:
        _, first, new = np.unique(np.column_stack([block[:, None], block[t]]), axis=0,
                                  return_index=True, return_inverse=True)
        new = new.reshape(-1)
        if len(first) == block.max() + 1:
            return new[t[first]], np.array(marks)[first], int(new[0])
        block = new


class Automaton:
    """Minimal automaton of several patterns; ``fold`` makes ASCII letters match either case.

    ``search``: find matches that start anywhere (else only at the first byte).
    ``backwards``: recognise the reversed strings. ``mark[state]`` has bit i
    set if pattern i ends there.
    """

    def __init__(self, patterns: list[str], fold: list[bool], search: bool = False,
                 backwards: bool = False):
        nfa = _Nfa(False)
        start, ends = nfa.state(), {}
        for i, (pattern, f) in enumerate(zip(patterns, fold, strict=True)):
            nfa.fold = f
            a, b = nfa.state(), nfa.state()
            _Parser(pattern, nfa).either()(a, b)
            nfa.free[start].append(a)
            ends[b] = 1 << i
        if backwards:
            nfa, start, ends = self._reversed(nfa, start, ends)
        if search:
            nfa.moves[start].append((frozenset(range(256)), start))
        signature = [[] for _ in range(256)]
        for moves in nfa.moves:
            for chars, _ in moves:
                for c in range(256):
                    signature[c].append(c in chars)
        ids: dict[tuple, int] = {}
        self.byte_class = np.array([ids.setdefault(tuple(s), len(ids)) for s in signature], np.uint8)
        sample = [int(np.flatnonzero(self.byte_class == k)[0]) for k in range(len(ids))]

        def reach(state):
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return {s for s in seen if nfa.moves[s] or s in ends}

        reached = [reach(s) for s in range(len(nfa.moves))]
        step = [{c: set().union(*(reached[b] for chars, b in moves if c in chars)) for c in sample}
                for moves in nfa.moves]
        first = frozenset(reached[start])
        number, order, table = {first: 0}, [first], []
        for subset in order:
            line = []
            for c in sample:
                to = frozenset().union(*(step[s][c] for s in subset))
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                line.append(number[to])
            table.append(line)
        marks = [sum({ends[s] for s in subset if s in ends}) for subset in order]
        t, mark, begin = _minimal(table, marks)
        by_mark = np.argsort(mark != 0, kind="stable")        # accepting states come last
        place = np.argsort(by_mark)
        self.n_classes = t.shape[1]
        self.next = place[t[by_mark]].astype(np.int32)
        self.mark, self.start = mark[by_mark], int(place[begin])
        self.first_accept = int((self.mark == 0).sum())

    @staticmethod
    def _reversed(nfa, start, ends):
        back = _Nfa(False)
        for _ in nfa.moves:
            back.state()
        for a, moves in enumerate(nfa.moves):
            for chars, b in moves:
                back.moves[b].append((chars, a))
            for b in nfa.free[a]:
                back.free[b].append(a)
        begin = back.state()
        back.free[begin] += list(ends)
        return back, begin, {start: 1}

    def ends(self, data: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (exclusive) at which a pattern ends, ascending, and their marks.
        ``stop`` is a byte that no pattern contains; it parts the texts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-n // LANE)
        cls = np.full(lanes * LANE, self.byte_class[stop], np.uint8)
        cls[:n] = self.byte_class[data]
        cls = np.ascontiguousarray(cls.reshape(lanes, LANE).T)
        flat = (self.next.astype(np.int64) * self.n_classes).ravel()
        limit = self.first_accept * self.n_classes
        begin = self.start * self.n_classes
        entry = np.full(lanes, begin, np.int64)
        last = np.full(lanes, -1, np.int64)
        found: dict[int, list] = {}
        run = np.arange(lanes)
        while len(run):                               # a second round is rare, and reruns few lanes
            state = entry[run]
            where, which, to = [], [], []
            steps = cls if len(run) == lanes else np.ascontiguousarray(cls[:, run])
            for j in range(LANE):
                state = flat.take(state + steps[j])
                hit = state >= limit
                if hit.any():
                    at = np.flatnonzero(hit)
                    where.append(run[at] * LANE + j + 1)
                    to.append(state[at])
            for k in run.tolist():
                found.pop(k, None)
            if where:
                pos, st = np.concatenate(where), np.concatenate(to)
                lane = (pos - 1) // LANE
                by = np.lexsort((pos, lane))
                pos, st, lane = pos[by], st[by], lane[by]
                cut = np.flatnonzero(np.diff(lane)) + 1
                for p, s in zip(np.split(pos, cut), np.split(st, cut), strict=True):
                    found[int((p[0] - 1) // LANE)] = [p, s]
            last[run] = state
            want = np.concatenate([[begin], last[:-1]])
            run = np.flatnonzero(want != entry)
            entry = want
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = sorted(found)
        pos = np.concatenate([found[k][0] for k in keys])
        st = np.concatenate([found[k][1] for k in keys])
        keep = pos <= n
        return pos[keep], self.mark[st[keep] // self.n_classes]

    def longest(self, data, step: int = 1) -> int:
        """Length of the longest match at the start of ``data``, read forwards or (-1) backwards."""
        state, best = self.start, 0
        dead = getattr(self, "_dead", None)
        if dead is None:
            dead = self._dead = {int(s) for s in range(len(self.next))
                                 if not self.mark[s] and (self.next[s] == s).all()}
        for n, c in enumerate(data[::step], 1):
            state = int(self.next[state, self.byte_class[c]])
            if self.mark[state]:
                best = n
            elif state in dead:
                break
        return best
