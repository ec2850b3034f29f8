"""Conversation structure repair: faults of each conversation, and its cheapest edits.

Rows are dealt out by ranges of (conversation, turn). A conversation that lies inside one range is
repaired there; one that touches the border of a range may hold any share of all rows, and is
repaired in blocks (see ``_spread``). In both cases a least-cost table over (row, state) is filled
backwards, the arcs on cheapest paths stay, and their nodes are ranked by the least audit of 1, 2, 4,
... edits; the least path is read off the doubled pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import importable, staged

START, USER, ASSISTANT, SYSTEM = range(4)     # states: the role that came last
AFTER = np.array([USER, ASSISTANT, USER, USER])  # the one that an inserted or changed row leads to
ROLES = {USER: "user", ASSISTANT: "assistant"}
NO = 1 << 40                                  # cost of what can't be
KEEP = np.full((4, 4), -1)                    # [initial, state] -> state; initials: s, u, a, other
KEEP[0, START], KEEP[1, [START, ASSISTANT, SYSTEM]], KEEP[2, USER] = SYSTEM, USER, ASSISTANT
LABELS = np.frombuffer(b"DIKR", np.uint8)     # edits, ascending in ASCII
DELETE, CHANGE, INSERT = 3, 2, 2
BLOCK_ROWS, BUFFER_BYTES = 4096, 32 << 20

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]


def faulty(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) damaged by crc32("conv_id:turn") % 20, nulls of
    role and text as one space: 0 drops a row (it stays with ``gone``), 1 empties its text, 2 takes
    [.!?] out, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select("conv_id", "turn", "role", "text", code.alias("code")).select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        (F.col("code") == 0).alias("gone"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


class Block:
    """Rows in order as arrays, cut at ``starts`` into runs (conversations, or blocks of one)."""

    def __init__(self, roles: list[str], forced: np.ndarray, late: np.ndarray, starts: np.ndarray, closed: bool):
        """``closed``: a run ends its conversation, else another run follows it."""
        self.initial = np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r in roles], np.int64)
        self.forced, self.late = forced, late.astype(np.int64)
        self.sizes = np.diff(np.append(starts, len(roles)))
        self.starts, self.closed = starts, closed
        self.level = starts + np.arange(len(starts))      # a run has a level before each row and one at its end
        self.n = len(roles) + len(starts)

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Least cost from every (level, state) on, given those at the end of each run."""
        d = np.full((self.n, 4), NO)
        d[self.level + self.sizes] = inserted(end) if self.closed else end
        by = np.argsort(-self.sizes, kind="stable")
        long = self.sizes[by]
        for i in range(int(long[0]) - 1 if len(long) else -1, -1, -1):
            own = by[:np.searchsorted(-long, -i, side="left")]
            row, at = self.starts[own] + i, self.level[own] + i
            after = d[at + 1]
            best = after + DELETE
            free = ~self.forced[row]
            to = KEEP[self.initial[row]]
            kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NO)
            change = after[:, AFTER] + CHANGE
            best = np.where(free[:, None], np.minimum(best, np.minimum(kept, change) + self.late[row][:, None]), best)
            d[at] = inserted(np.minimum(best, NO))
        return d

    def arcs(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ok, target) of each node (level * 4 + state) and edit: which arcs lie on cheapest paths, and where they lead."""
        ok, target = np.zeros((self.n, 4, 4), bool), np.zeros((self.n, 4, 4), np.int64)
        last = self.level + self.sizes
        at = np.delete(np.arange(self.n), last)                           # levels before rows

        def offer(where, edit, cost, to_level, to_state, allowed):
            to = np.where(to_state >= 0, d[to_level[:, None], np.maximum(to_state, 0)], NO)
            ok[where, :, edit] = allowed & (d[where] < NO) & (to + cost == d[where])
            target[where, :, edit] = to_level[:, None] * 4 + np.maximum(to_state, 0)

        free, late = ~self.forced[:, None], self.late[:, None]
        offer(at, 0, DELETE, at + 1, np.broadcast_to(np.arange(4), (len(at), 4)), np.True_)
        inserting = np.concatenate([at, last]) if self.closed else at
        offer(inserting, 1, INSERT, inserting, np.broadcast_to(AFTER, (len(inserting), 4)), np.True_)
        offer(at, 2, late, at + 1, KEEP[self.initial], free)
        offer(at, 3, CHANGE + late, at + 1, np.broadcast_to(AFTER, (len(at), 4)), free)
        return ok.reshape(-1, 4), target.reshape(-1, 4)

    def audits(self, d: np.ndarray, state: int = START) -> tuple[list[str], np.ndarray]:
        """Least cheapest audit of each run from ``state`` on, and the node where it ends.

        Prefix doubling: nodes are ranked by the first initial of their least audit, then by the first
        2, 4, 8, ...: by the pair of a node's rank and that of the node so many edits on. The arcs of a
        node have different initials, so so many least initials lead to one node. Of a node's arcs the
        least initial, then the least rank of its target is taken; the path is read off the doubled
        pointers."""
        ok, target = self.arcs(d)
        nodes = np.arange(len(ok))
        ends = ~ok.any(axis=1)

        def taken(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            edit = np.where(ok, np.arange(4) * (rank.max(initial=0) + 1) + rank[target], NO).argmin(axis=1)
            return np.where(ends, 0, edit + 1), np.where(ends, nodes, target[nodes, edit])

        label, to = taken(np.zeros(len(ok), np.int64))
        rank = label
        while True:
            rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[to], return_inverse=True)[1]
            if ends[to].all():
                break
            to = to[to]
        label, to = taken(rank)
        jumps = [to]
        while not ends[to].all():
            to = to[to]
            jumps.append(to)
        node = self.level * 4 + state
        final = to[node]
        owner, off = np.arange(len(node)), np.zeros(len(node), np.int64)
        live = ~ends[node]
        node, owner, off = node[live], owner[live], off[live]
        for k in range(len(jumps) - 1, -1, -1):
            ahead = jumps[k][node]
            live = ~ends[ahead]
            node, owner, off = (np.concatenate([x, y[live]]) for x, y in ((node, ahead), (owner, owner), (off, off + (1 << k))))
        by = np.lexsort((off, owner))
        text = LABELS[label[node[by]] - 1].tobytes().decode()
        cuts = np.searchsorted(owner[by], np.arange(len(self.sizes) + 1)).tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:])], final


def inserted(d: np.ndarray) -> np.ndarray:
    """Costs with insertions at the same place; twice in a row lead back, so twice are enough."""
    for _ in range(2):
        d = np.minimum(d, d[:, AFTER] + INSERT)
    return d


END = np.array([0, NO, 0, NO])                # a path ends before the first row or after an assistant's


def replay(audit: str, roles: list[str], texts: list[str], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that the edits leave."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = int(KEEP[{"s": 0, "u": 1, "a": 2}.get(roles[at][:1], 3), state])
            yield edit, roles[at], texts[at]
        else:
            state = int(AFTER[state])
            yield edit, ROLES[state], texts[at] if edit == "R" else ""
        at += edit != "I"


def _columns(batches: list[pa.RecordBatch]) -> dict[str, list]:
    return {c: [x for b in batches for x in b.column(c).to_pylist()] for c in ("conv_id", "turn", "role", "text", "gone", "blank", "cut")}


def _repaired(rows: dict[str, list], turns: bool) -> list[dict]:
    """Results of whole conversations, whose rows stand in order."""
    ids = rows["conv_id"]
    first = np.flatnonzero([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
    conv = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    here = np.flatnonzero(~np.array(rows["gone"], bool))
    conv, roles, texts = conv[here], [rows["role"][i] for i in here], [rows["text"][i] for i in here]
    turn = [rows["turn"][i] for i in here]
    blank, cut = np.array(rows["blank"], bool)[here], np.array(rows["cut"], bool)[here]
    seen: set = set()
    duplicate = np.zeros(len(here), bool)
    for i, x in enumerate(zip(conv.tolist(), roles, texts, strict=True)):
        duplicate[i] = x in seen
        seen.add(x)
    duplicate &= ~blank
    cut &= ~(blank | duplicate)
    starts = np.searchsorted(conv, np.arange(len(first)))
    block = Block(roles, blank | duplicate, cut, starts, closed=True)
    d = block.costs(np.broadcast_to(END, (len(first), 4)))
    audits, _ = block.audits(d)
    legal = {"su", "ua", "au"}
    illegal = np.array([False] + [roles[i - 1][:1] + roles[i][:1] not in legal for i in range(1, len(roles))], bool)[:len(roles)]
    illegal[starts[block.sizes > 0]] = False
    count = lambda x: np.bincount(conv, x, len(first)).astype(np.int64)
    totals = [count(x) for x in (blank, duplicate, cut, illegal)]
    out = []
    for c, (s, n) in enumerate(zip(starts.tolist(), block.sizes.tolist(), strict=True)):
        known = {t for t in turn[s:s + n] if t is not None}
        left = list(replay(audits[c], roles[s:s + n], texts[s:s + n]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in left).encode("utf-8", "surrogatepass")).hexdigest()
        out.append({"conv_id": ids[first[c]], "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
                    "blank": totals[0][c], "duplicate": totals[1][c], "truncated": totals[2][c], "illegal": totals[3][c],
                    "cost": int(d[block.level[c], START]), "audit": audits[c], "repaired_sha256": digest,
                    "turns": [{"edit": e, "role": r, "text": t} for e, r, t in left] if turns else None})
    return out


def _spread(rows: DataFrame, block_rows: int) -> DataFrame:
    """RESULT of conversations of any size, by key ``ck``; ``rows``: their rows with places ``pos`` in order.

    Blocks of ``block_rows`` rows are worked on apart. A block's least costs between its first
    and last states are a table of 4 by 4; folding these from the end gives the costs at each
    block's end, with which it finds its least audit from each first state. The states at the borders
    follow from the start on. One task sees one table a block (less than the audit itself, which is
    one cell of the result). The digest needs the text in order, so it is taken in a stream."""
    same = F.sha2(F.concat_ws("\u0001", "ck", F.char_length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumns({"same": same, "part": F.shiftright("pos", 33),
                             "blk": F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)})
    firsts = rows.where("not gone and not blank").groupBy("same").agg(F.min("pos").alias("first_pos"))
    rows = rows.join(firsts, "same", "left").withColumn("dup", F.coalesce(F.col("pos") > F.col("first_pos"), F.lit(False)) & ~F.col("blank"))
    rows = staged(rows.withColumn("cut", F.col("cut") & ~F.col("dup") & ~F.col("blank")).drop("same", "first_pos"), "open-rows")
    keys = ["ck", "part", "blk"]

    def loaded(table: pa.Table) -> tuple[Block, dict]:
        t = table.sort_by("pos")
        x = {c: t.column(c).to_pylist() for c in ("turn", "role", "gone", "blank", "dup", "cut", "text") if c in t.column_names}
        here = [i for i, g in enumerate(x["gone"]) if not g]
        x = {c: [v[i] for i in here] for c, v in x.items()}
        forced = np.array(x["blank"], bool) | np.array(x["dup"], bool)
        return Block(x["role"], forced, np.array(x["cut"], bool), np.zeros(1, np.int64), closed=False), x

    def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(list(batches))

    def measure(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, x = loaded(whole(batches))
        table = [block.costs(np.where(np.arange(4) == e, 0, NO)[None, :])[0].tolist() for e in range(4)]
        known = [t for t in x["turn"] if t is not None]
        pairs = [a[:1] + b[:1] for a, b in zip(x["role"], x["role"][1:])]
        row = {"ck": key[0].as_py(), "part": key[1].as_py(), "blk": key[2].as_py(), "costs": [v for r in table for v in r],
               "n": len(x["role"]), "turns": len(set(known)), "low": known[0] if known else None, "high": known[-1] if known else None,
               "first": x["role"][0][:1] if x["role"] else None, "last": x["role"][-1][:1] if x["role"] else None,
               "blank": sum(x["blank"]), "duplicate": sum(x["dup"]), "truncated": sum(x["cut"]),
               "illegal": sum(p not in ("su", "ua", "au") for p in pairs)}
        yield pa.RecordBatch.from_pylist([row], schema=MEASURED)

    narrow = rows.select(*keys, "pos", "turn", "role", "gone", "blank", "dup", "cut")
    measured = staged(narrow.groupBy(*keys).applyInArrow(
        measure, "ck string, part long, blk long, costs array<long>, n long, turns long, low long, high long, first string, last string, "
        "blank long, duplicate long, truncated long, illegal long"), "open-blocks")

    def backwards(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "blk"])
        end = inserted(END[None, :])[0]
        ends = []
        for costs in reversed(own["costs"].tolist()):
            ends.append(end.tolist())
            table = np.array(costs, np.int64).reshape(4, 4)               # [last state, first state]
            end = np.minimum((table + end[:, None]).min(axis=0), NO)
        out = own[["ck", "part", "blk"]].assign(ends=ends[::-1])
        known = own[own["low"].notna()]
        met = int((known["low"].iloc[1:].to_numpy() == known["high"].iloc[:-1].to_numpy()).sum())
        full = own[own["n"] > 0]
        joints = zip(full["last"].tolist(), full["first"].tolist()[1:])
        total = {"gaps": int(known["high"].iloc[-1] - known["low"].iloc[0] + 1 - (known["turns"].sum() - met)) if len(known) else 0,
                 "illegal": int(own["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in joints), "cost": int(end[START])}
        total |= {c: int(own[c].sum()) for c in ("blank", "duplicate", "truncated")}
        return pd.concat([out, pd.DataFrame([{"ck": own["ck"].iloc[0], "part": -1, "blk": -1, "ends": None} | total])])

    folded = staged(measured.groupBy("ck").applyInPandas(
        backwards, "ck string, part long, blk long, ends array<long>, " + ", ".join(f"{c} long" for c in COUNTS)), "open-ends")

    def paths(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        block, _ = loaded(table)
        d = block.costs(np.array([table.column("ends")[0].as_py()]))
        found = [block.audits(d, s) for s in range(4)]
        yield pa.RecordBatch.from_pydict({"ck": [key[0].as_py()], "part": [key[1].as_py()], "blk": [key[2].as_py()],
                                          "audits": [[a[0] for a, _ in found]], "to": [[int(e[0]) % 4 for _, e in found]]}, schema=PATHS)

    walked = staged(narrow.join(folded.where("part >= 0").select(*keys, "ends"), keys).groupBy(*keys).applyInArrow(
        paths, "ck string, part long, blk long, audits array<string>, to array<int>"), "open-paths")

    def forwards(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "blk"])
        state, states, pieces = START, [], []
        for audits, to in zip(own["audits"].tolist(), own["to"].tolist(), strict=True):
            states.append(state)
            pieces.append(audits[state])
            state = int(to[state])
        close = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]
        if pieces:
            pieces[-1] += close
        return own[["ck", "part", "blk"]].assign(state=states, audit=pieces)

    chosen = staged(walked.groupBy("ck").applyInPandas(forwards, "ck string, part long, blk long, state int, audit string"), "open-audits")

    def lines(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        _, x = loaded(table)
        left = list(replay(table.column("audit")[0].as_py(), x["role"], x["text"], table.column("state")[0].as_py()))
        n = len(left)
        yield pa.RecordBatch.from_pydict({
            "ck": [key[0].as_py()] * n, "part": [key[1].as_py()] * n, "blk": [key[2].as_py()] * n, "at": list(range(n)),
            "edit": [e for e, _, _ in left], "role": [r for _, r, _ in left], "text": [t for _, _, t in left]}, schema=LINES)

    kept = staged(rows.join(chosen, keys).groupBy(*keys).applyInArrow(
        lines, "ck string, part long, blk long, at long, edit string, role string, text string"), "open-turns")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            for ck, role, text in zip(*(batch.column(c).to_pylist() for c in ("ck", "role", "text")), strict=True):
                if ck != now and digest:
                    yield pa.RecordBatch.from_pydict({"ck": [now], "repaired_sha256": [digest.hexdigest()]})
                digest, start = (hashlib.sha256(), "") if ck != now else (digest, "\n")
                now = ck
                digest.update(f"{start}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            yield pa.RecordBatch.from_pydict({"ck": [now], "repaired_sha256": [digest.hexdigest()]})

    hashed = kept.repartition("ck").sortWithinPartitions(*keys, "at").select("ck", "role", "text").mapInArrow(
        digests, "ck string, repaired_sha256 string")
    ordered = chosen.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "blk", "audit"))).alias("p")).select(
        "ck", F.array_join(F.transform("p", lambda p: p["audit"]), "").alias("audit"))
    turns = kept.groupBy("ck").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "blk", "at", "edit", "role", "text"))),
                                              lambda p: F.struct(p["edit"].alias("edit"), p["role"].alias("role"), p["text"].alias("text"))).alias("turns"))
    out = folded.where("part < 0").select("ck", *COUNTS).join(ordered, "ck", "left").join(hashed, "ck", "left")
    return out.join(turns, "ck", "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).withColumn("audit", F.coalesce("audit", F.lit("")))


MEASURED = pa.schema([("ck", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("costs", pa.list_(pa.int64()))] +
                     [(c, pa.int64()) for c in ("n", "turns", "low", "high")] + [("first", pa.string()), ("last", pa.string())] +
                     [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")])
PATHS = pa.schema([("ck", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("audits", pa.list_(pa.string())), ("to", pa.list_(pa.int32()))])
LINES = pa.schema([("ck", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("at", pa.int64())] + [(c, pa.string()) for c in ("edit", "role", "text")])
TURNS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]))


def repair(rows: DataFrame, turns: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, and optionally ``gone`` for a row
    that only names its conversation): the counts, the cost and initials of the cheapest edits, and the
    digest of what they leave; with ``turns`` also these rows, as an array of (edit, role, text).

    Rows go by turn, nulls first; rows of one turn by role, the text's first 64 characters and
    its hash, so that the result doesn't depend on how the table is stored. A null conv_id is one
    conversation, null roles and texts are one space. Other columns are left out. An empty
    table gives no rows.
    """
    importable(rows.sparkSession)
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    space = r"\x20\x09-\x0D"
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.when(F.col("gone"), "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), "gone")
    order = ["conv_id", "turn", "role", "head", "hash"]
    rows = (rows.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
            .repartitionByRange(*order, "salt").sortWithinPartitions(*order, "text", "salt")
            .select("conv_id", "turn", "role", "text", "gone",
                    (~F.col("gone") & ~F.col("text").rlike(f"[^{space}]")).alias("blank"),
                    (~F.col("gone") & F.col("text").rlike(rf"[^{space}.!?][{space}]*\z")).alias("cut"),
                    F.monotonically_increasing_id().alias("pos")))
    schema = T.StructType([T.StructField("open", T.BooleanType()), *[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *[f for f in RESULT if f.name not in ("blank",)],
                           T.StructField("n_blank", T.LongType())])
    schema = schema if not turns else schema.add("turns", TURNS)
    names = schema.names
    fields = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def raw(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = {c: batch.column(c) for c in fields} | {"open": pa.array([True] * batch.num_rows)}
            return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(batch.num_rows, t)) for c, t in zip(names, kinds, strict=True)], names=names)

        def results(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            found = [{**r, "n_blank": r["blank"], "open": False, "blank": None} for r in _repaired(_columns(held), turns)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], t) for c, t in zip(names, kinds, strict=True)], names=names)

        held, last, at_border = [], [], True
        n_held = n_last = 0                                  # bytes
        # the first conversation may begin in an earlier range: its rows go on; so do the last one's, or one that fills the buffer
        for batch in batches:
            if kinds is None:
                of = {f.name: f.type for f in batch.schema}
                more = {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in RESULT}
                of = more | {"open": pa.bool_(), "n_blank": pa.int64()} | of | (
                    {"turns": pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))} if turns else {})
                kinds = [of[c] for c in names]
            ids = batch.column("conv_id").to_pylist()
            row_bytes = batch.nbytes / max(batch.num_rows, 1)
            cuts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if last and last[0] != ids[a]:
                    if at_border:
                        at_border = False
                    else:
                        held.extend(last[1])
                        n_held += n_last
                        if n_held > BUFFER_BYTES or len(held) > 5_000:
                            yield results(held)
                            held, n_held = [], 0
                    last = []
                if not last:
                    last, n_last = [ids[a], []], 0
                if at_border:
                    yield raw(part)
                    continue
                last[1].append(part)
                n_last += row_bytes * (b - a)
                if n_last > BUFFER_BYTES:
                    for x in last[1]:
                        yield raw(x)
                    last[1], at_border = [], True
        if held:
            yield results(held)
        for x in last[1] if last else []:
            yield raw(x)

    done = staged(rows.mapInArrow(run, schema), "conversations")
    of_result = ["conv_id", "gaps", F.col("n_blank").alias("blank"), *COUNTS[2:], "audit", "repaired_sha256"] + ["turns"] * turns
    ck = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    wide = done.where("open").select("conv_id", ck.alias("ck"), "turn", "role", "text", "gone", "blank", "cut", "pos")
    far = _spread(wide.drop("conv_id"), block_rows)
    named = wide.groupBy("ck").agg(F.first("conv_id").alias("conv_id")).join(far, "ck")
    return done.where("not open").select(*of_result).unionByName(
        named.select("conv_id", *COUNTS, "audit", "repaired_sha256", *(["turns"] * turns)))
