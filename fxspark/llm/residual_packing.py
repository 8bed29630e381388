"""Best-fit packing by levels of residual bins.

Documents longer than a sequence are cut into full pieces and one rest. A task packs the pieces it meets by best fit, longest
first: each goes into the fullest bin that still holds it. Bins with at most ``NEAR`` tokens of room are done. The others are
items of the next level: their tasks are leaves of a binary tree, and each round merges whole branches into nodes of about
``GROUP`` bins, where the same best fit packs bins into bins. Rounds end when one node is left, or when merging would need nodes
larger than that: then the bins of a node found nothing to go with in a whole group, and they stay as they are.

Only rows of bins and of pieces in underfull bins are shuffled, never texts. Null and empty texts have their closing token only.
Rows with equal or null doc_id are packed each on its own. A task holds the lengths of ``LEAF`` pieces or ``GROUP`` bins at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import stored, texts
from fxspark.llm.slack_packing import ids_of

CAPACITY = 4096
END = 1  # closes a document
NEAR = 16  # tokens of room that a finished bin may have
LEAF = 50_000  # pieces that a task packs together
GROUP = 20_000  # bins that a node packs together
DEPTH = 24  # levels of the tree: a leaf's label has so many bits


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each item the bin it goes into and its offset there; longest items first, each into the fullest bin that holds it.

    ``open_`` has a bit for each room that some bin has, so the least room that suffices is one shift and one lowest bit away.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, by_room, n_bins = 0, {}, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = open_ >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            waiting = by_room[room]
            into = waiting.pop()
            if not waiting:
                open_ ^= 1 << room
        else:
            into, room, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = into, capacity - room
        left = room - length
        if left:
            by_room.setdefault(left, []).append(into)
            open_ |= 1 << left
    return bins, offsets


LEAVES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int, label int"


def leaves(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, leaf: int = LEAF) -> DataFrame:
    """A row for each piece: its place in its document, its bin, its offset there, how full the bin is and the leaf's label."""
    closing = np.array([END], dtype="<u4").tobytes()

    def run(parts):
        from pyspark import TaskContext

        import xxhash

        part, number, ids, cols = TaskContext.get().partitionId(), 0, ids_of(tokenizer), [[] for _ in range(5)]

        def packed() -> pa.RecordBatch:
            lengths = np.array(cols[3], np.int64)
            bins, offset = best_fit(lengths, capacity)
            fill = np.bincount(bins, weights=lengths).astype(np.int32)[bins] if len(bins) else bins
            label = xxhash.xxh32_intdigest(f"{part}:{number}") >> 32 - DEPTH
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            whole = [*cols, (part << 40 | number << 24) + bins, offset, fill, np.full(len(bins), label, np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(whole, kinds)], [c.split()[0] for c in LEAVES.split(", ")])

        for batch in parts:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(ids.of(text) + closing)
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    body = data[4 * start : 4 * min(n, start + capacity)]
                    for c, x in zip(cols, (doc_id, piece, start, len(body) // 4, zlib.crc32(body))):
                        c.append(x)
                    if len(cols[0]) == leaf:
                        yield packed()
                        number += 1
                        for c in cols:
                            c.clear()
        if cols[0]:
            yield packed()
        ids.forget()  # the worker may go on to other work

    return texts(docs).mapInArrow(run, LEAVES)


#: A bin as an item: its number, its tokens, its leaf or branch, and the leaves' bins in it with the place where each begins.
BINS = "bin long, fill int, label int, members array<struct<bin: bigint, shift: bigint>>"
MEMBERS = pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))


def merged(bins: DataFrame, shift: int, capacity: int) -> DataFrame:
    """One round: the bins of each branch (labels without their last ``shift`` bits) are packed into each other by best fit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        fill, name = table.column("fill").to_numpy().astype(np.int64), table.column("bin").to_numpy()
        into, offset = best_fit(fill, capacity)
        order = np.lexsort((offset, into))
        first = np.flatnonzero(np.r_[True, np.diff(into[order]) > 0])
        members = table.column("members").to_pylist()
        joined = [[] for _ in first]
        for i in order.tolist():
            joined[into[i]] += [{"bin": m["bin"], "shift": m["shift"] + int(offset[i])} for m in members[i]]
        heads, sums = order[first], np.add.reduceat(fill[order], first).astype(np.int32)
        return pa.table({"bin": pa.array(name[heads]), "fill": pa.array(sums), "label": table.column("label").take(pa.array(heads)), "members": pa.array(joined, MEMBERS)})

    return bins.groupBy(F.shiftright("label", shift).alias("branch")).applyInArrow(run, BINS)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, near: int = NEAR, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = stored(leaves(docs, tokenizer, capacity, leaf), "leaves")
    underfull = F.col("fill") < capacity - near
    left = pieces.filter(underfull & (F.col("offset") == 0)).select(
        "bin", "fill", "label", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))
    bits, moves = DEPTH + 1, []
    while True:
        n = left.count()
        least = max(0, (-(-n // group) - 1).bit_length())  # a branch has about ``group`` bins: 2 ** least branches
        if not n or least >= bits:
            break
        bits = least
        done = stored(merged(left, DEPTH - bits, capacity), "bins")
        moves.append(done.filter(~underfull) if bits else done)
        left = done.filter(underfull)
        if not bits:
            break
    if bits:
        moves.append(left)
    placed = moves[0]
    for more in moves[1:]:
        placed = placed.unionByName(more)
    placed = placed.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), "m.shift")
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(~underfull).select(*own, F.col("bin").alias("sequence_id"), "offset")
    moved = pieces.filter(underfull).join(placed, "bin").select(*own, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    return full.unionByName(moved)
