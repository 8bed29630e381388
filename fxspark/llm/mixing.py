"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is a number of words. Targets are filled with blocks of equal size: sources get blocks by the
highest quotients target / (2 k + 1), and each source's blocks go to its regions of shards and then to the shards in the same way,
with their sizes as votes, which gives integer quotas per shard. What quotas of whole blocks leave over or take too much from a
target, less than a few blocks, goes to the source's largest shard, so that sources of any size come near their targets with the
same block. A shard takes whole passes over its words as often as its quota holds them, and the rest as blocks in a seeded random
order; the last of them may be taken in part.

Null text counts 0 words and takes none; a null source is a source of its own, last in order. No document is taken more
than ``most`` times its size. Reruns agree: orders come from hashes of doc_id, text and the seed. Rows with equal doc_id and text
share a shard, which streams through one task; null and repeated doc_ids alone do not gather.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import bounded, stored

MOST = 3
BLOCK = 256  # words of a block
SHARD = 5_000  # documents of a shard
REGION = 1_024  # shards of a region
MOST_SOURCES = 100_000  # sources that a mix may name; more are refused, since weights belong to each


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of all sizes by weight; a share above ``most`` times its size stops there and the rest is shared anew."""
    result, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                result[i] = unit * weights[i]
            break
        for i in full:
            result[i] = float(most * sizes[i])
            left -= result[i]
        stopped = set(full)
        open_ = [i for i in open_ if i not in stopped]
    return result


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); equal quotients in the order of the votes.

    A divisor found by halving gives all but the last few seats at once; those go one by one.
    """
    votes = np.asarray(votes, dtype=np.float64)
    out = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    low, high = votes.sum() / (4.0 * seats + 4.0 * len(votes)), 4.0 * votes.sum() + 1.0
    given = lambda d: np.floor(votes / d + 0.5).astype(np.int64)
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while out.sum() < seats:
        out[np.argmax(votes / (2 * out + 1))] += 1
    return out


def plan_shard(size: int, quota: int, block: int, seed: int, more: int = 0) -> tuple[int, np.ndarray]:
    """Whole passes over the shard, and how many words of each block the last, partial pass takes; ``more`` words beside the quota."""
    wanted = max(0, min(quota * block + more, MOST * size))
    passes, rest = divmod(wanted, size) if size else (0, 0)
    n = -(-size // block)
    takes = np.zeros(max(1, n), dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    length = np.minimum(block, size - order * block)  # the last block may be shorter
    takes[order] = np.clip(rest - (np.cumsum(length) - length), 0, length)
    return int(passes), takes


def taken_before(at: int, takes: np.ndarray, total: np.ndarray, block: int) -> int:
    """Words that the partial pass takes in front of a place; a block gives its first words. ``total``: those of the blocks before each."""
    k = min(at // block, len(takes) - 1)
    return int(total[k]) + min(at - k * block, int(takes[k]))


def tie(seed: int) -> Column:
    """The number by which a document finds its shard and its place there."""
    return F.xxhash64("doc_id", "text", F.lit(seed))


def sources_of(sized: DataFrame, weights=lambda i: i % 3 + 1) -> DataFrame:
    """A row for each source: number, size, target, shards, quota of blocks and the words that the quota misses (or has too many)."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in found], [weights(i) for i in range(len(found))])
    quota = apportion(np.array(goal), round(sum(goal) / BLOCK))
    rows = [(r["source"], i, r["size"], goal[i], max(1, -(-r["n"] // SHARD)), int(quota[i]), round(goal[i]) - int(quota[i]) * BLOCK) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "source string, number int, source_size long, target double, shards long, quota long, more long")


def _divided(part: str):
    """Quotas of the parts among which a quota is divided; the largest part gets the words beside it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(part)
        votes = table.column("size").to_numpy()
        quota, more = apportion(votes, table.column("quota")[0].as_py()), np.zeros(len(votes), np.int64)
        more[np.argmax(votes)] = table.column("more")[0].as_py()
        kept = [c for c in ("number", "region", "shard", "size") if c in table.column_names]
        return table.select(kept).append_column("quota", pa.array(quota, pa.int64())).append_column("more", pa.array(more))

    return run


def plans_of(sharded: DataFrame) -> DataFrame:
    """number, shard, size, quota and more of each shard: source, region and shard by shard, so that no task sees all shards of a large source."""
    of = [F.first("quota").alias("quota"), F.first("more").alias("more")]
    by_shard = sharded.groupBy("number", "shard").agg(F.sum("size").alias("size"), *of).withColumn("region", F.floor(F.col("shard") / REGION))
    regions = by_shard.groupBy("number", "region").agg(F.sum("size").alias("size"), *of)
    regions = regions.groupBy("number").applyInArrow(_divided("region"), "number int, region long, size long, quota long, more long")
    shards = by_shard.drop("quota", "more").join(regions.drop("size"), ["number", "region"])
    return shards.groupBy("number", "region").applyInArrow(_divided("shard"), "number int, region long, shard long, size long, quota long, more long").drop("region")


def mix(docs: DataFrame, row: Column, size: Column, seed: int = 11, keep: bool = False) -> DataFrame:
    """``row`` (any column: an id, or the whole document) with size, source_size, target, passes, taken and cuts.

    ``passes`` whole copies are taken, and the words of ``cuts`` (start and end, counted from 0) once more.
    Texts are not moved more than once: documents are dealt out by shard with the shard's plan in front of them, sorted by hash, and
    stream through. ``keep`` stores a small ``row`` beside its size, so that texts are measured once; whole documents are measured again instead.
    """
    sized = bounded(docs).select("doc_id", "source", row.alias("row"), size.alias("size"), tie(seed).alias("tie"))
    counted = stored(sized if keep else sized.drop("row"), "sizes")
    sources = F.broadcast(sources_of(counted))  # at most MOST_SOURCES rows

    def sharded(frame: DataFrame) -> DataFrame:
        own = sources.withColumnRenamed("source", "of")
        return frame.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod("tie", F.col("shards")))

    none = lambda kind: F.lit(None).cast(kind)
    placed = sharded(counted if keep else sized).select(
        "number", "shard", F.lit(1).alias("order"), "tie", "doc_id", "row", "size", "source_size", "target", none("long").alias("quota"), none("long").alias("more"))
    kinds = dict(placed.dtypes)
    plans = plans_of(sharded(counted)).select(
        "number", "shard", F.lit(0).alias("order"), *(none(kinds[c]).alias(c) for c in ("tie", "doc_id", "row")), "size", none("long").alias("source_size"), none("double").alias("target"), "quota", "more")
    # A shard must lie whole in one task, behind its plan. Only a stated number of partitions keeps adaptive plans from splitting or merging this shuffle.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plans.unionByName(placed).repartition(parts, "number", "shard").sortWithinPartitions("number", "shard", "order", "tie", "doc_id", "size")
    kind = kinds["row"]

    def run(parts):
        block, at, passes, takes, before = BLOCK, 0, 0, None, None
        for part in parts:
            col = lambda c: part.column(part.schema.get_field_index(c))
            all_passes, all_taken, all_cuts = [], [], []
            for number, shard, document, n, quota, more in zip(*(col(c).to_pylist() for c in ("number", "shard", "order", "size", "quota", "more"))):
                if not document:
                    at = 0
                    passes, takes = plan_shard(n, quota, block, seed * 1_000_003 + number * 65_537 + shard, more)
                    before = np.concatenate([[0], np.cumsum(takes)])  # words that the blocks before each give
                    continue
                first, last = at // block, (at + n - 1) // block if n else -1
                cuts, got = [], 0
                if n:
                    got = taken_before(at + n, takes, before, block) - taken_before(at, takes, before, block)
                    if got:
                        for k in (np.flatnonzero(takes[first : last + 1]) + first).tolist():
                            a, b = max(at, k * block), min(at + n, k * block + int(takes[k]))
                            if a < b:
                                if cuts and cuts[-1]["end"] == a - at:
                                    cuts[-1]["end"] = b - at
                                else:
                                    cuts.append({"start": a - at, "end": b - at})
                at += n
                all_passes.append(passes)
                all_taken.append(passes * n + got)
                all_cuts.append(cuts)
            documents = pc.equal(col("order"), 1)
            yield pa.RecordBatch.from_arrays(
                [*(col(c).filter(documents) for c in ("row", "size", "source_size", "target")), pa.array(all_passes, pa.int64()), pa.array(all_taken, pa.int64()),
                 pa.array(all_cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["row", "size", "source_size", "target", "passes", "taken", "cuts"])

    return ordered.mapInArrow(run, f"row {kind}, size long, source_size long, target double, passes long, taken long, cuts array<struct<start: bigint, end: bigint>>")


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: whole copies, and a row for each of the ``cuts``, with the text between its first and last word; columns as before.

    A cut over all words is a whole copy. ``n_chars``, where there is one, follows a cut.
    """
    own = docs.columns
    chosen = mix(docs, F.struct(*own), words(F.col("text")), seed)
    gap = r"\x20\x09-\x0D"
    parts = F.regexp_extract_all("row.text", F.lit(f"[^{gap}]+[{gap}]*"), F.lit(0))  # words, each with the white space behind it

    def piece(c: Column) -> Column:
        start, end = c["start"].cast("int"), c["end"].cast("int")
        front = F.array_join(F.slice("w", start + 1, end - start - 1), "")
        text = F.concat(front, F.regexp_extract(F.element_at("w", end), f"^[^{gap}]+", 0))
        cut = (start > 0) | (end < F.col("size"))
        return F.struct(F.when(cut, text).otherwise(F.col("row.text")).alias("text"), cut.alias("cut"))

    whole = F.array_repeat(F.struct(F.col("row.text").alias("text"), F.lit(False).alias("cut")), F.col("passes").cast("int"))
    each = chosen.filter("size > 0").withColumn("w", F.when(F.size("cuts") > 0, parts)).select("row", F.explode(F.concat(whole, F.transform("cuts", piece))).alias("copy"))
    now = {"text": F.col("copy.text"), "n_chars": F.when(F.col("copy.cut"), F.length("copy.text")).otherwise(F.col("row")["n_chars"]) if "n_chars" in own else None}
    kinds = dict(docs.dtypes)
    return each.select(*[(now[c].cast(kinds[c]) if c in now else F.col("row")[c]).alias(c) for c in own])
