"""Similarity join on word n-grams: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of n-grams. The join is exact:

1. Every n-gram of every text goes, as a hash in compressed blocks, to the task that owns its range of hashes, which counts
   in how many documents it stands. Columns of the matrix with one entry cannot add to an overlap and go no further.
2. An overlap of three quarters leaves no way around the rarest quarter of a set. A document with more n-grams of its own than
   that quarter holds links with nothing; the others meet at the rarest n-grams they have, in stars, never in pairs.
3. Each connected cluster of those stars is a diagonal block of the product. Rows of a block are multiplied one at a
   time; entries below the bound that the two sizes give are discarded. Rows that lie in the largest component
   need no product among themselves, since they are connected already.
4. A cluster with more entries than fit a task is dealt into chunks, which are multiplied chunk by chunk.

Null and empty texts have an empty set and link with nothing. Equal sets are one row of the matrix, so that copies cost one
row per block of documents. Repeated rows are copies. Other columns stay behind.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import WordHashes, bounded, raw, stored
from fxspark.llm.components import components

N = 5
PERCENT = 75
BLOCK = 600_000  # n-grams of a block of documents
CHUNK = 2_000_000  # entries of the matrix that one task multiplies

U64 = np.uint64


def grams(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    width = min(n, len(words))
    last = len(words) - width + 1
    with np.errstate(over="ignore"):
        x = words[:last] + U64(width)
        for j in range(1, width):
            x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9) + words[j : last + j]
        x = (x ^ (x >> U64(32))) * U64(0x94D049BB133111EB)
        return np.unique(x ^ (x >> U64(29)))


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many of the rarest of n entries no partner can avoid."""
    return n - -(-percent * n // 100) + 1


# ---- blocks of documents, and in how many of them each n-gram stands

_WIRE = "bucket int, kind int, block string, high binary, low binary, place binary"


def _blocks(docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Kind 0: n-grams of a block that fall in one bucket, with the place of their document. Kind 1: the block's documents."""

    def run(parts):
        from pyspark import TaskContext

        task, number, hashes = TaskContext.get().partitionId(), 0, WordHashes(150_000)
        sets: dict[tuple[int, int], int] = {}
        kept: list[np.ndarray] = []
        ids, of, total = [], [], 0

        def flush():
            nonlocal sets, kept, ids, of, total, number
            name = f"{task}-{number}"
            keys = np.concatenate(kept) if kept else np.zeros(0, U64)
            place = np.repeat(np.arange(len(kept), dtype=np.uint16), [len(k) for k in kept])
            bucket = ((keys & U64(0xFFFF)) * U64(buckets) >> U64(16)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            keys, place = keys[order] >> U64(16), place[order]
            high, low = (keys >> U64(16)).astype(np.uint32), (keys & U64(0xFFFF)).astype(np.uint16)
            rows = [(b, 0, name, high[i:j].tobytes(), low[i:j].tobytes(), place[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if i < j]
            table = np.array([(s, m) for s, m in sets], dtype=np.int64).reshape(-1, 2)
            null = np.array([i is None for i in ids], dtype=np.int64)
            doc = np.stack([np.array([i or 0 for i in ids], dtype=np.int64), null, np.array(of, dtype=np.int64)])
            rows.append((zlib.crc32(name.encode()) % buckets, 1, name, table.tobytes(), doc.tobytes(), b""))
            sets, kept, ids, of, total, number = {}, [], [], [], 0, number + 1
            cols = list(zip(*rows))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "kind", "block", "high", "low", "place"])

        for part in (batch.slice(at, 500) for batch in parts for at in range(0, batch.num_rows, 500)):
            for doc_id, text in zip(part.column(0).to_pylist(), raw(part.column(1))):
                found = grams(hashes.of((text or b"").lower().split()), n)
                key = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True), len(found)
                if key not in sets:
                    sets[key] = len(kept)
                    kept.append(found)
                    total += len(found)
                ids.append(doc_id)
                of.append(sets[key])
                if total >= BLOCK or len(kept) >= 65_000:
                    yield flush()
        if ids:
            yield flush()

    return bounded(docs).select("doc_id", "text").mapInArrow(run, _WIRE)


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's n-grams those that stand in two documents or more, with their count (255: that or more), per block."""
    own = frame[frame["kind"] == 0]
    out = frame[frame["kind"] == 1]
    if not len(own):
        return out
    high = np.concatenate([np.frombuffer(x, np.uint32) for x in own["high"]]).astype(U64)
    keys = high << U64(16) | np.concatenate([np.frombuffer(x, np.uint16) for x in own["low"]])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    seen = np.empty(len(keys), np.uint8)
    seen[order] = np.repeat(np.minimum(counts, 255), counts)
    del order, ordered
    rows, at, bucket = [], 0, int(own["bucket"].iloc[0])
    for block, a, b, c in zip(own["block"], own["high"], own["low"], own["place"]):
        n = len(c) // 2
        part = seen[at : at + n]
        pick = part > 1
        at += n
        if pick.any():
            hi, lo, place = np.frombuffer(a, np.uint32)[pick], np.frombuffer(b, np.uint16)[pick], np.frombuffer(c, np.uint16)[pick]
            rows.append((bucket, 0, block, hi.tobytes(), lo.tobytes(), place.tobytes() + part[pick].tobytes()))
    return pd.concat([out, pd.DataFrame(rows, columns=list(frame.columns))]) if rows else out


_ROWS = "kind int, doc_id long, set long, size long, entries binary"


def _rows(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Kind 1: a document and its set. Kind 0: a set that may have partners, its shared n-grams from the rarest on."""
        head = frame[frame["kind"] == 1].iloc[0]
        table = np.frombuffer(head["high"], np.int64).reshape(-1, 2)
        ids, null, of = np.frombuffer(head["low"], np.int64).reshape(3, -1)
        docs = pd.DataFrame({"kind": 1, "doc_id": pd.array(ids, "Int64"), "set": table[of, 0], "size": table[of, 1], "entries": None})
        docs.loc[null == 1, "doc_id"] = pd.NA
        keys, places, counts = [], [], []
        for bucket, kind, a, b, c in zip(frame["bucket"], frame["kind"], frame["high"], frame["low"], frame["place"]):
            if kind == 0:
                n = len(b) // 2
                keys.append(np.frombuffer(a, np.uint32).astype(U64) << U64(16) | np.frombuffer(b, np.uint16) | U64(bucket % 65536) << U64(48))
                places.append(np.frombuffer(c[: 2 * n], np.uint16))
                counts.append(np.frombuffer(c[2 * n :], np.uint8))
        rows = []
        if keys:
            key, place, count = np.concatenate(keys), np.concatenate(places), np.concatenate(counts)
            order = np.lexsort((key, count, place))
            key, place = key[order], place[order]
            edges = np.searchsorted(place, np.arange(len(table) + 1))
            for i, (name, n) in enumerate(table.tolist()):
                shared = int(edges[i + 1] - edges[i])
                if shared > n - prefix(n, percent):
                    rows.append((0, pd.NA, name, n, key[edges[i] : edges[i + 1]].tobytes()))
        nodes = pd.DataFrame(rows, columns=["kind", "doc_id", "set", "size", "entries"]).astype({"doc_id": "Int64"})
        return pd.concat([docs, nodes]) if rows else docs

    return run


# ---- stars over the rarest n-grams

def _stars(nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Edges ``a``, ``b``: whoever has an n-gram among its rarest is tied to the least set that has it there too."""

    def star(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        hub = np.repeat(sets[first], np.diff(np.concatenate([first, [len(keys)]])))
        apart = hub != sets
        return keys[first], sets[first], np.unique(np.stack([sets[apart], hub[apart]], 1), axis=0)

    def edges_of(found: np.ndarray) -> tuple[bytes, bytes]:
        return found[:, 0].tobytes(), found[:, 1].tobytes()

    names, kinds = ["bucket", "kind", "x", "y"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def local(parts):
        for part in parts:
            keys, sets = [], []
            for name, n, entries in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                have = np.frombuffer(entries, U64)
                own = n - len(have)
                keys.append(have[: prefix(n, percent) - own])
                sets.append(np.full(len(keys[-1]), name, np.int64))
            if not keys:
                continue
            key, hub, found = star(np.concatenate(keys), np.concatenate(sets))
            bucket = (key * U64(0x9E3779B97F4A7C15) >> U64(40)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key, hub = key[order], hub[order]
            rows = [(b, 0, key[i:j].tobytes(), hub[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if i < j]
            for b in range(0, len(found), 4096):
                rows.append((b // 4096 % buckets, 1, *edges_of(found[b : b + 4096])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.stack([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)], 1) for k, x, y in zip(frame["kind"], frame["x"], frame["y"]) if k == 1]
        own = frame[frame["kind"] == 0]
        if len(own):
            found.append(star(np.concatenate([np.frombuffer(x, U64) for x in own["x"]]), np.concatenate([np.frombuffer(x, np.int64) for x in own["y"]]))[2])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    wire = nodes.select("set", "size", "entries").mapInArrow(local, "bucket int, kind int, x binary, y binary")
    return wire.groupBy("bucket").applyInPandas(across, "a long, b long").distinct()


# ---- the product

class Incidence:
    """Rows (sets) by columns (n-grams) as sorted postings."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        _, column = np.unique(np.concatenate(rows), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.posting = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        self.start = np.searchsorted(column[order], np.arange(column.max() + 2 if len(column) else 1))
        self.column, self.edge = column, np.concatenate([[0], np.cumsum(lengths)])

    def product(self, row: int, upto: int | None = None) -> np.ndarray:
        """Overlap of a row with every row, summed over the postings of its columns."""
        columns = self.column[self.edge[row] : self.edge[row + 1]]
        start, count = self.start[columns], self.start[columns + 1] - self.start[columns]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.posting[at], minlength=self.n)


def linked(overlap: np.ndarray, size: int, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Entries of a product row that reach the bound their two sizes give."""
    return (100 + percent) * overlap >= percent * (size + sizes)


def connect(names: np.ndarray, sizes: np.ndarray, rows: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each row of a cluster the least name of its component. Rows outside the largest component are multiplied."""
    matrix, label = Incidence(rows), np.arange(len(rows))
    done = np.zeros(len(rows), bool)
    todo = [int(np.argmax(sizes))]
    while todo:
        for i in todo:
            done[i] = True
            hit = linked(matrix.product(i), sizes[i], sizes, percent)
            hit[i] = True
            found = np.unique(label[hit])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
        value, count = np.unique(label, return_counts=True)
        todo = np.flatnonzero(~done & (label != value[np.argmax(count)])).tolist()[:1 if done.sum() < 8 else 64]
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names)
    return least[label]


_ENTRIES = lambda frame: [np.frombuffer(x, U64) for x in frame["entries"]]


def _small(clusters: DataFrame, total: int, chunk: int, percent: int) -> DataFrame:
    """Whole clusters, many to a task."""
    bins = max(1, -(-total // chunk))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby("label", sort=False):
            names = own["set"].to_numpy(np.int64)
            out.append(pd.DataFrame({"a": names, "b": connect(names, own["size"].to_numpy(np.int64), _ENTRIES(own), percent)}))
        return pd.concat(out)

    return clusters.groupBy(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin")).applyInPandas(run, "a long, b long")


def _large(clusters: DataFrame, chunk: int, percent: int) -> DataFrame:
    """Clusters of more than one chunk. ``clusters`` has their number of chunks in ``parts``.

    Chunks are connected in themselves first, then a few rows of each against all chunks. What is still outside a cluster's
    largest component is multiplied with every chunk, in blocks of rows; pairs inside that component need no product.
    """
    placed = clusters.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame["set"].to_numpy(np.int64)
        return pd.DataFrame({"a": names, "b": connect(names, frame["size"].to_numpy(np.int64), _ENTRIES(frame), percent)})

    def against(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows of ``side`` 1 (a block) with those of side 0 (a chunk)."""
        frame = frame.sort_values(["side", "set"], kind="stable")
        names, sizes, side = (frame[c].to_numpy(np.int64) for c in ("set", "size", "side"))
        matrix, found = Incidence(_ENTRIES(frame)), []
        for i in np.flatnonzero(side == 1).tolist():
            hit = linked(matrix.product(i), sizes[i], sizes, percent) & (side == 0)
            if hit.any():
                found.append(pd.DataFrame({"a": names[hit], "b": names[i]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}).astype("int64")

    def crossed(rows: DataFrame) -> DataFrame:
        """``rows`` (label, set, size, entries, parts, block, blocks) with all chunks of their cluster."""
        many = rows.groupBy("label").agg(F.max("blocks").alias("blocks"))
        left = placed.join(many, "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cols = ["label", "part", "block", "set", "size", "entries"]
        both = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))
        return both.groupBy("label", "part", "block").applyInPandas(against, "a long, b long")

    edges = stored(placed.groupBy("label", "part").applyInPandas(within, "a long, b long"), "within")
    # of each chunk's largest component the least row, for up to eight chunks
    named = placed.select("label", "part", "set").join(edges.withColumnRenamed("a", "set"), "set")
    counts = named.groupBy("label", "part", "b").agg(F.count("*").alias("n"))
    hubs = counts.groupBy("label", "part").agg(F.max_by("b", F.struct("n", "b")).alias("set")).filter("part < 8").select("set")
    rows = placed.join(hubs, "set", "left_semi").withColumn("block", F.lit(0)).withColumn("blocks", F.lit(1))
    edges = edges.unionByName(stored(crossed(rows), "hubs"))
    known = components(edges)
    named = placed.select("label", "set").join(known.select(F.col("node").alias("set"), F.col("label").alias("root")), "set", "left")
    named = named.withColumn("root", F.coalesce("root", "set"))
    most = named.groupBy("label", "root").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    outside = placed.join(named.join(most, ["label", "root"], "left_anti").select("set"), "set", "left_semi")
    need = outside.groupBy("label").agg(F.ceil(F.sum(F.length("entries")) / 8 / chunk).cast("int").alias("blocks"))
    outside = outside.join(need, "label").withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int"))
    return edges.unionByName(stored(crossed(outside), "outside"))


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id that links lead to, the document's own included."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _blocks(docs, buckets, n).groupBy("bucket").applyInPandas(_shared, _WIRE)
    found = stored(counted.groupBy("block").applyInPandas(_rows(percent), _ROWS), "ngram-rows")
    owners = found.filter("kind = 1").select("doc_id", "set", "size")
    nodes = stored(found.filter("kind = 0").select("set", "size", "entries").dropDuplicates(["set"]), "ngram-sets")
    clusters = components(_stars(nodes, buckets, percent)).select(F.col("node").alias("set"), F.col("label"))
    weight = F.length("entries") / F.lit(8)
    clustered = stored(nodes.join(clusters, "set"), "ngram-clusters")
    weights = clustered.groupBy("label").agg(F.ceil(F.sum(weight) / chunk).cast("long").alias("parts"), F.sum(weight).cast("long").alias("weight"))
    weights = stored(weights, "ngram-weights")
    total, most = weights.agg(F.sum("weight"), F.max("parts")).first()
    if not total:
        edges = None
    elif most <= 2:
        edges = _small(clustered, total, chunk, percent)
    else:
        both = stored(clustered.join(weights.select("label", "parts"), "label"), "ngram-parts")
        edges = _small(both.filter("parts <= 2"), total, chunk, percent).unionByName(_large(both.filter("parts > 2"), chunk, percent))
    if edges is None:
        roots = owners.withColumn("root", F.col("set"))
    else:
        joined = components(edges).select(F.col("node").alias("set"), F.col("label").alias("root"))
        roots = owners.join(joined, "set", "left").withColumn("root", F.coalesce("root", "set"))
    roots = stored(roots, "ngram-roots")
    least = stored(roots.filter("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-least")  # then large groups can be split in the join
    return roots.join(least, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near duplicates: of each component the one with the least doc_id stays.

    Documents without words all stay. Rows with equal doc_id and text count once; rows without doc_id stay if one of them does.
    """
    found = stored(join(docs), "ngram-join")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("copies"))
    # dealt by doc_id at every size: the kept ids grow with the documents, so they are never sent to all tasks
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(kept.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        rows = rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text_hash")).dropDuplicates(["id", "text_hash"])
    return rows.select("row.*")
