"""Context-triggered piecewise hashing.

A rolling hash over seven bytes decides where chunks end, so an edit moves only the boundaries near it. Each chunk
gives one 12-bit symbol of a signature; a fingerprint holds the signatures of a block size and of its double:
``block_size:signature:signature``. Fingerprints are compared where block sizes are equal or differ by a factor of
two, by edit distance (insertions and deletions) over the symbols.

Texts are taken whole, in segments of bounded size; a signature has no length cap. Null and empty text: ``3::``. Equal
texts have equal fingerprints, and equal fingerprints the likeness 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import texts

WINDOW = 7
LEAST_BLOCK = 3
CHUNKS = 64  # chunks of a text at most, on average, at the first block size
SEGMENT = 1 << 20
ROLL = np.uint32(0x01000193)
GROW = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
SHRINK = pow(GROW, -1, 1 << 64)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
SYMBOLS = np.array([a + b for a in ALPHABET for b in ALPHABET])
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        x[0] = 1
        have = _POWERS[str(base)] = np.multiply.accumulate(x)
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolling(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of the window that ends at each byte of ``data``; ``before`` are the WINDOW - 1 bytes in front of it."""
    b = np.concatenate([before, data]).astype(np.uint32) + np.uint32(1)
    n, out, k = len(data), np.zeros(len(data), dtype=np.uint32), np.uint32(1)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out += b[WINDOW - 1 - j : WINDOW - 1 - j + n] * k
            k = k * ROLL
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        out ^= out >> np.uint32(13)
    return out


def block_size(n_bytes: int) -> int:
    size = LEAST_BLOCK
    while size * CHUNKS < n_bytes:
        size *= 2
    return size


def fingerprint(text: bytes) -> str:
    size = block_size(len(text))
    data = np.frombuffer(text, dtype=np.uint8)
    hashes: list[list[int]] = [[], []]
    open_hash, open_length = [0, 0], [0, 0]
    before = np.zeros(WINDOW - 1, dtype=np.uint8)
    mask = (1 << 64) - 1
    for start in range(0, len(data), SEGMENT):
        part = data[start : start + SEGMENT]
        roll = _rolling(part, before)
        before = np.concatenate([before, part])[-(WINDOW - 1) :]
        n = len(part)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(GROW, n)[:n], dtype=np.uint64)])
            for level in (0, 1):
                ends = np.flatnonzero(roll < np.uint32((1 << 32) // (size << level))) + 1
                edges = np.concatenate([[0], ends, [n]]).astype(np.int64)
                each = (total[edges[1:]] - total[edges[:-1]]) * _powers(SHRINK, n + 1)[edges[:-1]]
                joined = (open_hash[level] + int(each[0]) * pow(GROW, open_length[level], 1 << 64)) & mask
                if len(ends):
                    hashes[level].append(joined)
                    hashes[level].extend(each[1:-1].tolist())
                    open_hash[level], open_length[level] = int(each[-1]), n - int(edges[-2])
                else:
                    open_hash[level], open_length[level] = joined, open_length[level] + n
    signatures = []
    for level in (0, 1):
        all_hashes = hashes[level] + ([open_hash[level]] if open_length[level] else [])
        with np.errstate(over="ignore"):
            picks = _mixed(np.array(all_hashes, dtype=np.uint64)) & np.uint64(4095)
        signatures.append("".join(SYMBOLS[picks.astype(np.int64)].tolist()))
    return f"{size}:{signatures[0]}:{signatures[1]}"


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    distance = len(x) + len(y) - 2 * common(x, y)
    return 1.0 - distance / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where no block size is shared, or where one text is empty and the other is not."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    m, n = int(size_a), int(size_b)
    if not one_a or not one_b:
        return 0.0
    if m == n:
        return max(_alike(one_a, one_b), _alike(two_a, two_b) if two_a and two_b and len(two_a) + len(two_b) > 8 else 0.0)
    if m == 2 * n:
        return _alike(one_a, two_b)
    if n == 2 * m:
        return _alike(two_a, one_b)
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every whole text."""

    def run(parts):
        for part in parts:
            found = [fingerprint(t.encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


# ---- each document beside the next one in descending order of doc_id

def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Inner limits of about ``n`` ranges of doc_id with like numbers of rows; a sketch of fixed size gives them."""
    found = docs.select("doc_id").na.drop().stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in found})


def neighbours(docs: DataFrame, per_task: int = 4) -> DataFrame:
    """doc_id, text and ``heads``: rows of each range of doc_id together with the first row of the range below.

    Ranges are dealt out by number, so a text is shuffled once. The row that follows the last of a range is the largest
    of the next lower range that has rows (of the highest one after the lowest): one extra row for each range.
    """
    spark = docs.sparkSession
    n = per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(docs, n), dtype=np.int64)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        known = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, known).astype(np.int32))

    rows = texts(docs).withColumn("range", range_of("doc_id")).withColumn("tie", F.xxhash64("text"))
    first = rows.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("m")).orderBy("range").collect()  # a row for each range
    ranges = [r["range"] for r in first]
    if not ranges:
        return rows.withColumn("head", F.lit(False))
    above = ranges[1:] + ranges[:1]
    target = F.create_map(*[F.lit(x) for pair in zip(ranges, above) for x in pair])
    ids = [r["m"]["doc_id"] for r in first]
    known = [x for x in ids if x is not None]
    cond = F.col("doc_id").isin(known) if known else F.lit(False)
    heads = rows.filter(cond | F.col("doc_id").isNull() if None in ids else cond)
    w = F.struct("doc_id", "tie")
    heads = heads.groupBy("range").agg(F.max_by("text", w).alias("text"), F.max(w).alias("m"))
    heads = heads.select(F.col("m.doc_id").alias("doc_id"), "text", F.element_at(target, F.col("range")).alias("range"), F.col("m.tie").alias("tie"), F.lit(True).alias("head"))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "range").sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def compared(docs: DataFrame) -> DataFrame:
    """Each text against its edited form (its second half replaced by the start of the next text) and the next text.

    Rows with the same doc_id follow each other by a hash of their texts. A single document is its own next.
    """

    def run(parts):
        held = None  # (range, doc_id, text, fingerprint) of the row before

        def row(now, following, following_print):
            _, doc_id, text, own = now
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[:half]).encode()
            other = fingerprint(edited)
            return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, following_print)

        for part in parts:
            out = []
            ids, bodies, ranges, heads = (part.column(i).to_pylist() for i in (0, 1, 2, 4))
            for doc_id, text, r, head in zip(ids, bodies, ranges, heads):
                own = fingerprint(text.encode())
                if held is not None and held[0] == r:
                    out.append(row(held, text, own))
                held = None if head else (r, doc_id, text, own)
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbours(docs).mapInArrow(run, COMPARED)
