"""Toxicity by a factorization machine over hashed terms.

A term is a word, or the first four to seven characters that one, two or three different words of a text begin with, hashed
to 32 bits. Besides a weight each term has a vector, and the product of two terms' vectors is the weight of their meeting in
one text, which weights of single terms miss. Terms are present or not, so a text's length does not thin out what is in it.

Learning takes a bounded sample: about SAMPLE labelled documents of each class. Two machines are fitted on it in numpy. The wide one has a place
for every term, in a table of 2 ** BITS hashed places, so that terms which tell nothing alone can meet. The narrow one has the TERMS terms
whose presence differs most between the classes, as Spark counts them; with few labels it keeps the noise of thousands of
single words out. Each learns from four fifths of the sample, and the one with the less loss on the rest is fitted again on all and scores.
Scoring covers every whole text.

Null and empty texts have no terms and get the score of the bias. Documents with several labels count as toxic if one label
is 1; null labels are ignored. Repeated rows are scored each. Without both classes every score is the share of toxic
labels (0 without labels). Other columns stay behind.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import bounded, drawn, raw, stored

SAMPLE = 6_000  # documents of each class, about, that the fit sees
TERMS = 4_096  # terms of the narrow machine at most
BITS = 18  # the wide machine has 2 ** BITS places
WIDE = dict(epochs=40, decay=1e-3)  # how the wide machine learns; it stops when the fifth that it does not see gets worse
PATIENCE = 4  # epochs without a better loss
TRIAL, FAR = 5, 1.5  # a machine whose loss is FAR times the other's after TRIAL epochs is given up
LEAST_DOCS = 3  # sampled documents that a term must be in
FACTORS = 8
SURE = 0.7
TOKEN = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # letters, digits and what is not ASCII
HEAD_LENGTHS = (4, 5, 6, 7)
LEVELS = {2: 0x5BD1E995, 3: 0x27D4EB2F}  # turn a begin into "two words begin so", "three words"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashed(word: bytes) -> list[int]:
    """32-bit terms of a lower-case word."""
    import xxhash

    text = word.decode("utf-8", "replace")
    return [xxhash.xxh32_intdigest(b"w" + word), *(xxhash.xxh32_intdigest(f"h{text[:n]}") for n in HEAD_LENGTHS if len(text) > n)]


def words(text: bytes | None) -> set[bytes]:
    return set(TOKEN.findall((text or b"").decode("utf-8", "replace").lower().encode()))


class Terms(dict):
    """Terms of words, remembered for up to ``most`` words; with ``kept`` only those, as places there, with ``wide`` as hashed places."""

    def __init__(self, kept: np.ndarray | None = None, most: int = 300_000, wide: bool = False):
        super().__init__()
        self.most, self.place, self.wide = most, None, wide
        if kept is not None:
            self.place = {int(t): i for i, t in enumerate(kept)}
            # a word's own term matters if it, or a level of it, is kept
            self.near = set(self.place) | {t ^ x for t in self.place for x in LEVELS.values()}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = hashed(word)
        value = self[word] = tuple(found if self.place is None else [t for t in found if t in self.near])
        return value

    def of(self, text: bytes | None) -> set[int]:
        if len(self) > self.most:
            self.clear()
        counts = Counter(chain.from_iterable(map(self.__getitem__, words(text))))
        terms = set(counts)
        for level, turn in LEVELS.items():
            terms.update(t ^ turn for t, n in counts.items() if n >= level)
        if self.wide:
            return {t >> 32 - BITS for t in terms}
        return terms if self.place is None else {self.place[t] for t in terms if t in self.place}


class Machine:
    """bias + sum of weights + sum over pairs of vector products, of the terms that are present."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 1):
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).standard_normal((n, factors)) * 0.02

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        single = np.bincount(own, self.w[index], minlength=len(rows))
        total = np.stack([np.bincount(own, self.v[index, j], minlength=len(rows)) for j in range(self.v.shape[1])], axis=1)
        square = np.bincount(own, (self.v[index] ** 2).sum(1), minlength=len(rows))
        return self.bias + single + 0.5 * ((total**2).sum(1) - square)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        raw_ = [self.raw(rows[i : i + 256]) for i in range(0, len(rows), 256)]  # few rows' vectors at a time
        return 1 / (1 + np.exp(-np.clip(np.concatenate(raw_) if raw_ else np.zeros(0), -40, 40)))

    def loss(self, rows: list[np.ndarray], y: np.ndarray) -> float:
        p = np.clip(self.score(rows), 1e-12, 1 - 1e-12)
        return float(-np.where(y > 0, np.log(p), np.log(1 - p)).mean())

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.1, decay: float = 2e-4, seed: int = 2, unseen: tuple | None = None, rival: float = np.inf) -> tuple[float, int]:
        """Logistic loss by Adagrad over shuffled batches; the least loss on ``unseen`` (rows, y) and its epoch.

        With ``unseen`` learning ends PATIENCE epochs behind the best, or after TRIAL epochs if it is far behind ``rival``.
        """
        best = (np.inf, 0)
        r = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        for epoch in range(1, epochs + 1):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                some = [rows[i] for i in pick]
                error = (self.score(some) - y[pick]) / len(pick)
                index, own = np.concatenate(some).astype(np.int64), np.repeat(np.arange(len(some)), [len(s) for s in some])
                seen, at_seen = np.unique(index, return_inverse=True)  # only these change
                v = self.v[index]
                total = np.stack([np.bincount(own, v[:, j], minlength=len(some)) for j in range(v.shape[1])], axis=1)
                back = error[own][:, None] * (total[own] - v)
                dw = np.bincount(at_seen, error[own]) + decay * self.w[seen]
                dv = np.stack([np.bincount(at_seen, back[:, j]) for j in range(v.shape[1])], axis=1) + decay * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                gb += error.sum() ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= rate * dv / np.sqrt(gv[seen])
                self.bias -= rate * error.sum() / np.sqrt(gb)
            if unseen:
                best = min(best, (self.loss(*unseen), epoch))
                if epoch - best[1] >= PATIENCE or epoch >= TRIAL and best[0] > FAR * rival:
                    break
        return best


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, seed: int = 23) -> DataFrame:
    """text and label of about ``size`` documents of each class, by a hash of doc_id; rows held out are never in it."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda c: 2.0 if counts.get(c, 0) <= size else size / counts[c]
    ids = known.filter(F.col("toxic").isin(0, 1)).filter(drawn(F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)), "doc_id", F.lit(seed)))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")  # about 2 * size ids


def telling(sampled: DataFrame, terms: int = TERMS) -> np.ndarray:
    """The terms whose presence differs most between the classes (chi-square), counted over the whole sample."""

    def count(parts):
        cache, seen = Terms(), {}
        for part in parts:
            for text, label in zip(raw(part.column(0)), part.column(1).to_pylist()):
                for t in cache.of(text):
                    have = seen.setdefault(t, [0, 0])
                    have[label] += 1
            if len(seen) > 500_000:
                yield batch(seen)
                seen = {}
        yield batch(seen)

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], ["term", "clean", "toxic"])

    counted = sampled.mapInArrow(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    sizes = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    chi = (n0 + n1) * F.pow(t * n0 - c * n1, 2) / ((c + t) * (n0 + n1 - c - t) * n0 * n1 + 1e-9)
    found = counted.filter(c + t >= LEAST_DOCS).withColumn("chi", chi).filter("chi > 6.6").orderBy(F.desc("chi"), "term").limit(terms).collect()
    return np.array(sorted(r["term"] for r in found), dtype=np.int64)


def wide_is_better(narrow: list[np.ndarray], wide: list[np.ndarray], y: np.ndarray, n_kept: int) -> tuple[bool, int]:
    """Whether the wide machine has the less loss on a fifth of the rows that neither has seen, and after how many epochs.

    Rows with the same telling terms are on the same side, so that copies do not vouch for a machine that has seen them.
    """
    fold = np.array([zlib.crc32((a if len(a) else b).tobytes()) % 5 == 4 for a, b in zip(narrow, wide)], dtype=bool)
    if not fold.any() or len(set(y[~fold])) < 2:
        return False, 0
    part = lambda rows, at: ([rows[i] for i in np.flatnonzero(at)], y[at])
    few = Machine(n_kept)
    few.fit(*part(narrow, ~fold))
    rival = few.loss(*part(narrow, fold))
    loss, epochs = Machine(1 << BITS).fit(*part(wide, ~fold), unseen=part(wide, fold), rival=rival, **WIDE)
    return loss < rival, epochs


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray | None, Machine]:
    """The fitted machine and its terms: those kept by the narrow machine, None for the wide one."""
    sampled = stored(sample(docs, labels), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        machine = Machine(0)
        machine.bias = 40.0 if sizes.get(1) else -40.0
        return np.zeros(0, np.int64), machine
    kept = telling(sampled)

    def places(parts):
        few, all_ = Terms(kept), Terms(wide=True)
        for part in parts:
            cols = [pa.array([np.array(sorted(terms.of(t)), "<i4").tobytes() for t in raw(part.column(0))], pa.binary()) for terms in (few, all_)]
            yield pa.RecordBatch.from_arrays([*cols, part.column(1)], ["few", "every", "toxic"])

    found = sampled.mapInArrow(places, "few binary, every binary, toxic int").collect()  # about 2 * SAMPLE rows
    found = sorted(found, key=lambda r: (r["toxic"], bytes(r["every"]), bytes(r["few"])))  # the same fit whatever order tasks end in
    y = np.array([r["toxic"] for r in found], dtype=np.float64)
    narrow, wide = ([np.frombuffer(r[c], "<i4").astype(np.int64) for r in found] for c in ("few", "every"))
    better, epochs = wide_is_better(narrow, wide, y, len(kept))
    if better:
        machine = Machine(1 << BITS)
        machine.fit(wide, y, **{**WIDE, "epochs": epochs})
        machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
        return None, machine
    machine = Machine(len(kept))
    machine.fit(narrow, y)
    return kept, machine


def scored(docs: DataFrame, kept: np.ndarray | None, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""

    def run(parts):
        cache = Terms(kept, wide=kept is None)
        for part in parts:
            rows = [np.fromiter(cache.of(t), dtype=np.int64) for t in raw(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.score(rows), pa.float64())], ["doc_id", "score"])

    found = bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SURE).cast("int").alias("predicted"))
