"""Source divergence audit: how far the word shares of each source lie from those of its peers and of its language.

A group is a (lang, source). Terms are runs of ASCII letters and characters beyond ASCII; a language keeps those in at least
``LEAST_DOCS`` of its documents. A group's share of a term is ``p = 1 + floor(SCALE (count + 1) / (N + V))``, in integers, and the
divergence of p from q is the sum over the kept terms of ``floor((p - q)^2 / q)``.

The kept terms form a term-major index: a row for each term with its postings (source, count). The index is dealt into slabs by
a hash of the term. Within a slab a group takes its terms, walks their postings and scatters into a dense accumulator with an entry
for each peer (a row of a sparse matrix product by Gustavson's scheme), so no pair of postings is ever emitted. A term that a group or its
peer lacks has a share too, the zero baseline: it is added for all terms from the counts that occur in a slab, and the
scatter replaces it where both have the term.

Null text, lang and source are ''. A group without terms still has its rows; without kept terms all values are 0. Equal
documents and repeated rows count each on its own. A slab holds about ``SLAB`` postings (at most ``MOST_SLAB``), and large numbers of sources are cut into
stripes of rows, so that an accumulator holds at most ``DENSE`` entries.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fxspark.llm.common import bounded, raw, stored

SCALE_STEPS = (1000, 1000, 1000)
LEAST_DOCS = 3
TOP_TERMS = 200
HELD = 300_000  # terms whose counts a task holds before it hands them on
SLAB, MOST_SLAB = 50_000, 1_000_000  # postings of a slab
DENSE = 4_000_000  # entries of a stripe's accumulators
STEP = 1_000_000  # entries of a baseline computed at a time

#: Each byte of a term as itself or its small letter, all others as a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# ---- exact shares

def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), digit group by digit group, so that nothing overflows below 9 * 10^15."""
    total = np.maximum(total, 1)
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for step in SCALE_STEPS:
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares stay near 10^9, so squares fit."""
    d = p - q
    return d * d // q


# ---- counts

COUNTS = "lang binary, source binary, term binary, n long, docs long"


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term with occurrences and documents, summed over all rows; each group also has a row with the term ''."""

    def run(parts):
        n, df, size = {}, {}, 0

        def handed() -> pa.RecordBatch:
            rows = [(*group, term, k, df[group][term]) for group, of in n.items() for term, k in of.items()] + [(*group, b"", 0, 0) for group in n]
            cols = list(zip(*rows))
            kinds = [pa.binary()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "source", "term", "n", "docs"])

        for batch in parts:
            for lang, source, text in zip(*(raw(batch.column(i)) for i in range(3))):
                terms = (text or b"").translate(TERM_BYTES).split()
                group = (lang or b"", source or b"")
                if group not in n:
                    n[group], df[group] = Counter(), Counter()
                size -= len(n[group])
                n[group].update(terms)
                df[group].update(set(terms))
                size += len(n[group])
                if size > held:
                    yield handed()
                    n, df, size = {}, {}, 0
        if n:
            yield handed()

    parts = bounded(docs).select("lang", "source", "text").mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def index(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The term-major index: lang, term and its postings, as sources and counts beside each other."""
    terms = counts.filter(F.length("term") > 0).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", F.col("postings.source").alias("sources"), F.col("postings.n").alias("counts"))


def totals(counts: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each group with n_kept (occurrences of kept terms) and n_terms (kept terms of its language)."""
    posted = indexed.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p")).groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n_kept"))
    kept = indexed.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = counts.filter(F.length("term") == 0).select("lang", "source")
    return groups.join(posted, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n_kept", "n_terms"])


# ---- a slab

def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def slab_values(term: np.ndarray, peer: np.ndarray, count: np.ndarray, n_slab: int, n_kept: np.ndarray, n_terms: int, rows: np.ndarray) -> np.ndarray:
    """The part of a slab's ``n_slab`` terms in the divergence of each group in ``rows`` (numbers of groups) from every peer.

    ``term``, ``peer``, ``count`` are the postings in the order of the terms, which is the index's own.
    """
    whole = n_kept + n_terms
    zero = shares(np.zeros(len(n_kept), np.int64), whole)  # the share of an absent term, for each group
    p = shares(count, whole[peer])
    start = np.searchsorted(term, np.arange(n_slab + 1))
    acc = np.zeros((len(rows), len(n_kept)), np.int64)
    by_group = np.argsort(peer, kind="stable")
    edge = np.searchsorted(peer[by_group], np.arange(len(n_kept) + 1))
    own = lambda g: by_group[edge[g] : edge[g + 1]]  # noqa: E731  the places of a group's postings

    # Zero baselines, as if no term were shared: the terms of the row against the peer's zero, and the row's zero against the terms of the peer.
    held = np.diff(edge)
    for h in range(len(n_kept)):
        values, times = np.unique(p[own(h)], return_counts=True)
        step = max(1, STEP // len(n_kept))
        for i in range(0, len(values), step):
            v, k = values[i : i + step, None], times[i : i + step, None]
            acc[:, h] += (apart(zero[rows][None, :], v) * k).sum(axis=0)
            at = np.flatnonzero(rows == h)
            if len(at):
                acc[at[0]] += (apart(v, zero[None, :]) * k).sum(axis=0)
    for at, g in enumerate(rows.tolist()):
        acc[at] += (n_slab - held[g] - held) * apart(zero[g], zero)
        # The row of the product: postings of the group's terms, each scattered to its peer.
        mine = own(g)
        lengths = start[term[mine] + 1] - start[term[mine]]
        places, p_g = _runs(start[term[mine]], lengths), np.repeat(p[mine], lengths)
        h = peer[places]
        np.add.at(acc[at], h, apart(p_g, p[places]) - apart(p_g, zero[h]) - apart(zero[g], p[places]) + apart(zero[g], zero[h]))
    return acc


def _names(column: pa.ChunkedArray) -> pa.Array:
    return pa.array(column.cast(pa.binary()).to_pylist(), pa.binary())


VALUES = "lang binary, source binary, part string, item binary, value long"


def _slab(stripes: int, top: int):
    """The values that a slab gives a stripe of groups: parts of the divergence from each peer, and its ``top`` telling terms for each group."""

    def run(key: tuple, slab: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, stripe = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        names, n_kept = _names(groups.column("source")), groups.column("n_kept").to_numpy()
        n_terms = int(groups.column("n_terms")[0].as_py()) if len(groups) else 0
        rows = np.arange(stripe, len(names), stripes)
        sources, item, value, part = [], [], [], []

        def give(kind: str, of: pa.Array, what: pa.Array, values: np.ndarray) -> None:
            sources.append(of), item.append(what), value.append(pa.array(values, pa.int64())), part.append(pa.array([kind] * len(values), pa.string()))

        terms, counts = _names(slab.column("term")), slab.column("counts").combine_chunks()
        sizes = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64)
        count = counts.flatten().to_numpy()
        peer = pc.index_in(slab.column("sources").combine_chunks().flatten().cast(pa.binary()), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.repeat(np.arange(len(terms)), sizes)
        acc = slab_values(term, peer, count, len(terms), n_kept, n_terms, rows)
        at, h = np.nonzero(rows[:, None] != np.arange(len(names))[None, :])
        give("pair", names.take(pa.array(rows[at])), names.take(pa.array(h)), acc[at, h])

        if len(terms):
            in_lang = np.add.reduceat(count, np.cumsum(sizes) - sizes)
            p, q = shares(count, n_kept[peer] + n_terms), shares(in_lang, np.int64(n_kept.sum() + n_terms))[term]
            telling = np.flatnonzero((p > q) & (peer % stripes == stripe))
            f = apart(p[telling], q[telling])
            place = pc.rank(terms, tiebreaker="first").to_numpy().astype(np.int64)[term[telling]] if len(telling) else f
            order = np.lexsort((place, -f, peer[telling]))
            group = peer[telling][order]
            first = np.searchsorted(group, group)
            chosen = order[np.arange(len(order)) - first < top]
            give("term", names.take(pa.array(peer[telling][chosen])), terms.take(pa.array(term[telling][chosen])), f[chosen])
        of = pa.concat_arrays(sources)
        return pa.table({"lang": pa.array([lang] * len(of), pa.binary()), "source": of, "part": pa.concat_arrays(part), "item": pa.concat_arrays(item), "value": pa.concat_arrays(value)})

    return run


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, slab: int | None = None, dense: int = DENSE) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group."""
    counts = stored(counted(docs), "counts")
    indexed = stored(index(counts, least_docs), "index")
    groups = stored(totals(counts, indexed), "groups")
    postings = indexed.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()[0]
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    slabs = max(1, -(-postings // (slab or min(MOST_SLAB, max(SLAB, 64 * most)))))
    stripes = max(1, min(most, -(-most * most // dense)))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    dealt = indexed.withColumn("slab", F.pmod(F.xxhash64("term"), F.lit(slabs)).cast("int")).select("*", each("stripe", stripes))
    peers = groups.select("*", each("slab", slabs)).select("*", each("stripe", stripes))
    key = ["lang", "slab", "stripe"]
    values = dealt.groupBy(*key).cogroup(peers.groupBy(*key)).applyInArrow(_slab(stripes, top), VALUES)
    whole = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    text = [F.decode(c, "UTF-8").alias(c) for c in ("lang", "source")]
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select(*text, "part", F.decode("item", "UTF-8").alias("item"), "value", "rank")
