"""Personal data: fixed patterns, and what a character tagger adds to them.

The patterns give base spans, which always stay. A bidirectional LSTM with CRF transitions is trained on windows around base
spans of a bounded sample of documents, alone and side by side as they are written in lists. At work it reads windows
around digits and @ signs, without which no kind can be written; the emissions of overlapping windows are averaged,
most where a window is furthest from its edges, and one decoding runs over the whole stretch. A decoded span is added if it is
likely enough, overlaps no span of the patterns and passes the checks of its kind. So numbers and addresses that
stand too close together for the patterns are found too.

Null text counts as empty; empty texts have no spans. Offsets are code points, end exclusive. Repeated rows get equal rows;
other columns stay behind (``masked`` keeps them). Without any base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.char_tagger import Tagger, classes
from fxspark.llm.common import bounded, drawn, texts

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
TRIGGER = re.compile(r"[\d@＠]")
DIGIT = re.compile(r"[0-9]")
WINDOW, STRIDE, AROUND = 96, 48, 32
SAMPLE_DOCS = 20_000  # documents, about, whose windows may train the tagger
SAMPLE_WINDOWS = 3_000  # windows that train it at most
SURE = 0.8  # least mean posterior of an added span's tags


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def valid(kind: str, text: str) -> bool:
    """The checks that a match of the pattern must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return _octets(text)
    digits = re.sub(r"[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each @ back to where its run of characters begins: every character is met once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _quads(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern: four parts after four parts of each longest run of digits and single dots."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            length = sum(map(len, parts[i : i + 4])) + 3
            yield at, at + length
            at += length + 1


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, as :data:`PATTERNS` has them, in time linear in the text."""
    if kind == "email":
        return _emails(text)
    return _quads(text) if kind == "ip" else ((m.start(), m.end()) for m in PATTERNS[kind].finditer(text))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' spans in order."""
    found = []
    digits = DIGIT.search(text) is not None
    for number, kind in enumerate(KINDS):
        if "@" in text if kind == "email" else digits and (kind != "phone" or "+" in text):
            found += [(a, number, b) for a, b in _matches(kind, text) if valid(kind, text[a:b])]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- windows

def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text around triggers; parts that touch are one."""
    start = end = None
    for m in TRIGGER.finditer(text):
        if start is not None and m.start() - AROUND <= end:
            end = min(len(text), m.end() + AROUND)
            continue
        if start is not None:
            yield start, end
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
    if start is not None:
        yield start, end


def _padded(parts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    x, m = np.zeros((length, len(parts)), np.int16), np.zeros((length, len(parts)), np.float32)
    for i, p in enumerate(parts):
        x[: len(p), i], m[: len(p), i] = p, 1
    return x, m


def _tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for a, k, b in spans:
        if not y[a:b].any():
            y[a:b], y[a] = 2 + 2 * k, 1 + 2 * k
    return y


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 240, seed: int = 3) -> Tagger | None:
    """A tagger for (text, spans) windows; None without a span.

    Windows with two labelled strings side by side, and with digits that are none of the kinds, are made from the others.
    """
    r = np.random.default_rng(seed)
    strings = [(text[a:b], k) for text, spans in windows for a, k, b in spans]
    if not strings:
        return None
    plain = [text for text, spans in windows if not TRIGGER.search(text[:24])]
    made = []
    for _ in range(max(600, len(windows))):
        left = plain[r.integers(len(plain))][:24] if plain else ""
        right = plain[r.integers(len(plain))][:24] if plain else ""
        text, spans = left[r.integers(0, len(left) + 1) :] + (" " if left and r.random() < 0.8 else ""), []
        for _ in range(r.integers(1, 4)):
            if r.random() < 0.25:
                text += "".join(str(d) for d in r.integers(0, 10, r.integers(1, 9))) + " "
                continue
            s, k = strings[r.integers(len(strings))]
            spans.append((len(text), k, len(text) + len(s)))
            text += s + (" ", ", ", "; ", "\n")[int(r.choice(4, p=[0.7, 0.1, 0.1, 0.1]))]
        made.append((text.rstrip() + " " + right, spans))
    both = [(t[:WINDOW], [s for s in spans if s[2] <= WINDOW]) for t, spans in [*windows, *made]]
    x, m = _padded([classes(t) for t, _ in both], WINDOW)
    y = np.zeros((WINDOW, len(both)), np.int8)
    for i, (t, spans) in enumerate(both):
        y[: len(t), i] = _tags(len(t), spans)
    tagger = Tagger(len(KINDS))
    tagger.fit(x, m, y, steps)
    return tagger


def _emissions(tagger: Tagger, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions of each stretch, averaged over its windows by the distance from their edges."""
    cut = [(i, a) for i, p in enumerate(parts) for a in range(0, max(1, len(p) - STRIDE), STRIDE)]
    total = [np.zeros((len(p), tagger.k), np.float32) for p in parts]
    weight = [np.zeros((len(p), 1), np.float32) for p in parts]
    for at in range(0, len(cut), 512):
        some = cut[at : at + 512]
        x, m = _padded([parts[i][a : a + WINDOW] for i, a in some], WINDOW)
        e, _ = tagger.emissions(x, m)
        for j, (i, a) in enumerate(some):
            n = min(WINDOW, len(parts[i]) - a)
            w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32)[:, None]
            total[i][a : a + n] += w * e[:n, j]
            weight[i][a : a + n] += w
    return [t / w for t, w in zip(total, weight)]


def decoded(tagger: Tagger, bodies: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """For each text the tagger's spans (start, kind, end, mean posterior)."""
    where = [(i, a, b) for i, t in enumerate(bodies) for a, b in stretches(t)]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in bodies]
    where.sort(key=lambda w: w[2] - w[1])
    at = 0
    while at < len(where):
        longest = where[min(len(where), at + 256) - 1]
        some = where[at : at + max(1, min(256, 200_000 // max(1, longest[2] - longest[1])))]
        at += len(some)
        found = _emissions(tagger, [classes(bodies[i][a:b]) for i, a, b in some])
        length = max(len(f) for f in found)
        e, m = np.zeros((length, len(some), tagger.k), np.float32), np.zeros((length, len(some)), np.float32)
        for j, f in enumerate(found):
            e[: len(f), j], m[: len(f), j] = f, 1
        tags, post = tagger.best(e, m), tagger.marginals(e, m)[1]
        for j, (i, a, _) in enumerate(some):
            t = tags[:, j]
            for s in np.flatnonzero(t % 2 == 1).tolist():
                end = s + 1
                while end < length and t[end] == t[s] + 1:
                    end += 1
                out[i].append((a + s, int(t[s]) // 2, a + end, float(post[np.arange(s, end), j, t[s:end]].mean())))
    return out


def _plausible(kind: int, text: str) -> bool:
    name = KINDS[kind]
    if name == "email":
        return bool(re.fullmatch(r"\S+@\S+\.\S+", text))
    if name == "ip":
        return text.count(".") == 3 and bool(re.fullmatch(r"[0-9.]+", text)) and all(text.split(".")) and _octets(text)
    return valid(name, text)


def added(tagger: Tagger, bodies: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    out = []
    for text, own, found in zip(bodies, known, decoded(tagger, bodies)):
        new = [(a, k, b) for a, k, b, p in found if p >= SURE and all(b <= s or a >= e for s, _, e in own) and _plausible(k, text[a:b])]
        out.append(new)
    return out


# ---- jobs

def sample(docs: DataFrame, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around base spans of a sample whose size does not grow with the corpus: SAMPLE_DOCS, SAMPLE_WINDOWS."""
    rows = texts(docs)
    n = docs.count()
    picked = rows if n <= SAMPLE_DOCS else rows.filter(drawn(SAMPLE_DOCS / n, "doc_id", F.lit(seed)))

    def run(parts):
        for batch in parts:
            out = []
            for text in batch.column(1).to_pylist():
                spans = base(text)
                for a, _, b in spans:
                    lead = int(hashlib.md5(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) % AROUND
                    start = max(0, a - lead)
                    window = text[start : start + WINDOW]
                    inside = [(s - start, k, e - start) for s, k, e in spans if s >= start and e <= start + len(window)]
                    if b <= start + len(window):
                        out.append((window, [x for s in inside for x in s]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], ["window", "spans"])

    found = picked.select("doc_id", "text").mapInArrow(run, "window string, spans array<int>")
    rows = found.orderBy(F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()
    return [(r["window"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in rows]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans of every whole text."""

    def run(parts):
        for batch in parts:
            bodies = batch.column(1).to_pylist()
            known = [base(t) for t in bodies]
            more = added(tagger, bodies, known) if tagger else [[]] * len(bodies)
            counts = [[sum(k == i for _, k, _ in own) for own in known] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own in known], pa.string()),
                 pa.array([written(sorted(own + new)) for own, new in zip(known, more)], pa.string()), pa.array([len(new) for new in more], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return texts(docs).mapInArrow(run, FOUND)


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows. Null texts stay null."""
    own = docs.columns
    place = own.index("text")
    count = own.index("n_chars") if "n_chars" in own else None

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, k, b in sorted(spans):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(parts):
        for batch in parts:
            raw = batch.column(place).to_pylist()
            bodies = [t or "" for t in raw]
            known = [base(t) for t in bodies]
            more = added(tagger, bodies, known) if tagger else [[]] * len(bodies)
            hidden = [hide(t, k + n) if k or n else t for t, k, n in zip(bodies, known, more)]
            cols = list(batch.columns)
            cols[place] = pa.array([None if r is None else h for r, h in zip(raw, hidden)], cols[place].type)
            if count is not None:
                cols[count] = pa.array([None if r is None else len(h) if k or n else c for r, h, k, n, c in zip(raw, hidden, known, more, cols[count].to_pylist())], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=own)

    return bounded(docs).mapInArrow(run, docs.schema)
