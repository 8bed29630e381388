"""Packing by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` tokens: full pieces and one rest. Sequences are filled one after
the other: the longest rest that is left goes in, then a bitset (bit s: the sum s can be reached) over the lengths
that are left, longest first, finds the sum nearest to the room that remains; walking back through the bitsets gives how
many of each length. The pattern is used as often as the lengths last, so a group takes few searches.

Null and empty texts have their closing token only. Rows with equal doc_id are packed each on its own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import stored, texts

CAPACITY = 2048
END = 1  # closes a document
GROUP = 20_000  # pieces that are packed together
SIGMAS = {"Σ", "σ", "ς"}  # their small letter depends on the place


# ---- tokens

def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: b for b in own}, **{b: 256 + i for i, b in enumerate(rest)}}


class Ids(dict):
    """Token ids of words as bytes (little-endian 32 bits), remembered for up to ``most`` words.

    The vocabulary's pattern never crosses a blank or a line end and drops white space, so the ids of a text are those of
    the runs between them. It also parts letters from what follows them: a run of letters with signs behind it has the ids
    of the letters, then those of the signs. Plain runs of letters go to the vocabulary's merges directly.
    """

    SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters, self.table = Tokenizer.from_file(path), most, {}, _byte_letters()
        self.merges = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]

    def forget(self) -> None:
        self.clear()
        self.letters.clear()

    def _whole(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def _letters(self, run: str) -> bytes:
        """Ids of a run of letters; one whose small letters depend on their place or are more than letters takes the long way."""
        low = run.lower()
        found = self.letters.get(low)
        if found is None:
            if low.isascii():
                mapped = low
            elif low.isalpha() and is_normalized("NFC", low) and not SIGMAS & set(run):
                mapped = low.encode().decode("latin-1").translate(self.table)
            else:
                return self._whole(run)
            found = self.letters[low] = b"".join([self.packed[t.id] for t in self.merges.tokenize(mapped)])
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.forget()
        run = word.rstrip(self.SIGNS)
        if run.isalpha() and not SIGMAS & set(run):
            tail = word[len(run) :]
            value = self._letters(run) + self[tail] if tail else self._letters(run)
        else:
            value = self._whole(word)
        self[word] = value
        return value

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def ids_of(path: str) -> Ids:
    return Ids(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document; ``part`` and ``place`` number the rows as the task met them."""
    closing = np.array([END], dtype="<u4").tobytes()

    def run(parts):
        from pyspark import TaskContext

        part, place, ids = TaskContext.get().partitionId(), 0, ids_of(tokenizer)
        for batch in parts:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(ids.of(text) + closing)
                n = len(data) // 4
                for start in range(0, n, capacity):
                    body = data[4 * start : 4 * min(n, start + capacity)]
                    out.append((doc_id, start, len(body) // 4, zlib.crc32(body), n, part, place))
                    place += 1
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])
        ids.forget()  # the worker may go on to other work

    return texts(docs).mapInArrow(run, PIECES)


# ---- bins

def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, how many), whose sum is nearest below ``room``; longest lengths are tried first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, k = reach, min(counts[length], room // length)
        while k:
            more = (reach | reach << length) & mask
            if more == reach:
                break
            reach, k = more, k - 1
        steps.append((length, before))
        if reach >> room & 1:
            break
    best, picked = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> best & 1:
            best, n = best - length, n + 1
        if n:
            picked.append((length, n))
    return picked


def patterns(lengths: np.ndarray, capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Fillings of a sequence and how often each is used, until every length is used up."""
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            picked = dict(fill(counts, capacity - longest))
            counts[longest] += 1
            picked[longest] = picked.get(longest, 0) + 1
            times = min(counts[x] // k for x, k in picked.items())
            for x, k in picked.items():
                counts[x] -= k * times
            yield list(picked.items()), times


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: the sequence it lies in and its offset there."""
    order = np.argsort(lengths, kind="stable")
    values, first = np.unique(lengths[order], return_index=True)
    next_of = dict(zip(values.tolist(), first.tolist()))
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    for filling, times in patterns(lengths, capacity):
        at = 0
        for length, k in sorted(filling, reverse=True):
            start = next_of[length]
            next_of[length] = start + k * times
            rows = order[start : start + k * times].reshape(times, k)
            sequence[rows] = number + np.arange(times)[:, None]
            offset[rows] = at + length * np.arange(k)[None, :]
            at += k * length
        number += times
    return sequence, offset


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence and offset.

    Only the small piece rows are shuffled, in groups of about ``group`` by a hash of what numbers them, so no document,
    source or length gathers in one task; each group leaves at most its last sequences unfilled.
    """
    rows = stored(pieces(docs, tokenizer, capacity), "pieces")
    n_groups = max(1, -(-rows.count() // group))

    def run(frame):
        frame = frame.sort_values(["part", "place"], kind="stable")
        sequence, frame["offset"] = pack(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame["pack"].to_numpy(np.int64) << 32) + sequence
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    keyed = rows.withColumn("pack", F.pmod(F.xxhash64("part", "place"), F.lit(n_groups)))
    return keyed.groupBy("pack").applyInPandas(run, PACKED)
