from itertools import product

import numpy as np
import public_tokenizers
import zlib
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fxspark.llm import slack_packing as sp
from tests.llm.conftest import rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 3), max_size=5), st.integers(0, 60))
def test_fill_reaches_the_best_sum(counts, room):
    picked = sp.fill(dict(counts), room)
    assert all(k <= counts[x] for x, k in picked)
    sums = {sum(x * k for x, k in zip(counts, n)) for n in product(*(range(k + 1) for k in counts.values()))}
    assert sum(x * k for x, k in picked) == max(s for s in sums if s <= room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_pack_places_everything_once(lengths):
    n = np.array(lengths, dtype=np.int64)
    sequence, offset = sp.pack(n, 100)
    for s in set(sequence.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(sequence == s), key=lambda i: offset[i]):
            assert offset[i] == at
            at += n[i]
        assert at <= 100


def test_ids_are_those_of_the_tokenizer():
    t, ids = Tokenizer.from_file(PATH), sp.Ids(PATH, most=20)
    odd = ["İstanbul, x", "ΑΣ ΣΑΣ. Σ", "<|endoftext|> a<|endoftext|>b", "it's don't. a'll", "x́a ́", "a\tb\rc\x0bd\x1ce f", "ﬁne ①② ²", "", " \n ", "Word, word. WORD!|", "x" * 400, "Éçà, ÉTÉ. Ñandú! ǅ ǆ ŉ", "don't's rock'n", "a_b--c** **d", "e\u0301t\u00e9", "한국어, 조선.", "ẞß ﬀ ŉa"]
    odd += [r[1] or "" for r in rows()]
    for text in odd:
        assert ids.of(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packed_rows(docs, clash, none):
    t = Tokenizer.from_file(PATH)
    for frame in (docs, clash):
        got = sp.packed(frame, PATH, group=7).collect()
        ends, seen = {}, {}
        for r in got:
            seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
            ends.setdefault((r.doc_id, r.ids_crc32, r.start), []).append(r)
        for parts in seen.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= sp.CAPACITY
        want = []
        for doc_id, text, *_ in rows():
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            for a in range(0, len(ids), sp.CAPACITY):
                body = np.array(ids[a : a + sp.CAPACITY], dtype="<u4").tobytes()
                want.append((doc_id or -1, a, len(body) // 4, zlib.crc32(body), len(ids)))
        assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    assert sp.packed(none, PATH).count() == 0


def test_little_padding():
    n = np.random.default_rng(1).integers(1, 2048, 5000)
    sequence, _ = sp.pack(n)
    assert n.sum() / ((sequence.max() + 1) * 2048) > 0.995
