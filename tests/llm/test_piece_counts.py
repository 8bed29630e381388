import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from fxspark.llm import piece_counts as pc
from tests.llm.conftest import rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = st.text("abc", min_size=1, max_size=12)


def greedy(word, initial, continuing):
    at, n = 0, 0
    while at < len(word):
        pieces = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return pc.UNKNOWN
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=9), st.sets(st.text("abc", min_size=1, max_size=5), max_size=9), st.lists(WORD, max_size=20))
def test_counts_are_those_of_greedy_matching(initial, continuing, words):
    a = pc.Automaton(initial, continuing)
    assert [a.count(w) for w in words] == [greedy(w, initial, continuing) for w in words]


def test_counts_of_texts(docs, clash, none):
    initial, continuing = pc.vocabulary(PATH)
    names = {"[UNK]": 0}
    for p in [*initial, *("##" + p for p in continuing)]:
        names.setdefault(p, len(names))
    model = Tokenizer(models.WordPiece(names, unk_token="[UNK]", max_input_chars_per_word=10**6))
    want = []
    for doc_id, text, *_ in rows():
        words = [w.decode() for w in (text or "").encode().split()]
        found = [model.encode(w).ids for w in words]
        want.append((doc_id or -1, len(words), sum(map(len, found)), sum(f == [0] for f in found)))
    for frame in (docs, clash):
        assert sorted((r.doc_id or -1, r.n_words, r.n_pieces, r.n_unknown) for r in pc.counted(frame, PATH).collect()) == sorted(want)
    assert pc.counted(none, PATH).count() == 0
