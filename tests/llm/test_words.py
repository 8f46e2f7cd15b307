import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helioframe.llm import private, words

TEXT = st.text(alphabet="aZé漢 \t\n\x0b.\x1c 9", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for dense, pattern in ((words.DENSE, rb"[^\x20\x09-\x0D]+"),
                           (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for _, _, w in words.pieces(pa.array(texts, pa.string()), dense, lower=True):
            found += [[w.word(i) for i in range(w.first[k], w.first[k + 1])] for k in range(w.n)]
        lowered = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) for t in texts]
        assert found == [re.findall(pattern, t) for t in lowered]


def test_hash_depends_on_words_alone():
    texts = ["a b c d e f", "x a b c", "", "b c", "bc", "b  c"]
    seen = {}
    for _, _, w in words.pieces(pa.array(texts)):
        for size in (1, 2, 3):
            starts, ends = w.windows(size, whole=True)
            for a, b, h in zip(starts, ends, w.runs().hash(starts, ends)):
                key = tuple(w.word(i) for i in range(a, b))
                assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


def test_patterns_of_two_letters_have_hashes_of_their_own():
    """Words whose polynomials of any base agree modulo 2^64: a Thue-Morse word and its complement."""
    bits = [i.bit_count() & 1 for i in range(4096)]
    texts = ["".join("ab"[b ^ k] for b in bits[:n]) for n in (512, 1024, 2048, 4096) for k in (0, 1)]
    texts += ["a\0", "a", "a\0\0", "abcdefgh", "abcdefgh\0", "hgfedcba"]
    for lane in (0, 1):
        found = [h for _, _, w in words.pieces(pa.array(texts)) for h in w.hashes(lane).tolist()]
        assert len(found) == len(texts) == len(set(found))
    _, _, w = next(words.pieces(pa.array(texts)))
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_pieces_keep_long_texts_whole(monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 50)
    texts = ["w " * 200, "a", None, "b c"] * 3
    sizes = [n for _, _, w in words.pieces(pa.array(texts)) for n in w.counts]
    assert sizes == [200, 1, 0, 2] * 3


def test_cover():
    assert words.cover(6, np.array([1, 2]), np.array([3, 5])).tolist() == [False, True, True, True, True, False]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- (2", max_size=40))
def test_private_spans_equal_the_plain_patterns(text):
    from tests.llm import brute
    assert private.base_spans(text) == brute.private(text)


def test_private_spans_of_long_runs_take_no_squares():
    text = "a" * 300_000 + " " + "1" * 300_000 + "@" + "+1" * 100_000
    assert private.base_spans(text) == []


def test_luhn():
    r = random.Random(1)
    for _ in range(50):
        body = "".join(str(r.randrange(10)) for _ in range(15))
        assert sum(private.luhn(body + str(d)) for d in range(10)) == 1
