import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = bpe.Transducer(RANKS)
SPLIT = regex.compile(P.PATTERN)


def encode(text):
    return [t for piece in SPLIT.findall(text) for t in MACHINE.encode(piece.encode())]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst 's1\n\x1c\x85é漢😀", max_size=60)))
def test_encodes_as_the_library(text):
    assert encode(text) == REFERENCE.encode_ordinary(text)


def test_long_pieces_and_forgetting(monkeypatch):
    text = "abcab" * 2000 + "é" * 500
    assert encode(text) == REFERENCE.encode_ordinary(text)
    monkeypatch.setattr(bpe, "MOVES", 10)
    words = "the quick brown fox unbelievably antidisestablishmentarianism"
    assert encode(words) == REFERENCE.encode_ordinary(words)


def test_tokens_come_after_bounded_lookahead(monkeypatch):
    """However long the piece, little more than the longest entry waits for more bytes."""
    longest, waiting, certain = max(map(len, RANKS)), [], bpe.Transducer.certain

    def watched(self, state, last):
        out = certain(self, state, last)
        waiting.append(len(last))
        return out

    monkeypatch.setattr(bpe.Transducer, "certain", watched)
    monkeypatch.setattr(bpe, "EMIT_BYTES", 3 * longest)
    piece = "internationalization" * 500 + "ab" * 3000
    assert encode(piece) == REFERENCE.encode_ordinary(piece)
    assert len(waiting) > 20 and max(waiting) <= 2 * longest


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_utf8_stream_equals_decoding_at_once(data, step):
    stream = bpe.Utf8Stream()
    parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join(parts) + stream.close() == data.decode("utf-8", "replace")


def test_operator_round_trip(spark, docs):
    texts = [(1, "Hello  world's\n\n"), (2, None), (3, ""), (4, "漢字 <|endoftext|> é" * 50), (4, "x"), (None, "null id"), (6, "long " * 60_000)]
    tokens = bpe.encode(docs(texts), PATH, P.PATTERN)
    out = bpe.decode(tokens, PATH, step=3, keep_tokens=True).collect()
    want = sorted((repr(i), REFERENCE.encode_ordinary(t or ""), t or "") for i, t in texts)
    assert sorted((repr(r.doc_id), r.tokens, r.text) for r in out) == want
    for r in out:
        assert r.n_tokens == len(r.tokens)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.tokens, dtype="<u4").tobytes()).hexdigest()
    both = bpe.round_trip(docs(texts), PATH, P.PATTERN, step=3, keep_tokens=True).collect()
    key = {(repr(r.doc_id), r.ids_sha256, hashlib.sha256(r.text.encode()).hexdigest()): r.tokens for r in out}
    assert {(repr(r.doc_id), r.ids_sha256, r.decoded_sha256): r.tokens for r in both} == key and len(both) == len(texts)
    assert [r.n_tokens for r in bpe.round_trip(docs([(1, None)]), PATH, P.PATTERN).collect()] == [0]
    assert bpe.encode(docs([]), PATH, P.PATTERN).collect() == bpe.round_trip(docs([]), PATH, P.PATTERN).collect() == []


def test_unknown_ids_fail(spark):
    bad = spark.createDataFrame([(1, [99_999_999])], "doc_id long, tokens array<int>")
    with pytest.raises(Exception, match="KeyError|99999999"):
        bpe.decode(bad, PATH).collect()
