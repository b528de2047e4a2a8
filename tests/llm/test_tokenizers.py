"""Op 1 and op 10 against the tokenizer libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, tokencount

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), bpe.load(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE), tokencount.load(PIECE)


PARTS = st.sampled_from(["the", " of", " ", "  ", "\n", "\r\n", "\t", "don't", "'ll", "123", "ünï", "漢字", "😀", "<|endoftext|>", "<s>", "▁", "aaaa", "!?", " ", "\x1f", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(PARTS, max_size=25).map("".join), st.text("ab ", max_size=60)))
def test_same_as_the_libraries(libraries, text):
    hf, codec, sp, counter = libraries
    want = hf.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == hf.decode(want, skip_special_tokens=False)
    assert counter.count([text]) == [len(sp.encode(text))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decodes_any_ids(libraries, ids):
    assert libraries[1].decode(ids) == libraries[0].decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_what_merging_gives(libraries):
    codec = libraries[1]
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    for x, y, good in zip(a.tolist(), b.tolist(), codec.compatible(a, b).tolist(), strict=True):
        assert good == (codec.merge(codec.token_bytes[x] + codec.token_bytes[y]) == [x, y])


def test_speculation_is_verified(libraries):
    codec = libraries[1]
    before = dict(codec.stats)
    codec.encode(" zqxthe zqxandor zqxdisestablishment")
    assert codec.stats["words"] > before["words"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "zq", "international", "isation", "a", "ü", "漢字", "=====", "0"]), min_size=20, max_size=80).map("".join))
def test_long_words_are_proposed_and_verified_too(libraries, word):
    hf, codec, sp, counter = libraries
    raw = word.encode()
    assert b"".join(codec.token_bytes[t] for t in codec.propose_long(raw)) == raw
    assert codec.propose_long(raw).tolist() == codec.propose([raw])[0].tolist()
    assert codec.encode(word) == hf.encode(word, add_special_tokens=False).ids
    assert counter.count([word]) == [len(sp.encode(word))]


def test_caches_start_over(libraries, monkeypatch):
    hf, codec, sp, counter = libraries
    monkeypatch.setattr(bpe.SpeculativeBPE, "REMEMBERED", 4)
    for text in ("one two three four five six", "seven eight nine one two"):
        assert codec.encode(text) == hf.encode(text).ids
        assert counter.count([text]) == [len(sp.encode(text))]


def test_documents(odd, none, libraries):
    hf, _, sp, _ = libraries
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = sorted(((d, *digests(hf, t or "")) for d, t in rows), key=str)
    got = sorted({tuple(r) for r in bpe.round_trip(odd, BYTE).collect()}, key=str)
    assert got == want
    counted = {tuple(r) for r in tokencount.count_tokens(odd, PIECE, limit=100).collect()}
    assert counted == {(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for d, t in rows}
    assert bpe.round_trip(odd, BYTE).count() == odd.count() == tokencount.count_tokens(odd, PIECE).count()
    assert bpe.round_trip(none, BYTE).count() == 0 == tokencount.count_tokens(none, PIECE).count()


def test_counts_in_small_blocks_and_shares(spark, libraries, monkeypatch):
    _, _, sp, _ = libraries
    rng = random.Random(7)
    parts = ["the", "of", "don't", "123", "ünï", "漢字", "😀", "<s>", "▁", "aaaa" * 30, "!?", "", "a\tb\nc", "\x00", "Word" * 200]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    monkeypatch.setattr(tokencount, "BLOCK", 500)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = sorted(map(tuple, tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PIECE, 60).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 60) for d, t in rows), key=str)


def digests(hf, text):
    ids = hf.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(odd):
    back = bpe.decode_documents(bpe.encode_documents(odd, BYTE), BYTE)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
