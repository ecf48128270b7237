import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import tokens

BPE = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
RANKS = tokens.read_ranks(os.path.join(tokens.TOKENIZERS, tokens.RANKS))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "Fix NPE in Cart, don't retry.", "  two  spaces \t\n\n tabs ", "<|endoftext|> is text", "修复 X 空指针 🚧⚠️", "Óäàë¸í \x85\xa0​�", "a" * 5000, "ab " * 3000 + " " * 700,
    "it's we'll I'VE 's ''s", "\r\n\r\n x", "0123456789" * 40, "é" * 999, "\x00\x01", " ", "日本語" * 200,
]


def ids_of(texts, entries=()):
    lex = lexicon({w.encode(): tokens.merge(w.encode(), RANKS) for w in entries})
    ids, ends = tokens.encode_texts(texts, lex, RANKS, {})
    return [list(map(int, x)) for x in np.split(ids, ends[:-1])] if texts else []


def lexicon(entries, folder="/tmp"):
    import tempfile

    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        f.write(tokens.compile_lexicon(entries))
    return tokens.Lexicon(f.name)


def test_same_ids_as_the_public_library(public):
    assert ids_of(TEXTS) == public(TEXTS)
    assert ids_of(TEXTS, [" spaces", "Fix", "'t", " two", "\n\n", " ", "日本語"]) == public(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(public, text):
    assert ids_of([text])[0] == public([text])[0]


def test_transducer_finds_exactly_its_words():
    r = random.Random(1)
    words = {bytes(r.choice(b"ab\xff\x00") for _ in range(r.randrange(1, 9))) for _ in range(400)}
    entries = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)}
    lex = lexicon(entries)
    asked = [*words, b"", *[bytes(r.choice(b"ab\xff\x00c") for _ in range(r.randrange(12))) for _ in range(400)]]
    for w, n in zip(asked, lex.find(asked), strict=True):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert list(lex.ids[lex.ends[n] : lex.ends[n + 1]]) == entries[w]


def test_transducer_is_minimal():
    entries = {w: [1] for w in (b"walking", b"talking", b"walked", b"talked")}
    lex = lexicon(entries)
    assert len(lex.final) == 9  # four up to "alk", shared by both first letters, then a fork and "ing" and "ed" with one end
    assert lexicon({}).find([b"x", b""]).tolist() == [-1, -1]


def test_encode(spark, public):
    rows = [(i, t, "kept") for i, t in enumerate([*TEXTS, None, ""])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "text").collect()}
    want = public(TEXTS)
    assert got == {i: want[i] if i < len(want) else [] for i in range(len(rows))}
    counted = tokens.encode(df, "text", counts_only=True)
    assert counted.columns == ["doc_id", "ids", "tokens"]
    assert {r["doc_id"]: r["tokens"] for r in counted.collect()} == {i: len(x) for i, x in got.items()}


def test_slices_and_counting_limits_change_nothing(spark, public, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 20)
    monkeypatch.setattr(tokens, "COUNTED_WORDS", 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == public(TEXTS)


def test_empty(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string"), "text").count() == 0
    assert tokens.encode(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), "text").first()["ids"] == []


def test_whole_table(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokens.encode(docs, "text").collect():
        assert r["ids"] == (public([texts[r["doc_id"]]])[0] if texts[r["doc_id"]] else [])
