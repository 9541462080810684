"""Encoding against the tokenizers library, and decoding back."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(path, tmp_path_factory):
    from weftlake.llm import lexicon
    from weftlake.llm.bpe import Encoder, Vocabulary

    v = Vocabulary(path)
    file = str(tmp_path_factory.mktemp("lexicon") / "l")
    lexicon.build([(w.encode(), v.merge(w.encode())) for w in (" the", " then", "the", " a", "\n", " hen")], file)
    return Encoder(v, lexicon.Lexicon(file))


PIECES = ["the", " the", "'s", "don't", "<|endoftext|>", "<|end", "\n", "  ", "\t", "\x1c", " ", "é", "漢字", "😀", "²Ⅷ½", "12", "_", "!?", "࢏", "\U0001e6c0", "á", "﻿"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_same_ids_and_text(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert got == want
    assert encoder.vocabulary.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_long_words(library, encoder):
    r = random.Random(3)
    for text in ("x" * 5000, "".join(r.choice("abcé") for _ in range(4000)), "ab" * 3000):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_lexicon_round_trip(tmp_path):
    from weftlake.llm.lexicon import Lexicon, build

    r = random.Random(2)
    words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))): tuple(r.randrange(1000) for _ in range(r.randint(1, 4))) for _ in range(500)}
    states = build(words.items(), str(tmp_path / "l"))
    x = Lexicon(str(tmp_path / "l"))
    assert all(x.get(w) == ids for w, ids in words.items())
    assert all(x.get(w + b"z") is None and x.get(w[:-1] + b"\xff") is None for w in words)
    assert states < 500
    build([], str(tmp_path / "e"))
    assert Lexicon(str(tmp_path / "e")).get(b"a") is None


def test_spark(docs, rows, empty, library, path):
    from weftlake.llm.bpe import bpe_decode, bpe_encode, bpe_report

    out = bpe_encode(docs, path, lexicon_words=40)
    assert out.columns == [*docs.columns, "token_ids"]
    back = bpe_decode(out.select("doc_id", "text", "token_ids"), path, text_out="again").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.again == (r.text or "")
    assert bpe_report(empty, path).count() == 0
    want = Counter(report_row(i, t, library) for i, t, *_ in rows)
    got = Counter(tuple(r) for r in bpe_report(docs, path).collect())
    assert got == want
    clash = docs.select("doc_id", "text").withColumnsRenamed({"doc_id": "ids", "text": "decoded"})
    assert Counter(tuple(r) for r in bpe_report(clash, path, "ids", "decoded").collect()) == want


def report_row(doc_id, text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_registered_query_on_whole_documents(spark, library):
    """Every row of a whole table has the library's digests."""
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = __spark_entry__.queries()["op5_bpe_lexicon"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(report_row(r.doc_id, r.text, library) for r in texts)


def test_slices_and_many_texts_at_once(library, encoder):
    import pyarrow as pa

    from weftlake.llm.arrays import slices

    r = random.Random(8)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(400)] + ["", None, "a b " * 3000]
    got = []
    for _, part in slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0, 2000):
        x = encoder.encode_all(part)
        got += [x.values[a:b].tolist() for a, b in zip(x.at, x.at[1:])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_merged_together_are_those_merged_alone(encoder):
    import pyarrow as pa

    from weftlake.llm.arrays import parts

    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij thenoué漢") for _ in range(r.randint(1, 25))).encode() for _ in range(3000)]
    at, data = parts(pa.array(words, pa.binary()))
    x = encoder.vocabulary.merge_all(data, at)
    assert [tuple(x.values[a:b].tolist()) for a, b in zip(x.at, x.at[1:])] == [encoder.vocabulary.merge(w) for w in words]
    empty = encoder.vocabulary.merge_all(data[:0], at[:1])
    assert not len(empty.values) and len(empty.at) == 1
