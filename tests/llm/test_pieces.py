"""SentencePiece encoding, spans and decoding, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from sitehazard.llm import piece_codec, queries
from sitehazard.llm.common import importable

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


def model(rule=None, extra=False, dummy=True, fallback=True):
    """The vocabulary under one of the library's own character maps."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        spec.ParseFromString(file.read())
    if rule:
        mapped = sentencepiece_model_pb2.ModelProto()
        mapped.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        spec.normalizer_spec.CopyFrom(mapped.normalizer_spec)
        spec.normalizer_spec.escape_whitespaces = True
    spec.normalizer_spec.remove_extra_whitespaces = extra
    spec.normalizer_spec.add_dummy_prefix = dummy
    spec.trainer_spec.byte_fallback = fallback
    if not fallback:
        for piece in spec.pieces:
            if piece.type == piece.BYTE:
                piece.type = piece.CONTROL
    return spec.SerializeToString()


def texts(n):
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "\x1c", "é", "é", "中", "😀", "'s", "23", "!", "▁", "ing"]
    parts += ["aaaa", "　", "́", "ﬁ", "Ⅳ", "½", "ﷺ", "﻿", "​", "\x00", "<s>", "<0x41>", "<unk>", "한", "¨", "ａ"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]
    out += ["", " ", "\n", "\x1c", " \x1c a ", "▁", "a ", "x" * 47, "x" * 49, "ha" * 2000, " " * 999, "é" * 500]
    return out


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"extra": True},
        {"dummy": False},
        {"fallback": False},
        {"rule": "nmt_nfkc", "extra": True},
        {"rule": "nfkc_cf"},
        {"rule": "nfkc", "extra": True, "dummy": False},
        {"rule": "nmt_nfkc_cf", "extra": True, "fallback": False},
    ],
)
def test_ids_spans_and_texts_equal_the_library(settings):
    raw = model(**settings)
    own, library = piece_codec.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in texts(400):
        wanted = library.encode(text, return_type="proto").pieces
        decimals, ids, spans = own.encode(text)
        assert ids.tolist() == [p.id for p in wanted]
        assert decimals == ",".join(str(p.id) for p in wanted)
        assert [tuple(s) for s in spans.tolist()] == [(p.begin, p.end) for p in wanted]
        assert own.decode(ids) == library.decode([p.id for p in wanted])


def test_any_ids_are_decoded_as_the_library_does():
    raw, rng = model(), random.Random(5)
    own, library = piece_codec.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for _ in range(2000):
        ids = [rng.randrange(400 if rng.random() < 0.6 else 32000) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_units_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(piece_codec, "MOST_UNITS", 3)
    own, library = piece_codec.Pieces(model()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts(100):
        assert own.encode(text)[1].tolist() == library.encode(text)
        assert len(own.known) <= 3


def test_rows(spark):
    given = ["hello world", None, "", "x" * 200_000, "hello world", "é\n 中"]
    rows = [(i, t, 7, "mine") for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, x string").withColumnRenamed("x", "n.b").repartition(3)
    found = piece_codec.encode_decode(docs, PATH, ["doc_id", "ids", "n.b"])
    assert found.columns[:3] == ["doc_id", "n.b", "ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for row in found.collect():
        text = given[row["doc_id"]] or ""
        assert row["ids"] == library.encode(text) and row["decoded"] == text and row["n.b"] == "mine"
        raw = text.encode()
        assert b"".join(raw[s["low"] : s["high"]] for s in row["spans"]) == raw
    assert piece_codec.digests(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), digest)
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
