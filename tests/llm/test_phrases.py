"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitehazard.llm import collocations, queries
from sitehazard.llm.common import importable

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


def plain(rows, least, cover=100, most_words=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang, words] = (a, f[lang, words[:k]], f[lang, words[k:]], n[lang], k, score)
    covered = {
        (lang, words[i : i + size])
        for (lang, words), row in found.items()
        for size in range(2, len(words))
        for i in range(len(words) - size + 1)
        if 100 * row[0] >= cover * f[lang, words[i : i + size]]
    }
    return {(lang, " ".join(words)): row for (lang, words), row in found.items() if (lang, words) not in covered}


def given(df):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["k"], r["score"]) for r in df.collect()}


def random_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "of", "the", "é", " ", "x\x0by", "\xa0", "New", "York", "new york city", "w1", "w2", "\t"]
    ends = [" ", " ", " ", " ", "  ", ". ", ",", "\n", "\r\n", "\x0c", ";"]
    rows = [
        (rng.choice(["en", "en", "en", None, "und", "", "de"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))))
        for _ in range(200)
    ]
    rows += [("en", None), (None, ""), ("en", " .,"), ("en", "z " * 5000), ("en", "long" * 9000 + " a of the"), ("fr", "rare words")]
    rows += [("en", "one two three four five six")] * 30
    return rows


@pytest.mark.parametrize("settings", [{}, {"share": 10**6, "chunk": 50}, {"share": 20, "chunk": 500}])
def test_phrases(spark, settings):
    rows = random_rows(1)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    frame = frame.withColumns({c: F.lit(1) for c in ("phrase", "prefix", "word", "n", "salt", "side", "a.b")})
    found = collocations.collocations(frame, least=12, **settings)
    assert given(found) == plain(rows, 12)


def test_cover_and_lengths(spark):
    rows = random_rows(2)
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(frame, most_words=3, least=8, cover=60)
    assert given(found) == plain(rows, 8, 60, 3)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = random_rows(3)
    frame = spark.createDataFrame(rows, "lang string, text string")
    full = collocations.BitFilter(np.full(1 << 4, -1, np.int64).view(np.uint64), 10)
    monkeypatch.setattr(collocations, "bit_filter", lambda *_: full)
    assert given(collocations.collocations(frame, least=10)) == plain(rows, 10)


def test_products_beyond_64_bits(spark):
    row = spark.sql(
        "SELECT (CAST(1000 AS DECIMAL(4, 0)) * CAST(9000000000000 AS DECIMAL(19, 0)) * CAST(90000000000000 AS DECIMAL(19, 0)))"
        " div (CAST(9000000000001 AS DECIMAL(19, 0)) * CAST(9000000000007 AS DECIMAL(19, 0))) AS s"
    ).first()
    assert row["s"] == 1000 * 9000000000000 * 90000000000000 // (9000000000001 * 9000000000007)


def test_ranks_and_empty(spark):
    rows = [("en", f"{w} x{i % 3}") for i in range(60) for w in ("p", "q", "ä")] + [("de", "u v")] * 20
    frame = spark.createDataFrame(rows, "lang string, text string")
    wanted = plain(rows, 20)
    found = collocations.first_of_each(collocations.collocations(frame, least=20), 4).collect()
    for lang in ("en", "de"):
        order = sorted((k for k in wanted if k[0] == lang), key=lambda k: (-wanted[k][5], -wanted[k][0], k[1].encode()))
        got = sorted((r["rank"], r["phrase"]) for r in found if r["lang"] == lang)
        assert got == [(i + 1, k[1]) for i, k in enumerate(order[:4])]
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.first_of_each(collocations.collocations(none), 5).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").collect()
    wanted = plain([tuple(d) for d in docs], 100)
    rows = queries.QUERIES["op12_collocations"](spark, FOLDER).collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows} == {
        k: (*v[:4], v[5]) for k, v in wanted.items()
    }
