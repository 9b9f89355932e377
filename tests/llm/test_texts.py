"""Tokens, language model, decontamination, similarity join and repeated passages."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from sitehazard.llm import bloom_lm, bpe, decontaminate, jaccard_join, quality_rules, suffix_dedup
from sitehazard.llm.common import importable, text_key
from sitehazard.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


def frame(spark, texts, parts=4):
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(parts)


def test_bpe_equals_the_library():
    own, theirs = bpe.Tokenizer(open(PATH, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "é", "ß", "中", "😀", "'s", "'ll", "1", "23", "!"]
    parts += ["<|endoftext|>", "ing", "aaaa", " ", "́", "ſ", "᠎", "​", "﻿", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "\n" * 500 + "x", " " * 999, "é" * 3000, "ha" * 4000]
    for text in texts:
        wanted = theirs.encode(text, add_special_tokens=False).ids
        decimals, ids = own.encode(text)
        assert ids.tolist() == wanted and decimals == ",".join(map(str, wanted))
        assert own.decode(ids).decode() == text


def test_bpe_rows(spark):
    texts = ["hello world", None, "", "x" * 50_000, "hello world"]
    rows = sorted(bpe.encode_decode(frame(spark, texts), PATH, ["doc_id", "key"]).collect())
    assert [r["decoded"] for r in rows] == [t or "" for t in texts]
    assert rows[1]["n_tokens"] == 0 and rows[1]["ids"] == []
    assert bpe.digests(frame(spark, []), PATH, ["doc_id"]).count() == 0


def test_language_model_counts_and_scores(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += [None, ""]
    out = F.col("doc_id") % 10 == 0
    rows = bloom_lm.scores(frame(spark, texts), "doc_id", out).collect()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + ["\n"] for i, t in enumerate(texts)}
    count = Counter(w for i, words in split.items() if i % 10 for w in words)
    total, types = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        words = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"]) == (r["doc_id"] % 10 == 0, len(words))
        assert (r["n_known"], r["train_tokens"]) == (sum(count[w] > 0 for w in words), total)
        wanted = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        assert r["base_score"] == pytest.approx(wanted)
        assert -50 * len(words) < r["score"] < 0
    assert bloom_lm.scores(frame(spark, []), "doc_id", out).count() == 0


def test_scores_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "Bb", "bcd", f"w{rng.randrange(99)}", f"v{rng.randrange(9)}"]) for _ in range(40)) for _ in range(90)]
    texts += ["zq" * n for n in (200, 400, 4000)]
    out = F.col("doc_id") >= 85
    results = []
    for parts, chunk in ((1, 10**6), (7, 10**6), (3, 50)):
        monkeypatch.setattr(bloom_lm, "CHUNK", chunk)
        results.append({r["doc_id"]: r["score"] for r in bloom_lm.scores(frame(spark, texts, parts), "doc_id", out).collect()})
    assert results[1] == pytest.approx(results[0], rel=1e-9) and results[2] == pytest.approx(results[0], rel=1e-9)
    one, two, many = (results[0][i] for i in (90, 91, 92))
    assert many < 9 * two < 17 * one < -17 * 300


def test_filter_reads_back_levels():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 5000).astype(np.uint64)
    totals = rng.integers(1, 10_000, 5000).astype(np.uint64)
    bits = 12 * int(bloom_lm.level(totals).sum()) // 8 * 8
    model = bloom_lm.Model(np.frombuffer(bloom_lm.block(hashes, bloom_lm.level(totals), bits), np.uint8), 1, bits, 1, 1, 1.0, int(bloom_lm.level(totals).max()))
    read, stored = model.counts(hashes), bloom_lm.middle(bloom_lm.level(totals))
    assert (read >= stored).all() and (read == stored).mean() > 0.97
    assert (model.counts(rng.integers(1, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.03


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, text in items:
        words = split(text)
        size = min(10, len(words))
        for a in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[a : a + size])].add(str(i))
    out = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if (window := tuple(words[a : a + size])) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[window]
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["a", "b", "C", "É", "é", "1"]
    docs = [(i % 90, None if i % 17 == 0 else " ".join(rng.choice(texts) for _ in range(rng.randrange(40)))) for i in range(120)]
    items = [(i, None if i == 3 else " ".join(rng.choice(texts) for _ in range(rng.randrange(14)))) for i in range(40)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(left, right).collect())
    assert got == brute_hits(docs, items)
    clean = sorted(r["doc_id"] for r in decontaminate.remove(left, right).collect())
    assert clean == sorted(i for i, _, n, _ in brute_hits(docs, items) if not n)
    assert decontaminate.scan(left, right.where("false")).where("contaminated").count() == 0


def brute_groups(docs, size, percent):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(grams if len(words) >= size else {tuple(words)} if words else set())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, left in enumerate(sets):
        for b in range(a):
            both = len(left & sets[b])
            if both and 100 * both >= percent * len(left | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(docs))


@pytest.mark.parametrize(("size", "percent", "frequent"), [(4, 85, 4), (5, 80, 32)])
def test_similarity_join_by_brute_force(spark, monkeypatch, size, percent, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(size)
    lengths = [3, 5, 9, 30, 60, 200]
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.choice(lengths))] for _ in range(12)]
    docs = []
    for i in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice("qrst") + rng.choice("uvw")
        docs.append((i, None if i % 50 == 0 else " ".join(words) if i % 51 else ""))
    found = jaccard_join.groups(frame(spark, [t for _, t in docs]).drop("key"), "doc_id", percent=percent, shingle=size)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == brute_groups(docs, size, percent)


def test_similarity_join_of_long_texts(spark):
    rng = random.Random(9)
    docs = []
    for length in (1020, 1500, 2050, 2300):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(length)]
        for changed in (0, 10, 20, 40, 60, 70, 80, 90, 120, 180):
            words = list(base[: length - rng.choice([0, 0, 40])])
            for at in rng.sample(range(len(words)), changed):
                words[at] = "q" + rng.choice("uvw")
            docs.append((len(docs), " ".join(words)))
    found = jaccard_join.groups(frame(spark, [t for _, t in docs]).drop("key"), "doc_id", percent=80)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == brute_groups(docs, 4, 80)


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(4)
    for n in (1025, 2048, 2049, 5000):
        one = np.unique(rng.integers(0, 2**63, n, np.int64).astype(np.uint64))
        for kept in (0, n // 2, n - 40, n):
            new = rng.integers(0, 2**63, n // 3 + 1, np.int64).astype(np.uint64)
            two = np.unique(np.concatenate([one[:kept], new]))
            x, y = (jaccard_join.sketch(s, 1 << (len(s) - 1).bit_length()).tobytes() for s in (one, two))
            assert jaccard_join.differing(x, x) == 0
            assert jaccard_join.differing(x, y) <= len(np.setxor1d(one, two))
    assert jaccard_join.own_sketch(one[:1024]) is None


def test_one_row_of_each_group_stays(spark):
    texts = ["a b c d e f g"] * 3 + ["A b c d e f g", None, "", "", "other words that stand alone here"]
    kept = jaccard_join.first_of_each(frame(spark, texts).drop("key")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 4, 5, 6, 7]


def brute_first(df):
    """(id, text) of the rows that stay."""
    rows = [(r["doc_id"] is None, r["doc_id"] or 0, r["k"], r["doc_id"], r["text"]) for r in df.withColumn("k", text_key()).collect()]
    wordy = [r for r in rows if (r[4] or "").split()]
    groups = defaultdict(list)
    for n, _, top in brute_groups([(n, r[4]) for n, r in enumerate(wordy)], 5, 80):
        groups[top].append(wordy[n])
    kept = [min(g, key=lambda r: r[:3]) for g in groups.values()] + [r for r in rows if not (r[4] or "").split()]
    return Counter(r[3:] for r in kept)


def test_null_and_repeated_ids_lose_no_group(spark):
    near = "the same long passage of words that comes again and again in this small table of texts"
    rows = [(None, f"unrelated text number {n} with own words {n * 7} and {n * 13} more") for n in range(8)]
    rows += [(5, f"another text {n * 3} that shares an id {n * 17} with others {n}") for n in range(6)]
    rows += [(9, near), (9, near + " x"), (None, near), *[(None, "twice the same text, without an id")] * 2]
    rows += [(None, None), (None, ""), (3, " ")]
    df = spark.createDataFrame([(*r, f"s{n}") for n, r in enumerate(rows)], "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.first_of_each(df).collect())
    assert got == brute_first(df)
    assert got.total() == 8 + 6 + 1 + 1 + 3


def test_pipeline_by_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn(
        "doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 30)
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    good = quality_rules.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    first = list(brute_first(good).elements())
    assert sum(i is None for i, _ in first) > 10
    hits = brute_hits([(n, t) for n, (_, t) in enumerate(first)], [(r["item_id"], r["text"]) for r in items.collect()])
    clean = Counter(first[n][0] for n, _, hit, _ in hits if not hit)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == clean


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(40)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(40)}


def test_suffixes_come_in_order():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        key = np.empty(len(text), np.uint64)
        key[order] = np.arange(len(text))
        assert suffix_dedup.suffix_order(text, key).tolist() == order


def test_repeated_passages_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 5000)
    rng = random.Random(1)
    parts = ["".join(rng.choice("abé ") for _ in range(600)) for _ in range(6)] + ["a" * 900, "ab" * 500]
    texts = []
    for i in range(60):
        text = "".join(rng.choice("xyz ü") for _ in range(rng.randrange(700)))
        for _ in range(rng.randrange(3)):
            part = rng.choice(parts)
            start = rng.randrange(len(part) // 2)
            text += part[start : start + rng.randrange(300, 600)] + str(rng.random())
        texts.append(text if i % 9 else None)
    texts += [texts[1], texts[1], "a" * 900]
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[a : a + 400] for b in raw for a in range(len(b) - 399))
    wanted = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for a in range(len(b) - 399):
            if often[b[a : a + 400]] > 1:
                gone[a : a + 400] = b"\x01" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        wanted.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = suffix_dedup.deduplicated(frame(spark, texts).drop("key"), ["doc_id"], whole=False)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.select(columns).collect())) == wanted
    assert suffix_dedup.deduplicated(frame(spark, []).drop("key"), ["doc_id"]).count() == 0


def test_repeats_within_stretches():
    import random
    from collections import Counter

    r = random.Random(2)
    assert suffix_dedup.repeated([]) == []
    for _ in range(30):
        bases = [bytes(r.choices(b"abcdefgh ", k=700)) for _ in range(3)]
        stretches = []
        for _ in range(r.randint(1, 9)):
            own = bytearray(r.choice(bases))
            if r.random() < 0.6:
                own[r.randrange(700)] = 120
            begin = r.randint(0, 150)
            stretches.append(bytes(own[begin : begin + 400 + r.randint(0, 150)]))
        stretches = list(dict.fromkeys(stretches))
        often = Counter(s[i : i + 400] for s in stretches for i in range(len(s) - 399))
        want = [[i for i in range(len(s) - 399) if often[s[i : i + 400]] > 1] for s in stretches]
        assert [found.tolist() for found in suffix_dedup.repeated(stretches)] == want


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    """Columns with names that the operators use inside come back with the owner's values."""
    sf = "/root/testdata/sf0.001"
    names = ["_body", "_text", "_found", "_new", "_cards", "_words", "_lines", "_own", "_row", "row", "place"]
    names += ["n_words", "votes", "kept", "posterior", "key", "_key", "n_replaced", "hash", "component", "_rest", "a b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, given, str(tmp_path))
        assert found.columns == given.columns, name
        rows = found.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
        wanted = stage(spark, plain, sf).collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in wanted), name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)


def test_first_of_each_on_rows_without_files_and_taken_names(spark):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (None, "", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string").withColumnRenamed("k", "_metadata")
    found = jaccard_join.first_of_each(docs)
    assert found.columns == docs.columns
    assert Counter(tuple(r) for r in found.collect()) == Counter(rows[1:])


def test_shared_passages_of_51_words(spark):
    """Every text that shares 51 words has a count; texts that share no 26 have none."""
    rng = random.Random(12)
    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage, short = words(51), words(25)
    texts = [" ".join([*words(rng.randrange(40)), *passage, *words(rng.randrange(90))]).upper() for _ in range(6)]
    texts += ["\t".join([*words(10), *passage[:49], "x", *words(60)]), "\n ".join(words(30) + passage[1:])]
    texts += [" ".join([*words(60), *short, *words(60)]) for _ in range(5)]
    texts += [" ".join(words(n)) for n in (0, 1, 50, 51, 52, 300)]
    own = " ".join(words(200))
    texts += [own, own, own + " and more", None, "a b", "a b", " ".join(["same"] * 500), " ".join([*words(9), *["same"] * 60])]
    texts += [" ".join(words(50))] * 2
    rows = suffix_dedup.deduplicated(frame(spark, texts).drop("key"), ["doc_id"], whole=False).collect()
    got = {r["doc_id"]: r["n_shared_words"] for r in rows}
    split = [(t or "").lower().split() for t in texts]

    def runs(size, of):
        return {tuple(of[i : i + size]) for i in range(len(of) - size + 1)}

    for i, text in enumerate(texts):
        others = [split[j] for j in range(len(texts)) if texts[j] != text]
        if texts.count(text) > 1:
            n = len(split[i])
            assert got[i] == (n if n >= 51 else 0) or (n >= 51 and got[i] > 0)
        elif runs(51, split[i]) & set().union(*(runs(51, o) for o in others)):
            assert 26 <= got[i] <= len(split[i])
        elif not runs(26, split[i]) & set().union(*(runs(26, o) for o in others)):
            assert got[i] == 0


def test_a_full_filter_ends_and_a_small_one_reads_counts():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 400, dtype=np.uint64)
    counts = rng.integers(1, 5000, 400)
    levels = bloom_lm.level(counts)
    top = int(levels.max())
    bits = 1 << 18
    words = np.frombuffer(bloom_lm.block(hashes, levels, bits), np.uint8)
    model = bloom_lm.Model(words, 1, bits, 1, 1, 1.0, top)
    assert model.counts(hashes).tolist() == bloom_lm.middle(levels).tolist()
    assert model.counts(rng.integers(0, 2**63, 2000, dtype=np.uint64)).max() <= bloom_lm.middle(np.array([1]))[0]
    full = bloom_lm.Model(np.full(128, 255, np.uint8), 1, 1024, 1, 1, 1.0, top)
    assert set(full.counts(hashes)) == {bloom_lm.middle(np.array([top]))[0]}
    assert set(bloom_lm.Model(np.full(128, 255, np.uint8), 1, 1024, 0, 0, 0.0, 0).counts(hashes)) == {0.0}


def test_language_model_knows_word_order(spark):
    """Scores of held-out texts equal pairs and triples counted in plain Python, and order matters."""
    rng = random.Random(8)
    line = "the cat sat on the mat and the dog lay by the door".split()
    texts = [" ".join(line[a : a + rng.randrange(3, 9)]) for a in (rng.randrange(9) for _ in range(300))]
    texts += ["the cat sat on the mat", "mat the on sat cat the", "the cat flew", "", None, "cat"]
    rows = {r["doc_id"]: r for r in bloom_lm.scores(frame(spark, texts), "doc_id", F.col("doc_id") >= 300).collect()}
    assert rows[300]["base_score"] == pytest.approx(rows[301]["base_score"])
    assert rows[300]["score"] > rows[301]["score"] + 3
    split = [(t or "").split() + ["\n"] for t in texts]
    counts = Counter()
    for words in split[:300]:
        longer = ["\n", *words]
        counts.update(words)
        counts.update(zip(longer, words))
        counts.update(zip(longer, words, words[1:]))
    q = lambda *w: float(bloom_lm.middle(bloom_lm.level(np.array([counts[w if len(w) > 1 else w[0]]])))[0])
    types = sum(isinstance(w, str) for w in counts)
    mass = sum(q(w) for w in counts if isinstance(w, str))
    pair_weight, triple_weight = bloom_lm.PAIR_WEIGHT, bloom_lm.TRIPLE_WEIGHT

    def plain(words):
        total, before, last = 0.0, "\n", None
        for w in words:
            alone = q(w) / (mass + types)  # the spelling's share is left out: it is what bounds the rest
            pair = min(q(before, w), q(w), q(before))
            p = (pair + pair_weight * alone) / (q(before) + pair_weight)
            if last is not None:
                triple = min(q(*last, w), pair, seen)
                p = (triple + triple_weight * p) / (seen + triple_weight)
            total += math.log10(p)
            last, before, seen = (before, w), w, pair
        return total

    for i in (300, 301, 303, 304, 305):
        assert rows[i]["score"] == pytest.approx(plain(split[i]), abs=0.15 * len(split[i]))
        assert rows[i]["score"] >= plain(split[i]) - 1e-6
    assert rows[303]["score"] == rows[304]["score"]
