"""The operators as queries over the shared tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitehazard.llm import (
    bloom_lm,
    bpe,
    collocations,
    decontaminate,
    jaccard_join,
    licences,
    piece_codec,
    pii,
    quality_rules,
    secrets,
    suffix_dedup,
    turn_trie,
    warc,
)
from sitehazard.llm.common import documents, importable, table
from sitehazard.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: For tests only; a job passes its own secret.
PII_KEY = "key of the test queries"


def query(build):
    QUERIES[build.__name__] = lambda spark, folder: build(importable(tune(spark)), folder)
    return build


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    counted = quality_rules.judge(docs, drop=("text",))
    return counted.select(
        "doc_id",
        *quality_rules.COUNTS,
        "base_failed",
        "kept",
        F.round("posterior", 6).alias("posterior"),
    )


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


@query
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(documents(spark, folder), ["doc_id"])
    counts = [f"CAST(size(filter(base, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in ("assign", "access", "hex")]
    return found.selectExpr(
        "doc_id",
        *counts,
        f"sha2({secrets.listed('base')}, 256) AS base_sha256",
        f"{secrets.listed('spans')} AS spans",
    )


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return decontaminate.scan(docs, table(spark, folder, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return pii.with_pseudonyms(docs, PII_KEY).select("doc_id", "n_replaced", "text")


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.groups(documents(spark, folder), "doc_id")
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return bloom_lm.scores(documents(spark, folder), "doc_id", F.crc32(number) % 10 == 0)


@query
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, folder), ["doc_id"], whole=False)


@query
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(documents(spark, folder), ["doc_id"])
    return found.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        "best",
        F.round("similarity", 6).alias("similarity"),
    )


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Six captures of every page, a day apart, as archive records.

    A page's body changes on its fourth day. Full responses are on the first day (not of every
    fourth page) and on the fourth; the others are revisits that state the digest, an entity tag or
    the time of last modification, some of them of another body than the one last seen. Every fifth
    page is captured under its site's front page, which so has very many captures.
    """
    number, day = F.col("page_id"), F.col("day")
    bodies = table(spark, folder, "pages").select(
        "page_id",
        F.when(number % 5 == 0, F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)).otherwise(F.col("url")).alias("url"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("first"),
        F.sha1(F.concat(F.coalesce("html", F.lit("")), F.lit("again"))).alias("second"),
        F.octet_length("html").cast("string").alias("size"),
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("day"),
    )
    full = (day == 3) | ((day == 0) & (number % 4 != 1))
    # The body that a record speaks of: on some days that of the other half.
    other = ((day == 2) & (number % 4 == 2)) | ((day == 4) & (number % 4 == 3)) | ((day == 5) & (number % 2 == 1))
    later = (day >= 3) != other
    body = F.when(later, F.col("second")).otherwise(F.col("first"))
    changed = F.date_format(F.timestamp_seconds(number * 60 + F.when(later, 3 * 86_400).otherwise(0)), "yyyy-MM-dd HH:mm")

    def line(name: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    block = F.concat(
        line("ETag", F.concat(F.lit('W/"'), F.substring(body, 1, 12), F.lit('"')), full | (day == 2)),
        line("Last-Modified", changed, full | (day == 4)),
        line("Date", day.cast("string"), F.lit(True)),
        line("Content-Length", F.coalesce("size", F.lit("0")), F.lit(True)),
    )
    return bodies.select(
        (number * 6 + day).alias("record_id"),
        "url",
        F.timestamp_seconds(number * 60 + day * 86_400).alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, 200).otherwise(304).alias("http_status"),
        warc.header_map(block).alias("headers"),
        F.when(full | day.isin(0, 1, 5), body).alias("digest"),
    )


@query
def op5_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolved(captures(spark, folder))
    headers = F.array_sort(F.map_entries("headers"))
    return found.select(
        "record_id",
        F.expr("record_id div 6").alias("page_id"),
        "place",
        "status",
        "payload_record",
        F.array_join(F.transform(headers, lambda h: F.concat_ws("=", h["key"], h["value"])), ";").alias(
            "headers"
        ),
    )


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


@query
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    hundred = F.expr("conv_id - conv_id % 100")
    return turn_trie.prefix_trie(table(spark, folder, "conversations"), hundred, turn_trie.of_hundred)


# CRC-32 a bit at a time; each conversation's nodes by its own path; subtrees by going up from
# the smallest member of each node.
SQL["op13_conversation_trie"] = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, id) AS said
  FROM turns GROUP BY conv_id),
lent AS (
  SELECT conv_id, said, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, code: list_reduce(
      list_prepend(xor(crc, code), range(8)),
      lambda c, i: xor(c >> 1, (c & 1) * CAST(3988292384 AS BIGINT)))), 4294967295) % 6 AS h
  FROM own),
built AS (
  SELECT l.conv_id, list_concat(coalesce(b.said[1:l.h], []), coalesce(l.said[l.h + 1:], [])) AS said
  FROM lent l LEFT JOIN own b ON b.conv_id = l.conv_id - l.conv_id % 100),
steps AS (
  SELECT conv_id, said, unnest(range(len(said) + 1)) AS depth FROM built),
placed AS (
  SELECT conv_id, depth, len(said) = depth AS ending, said[1:depth] AS path,
    min(conv_id) OVER (PARTITION BY said[1:depth]) AS top
  FROM steps),
nodes AS (
  SELECT top AS conv_id, depth, count(*) AS n_convs, any_value(path) AS path,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256
  FROM placed GROUP BY top, depth),
linked AS (
  SELECT n.*, a.top AS parent_conv_id
  FROM nodes n LEFT JOIN placed a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1),
children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
  FROM linked WHERE depth > 0 GROUP BY 1, 2),
weighed AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN l.depth > 0 THEN (l.n_convs - 1) * length(l.path[l.depth].text) ELSE 0 END AS weight
  FROM linked l LEFT JOIN children c USING (conv_id, depth)),
sums AS (
  SELECT a.top AS conv_id, a.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves,
    sum(w.weight) AS saved_tokens
  FROM weighed w JOIN placed a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY 1, 2)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM weighed w JOIN sums s USING (conv_id, depth)"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(documents(spark, folder))
    ranked = collocations.first_of_each(found, 2000)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# Every phrase of one to five words is counted, each cut of the frequent ones scored.
SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM said GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS size),
starts AS (
  SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place
  FROM said JOIN sizes ON len(words) >= size),
counts AS (
  SELECT lang, size, array_to_string(words[place:place + size - 1], ' ') AS phrase, count(*) AS f
  FROM starts GROUP BY ALL HAVING count(*) >= 100),
candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size >= 2),
inner_sizes AS (
  SELECT c.lang, c.a, c.size, c.words, s.size AS part FROM candidates c JOIN sizes s ON s.size < c.size),
inner_phrases AS (
  SELECT lang, a, words, part, unnest(range(1, size - part + 2)) AS place FROM inner_sizes),
covers AS (
  SELECT lang, array_to_string(words[place:place + part - 1], ' ') AS phrase, max(a) AS most
  FROM inner_phrases GROUP BY ALL),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
  b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
WHERE c.most IS NULL OR 100 * c.most < 100 * b.a
QUALIFY rank <= 2000"""
