"""Quality rules as weak supervision: rules vote or abstain, and votes are weighed.

Every rule looks at counts of one document and votes for (1), against (-1) or abstains (0).
Expectation-maximisation over the whole table estimates how often each rule is right on good
and on poor documents, without labels. A document's verdict is its posterior probability of
being good, given its votes.

The table is read once. Votes are grouped by pattern before anything leaves the executors;
there are at most 3^rules patterns whatever the size of the table, which bounds both what the
driver fits on and what is broadcast. Everything on the executors is built-in expressions.

Defined results: a null text has no words, votes like an empty one and fails. Repeated rows are
separate rows with equal verdicts. An empty table gives no rows. Columns that the operator adds
replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.llm.common import WORD_GAP, named_as, numbered, settle

GAPS = "\t\n\x0b\x0c\r "
SYMBOLS = "[#*$%&|<>]"

#: Each rule: when it votes for, when it votes against; else it abstains. Most know one symptom
#: and say nothing without it; each symptom is looked at in two ways, which is what lets their
#: agreement tell how good they are.
RULES: dict[str, tuple[str, str]] = {
    "prose": (
        "n_symbols + n_marks <= 0.02 * n_words AND n_upper <= 0.15 * word_chars "
        "AND n_repeat_words <= 0.2 * n_words",
        "n_symbols + n_marks > 0.08 * n_words OR n_upper > 0.4 * word_chars "
        "OR n_repeat_words > 0.4 * n_words",
    ),
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("false", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    "symbols_per_word": ("false", "n_symbols > 0.08 * n_words"),
    "symbols_per_char": ("false", "n_symbols > 0.015 * word_chars"),
    "shouting": ("false", "n_upper > 0.4 * word_chars"),
    "exclamations": ("false", "n_marks > 0.1 * n_words"),
    "repeated_words": ("false", "n_repeat_words > 0.3 * n_words"),
    "few_words": ("false", "n_distinct < 0.3 * n_words"),
    "repeated_lines": ("false", "n_dup_lines > 0.2 * n_lines"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The base counts of every whole text, and those that only the rules use."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_body", F.expr(f"trim(BOTH '{GAPS}' FROM coalesce(`{text}`, ''))"))
    df = df.withColumn(
        "_words",
        F.when(F.col("_body") == "", F.array().cast("array<string>")).otherwise(
            F.split("_body", WORD_GAP)
        ),
    )
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    )
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(
                F.regexp_replace(F.col("_body"), SYMBOLS.replace("[", "[^") + "+", "")
            ).cast("long"),
            "n_marks": F.length(F.regexp_replace(F.col("_body"), "[^!]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(F.col("_body"), "[^\\p{Lu}]+", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    df = df.withColumn(
        "_windows",
        F.expr(
            "CASE WHEN n_words >= 3 THEN transform(sequence(0, size(_words) - 3), "
            "i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) "
            "ELSE CAST(array() AS array<bigint>) END"
        ),
    )
    # Only texts in which some window is found twice sort their windows with positions.
    df = df.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows) "
            "THEN array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        "_at",
        F.expr(
            "array_sort(transform(filter(_sorted, (e, j) -> "
            "coalesce(e.h = get(_sorted, j - 1).h, false) "
            "OR coalesce(e.h = get(_sorted, j + 1).h, false)), e -> e.i))"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr(
            "CAST(CASE WHEN _at IS NULL OR size(_at) = 0 THEN 0 ELSE aggregate(zip_with("
            "slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1), "
            "(a, b) -> least(3, b - a)), 3, (s, x) -> s + x) END AS bigint)"
        ),
    )
    return df.drop("_body", "_words", "_lines", "_windows", "_sorted", "_at")


def with_votes(df: DataFrame) -> DataFrame:
    """One vote array for all rules; texts without words have every rule abstain but length."""
    votes: list[Column] = []
    for name, (good, poor) in RULES.items():
        vote = F.when(F.expr(poor), -1).when(F.expr(good), 1).otherwise(0)
        if name != "length":
            vote = F.when(F.col("n_words") == 0, 0).otherwise(vote)
        votes.append(vote)
    return df.withColumn("votes", F.array(*votes))


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents, and for each rule P(vote | good) and P(vote | poor)."""

    prior: float
    good: list[dict[int, float]]
    poor: list[dict[int, float]]

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for rule, vote in enumerate(votes):
            odds += math.log(self.good[rule][vote]) - math.log(self.poor[rule][vote])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over counted vote patterns (at most 3^rules of them).

    Starts from each rule being more often right than wrong. Votes are taken as independent
    given the document's quality; one pseudo-count a vote keeps every probability above 0. A
    rule never counts against the direction it votes in, else the two classes could swap: where an
    estimate says so, the rule says nothing.
    """
    rules, kinds = len(RULES), (-1, 0, 1)
    model = VoteModel(
        0.8, [{1: 0.5, 0: 0.48, -1: 0.02}] * rules, [{1: 0.2, 0: 0.4, -1: 0.4}] * rules
    )
    total = sum(patterns.values())
    if not total:
        return model
    for _ in range(rounds):
        weight = {votes: model.posterior(votes) for votes in patterns}
        sums = [[dict.fromkeys(kinds, 1.0) for _ in range(rules)] for _ in range(2)]
        share = 0.0
        for votes, n in sorted(patterns.items()):
            share += n * weight[votes]
            for rule, vote in enumerate(votes):
                sums[0][rule][vote] += n * weight[votes]
                sums[1][rule][vote] += n * (1 - weight[votes])
        good, poor = (
            [{k: v / sum(one.values()) for k, v in one.items()} for one in side] for side in sums
        )
        for g, p in zip(good, poor, strict=True):
            if g[1] < p[1]:
                g[1] = p[1] = (g[1] + p[1]) / 2
            if g[-1] > p[-1]:
                g[-1] = p[-1] = (g[-1] + p[-1]) / 2
        model = VoteModel(min(0.99, max(0.01, share / total)), good, poor)
    return model


def judge(
    docs: DataFrame, text: str = "text", threshold: float = 0.5, drop: tuple[str, ...] = ()
) -> DataFrame:
    """The given columns plus counts, ``votes``, ``posterior``, ``base_failed`` and ``kept``.

    Columns in ``drop`` (such as the text) are not carried along.
    """
    counted = settle(with_votes(with_counts(docs, text)).drop(*drop), "quality")
    return (
        _weighed(counted.drop("posterior"))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def _weighed(counted: DataFrame) -> DataFrame:
    """Adds the posterior of each row's votes, from a model fitted to all rows' votes."""
    patterns = {
        tuple(row["votes"]): row["n"]
        for row in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    }
    model = fit(patterns)
    rows = [(list(votes), model.posterior(votes)) for votes in patterns]
    known = counted.sparkSession.createDataFrame(rows, "_votes array<int>, posterior double")
    return counted.join(F.broadcast(known), F.col("votes") == F.col("_votes"), "left").drop("_votes")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with all columns as they came, whatever their names."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    counted = with_votes(with_counts(numbered(docs), own[docs.columns.index("text")]))
    verdicts = counted.select(*own, "votes", F.expr(BASE_FAILED).alias("base_failed"))
    judged = _weighed(settle(verdicts, "quality"))
    return named_as(judged.where(~F.col("base_failed") & (F.col("posterior") >= threshold)), docs.columns)
