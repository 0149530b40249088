"""Quality rules as a short-circuit cascade.

Every rule is a DataFrame condition that rejects a document, with the statistics it needs.  On a
bounded sample the cascade times each rule, its statistics included, and sees which rows it rejects.
Then it picks rules one after the other, each time the one with the most rejections per second among
the rows that the rules before leave.  ``keep`` evaluates them in that order, and a rule's
statistics are worked out only for documents that all earlier rules let pass.  ``assess`` reports
all base statistics, so there only the other rules' counts are saved.  The order changes the work,
never the verdict.  DataFrame functions only.

Defined cases: null and blank texts have no word, so they fail the base rules; repeated rows get
equal verdicts; an empty table gives an empty result and the rules keep their given order.
``keep`` returns the columns of its input, whatever their names; ``assess`` replaces a column of the
input named like one it adds.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents, fresh, words_of

SYMBOLS = r"[#*$%&|<>]"
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: The cascade is planned on at most this many rows.
SAMPLE_ROWS = 1_000
#: So often each sampled row is worked out for a measurable time.
PASSES = 2


@dataclass(frozen=True)
class Rule:
    """``rejects`` may use the text column and the base statistics that ``needs`` names."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ("n_words",)


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows are hashed to 96 bits; only a text whose 64-bit hashes collide gets the sort that
    finds the repeated positions, whose windows of three are then merged.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    short = F.transform(at, lambda i: F.xxhash64(*three(i)))
    full = F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*three(i)).alias("h"), F.hash(*three(i)).alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
        hit = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
        p = F.sort_array(F.transform(hit, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    once = F.size(F.array_distinct(short)) == F.size(words) - 2
    held = F.transform(F.array(full), repeated)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).when(once, F.lit(0).cast("long")).otherwise(F.get(held, F.lit(0)))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _statistics(body: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_BLANK))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": n_repeat_words(words),
    }


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 50), Rule("repeat_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_words", "n_repeat_words"))]


def base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the base statistics (long) and base_failed."""
    df = df.drop(*BASE, "base_failed")
    words = fresh(df, "words")
    df = df.withColumn(words, words_of(F.col(text)))
    df = df.withColumns(_statistics(F.coalesce(F.col(text), F.lit("")), F.col(words))).drop(words)
    failed = base_rules()[0].rejects
    for r in base_rules()[1:]:
        failed = failed | r.rejects
    return df.withColumn("base_failed", failed)


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern))


def default_rules(text: str = "text") -> list[Rule]:
    n = F.col("n_words")
    letters, capitals = _count(text, "[A-Za-z]"), _count(text, "[A-Z]")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, ("n_words", "n_symbols")),
        Rule("dup_lines", F.col("n_dup_lines") * 10 > n, ("n_words", "n_dup_lines")),
        Rule("short_words", F.col("word_chars") < 2 * n, ("n_words", "word_chars")),
        Rule("long_words", F.col("word_chars") > 20 * n, ("n_words", "word_chars")),
        Rule("exclaims", 10 * _count(text, "!") > 3 * n),
        Rule("capitals", 10 * capitals > 6 * letters),
    ]


def plan_cascade(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float]]:
    """Rules in the order to run them, each with its rejections per second among the rows left to it.

    A rule's cost is the time of a pass over the cached sample, each row ``PASSES`` times, that works
    out only this rule and what it needs, less that of a pass that works out none.
    """
    total = df.count()
    sample = df.sample(False, min(1.0, 1.2 * sample_rows / total), seed=7) if total > sample_rows else df
    sample = sample.limit(sample_rows).select(F.col(text), words_of(F.col(text)).alias("__words")).cache()
    try:
        if not sample.count():
            return [(r, 0.0) for r in rules]
        stats = _statistics(F.coalesce(F.col(text), F.lit("")), F.col("__words"))
        many = sample.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))

        def seconds(needs: tuple[str, ...], rejects: Column) -> float:
            began = time.perf_counter()
            many.withColumns({k: stats[k] for k in needs}).agg(F.count(F.when(rejects, 1))).first()
            return time.perf_counter() - began

        seconds((), F.col("__pass") < 0)
        floor = min(seconds((), F.col("__pass") < 0) for _ in range(2))
        cost = [max(seconds(r.needs, r.rejects) - floor, 1e-4) for r in rules]
        flagged = sample.withColumns(stats).select(F.array(*(F.coalesce(r.rejects, F.lit(False)) for r in rules)).alias("hit"))
        rows = [(r["hit"], r["n"]) for r in flagged.groupBy("hit").agg(F.count("*").alias("n")).collect()]
    finally:
        sample.unpersist()
    order, left = [], list(range(len(rules)))
    while left:
        rate = {i: sum(n for hit, n in rows if hit[i]) / cost[i] for i in left}
        best = max(left, key=lambda i: (rate[i], -cost[i]))
        order.append((rules[best], rate[best]))
        left.remove(best)
        rows = [(hit, n) for hit, n in rows if not hit[best]]
    return order


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, in this order; null if none does."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        chain = chain.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    return chain


def assess(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """``df`` plus base statistics, base_failed, rejected_by and kept."""
    stats = base_stats(df, text).drop("kept", "rejected_by")
    rules = default_rules(text) if rules is None else rules
    order = [r for r, _ in plan_cascade(df.select(text), rules, text)]
    return stats.withColumn("rejected_by", verdict(order)).withColumn("kept", F.col("rejected_by").isNull())


def keep(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects.

    The row number keeps the optimiser from pushing the filter below the statistics, which would
    work the word list out anew in every lambda.
    """
    rules = [*base_rules(), *default_rules(text)] if rules is None else rules
    body, known = F.coalesce(F.col(text), F.lit("")), set()
    work = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(text), words_of(F.col(text)).alias("__words"))
    stats, alive = _statistics(body, F.col("__words")), F.lit(True)
    for k, (r, _) in enumerate(plan_cascade(df.select(text), rules, text)):
        new = [n for n in r.needs if n not in known]
        known.update(new)
        if new:
            work = work.withColumns({n: F.when(alive, stats[n]) for n in new})
        work = work.withColumn(f"__alive{k}", alive & ~F.coalesce(r.rejects, F.lit(False)))
        alive = F.col(f"__alive{k}")
    return work.withColumn("__n", F.monotonically_increasing_id()).where(alive & (F.col("__n") >= 0)).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *BASE, "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), b AS (
  SELECT w.doc_id, text, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         length(regexp_replace(text, '[^!]', '', 'g')) AS exclaims
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 10 * exclaims > 3 * n_words OR 10 * capitals > 6 * letters) AS kept
FROM f
"""
