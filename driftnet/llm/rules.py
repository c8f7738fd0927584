"""Quality rules as a short-circuit cascade (operator 11), native: features and verdicts are column expressions.

A rule is a condition on features of a text that good texts meet. On a bounded sample each rule is timed alone and all verdicts are taken together; the rules are then ordered, the
one that rejects most per second among what the ones before it leave first. The verdict is one CASE whose branches follow that order, so an expensive rule is only
computed for texts that the cheaper ones leave. The order depends on the sample and the clock, the verdict does not: a text is kept if it meets every rule.

Defined cases: a null text has no words and no lines; its features are zero. Rows are rated one by one, so repeated rows and null ids are rated alike. Extra columns pass through; those that
bear the name of a result column are replaced. An empty table gives an empty result, its rules in the order in which they were given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.storage import written

#: Rows of the sample by which rules are ordered, and how often each rule is timed on it.
SAMPLE, TIMES = 4000, 2
SPACE = " \t\n\x0b\f\r"
GRAM = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Features = Mapping[str, Column]
Rules = Mapping[str, Callable[[Features], Column]]


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows of five words are compared by a 64-bit hash of their words within one text. Only a text in which two are equal has its windows sorted, to find which.
    """
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    trimmed = F.btrim(F.col("text"), F.lit(SPACE))
    cut = docs.drop(*BASE).withColumn("_dn_words", F.when(trimmed != "", F.split(trimmed, "[ \t-\r]+")))
    words = F.col("_dn_words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    grams = F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(GRAM)])))
    told = cut.withColumns({"_dn_grams": grams, "_dn_lines": lines})
    counted = told.withColumns(
        {
            "n_words": F.when(words.isNull(), F.lit(0)).otherwise(F.size(words)).cast("long"),
            "word_chars": long(F.length(F.array_join(words, ""))),
            "n_symbols": long(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))),
            "n_dup_lines": F.when(F.col("_dn_lines").isNull(), F.lit(0)).otherwise(F.size("_dn_lines") - F.size(F.array_distinct("_dn_lines"))).cast("long"),
            # by hash, then place: equal windows stand beside each other
            "_dn_sorted": F.when(F.size(F.array_distinct("_dn_grams")) < F.size("_dn_grams"), F.sort_array(F.transform("_dn_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        }
    )
    beside = lambda c, f: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), f)
    twice = counted.withColumn("_dn_at", F.filter(beside("_dn_sorted", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    placed = twice.withColumn("_dn_at", F.sort_array(F.array_distinct(F.flatten("_dn_at"))))
    steps = beside("_dn_at", lambda a, b: F.least(b - a, F.lit(GRAM)))
    covered = F.aggregate(steps, F.lit(GRAM), lambda total, x: total + x)
    # generated, not projected: else a filter on a feature would be pushed down, its expression copied into each place that refers to it
    told = F.inline(F.array(F.struct(*BASE[:-1], long(covered).alias(BASE[-1]))))
    return placed.select(*[c for c in docs.columns if c not in BASE], told)


def more_features(text: Column) -> dict[str, Column]:
    """Features beyond the base, each computed from the text where a rule asks for it."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return {
        "n_lines": F.coalesce(F.size(lines), F.lit(0)),
        "n_bullets": F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*[-*•]"))), F.lit(0)),
        "n_cut_lines": F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t\x0b\f\r]*$"))), F.lit(0)),
        "n_digits": F.coalesce(F.length(text) - F.length(F.regexp_replace(text, "[0-9]", "")), F.lit(0)),
        "n_braces": F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[{}\[\]\\\\]", "")), F.lit(0)),
    }


#: Rules by name; all in whole numbers.
RULES: dict[str, Callable[[Features], Column]] = {
    "enough_words": lambda x: x["n_words"] >= 10,
    "few_repeats": lambda x: 100 * x["n_repeat_words"] <= 20 * x["n_words"],
    "few_symbols": lambda x: 10 * x["n_symbols"] <= x["n_words"],
    "word_length": lambda x: (x["word_chars"] >= 2 * x["n_words"]) & (x["word_chars"] <= 15 * x["n_words"]),
    "few_equal_lines": lambda x: 2 * x["n_dup_lines"] <= x["n_lines"],
    "few_bullets": lambda x: 10 * x["n_bullets"] <= 9 * x["n_lines"],
    "few_cut_lines": lambda x: 10 * x["n_cut_lines"] <= 3 * x["n_lines"],
    "few_digits": lambda x: 2 * x["n_digits"] <= x["word_chars"],
    "few_braces": lambda x: 20 * x["n_braces"] <= x["word_chars"],
}


def arranged(costs: Mapping[str, float], failures: list[tuple[frozenset[str], int]]) -> list[str]:
    """The rules of ``costs`` in order: each time the one that rejects most per cost of the texts that are left. ``failures`` has sets of rules that texts fail,
    with the number of such texts. Rules that reject nothing more go last, the cheapest first."""
    out, left, open_ = [], [x for x in failures if x[0]], dict(costs)
    while open_:
        gain = {r: sum(n for failed, n in left if r in failed) / max(open_[r], 1e-9) for r in open_}
        best = max(open_, key=lambda r: (gain[r], -open_[r]))
        out.append(best)
        del open_[best]
        left = [x for x in left if best not in x[0]]
    return out


def sampled(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """About ``rows`` texts of ``docs``, drawn over all of them, in one partition so that times compare."""
    total = docs.count()
    return docs.select("text").sample(min(1.0, rows / max(total, 1)), 42).coalesce(1)


def order(some: DataFrame, features: Features, rules: Rules) -> list[str]:
    """``rules`` by rejection per cost, estimated on the sample ``some``."""
    tests = {name: F.coalesce(rule(features), F.lit(False)) for name, rule in rules.items()}
    seen = some.select(*[x.alias(name) for name, x in tests.items()]).groupBy(*rules).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most a row for each of the sample's
    failures = [(frozenset(name for name in rules if not row[name]), row["_n"]) for row in seen]

    def took(test: Column) -> float:
        def once() -> float:
            began = time.perf_counter()
            some.agg(F.count_if(test)).collect()
            return time.perf_counter() - began

        return min(once() for _ in range(TIMES))

    idle = took(F.col("text").isNull())
    return arranged({name: max(took(test) - idle, 1e-4) for name, test in tests.items()}, failures)


def cascade(docs: DataFrame, features: Features, rules: Rules, by: list[str]) -> DataFrame:
    """``docs`` with rejected_by, the first rule of ``by`` that a text fails (null: none), and kept: one CASE, which stops at that rule."""
    verdict = F.lit(None).cast("string")
    for name in reversed(by):
        verdict = F.when(~F.coalesce(rules[name](features), F.lit(False)), F.lit(name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, rules: Rules = RULES, by: list[str] | None = None) -> DataFrame:
    """``docs`` with the base features, base_failed (too few words, or too many repeated ones), rejected_by and kept. ``by`` gives the rules' order,
    else it is estimated on a sample."""
    features = {c: F.col(c) for c in BASE} | more_features(F.col("text"))
    by = by if by is not None else order(written(with_base(sampled(docs))), features, rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = cascade(with_base(docs), features, rules, by)
    return found.withColumn("base_failed", failed).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
