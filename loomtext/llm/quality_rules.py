"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule votes 1 (good), -1 (bad) or 0 (abstains); a rule that looks for one fault abstains
where the fault is absent, as that alone says nothing for a text.  The votes of all documents are counted
by pattern (at most 3 ** rules rows), and expectation-maximisation over the pattern table
estimates how often each rule votes which way on good and on bad documents.  A document is
kept if the posterior probability of good quality reaches ``least``.  Everything is a
DataFrame expression; the driver only sees one row of sums for each step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import double_array, materialise, space_words

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = "the of and to in is that for with it as on by this be are was at from de la le les des et en un une du que pour dans qui est el los las del por con para una der die das und den von mit ist im auf ein eine zu nicht sich".split()
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_bangs", "n_function", "n_lines", "n_dup_lines", "n_repeat_words")
#: The share of good documents is given, as votes on faults alone can't tell it.  EM ends
#: when no probability moves by ``SETTLED``, or after ``STEPS`` steps.
STEPS, SETTLED, LEAST, PRIOR = 200, 1e-6, 0.5, 0.85
#: Start of EM: probability of a vote on good and on bad documents, for rules that look for a
#: fault and for the rule that also speaks for a text.  The start stays as pseudo-counts of
#: ``SMOOTH`` times each class, which keeps the classes from changing places.
FAULT = {-1: (0.01, 0.35), 0: (0.98, 0.64), 1: (0.01, 0.01)}
WEAK_FAULT = {-1: (0.05, 0.35), 0: (0.94, 0.64), 1: (0.01, 0.01)}
BOTH_WAYS = {-1: (0.10, 0.60), 0: (0.10, 0.20), 1: (0.80, 0.20)}
SMOOTH = 0.05
#: Where EM starts for each rule.
STARTS = {"symbols": FAULT, "exclamations": FAULT, "upper_case": FAULT, "repeated_lines": WEAK_FAULT, "repeated_words": FAULT, "word_length": FAULT, "function_words": BOTH_WAYS}


def text_features(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row with the counts of its text; null and blank texts count nothing.

    The columns in ``carry`` (all but the text, unless named) pass through; those that
    share a name with a count are replaced by it.

    ``n_repeat_words`` counts the words that lie in a window of three that the text has
    twice or more.  Windows are compared by 64-bit hashes of word hashes inside one text;
    texts whose windows all differ, found with a hash set, skip the sort.
    """
    body = F.coalesce(F.col("t"), F.lit(""))
    count_of = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    carry = [c for c in (carry if carry is not None else [c for c in df.columns if c != text]) if c not in COUNTS]
    carried = [f"_c{i}" for i in range(len(carry))]
    one = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carry, carried, strict=True)], F.col(f"`{text}`").alias("t")).select(*carried, "t", space_words(F.col("t")).alias("w"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select(
        *carried,
        F.size("w").cast("bigint").alias("n_words"),
        (F.length(body) - count_of(" \t\n\x0b\f\r")).cast("bigint").alias("word_chars"),
        count_of(SYMBOLS).cast("bigint").alias("n_symbols"),
        count_of(upper).cast("bigint").alias("n_upper"),
        count_of("!").cast("bigint").alias("n_bangs"),
        F.size(F.filter("w", lambda x: x.isin(*FUNCTION_WORDS))).cast("bigint").alias("n_function"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.when(F.size("h") >= 3, F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    three = two.select(
        *[c for c in two.columns if c not in ("h", "lines")],
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("g"),
    )
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    plain = [c for c in three.columns if c != "g"]
    four = three.select(*plain, F.when(repeats, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("s"))
    again = lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"])
    five = four.select(*plain, F.when(F.col("s").isNotNull(), F.sort_array(F.filter(F.transform("s", lambda x, i: F.when(again(x, i), x["p"])), lambda p: p.isNotNull()))).alias("starts"))
    covered = F.aggregate(F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return five.select(*[F.col(k).alias(c) for c, k in zip(carry, carried, strict=True)], *plain[len(carry):], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    votes = F.when(bad, F.lit(-1))
    return (votes if good is None else votes.when(good, F.lit(1))).otherwise(F.lit(0))


def rule_votes() -> dict[str, Column]:
    """The rules over ``text_features``."""
    n = F.col("n_words")
    return {
        "symbols": _vote(10 * F.col("n_symbols") > n),
        "exclamations": _vote(4 * F.col("n_bangs") > n),
        "upper_case": _vote((n >= 10) & (100 * F.col("n_upper") > 30 * F.col("word_chars"))),
        "repeated_lines": _vote(100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "repeated_words": _vote(100 * F.col("n_repeat_words") > 25 * n),
        "word_length": _vote((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)),
        "function_words": _vote((n >= 50) & (100 * F.col("n_function") < 2 * n), (n >= 10) & (100 * F.col("n_function") >= 10 * n)),
    }


def vote_places(rules: list[str]) -> Column:
    """The votes as places in a table of weights: three for each rule, in the order -1, 0, 1."""
    return F.array(*[F.col(r) + F.lit(3 * i + 1) for i, r in enumerate(rules)])


def estimate_accuracies(patterns: DataFrame, starts: list[dict[int, tuple[float, float]]], steps: int = STEPS, share: float = PRIOR) -> tuple[list[float], list[float]]:
    """EM over a table of vote patterns ``(votes array<int> of vote_places, n)``.

    Returns, for each place, the probability of that vote on good and on bad documents.
    An empty table returns the start values.  A step is one aggregate whose weights are a
    literal array, so all steps share one compiled plan; they end once they move nothing.
    """
    start_good, start_bad = ([s[v][k] for s in starts for v in (-1, 0, 1)] for k in (0, 1))
    good, bad = start_good, start_bad
    for _ in range(steps):
        weighed = patterns.select("votes", "n", (F.col("n") * posterior(F.col("votes"), share, good, bad)).alias("p"))
        sums = weighed.select("n", "p", F.explode("votes").alias("at")).groupBy("at").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        if not sums:  # three rows for each rule at most
            break
        of_good, of_all = {r["at"]: r["p"] for r in sums}, {r["at"]: r["n"] for r in sums}
        total_good, total = sum(of_good.get(v, 0.0) for v in range(3)), sum(of_all.get(v, 0) for v in range(3))
        of_bad = {at: of_all[at] - of_good[at] for at in of_all}
        before = [*good, *bad]
        good, bad = (
            [(of.get(v, 0.0) + (SMOOTH * total + 1) * start[v]) / (size + SMOOTH * total + 1) for v in range(len(start))]
            for of, size, start in ((of_good, total_good, start_good), (of_bad, total - total_good, start_bad))
        )
        if max(abs(x - y) for x, y in zip(before, [*good, *bad], strict=True)) < SETTLED:
            break
    return good, bad


def posterior(votes: Column, share: float, good: list[float], bad: list[float]) -> Column:
    """The probability of good quality given the votes of all rules that don't abstain."""
    weights = [0.0 if v % 3 == 1 else math.log(g / b) for v, (g, b) in enumerate(zip(good, bad, strict=True))]
    held = double_array([*weights, math.log(share / (1 - share))])
    total = F.aggregate(votes, F.get(held, F.lit(len(weights))), lambda acc, v: acc + F.get(held, v))
    return 1 / (1 + F.exp(-total))


def judge_quality(df: DataFrame, text: str = "text", carry: list[str] | None = None, steps: int = STEPS, least: float = LEAST) -> DataFrame:
    """One row for each document: the carried columns, counts, votes, ``quality`` (posterior), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words repeated.  Null texts
    have no words and fail.  Equal rows get equal rows; an empty table gives no rows.  The
    counts are written once to the shared folder, as both EM and the result need them.
    """
    votes = rule_votes()
    counted = materialise(text_features(df, text, carry), "quality-counts").withColumns({f"vote_{k}": v for k, v in votes.items()})
    rules = [f"vote_{k}" for k in votes]
    patterns = materialise(counted.groupBy(vote_places(rules).alias("votes")).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "quality-patterns").coalesce(1)
    good, bad = estimate_accuracies(patterns, [STARTS[k] for k in votes], steps)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.withColumns({"quality": posterior(vote_places(rules), PRIOR, good, bad), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
