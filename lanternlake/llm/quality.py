"""Quality by weak supervision, in DataFrame operations only.

Rules look at counts of a text and vote for it, against it, or abstain. How often each vote goes with good and with
poor texts is estimated from the votes alone by expectation-maximisation; a text is kept by its posterior
probability of being good, not by passing all rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, saved, words

WINDOW = 5


def _repeat_words(tokens: Column) -> Column:
    """Words of the array that stand in a window of WINDOW words found twice or more in it. tokens must be a column, not an expression."""
    n = F.size(tokens)
    at = lambda a, i: F.get(a, i)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(tokens, i + k) for k in range(WINDOW))))
    in_order = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j, k: F.coalesce(at(s, j + k)["x"] == x["x"], F.lit(False))
        found = F.transform(s, lambda x, j: F.when(F.when(j > 0, same(x, j, -1)).otherwise(F.lit(False)) | same(x, j, 1), x["i"]))
        return F.array_sort(F.filter(found, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    # transform over an array of one holds a value that is used more than once
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    some = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(in_order(h), lambda s: covered(places(s)))).otherwise(F.lit(0)))
    return F.when(n >= WINDOW, some).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts for more rules) of each row; all 0 for null and empty texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(text).alias("tokens"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    base = base.withColumn("lines", lines)
    long = lambda c: c.cast("long")
    return base.select(
        F.col("id").alias(id_col),
        long(F.size("tokens")).alias("n_words"),
        long(F.length(F.regexp_replace("text", SPACE, ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("tokens")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.array_distinct("tokens"))).alias("n_distinct_words"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_bangs"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of counts: 1 for, -1 against, 0 abstains."""
    n = F.col("n_words")
    vote = lambda against, favour: F.when(against, F.lit(-1)).when(favour, F.lit(1)).otherwise(F.lit(0))
    share = lambda name, of=n: F.col(name) / F.greatest(of, F.lit(1))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    never = F.lit(False)
    return {
        "length": vote(n < 10, n >= 50),
        "word_length": vote((mean < 2) | (mean > 15), (mean >= 3) & (mean <= 10)),
        "symbols": vote(share("n_symbols") > 0.1, never),
        "repeated_windows": vote(share("n_repeat_words") > 0.2, share("n_repeat_words") < 0.01),
        "repeated_lines": vote((F.col("n_dup_lines") >= 3) & (share("n_dup_lines", F.col("n_lines")) > 0.3), never),
        "few_words": vote((n >= 20) & (share("n_distinct_words") < 2.5 / F.sqrt(F.greatest(n, F.lit(1)))), never),
        "shouting": vote(F.col("n_upper") > 0.4 * F.col("word_chars"), never),
        "exclamations": vote((n >= 10) & (share("n_bangs") > 0.5), never),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.8) -> tuple[float, list[dict[int, float]]]:
    """(log odds of a good text, for each rule the log odds that each vote adds), from counted patterns of votes.

    Starts from texts without a vote against being likely good. In each round a vote's accuracy is the expected share of texts that
    it is right about; it counts as far as it departs from the prior, the share of good texts that is taken as known. Estimates are smoothed. Rules are held to be
    no worse than chance: a vote against never counts in favour, nor one in favour against; abstaining adds nothing.
    """
    if not patterns:
        return math.log(prior / (1 - prior)), []
    m = len(patterns[0][0])
    good = [0.95 if -1 not in p else 0.02 for p, _ in patterns]
    log_odds = math.log(prior / (1 - prior))
    for _ in range(rounds):
        weights = []
        for j in range(m):
            seen = {v: [1.0, 1.0] for v in (-1, 1)}
            for (p, n), g in zip(patterns, good, strict=True):
                if p[j]:
                    seen[p[j]][0] += g * n
                    seen[p[j]][1] += (1 - g) * n
            adds = {v: math.log(a / b) - log_odds for v, (a, b) in seen.items()}
            weights.append({-1: min(adds[-1], 0.0), 0: 0.0, 1: max(adds[1], 0.0)})
        logits = [log_odds + sum(w[v] for w, v in zip(weights, p, strict=True)) for p, _ in patterns]
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) for z in logits]
    return log_odds, weights


def judge(counted: DataFrame, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """counted with base_failed, p_good and kept (p_good >= least, and not base_failed) added.

    counted: rows of counts(), on which all rows vote. The distinct patterns of votes with their numbers come to the driver, 3 to
    the power of the number of rules at most (6,561); an empty table gives no rows.
    """
    rules = votes()
    voted = counted.select(*counted.columns, *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect())
    log_odds, weights = estimate(patterns)
    z = F.lit(log_odds)
    for name, w in zip(names, weights, strict=False):
        z = z + F.when(F.col(name) == 1, F.lit(w[1])).when(F.col(name) == -1, F.lit(w[-1])).otherwise(F.lit(w[0]))
    judged = voted.withColumn("base_failed", base_failed()).withColumn("p_good", 1 / (1 + F.exp(-z)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= F.lit(least))).drop(*names)


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """counts() and judge() of each row of docs. The counts, a few numbers a row, are written to the shared folder between the two.

    Null and empty texts have all counts 0 and fail the base rule. Repeated ids are separate rows; other columns are not read.
    """
    return judge(saved(counts(docs, id_col, text_col), "quality-counts"), id_col, least)
