"""Retrieval quality: recall, precision, reciprocal rank and hits by case, summaries, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions.text import identifiers
from lanternlake.operators.retrieval import fused, leg_hits, small
from lanternlake.storage import checkpointed

KS = (5, 10)


def deduplicated(found: DataFrame) -> DataFrame:
    """(case_id, leg, source_key, rank): a source's first rank, ranked anew without gaps; rows without a source are dropped."""
    first = found.where("source_key is not null").groupBy("case_id", "leg", "source_key").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("case_id", "leg").orderBy("first", "source_key")
    return first.select("case_id", "leg", "source_key", F.row_number().over(w).alias("rank"))


def case_metrics(found: DataFrame, gold: DataFrame, legs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(case_id, leg, k, recall, precision, mrr, hit) for each case with gold (case_id, source_key), leg (leg) and k.

    Cases without gold are skipped. Precision is over k; the reciprocal rank is over the whole list.
    """
    size = gold.groupBy("case_id").agg(F.count_distinct("source_key").alias("n_gold"))
    marked = found.join(gold.distinct().withColumn("relevant", F.lit(1)), ["case_id", "source_key"], "left")
    ks_table = F.explode(F.array(*map(F.lit, ks))).alias("k")
    cases = size.crossJoin(F.broadcast(legs)).select("*", ks_table)
    at = F.when((F.col("relevant") == 1) & (F.col("rank") <= F.col("k")), 1).otherwise(0)
    joined = cases.join(marked.select("case_id", "leg", "rank", "relevant"), ["case_id", "leg"], "left")
    out = joined.groupBy("case_id", "leg", "k", "n_gold").agg(F.sum(at).alias("hits"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    return out.select("case_id", "leg", "k", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("hits") / F.col("k"), 6).alias("precision"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.least(F.col("hits"), F.lit(1)).cast("int").alias("hit"))


#: The strategies that are compared, and why one is left out for a case.
LEGS = ("vector", "keyword", "dependency", "hybrid")
NO_TERMS, NO_GOLD = "no identifiers in the query", "no expected evidence"


def leg_results(cases: DataFrame, chunks: DataFrame, vectors: DataFrame, gold: DataFrame, top: int = max(KS)) -> tuple[DataFrame, DataFrame]:
    """(case_id, leg, source_key, rank) of the first `top` chunks of each case and leg by source, and (case_id, leg, reason) of what was skipped.

    cases: (case_id, project_id, text, vector); chunks: (chunk_id, project_id, content, symbol, source_key); gold: (case_id, source_key). The three legs are searched once
    each, with the identifiers of a case's text as the symbols of its dependency leg; hybrid fuses them all. A case without gold is skipped
    in every leg, one without identifiers in the dependency leg. All rest is ranked as it stands: a leg that finds nothing is not skipped.
    """
    asked = cases.select(F.col("case_id").alias("query_id"), "project_id", "text", "vector", identifiers(F.col("text")).alias("symbols"))
    hits = checkpointed(leg_hits(asked, chunks, vectors, ["vector", "keyword", "dependency"]))
    found = reduce(DataFrame.unionByName, [fused(hits, leg, top).select("query_id", "chunk_id", "rank", F.lit(leg).alias("leg")) for leg in LEGS])
    keyed = found.join(chunks.select("chunk_id", "source_key"), "chunk_id").select(F.col("query_id").alias("case_id"), "leg", "source_key", "rank")
    legs = F.explode(F.array(*map(F.lit, LEGS))).alias("leg")
    known = gold.select(F.col("case_id").alias("query_id"), F.lit(True).alias("known")).distinct()
    reasons = asked.join(known, "query_id", "left").select(F.col("query_id").alias("case_id"), "symbols", "known", legs)
    reason = F.when((F.col("leg") == "dependency") & (F.size("symbols") == 0), NO_TERMS).when(F.col("known").isNull(), NO_GOLD)
    skipped = checkpointed(reasons.select("case_id", "leg", reason.alias("reason")).where("reason is not null"))
    return deduplicated(keyed.join(skipped, ["case_id", "leg"], "left_anti")), skipped


def passage_gold(cases: DataFrame, chunks: DataFrame, words: int = 5) -> DataFrame:
    """(case_id, source_key): the sources of the chunks (project_id, content, source_key) of a case's project that hold its text (case_id, project_id, text).

    Words 2 to `words` + 1 of the text, which stand whole in whatever holds it, are joined with all runs of as many words; then the text is looked
    for. A text of fewer words than these and one more is looked for by all the words between its first and last, and has no gold if there are none.
    """
    split = lambda c: F.split(c, r"\s+")
    parts = split(F.col("text"))
    inner = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.least(F.lit(words), F.size(parts) - 2)))
    asked = checkpointed(cases.select("case_id", "project_id", "text", F.array_join(inner, " ").alias("run"), F.size(inner).alias("n")).where("n > 0"))
    join = small(asked.select("project_id", "run", "n", "case_id"))
    # A mark stands for a chunk while its words are apart: its content would be copied to each of them.
    marked = chunks.select("project_id", "content", "source_key", F.xxhash64("content", "source_key").alias("mark"))
    held = []
    # One pass for each length that occurs, `words` of them at most.
    for n in [r[0] for r in asked.select("n").distinct().collect()]:
        # An array of one element, so that the text is split once and not for each word.
        runs = F.flatten(F.transform(F.array(split(F.col("content"))), lambda w: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
        rows = marked.where("content is not null").select("project_id", "mark", F.explode(runs).alias("run"))
        held.append(rows.join(join.where(F.col("n") == n), ["project_id", "run"]).select("project_id", "mark", "case_id"))
    if not held:
        return cases.select("case_id", F.lit(None).cast("string").alias("source_key")).limit(0)
    likely = checkpointed(reduce(DataFrame.unionByName, held).distinct().join(asked.select("case_id", "project_id", "text").distinct(), ["case_id", "project_id"]))
    return marked.join(small(likely), ["project_id", "mark"]).where(F.col("content").contains(F.col("text"))).select("case_id", "source_key").distinct()


def leg_summary(metrics: DataFrame) -> DataFrame:
    """(leg, k, n_cases, recall, precision, mrr, hit_rate): means over the cases, to six places."""
    mean = lambda c: F.round(F.avg(c), 6)
    return metrics.groupBy("leg", "k").agg(F.count("*").alias("n_cases"), mean("recall").alias("recall"), mean("precision").alias("precision"), mean("mrr").alias("mrr"), mean("hit").alias("hit_rate"))


def leg_contribution(found: DataFrame) -> DataFrame:
    """(signal, share): of fused results (vector, keyword, dependency), those that each leg found."""
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)
    one = found.agg(*(share(c).alias(c) for c in ("vector", "keyword", "dependency")))
    return one.unpivot([], ["vector", "keyword", "dependency"], "signal", "share")


def long_metrics(summary: DataFrame) -> DataFrame:
    return summary.unpivot(["leg", "k"], ["recall", "precision", "mrr", "hit_rate"], "metric", "value")


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(leg, k, metric, baseline, current, delta) of metrics (leg, k, metric, value) that both have."""
    old = baseline.select("leg", "k", "metric", F.col("value").alias("baseline"))
    return current.select("leg", "k", "metric", F.col("value").alias("current")).join(old, ["leg", "k", "metric"]).select("leg", "k", "metric", "baseline", "current", F.round(F.col("current") - F.col("baseline"), 6).alias("delta"))


def gold_coverage(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, covered, n_gold): gold sources cited, in any case of letters."""
    low = lambda d: d.select("case_id", F.lower("source_key").alias("s")).distinct()
    return low(gold).join(low(cited).withColumn("hit", F.lit(1)), ["case_id", "s"], "left").groupBy("case_id").agg(F.count("hit").alias("covered"), F.count("*").alias("n_gold"))


def matched_sources(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, source_key, cited_key, tier) of each expected source (case_id, source_key): the cited one that is the same, or else the smallest that is the same in any case of letters; null for none.

    Letters are compared by a collation, so keys are joined by equality as they are.
    """
    blind = lambda c: F.collate(c, "UTF8_LCASE").alias("blind")
    wanted = gold.select("case_id", "source_key").distinct()
    same = cited.select("case_id", "source_key", F.lit(True).alias("same")).distinct()
    folded = cited.select("case_id", "source_key", blind("source_key")).groupBy("case_id", "blind").agg(F.min("source_key").alias("near"))
    both = wanted.join(same, ["case_id", "source_key"], "left").withColumn("blind", F.collate("source_key", "UTF8_LCASE")).join(folded, ["case_id", "blind"], "left")
    tier = F.when(F.col("same"), "exact").when(F.col("near").isNotNull(), "case-blind")
    return both.select("case_id", "source_key", F.when(F.col("same"), F.col("source_key")).otherwise(F.col("near")).alias("cited_key"), tier.alias("tier"))


def outcome_counts(cases: DataFrame, *flags: str) -> DataFrame:
    """One row: cases, and for each flag how many have it."""
    return cases.agg(F.count("*").alias("n_cases"), *(F.count_if(F.col(f)).alias(f) for f in flags))


def skip_reasons(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def markdown_report(summary: DataFrame, deltas: DataFrame | None = None) -> str:
    """A table of a summary, a row for each leg and k: small by construction, so it is put together on the driver."""
    rows = summary.orderBy("leg", "k").collect()
    show = lambda x: "—" if x is None else f"{x:.3f}"
    out = ["| leg | k | cases | recall | precision | MRR | hit rate |", "| --- | --- | --- | --- | --- | --- | --- |"]
    out += [f"| {r.leg} | {r.k} | {r.n_cases} | {show(r.recall)} | {show(r.precision)} | {show(r.mrr)} | {show(r.hit_rate)} |" for r in rows]
    if deltas is not None:
        out += ["", "| leg | k | metric | baseline | current | delta |", "| --- | --- | --- | --- | --- | --- |"]
        out += [f"| {r.leg} | {r.k} | {r.metric} | {show(r.baseline)} | {show(r.current)} | {show(r.delta)} |" for r in deltas.orderBy("leg", "k", "metric").collect()]
    return "\n".join(out) + "\n"
