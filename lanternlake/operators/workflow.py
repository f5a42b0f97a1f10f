"""What surrounds a model call: retries, validation and repair, budgets of tool output, traces, sinks, and small column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions.text import backoff, sanitize_lines

# fixed values: failures that may pass by themselves, and the names of tool states outside
TRANSIENT = ("RATE_LIMITED", "TIMEOUT", "UNAVAILABLE")
TOOL_STATUS = {"Executed": "executed", "Rejected": "rejected", "Failed": "failed", "NotAllowed": "not_allowed", "Timeout": "timeout"}


def safe_ratio(part: Column, whole: Column) -> Column:
    """part/whole to six places; null where whole is not above 0."""
    return F.when(whole > 0, F.round(part / whole, 6))


def tool_status(status: Column) -> Column:
    """The outer name of a tool's state; failed for any other."""
    known = F.create_map(*(F.lit(x) for pair in TOOL_STATUS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(status, F.lit(""))), F.lit("failed"))


def argument_summary(arguments: Column, most: int = 200) -> Column:
    """The first characters of arguments as JSON."""
    return F.substring(arguments, 1, most)


def without_nulls(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def camel_case(df: DataFrame) -> DataFrame:
    """df with its columns' names in camelCase: words after the first begin with a capital, the underscores go."""
    named = lambda c: "".join(x if i == 0 else x[:1].upper() + x[1:] for i, x in enumerate(c.split("_")))
    return df.toDF(*map(named, df.columns))


#: Kinds of evidence, by which an id begins.
EVIDENCE_KINDS = ("api", "change", "chunk", "component", "dependency", "document", "incident", "runbook", "service", "symbol")


def evidence_ids_in(text: Column) -> Column:
    """The ids on lines of a rendered text that are a dash and an id: a kind, a colon and one word, or two words with an arrow between them."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.startswith(x, F.lit("- ")) & (F.trim(F.substring_index(F.substring(x, 2, 1 << 30), ":", 1)).isin(*EVIDENCE_KINDS)))
    words = F.transform(lines, lambda x: F.filter(F.split(F.substring(x, 2, 1 << 30), r"\s+"), lambda w: w != ""))
    whole = F.filter(words, lambda w: ((F.size(w) == 1) | (F.size(w) == 3) & (F.get(w, F.lit(1)) == "->")) & ~F.get(w, F.lit(0)).endswith(":"))
    return F.transform(whole, lambda w: F.array_join(w, " "))


def union_of(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def warnings_of(*parts: DataFrame) -> DataFrame:
    """The different rows of all parts."""
    return union_of(*parts).distinct()


def tool_output_budget(results: DataFrame, total: int = 120_000) -> DataFrame:
    """(request_id, seq, body) from (request_id, seq, output): half of the total budget of characters, spent in order.

    Lines that read like instructions go first. A result that begins after the budget is spent is left out, the one
    that crosses it is cut; blank bodies read "(no output)" and take what they are long. A request's few results are one task's.
    """
    budget = total // 2
    bodies = results.select("request_id", "seq", sanitize_lines(F.col("output")).alias("body"))
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.lit(budget) - F.coalesce(F.sum(F.length("body")).over(before), F.lit(0))).cast("int")
    cut = bodies.withColumn("room", left).where("room > 0").withColumn("body", F.expr("substring(body, 1, room)"))
    blank = F.regexp_replace("body", r"\s", "") == ""
    return cut.select("request_id", "seq", F.when(blank, F.lit("(no output)")).otherwise(F.col("body")).alias("body"))


def retried(outcomes: DataFrame, retries: int = 2, base: float = 5.0, cap: float = 30.0) -> DataFrame:
    """(call_id, attempt, code, delay, final) of the attempts that are made, from what each would give: (call_id, attempt from 1, code or null).

    Only transient failures are tried again, `retries` times at most; the wait before an attempt doubles from base up to cap seconds.
    final marks the last attempt, whose code is the call's.
    """
    w = Window.partitionBy("call_id").orderBy("attempt")
    passing = F.coalesce(F.col("code").isin(*TRANSIENT), F.lit(False))
    stopped = F.coalesce(F.sum(F.when(passing, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = outcomes.select("call_id", "attempt", "code", stopped.alias("stops")).where((F.col("stops") == 0) & (F.col("attempt") <= retries + 1))
    delay = F.when(F.col("attempt") > 1, backoff(F.lit(base), F.col("attempt") - 2, F.lit(cap))).otherwise(F.lit(0.0))
    return made.select("call_id", "attempt", "code", delay.alias("delay"), (F.lead("attempt").over(w).isNull()).alias("final"))


def validated(outputs: DataFrame, repairs: int = 2) -> DataFrame:
    """(request_id, status, attempts, errors) from what each attempt gives: (request_id, attempt from 1, errors array or null for no usable output).

    The first attempt without errors counts, as valid or, if it is not the first, repaired; after `repairs` repairs the request fails
    safely, with the errors of its last attempt. Attempts beyond that are never made.
    """
    tried = outputs.where(F.col("attempt") <= repairs + 1)
    right = F.coalesce(F.size("errors") == 0, F.lit(False)) & F.col("errors").isNotNull()
    groups = tried.groupBy("request_id").agg(F.min(F.when(right, F.col("attempt"))).alias("first"), F.max("attempt").alias("made"), F.max_by("errors", "attempt").alias("last"))
    errors = F.when(F.col("first").isNotNull(), F.array().cast("array<string>")).otherwise(F.coalesce("last", F.array(F.lit("no usable output"))))
    status = F.when(F.col("first") == 1, "valid").when(F.col("first").isNotNull(), "repaired").otherwise("failed")
    return groups.select("request_id", status.alias("status"), F.coalesce("first", "made").alias("attempts"), errors.alias("errors"))


def embedded(chunks: DataFrame, provider, dimension: int, most: int = 100_000) -> DataFrame:
    """(chunk_id, vector, error) of chunks (chunk_id, content): blank and overlong ones have an error instead of a vector, none is dropped."""
    text = F.coalesce("content", F.lit(""))
    error = F.when(~text.rlike(r"\S"), "EMPTY").when(F.length(text) > most, "TOO_LONG")
    marked = chunks.select("chunk_id", "content", error.alias("error"))
    return marked.select("chunk_id", F.when(F.col("error").isNull(), provider(F.col("content"), dimension)).alias("vector"), "error")


def upserted(old: DataFrame, new: DataFrame, status: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Rows of documents (chunks, vectors) after an ingestion: what belongs to new, changed or deleted documents is replaced by its new rows.

    status: (document id, status). Rows of documents that are skipped or in error, or that aren't named, stay as they are.
    """
    touched = status.where(F.col("status").isin("new", "changed", "deleted")).select(id_col).distinct()
    written = status.where(F.col("status").isin("new", "changed")).select(id_col).distinct()
    return old.join(touched, id_col, "left_anti").unionByName(new.join(written, id_col, "left_semi"))


def trace_counts(calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, n_calls, n_executed, n_evidence_ids) from calls (run_id, status) and evidence (run_id, evidence_id); runs with either appear."""
    a = calls.groupBy("run_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("status") == "executed").alias("n_executed"))
    b = evidence.groupBy("run_id").agg(F.count_distinct("evidence_id").alias("n_evidence_ids"))
    return a.join(b, "run_id", "full").na.fill(0, ["n_calls", "n_executed", "n_evidence_ids"])


def as_json(df: DataFrame, key: str, name: str = "json") -> DataFrame:
    """(key, json): each row's other columns as a JSON object, for a table of runs, traces or results."""
    return df.select(key, F.to_json(F.struct(*(c for c in df.columns if c != key))).alias(name))


#: The producers of a change's evidence ids, in their order; documents bring their own ids.
PRODUCERS = ("change", "component", "api", "document", "incident", "runbook", "symbol", "symbol", "dependency")


def change_evidence(*parts: DataFrame) -> DataFrame:
    """(request_id, section, position, evidence_id) of the nine parts of a change in the order of PRODUCERS, repeated ids kept.

    Each part is (request_id, position, id); of dependencies (request_id, position, from_id, to_id).
    """
    out = []
    for i, (kind, part) in enumerate(zip(PRODUCERS, parts, strict=True)):
        value = F.concat("from_id", F.lit(" -> "), "to_id") if kind == "dependency" else F.col("id").cast("string")
        out.append(part.select("request_id", F.lit(i).alias("section"), "position", (value if kind == "document" else F.concat(F.lit(f"{kind}:"), value)).alias("evidence_id")))
    return union_of(*out)
