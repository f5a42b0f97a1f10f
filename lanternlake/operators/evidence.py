"""Evidence: ids, packing to a budget of characters, grounding of claims, tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions.text import sanitize_lines


def evidence_id(kind: str, *parts: Column) -> Column:
    """kind:part; a dependency is dependency:from -> to."""
    return F.concat(F.lit(f"{kind}:"), parts[0] if len(parts) == 1 else F.concat_ws(" -> ", *parts))


def evidence_index(*sections: DataFrame) -> DataFrame:
    """(request_id, section, position, evidence_id) of all sections (request_id, position, evidence_id) in order, duplicates kept."""
    out = None
    for i, s in enumerate(sections):
        part = s.select("request_id", F.lit(i).alias("section"), "position", "evidence_id")
        out = part if out is None else out.unionByName(part)
    return out


#: Parts that a request's items are dealt into before its budget is spent.
PACK_PARTS = 256


def pack(items: DataFrame, budget: int, per_item: int, order: list | None = None) -> DataFrame:
    """(request_id, ord, item_id, content, truncated) from (request_id, item_id, score, content): what fits a budget of characters.

    Items without a score come first, then by score; lines that read like instructions go; each item is cut to per_item and to what is
    left; blank items take nothing. An item is truncated if it was cut or the budget is used up with it.

    Items are dealt into parts, each of which spends the whole budget by itself: what a part has no room for has none in the request
    either, where more comes before it. So one task gets what PACK_PARTS budgets hold at most, however many items a request has.
    """
    order = order or [F.desc_nulls_first("score"), F.asc("item_id")]
    clean = items.withColumn("clean", sanitize_lines(F.col("content")))
    capped = clean.withColumn("part", F.substring("clean", 1, per_item)).where(F.trim("part") != "")
    capped = capped.withColumn("n_clean", F.length("clean")).drop("content", "clean").withColumn("deal", F.pmod(F.xxhash64("item_id"), F.lit(PACK_PARTS)))

    def within(rows: DataFrame, *by: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))
        return rows.withColumn("left", (F.lit(budget) - used).cast("int")).where("left > 0")

    w = Window.partitionBy("request_id").orderBy(*order)
    placed = within(within(capped, "request_id", "deal"), "request_id").withColumn("out", F.expr("substring(part, 1, left)"))
    cut = (F.length("out") < F.col("n_clean")) | (F.length("out") == F.col("left"))
    return placed.where(F.trim("out") != "").select("request_id", F.row_number().over(w).alias("ord"), "item_id", F.col("out").alias("content"), cut.alias("truncated"))


def grounding_violations(claims: DataFrame, index: DataFrame) -> DataFrame:
    """(request_id, kind, position, id) of what has no ground.

    claims: (request_id, claim, position, evidence_ids). A claim needs at least one id of the index: kind ungrounded. Ids that are not
    in the index are kind invented.
    """
    known = index.select("request_id", "evidence_id").distinct().withColumn("known", F.lit(1))
    cited = claims.select("request_id", "claim", "position", F.explode_outer("evidence_ids").alias("evidence_id"))
    checked = cited.join(known, ["request_id", "evidence_id"], "left")
    none = checked.groupBy("request_id", "claim", "position").agg(F.max(F.coalesce("known", F.lit(0))).alias("m")).where("m = 0")
    invented = checked.where("known is null and evidence_id is not null").select("request_id", "evidence_id").distinct()
    return none.select("request_id", F.lit("ungrounded").alias("kind"), "position", F.col("claim").alias("id")).unionByName(
        invented.select("request_id", F.lit("invented").alias("kind"), F.lit(None).cast(claims.schema["position"].dataType).alias("position"), F.col("evidence_id").alias("id"))
    )


def tool_evidence_ids(results: DataFrame, id_col: str = "tool_call_id", output_col: str = "output") -> DataFrame:
    """(id, evidence_id): distinct strings of the outputs' top-level evidenceIds; none for what is no JSON object."""
    ids = F.from_json(F.col(output_col), "evidenceIds array<string>")["evidenceIds"]
    return results.select(F.col(id_col), F.explode(F.array_distinct(ids)).alias("evidence_id")).where("evidence_id is not null")


def tool_output(ids: Column, payload: Column) -> Column:
    return F.to_json(F.struct(ids.alias("evidenceIds"), payload.alias("payload")))


def structured_violations(results: DataFrame, checks: dict[str, Column], id_col: str) -> DataFrame:
    """(id, errors): names of the checks that a row fails; null counts as failing."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return results.select(id_col, failed.alias("errors")).where(F.size("errors") > 0)


def selection_trace(found: DataFrame, most: int = 20, per_item: int = 12_000) -> DataFrame:
    """found with selected (rank within most) and the content cut to per_item."""
    return found.withColumn("selected", F.col("rank") <= most).withColumn("content", F.substring("content", 1, per_item))


def incident_queries(incidents: DataFrame) -> DataFrame:
    """(incident_id, query_ord, text): title, five distinct symptoms at most, the service; blanks left out."""
    texts = F.concat(F.array("title"), F.slice(F.array_distinct("symptoms"), 1, 5), F.array("service"))
    kept = F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return incidents.select("incident_id", F.posexplode(kept).alias("query_ord", "text"))


def change_queries(changes: DataFrame) -> DataFrame:
    """(change_id, query_ord, text): the summary cut to 2,000, five distinct file names at most, twenty distinct symbol names at most."""
    names = F.array_distinct(F.transform("paths", lambda p: F.element_at(F.split(p, "/"), -1)))
    texts = F.concat(F.array(F.substring("summary", 1, 2000)), F.slice(names, 1, 5), F.slice(F.array_distinct("symbols"), 1, 20))
    kept = F.filter(F.array_distinct(texts), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return changes.select("change_id", F.posexplode(kept).alias("query_ord", "text"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float | None, price_out: float | None) -> Column:
    """Price per million tokens; null unless both prices are set."""
    if price_in is None or price_out is None:
        return F.lit(None).cast("double")
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000.0, 6)
