"""Operational queries: lists in pages, timelines, context, access, audit."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import folded


def with_filters(df: DataFrame, **equal) -> DataFrame:
    """Rows with the given values; None doesn't filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of sorted rows with the total of all. Size 1 to 100, pages from 1 on; order must end in a unique column."""
    size, number = max(1, min(100, size)), max(1, number)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def contains_text(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle, in any case of letters, in one of the columns; all rows for a blank one."""
    needle = needle.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(needle)
    return df.where(hit) if needle else df


def timeline(events: DataFrame, limit: int = 50) -> DataFrame:
    """Each incident's first events by time, then id, 1 to 200."""
    w = Window.partitionBy("incident_id").orderBy("occurred_at", "event_id")
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, min(200, limit)))


def with_events(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """incidents with their events as an array by time, then id; none is an empty array."""
    lists = events.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "type", "message"))).alias("events"))
    return incidents.join(lists, "incident_id", "left").withColumn("events", F.coalesce("events", F.array().cast(lists.schema["events"].dataType)))


def symptoms(events: DataFrame) -> DataFrame:
    """(incident_id, symptoms): messages of errors and logs that aren't blank, the first 20, and of those the distinct ones in order."""
    w = Window.partitionBy("incident_id").orderBy("occurred_at", "event_id")
    first = events.where(F.col("type").isin("Error", "Log") & (F.trim("message") != "")).withColumn("n", F.row_number().over(w)).where("n <= 20")
    return first.groupBy("incident_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda x: x["message"])).alias("symptoms"))


# fixed values: what is said of missing inputs, in this order
UNKNOWNS = (
    "No detection timestamp was supplied.",
    "No deployment events were supplied; the change window is unknown.",
    "No error or log samples were supplied.",
    "No metric/telemetry data was available.",
)


def incident_context(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """(incident_id, known_facts, unknowns, symptoms) of incidents (incident_id, title, severity, started_at, detected_at, environment, service)."""
    none_of = lambda kind: F.bool_and(F.col("type") != kind)
    flags = events.groupBy("incident_id").agg(none_of("Deployment").alias("no_deployment"), none_of("Metric").alias("no_metric"))
    joined = incidents.join(flags, "incident_id", "left").join(symptoms(events), "incident_id", "left")
    said = F.coalesce("symptoms", F.array().cast("array<string>"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fact = lambda label, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"{label}: "), c))
    known = F.array_compact(F.array(fact("Incident", F.col("title")), fact("Severity", F.col("severity")), fact("Started at", stamp("started_at")), fact("Environment", F.col("environment")), fact("Affected service", F.col("service")), fact("Detected at", stamp("detected_at"))))
    missing = (F.col("detected_at").isNull(), F.coalesce("no_deployment", F.lit(True)), F.size(said) == 0, F.coalesce("no_metric", F.lit(True)))
    unknown = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in zip(missing, UNKNOWNS, strict=True))))
    return joined.select("incident_id", known.alias("known_facts"), unknown.alias("unknowns"), said.alias("symptoms"))


# fixed values: what each role may do
ROLE_PERMISSIONS = {"Owner": ("Read", "Write", "Manage"), "Admin": ("Read", "Write", "Manage"), "Engineer": ("Read", "Write"), "Viewer": ("Read",)}


def access(requests: DataFrame, members: DataFrame) -> DataFrame:
    """requests (user_id, project_id, permission, is_admin) with decision: allowed, forbidden, or not_found for who is no member; administrators may all."""
    may = F.lit(False)
    for role, permissions in ROLE_PERMISSIONS.items():
        may = may | ((F.col("role") == role) & F.col("permission").isin(*permissions))
    joined = requests.join(members.select("user_id", "project_id", "role"), ["user_id", "project_id"], "left")
    return joined.withColumn("decision", F.when(F.col("is_admin") | F.coalesce(may, F.lit(False)), "allowed").when(F.col("role").isNull(), "not_found").otherwise("forbidden"))


def last_owners(members: DataFrame) -> DataFrame:
    """Projects with a single owner, who can't leave."""
    return members.groupBy("project_id").agg(F.count_if(F.col("role") == "Owner").alias("owners")).where("owners = 1").select("project_id")


def dashboard(**tables: DataFrame) -> DataFrame:
    """(name, n): the number of rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def unique_slugs(names: DataFrame, slug: Column, order: str) -> DataFrame:
    """names with slug: in order, each row's own if no earlier row has it, else the first free one of -2, -3, ... behind it; null stays null.

    A slug can be an own one of a row and a numbered one of another (a, a, a-2), so rows are dealt by what is left without
    numbers at the end. A task keeps a number for each different own slug of a group.
    """

    def begin():
        following: dict[str, int] = {}
        own: set[str] = set()

        def step(base):
            if base is None:
                return None
            k = following.get(base)
            if k is None:
                found = re.fullmatch(r"(.*)-([2-9]|[1-9][0-9]+)", base)
                k = 2
                if not found or following.get(found[1], 1) <= int(found[2]):
                    own.add(base)
                    following[base] = k
                    return base
            while f"{base}-{k}" in own:
                k += 1
            following[base] = k + 1
            return f"{base}-{k}"

        return step

    return folded(names, [F.regexp_replace(slug, "(-[0-9]+)+$", "")], [order], [slug], "slug", ("string", pa.string()), begin)


def foreign_services(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Incidents whose service isn't one of their project's."""
    own = services.select("project_id", F.col("service_id").alias("affected_service_id"))
    return incidents.where("affected_service_id is not null").join(own, ["project_id", "affected_service_id"], "left_anti")


def audit_append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def last_deployment(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """incidents with deployed_at, the last deployment of their project until they started (an extension).

    Incidents and deployments are put in one order of time within each project and hour; the last deployment of the hours before comes
    from the maxima of the hours, of which a project has few. No incident meets a deployment in a join.
    """
    row = F.struct(*(F.col(c) for c in incidents.columns)).alias("row")
    i = incidents.select("project_id", F.col("started_at").cast("timestamp").alias("at"), row, F.lit(None).cast("timestamp").alias("deployed"))
    at = F.col("occurred_at").cast("timestamp")
    d = events.where((F.col("type") == "Deployment") & F.col("project_id").isNotNull() & F.col("occurred_at").isNotNull())
    d = d.select("project_id", at.alias("at"), F.lit(None).cast(i.schema["row"].dataType).alias("row"), at.alias("deployed"))
    hour = F.floor(F.unix_seconds("at") / 3600).alias("hour")
    moments = i.unionByName(d).select("*", hour)
    before = Window.partitionBy("project_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = moments.groupBy("project_id", "hour").agg(F.max("deployed").alias("last")).select("project_id", "hour", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("project_id", "hour").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = moments.withColumn("own", F.max("deployed").over(within)).where("row is not null").join(carried, ["project_id", "hour"], "left")
    return found.select("row.*", F.coalesce("own", "carried").alias("deployed_at"))
