"""Queries of the store, versioned files, arguments and code chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternlake.functions import text as X
from lanternlake.operators import arguments as A
from lanternlake.operators import chunkers as K
from lanternlake.operators import ingest as I
from lanternlake.operators import sinks as W
from lanternlake.plans.retrieval_queries import DOCS
from lanternlake.sources import revisions as V
from lanternlake.sources import tables as S
from lanternlake.storage import new_folder

# ---------------------------------------------------------------- the store

DOCUMENT = "document_id bigint, project_id string, content string"
CHUNK = "document_id bigint, position int, chunk string"
VECTOR = "document_id bigint, vector array<double>"


def filled_store(spark, sf) -> str:
    """The path of a store that held two thirds of the documents, some with another text or project, and then took a batch with all, but for those
    that were deleted; the batch twice, as after a failure."""
    now = S.documents(spark, sf).select(F.col("chunk_id").alias("document_id"), "project_id", "content")
    n, path = F.col("document_id"), new_folder(spark, "store")
    first = now.where(n % 3 != 0).select("document_id", F.when(n % 11 == 0, "other").otherwise(F.col("project_id")).alias("project_id"), F.when(n % 3 == 1, F.concat("content", F.lit(" x"))).otherwise(F.col("content")).alias("content"))
    vectors = S.vectors(spark, sf).select(F.col("chunk_id").alias("document_id"), F.col("vector").cast("array<double>").alias("vector"))

    def bring(batch, docs, status):
        chunks = I.section_chunks(docs).select("document_id", "position", "chunk")
        W.ingest(path, batch, status, docs, chunks, vectors.join(docs.select("document_id"), "document_id", "left_semi"))

    bring("first", first, first.select("document_id", F.lit("new").alias("status")))
    then = now.where(n % 13 != 0)
    for _ in range(2):
        held = W.table(spark, path, "documents", DOCUMENT).select(n.alias("id"), "project_id", X.content_hash(F.col("content")).alias("content_hash"))
        status = I.ingest_delta(then.withColumnRenamed("document_id", "id"), held).select(F.col("id").alias("document_id"), "status")
        gone = held.where("id % 13 = 0").select(F.col("id").alias("document_id"), F.lit("deleted").alias("status"))
        bring("second", then, status.unionByName(gone))
    return path


def store_state(spark, sf):
    """Documents with the texts of their chunks and whether they have a vector."""
    path = filled_store(spark, sf)
    chunks = W.table(spark, path, "chunks", CHUNK).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk"))).alias("c"))
    vectors = W.table(spark, path, "vectors", VECTOR).select("document_id", F.lit(True).alias("has_vector"))
    # Digests are joined, not texts.
    chunks = chunks.select("document_id", F.md5(F.array_join(F.transform("c", lambda x: x["chunk"]), "\n")).alias("chunks_md5"))
    documents = W.table(spark, path, "documents", DOCUMENT).select("document_id", "project_id", F.md5("content").alias("content_md5"))
    out = documents.join(chunks, "document_id", "full").join(vectors, "document_id", "full")
    return out.select("document_id", "project_id", "content_md5", "chunks_md5", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


def store_rejects(spark, sf):
    return W.rejects(spark, filled_store(spark, sf))


# ---------------------------------------------------------------- versioned files


def _files(spark, sf, rev: str):
    """(rev, path, content): a file a brand with a line a part; each revision lacks a brand and some parts."""
    lacks, keep, change = {"base": (3, F.col("p_partkey") % 10 != 0, F.lit("")), "target": (4, F.col("p_partkey") % 7 != 0, F.when(F.col("p_partkey") % 11 == 0, " new").otherwise("")), V.WORKING_TREE: (5, F.lit(True), F.lit(""))}[rev]
    number = F.substring_index("p_brand", "#", -1).cast("int")
    line = F.concat(F.lit("part "), "p_partkey", F.lit(" "), "p_name", change)
    parts = S.read(spark, sf, "part").where(keep & (number != lacks)).groupBy(number.alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("lines"))
    return parts.select(F.lit(rev).alias("rev"), F.concat(F.lit("src/Brand"), "k", F.lit(".cs")).alias("path"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def _change(spark, sf):
    root = new_folder(spark, "revisions")
    V.register(spark)
    for rev in ("base", "target", V.WORKING_TREE):
        _files(spark, sf, rev).write.format("revisions").mode("append").save(root)
    asked = S.read(spark, sf, "part").select(F.concat(F.lit("src/Brand"), F.substring_index("p_brand", "#", -1), F.lit(".cs")).alias("path")).distinct().where("path not rlike 'Brand2'")
    files = asked.unionByName(spark.range(1).select(F.lit("src/Nowhere.cs").alias("path")))
    return root, V.resolved_change(spark, root, files, "base", "target")


def change_contents(spark, sf):
    _, change = _change(spark, sf)
    return change.select("path", F.md5("base_content").alias("base_md5"), F.md5("target_content").alias("target_md5"), "warning")


def target_state(spark, sf):
    root, change = _change(spark, sf)
    return V.state_after(spark, root, change).select("path", F.md5("content").alias("content_md5"))


# ---------------------------------------------------------------- arguments


def _calls(spark, sf):
    """Events as calls of tools: their arguments as JSON, with what is wrong in turn."""
    n = F.col("event_id")
    uuid = F.concat(F.lpad(F.hex(n), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    name = F.when(n % 7 == 0, "  ").when(n % 7 == 1, "a/b").when(n % 7 == 2, "a name that is too long").otherwise(F.concat(F.lit("s"), n % 100))
    good = F.to_json(F.struct(F.when(n % 5 != 0, F.when(n % 5 == 1, "nothing").otherwise(uuid)).alias("id"), name.alias("name"), (n % 30).alias("depth"), F.col("value").alias("limit"), F.array_repeat(F.lit("x"), (n % 4).cast("int")).alias("tags")))
    json = F.when(n % 17 == 0, "no json").when(n % 17 == 1, "[1, 2]").when(n % 17 == 2, F.concat(F.lit('{"id": 5, "name": "ok", "depth": "3", "tags": {}, "limit": null, "extra": '), "props", F.lit("}"))).otherwise(good)
    return S.read(spark, sf, "events").select("event_id", F.col("event_type").alias("subject"), json.alias("json"))


_RULES = [("id", "uuid", True, None, None, None), ("name", "identifier", True, None, 10.0, None), ("depth", "integer", False, 1.0, 20.0, None), ("limit", "number", False, None, 150.0, None), ("tags", "array", True, 1.0, 2.0, None)]


def argument_errors(spark, sf):
    known = A.rules(spark, *((tool, *r) for tool in ("error", "view", "click", "purchase") for r in _RULES))
    out = A.checked(_calls(spark, sf), known)
    return out.select("event_id", F.array_join("errors", ",").alias("errors"), A.integer_argument(F.col("json"), "depth", 5).alias("depth"))


def event_raw_data(spark, sf):
    n = F.col("event_id")
    e = S.read(spark, sf, "events").select(n, F.when(n % 9 == 0, F.lit(None)).when(n % 9 == 1, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("raw"))
    r = A.raw_data(F.col("raw"))
    return e.select("event_id", r["valid"].alias("valid"), F.try_variant_get(r["data"], "$.k", "bigint").alias("k"))


# ---------------------------------------------------------------- code


def code_units(spark, sf):
    """A class a brand, with a method or a property a part, cut by the table function."""
    n = F.col("p_partkey")
    member = F.when(n % 3 == 0, F.concat(F.lit("public int P"), n, F.lit(' { get; set; }'))).otherwise(F.concat(F.lit("public string P"), n, F.lit("(int x)\n        {\n            if (x > 0) { return \"}"), "p_name", F.lit("\"; }\n            return null; // }\n        }")))
    rows = S.read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), member.alias("m")))).alias("m"))
    name = F.concat(F.lit("B"), F.substring_index("p_brand", "#", -1))
    text = F.concat(F.lit("namespace Shop\n{\n    public class "), name, F.lit("\n    {\n        private int n = 0;\n        "), F.array_join(F.transform("m", lambda x: x["m"]), "\n        "), F.lit("\n    }\n}\n"))
    out = K.code_chunks(rows.select(name.alias("document_id"), text.alias("content"), F.lit("csharp").alias("language")))
    return out.select("document_id", "position", "chunk_type", "symbol", "container", F.md5("chunk").alias("chunk_md5"))


QUERIES = {f.__name__: f for f in (store_state, store_rejects, change_contents, target_state, argument_errors, event_raw_data, code_units)}

_FILES_SQL = """b AS (SELECT *, split_part(p_brand, '#', -1)::INT AS k FROM part),
  files AS (SELECT 'base' AS rev, 'src/Brand' || k || '.cs' AS path, string_agg('part ' || p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) AS content FROM b WHERE p_partkey % 10 <> 0 AND k <> 3 GROUP BY k
    UNION ALL SELECT 'target', 'src/Brand' || k || '.cs', string_agg('part ' || p_partkey || ' ' || p_name || CASE WHEN p_partkey % 11 = 0 THEN ' new' ELSE '' END, chr(10) ORDER BY p_partkey) FROM b WHERE p_partkey % 7 <> 0 AND k <> 4 GROUP BY k
    UNION ALL SELECT 'worktree', 'src/Brand' || k || '.cs', string_agg('part ' || p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) FROM b WHERE k <> 5 GROUP BY k),
  asked AS (SELECT DISTINCT 'src/Brand' || k || '.cs' AS path FROM b WHERE NOT starts_with(k::VARCHAR, '2') UNION ALL SELECT 'src/Nowhere.cs'),
  change AS (SELECT path, x.content AS base, y.content AS target FROM asked LEFT JOIN (SELECT * FROM files WHERE rev = 'base') x USING (path) LEFT JOIN (SELECT * FROM files WHERE rev = 'target') y USING (path))"""
_MEMBER = """CASE WHEN p_partkey % 3 = 0 THEN 'public int P' || p_partkey || ' { get; set; }' ELSE 'public string P' || p_partkey || '(int x)' || chr(10) || '        {' || chr(10) || '            if (x > 0) { return "}' || p_name || '"; }' || chr(10) || '            return null; // }' || chr(10) || '        }' END"""
_FINAL = "(chunk_id % 13 <> 0 AND chunk_id % 3 <> 0 AND chunk_id % 11 = 0)"

SQL = {
    "store_state": f"""WITH {DOCS}, f AS (SELECT chunk_id AS document_id, CASE WHEN {_FINAL} THEN 'other' ELSE project_id END AS project_id, md5(CASE WHEN {_FINAL} AND chunk_id % 3 = 1 THEN content || ' x' ELSE content END) AS content_md5 FROM docs WHERE chunk_id % 13 <> 0)
      SELECT document_id, project_id, content_md5, content_md5 AS chunks_md5, vec_id IS NOT NULL AS has_vector FROM f LEFT JOIN embeddings ON vec_id = document_id""",
    "store_rejects": f"WITH {DOCS} SELECT 'document' AS kind, chunk_id::VARCHAR AS id, 'the document is another project''s' AS reason, 'second' AS batch FROM docs WHERE {_FINAL}",
    "change_contents": f"WITH {_FILES_SQL} SELECT path, md5(base) AS base_md5, md5(target) AS target_md5, CASE WHEN base IS NULL AND target IS NULL THEN 'No content for ' || path END AS warning FROM change",
    "target_state": f"WITH {_FILES_SQL} SELECT path, md5(content) AS content_md5 FROM (SELECT path, content FROM files WHERE rev = 'worktree' AND path NOT IN (SELECT path FROM asked) UNION ALL SELECT path, target FROM change WHERE target IS NOT NULL)",
    "argument_errors": """WITH e AS (SELECT *, event_id AS n FROM events), v AS (SELECT n, event_type, CASE WHEN n % 17 = 0 THEN ['not-json'] WHEN n % 17 = 1 THEN ['not-object'] WHEN n % 17 = 2 THEN ['depth:type', 'id:type', 'tags:type']
        ELSE list_filter([CASE WHEN n % 30 < 1 THEN 'depth:below' WHEN n % 30 > 20 THEN 'depth:above' END, CASE n % 5 WHEN 0 THEN 'id:missing' WHEN 1 THEN 'id:not-uuid' END, CASE WHEN value > 150 THEN 'limit:above' END,
          CASE n % 7 WHEN 0 THEN 'name:blank' WHEN 1 THEN 'name:unsafe' WHEN 2 THEN 'name:above' END, CASE n % 4 WHEN 0 THEN 'tags:below' WHEN 3 THEN 'tags:above' END], lambda x: x IS NOT NULL) END AS errors FROM e)
      SELECT n AS event_id, CASE WHEN event_type IN ('error', 'view', 'click', 'purchase') THEN coalesce(array_to_string(errors, ','), '') END AS errors, CASE WHEN n % 17 > 2 THEN n % 30 ELSE 5 END AS depth FROM v""",
    "event_raw_data": "SELECT event_id, event_id % 9 <> 1 AS valid, CASE WHEN event_id % 9 > 1 THEN (props::JSON ->> '$.k')::BIGINT END AS k FROM events",
    "code_units": f"""WITH m AS (SELECT 'B' || split_part(p_brand, '#', -1) AS document_id, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN 'Property' ELSE 'Method' END AS kind, {_MEMBER} AS m FROM part),
      c AS (SELECT document_id, 'public class ' || document_id || chr(10) || '    {{' || chr(10) || '        private int n = 0;' || chr(10) || '        ' || string_agg(m, chr(10) || '        ' ORDER BY n) || chr(10) || '    }}' || chr(10) || '// members:' || chr(10)
        || string_agg('// ' || kind || ': P' || n, chr(10) ORDER BY n) AS chunk FROM m GROUP BY 1)
      SELECT document_id, 0 AS position, 'Class' AS chunk_type, document_id AS symbol, NULL AS container, md5(chunk) AS chunk_md5 FROM c
      UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n)::INT, kind, 'P' || n, document_id, md5(m) FROM m""",
}
