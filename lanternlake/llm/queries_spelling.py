"""The query on spelling variants: op12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spelling
from .common import table

#: Every so many hashes a run loses a letter; lengths and counts from which on a run is a word (fixed values).
MISSPELT, LEAST_LENGTH, LEAST_COUNT = 31, 7, 2


def misspelt_runs(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of all texts, those whose hash with the document's id says so with a letter left out. A null id leaves its runs whole."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    shorter = F.overlay("run", F.lit(""), (h % F.char_length("run") + 1).cast("int"), F.lit(1))
    return runs.select(F.when(h % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(spelling.dictionary(words, LEAST_LENGTH, LEAST_COUNT), ratio=10)


_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))"
_STEP = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
# All pairs by what is left when a letter is blanked or left out, for small tables.
OP12_SQL = rf"""
WITH RECURSIVE bits AS (SELECT range AS b, 0 AS k, range AS c FROM range(256) UNION ALL SELECT b, k + 1, {_STEP("c")} FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.LETTERS}')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, s, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM (SELECT *, doc_id || ':' || run AS s FROM runs), crc
), word AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, n FROM hashed
), known AS (
  SELECT word, sum(n)::BIGINT AS n FROM word WHERE len(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS (
  SELECT word, n, left(word, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM (SELECT *, unnest(range(len(word))) AS i FROM known)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN known b ON a.head || a.tail = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN known b ON a.head || a.tail = b.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), step AS (
  SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n
), way AS (
  SELECT word, word AS root, 0 AS k FROM known UNION ALL SELECT way.word, step.form, k + 1 FROM way JOIN step ON step.word = way.root
), last AS (
  SELECT word, arg_max(root, k) AS root FROM way GROUP BY word
)
SELECT known.word, form, root, known.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM known JOIN last USING (word) LEFT JOIN best USING (word) LEFT JOIN step USING (word)
"""
