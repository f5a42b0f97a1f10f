"""The query on Merkle manifests: op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle
from .common import table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language; the text of those whose id's CRC divides by 3 is tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents").select(*COLUMNS), COLUMNS, changed={"text": tampered})


def crc32_sql(data: str) -> str:
    """Unsigned CRC-32 of a blob's bytes, bit by bit."""
    bits = f"flatten(list_transform(range(octet_length({data})), lambda k: list_transform(range(8), lambda b: (('0x' || substr(hex({data}), 2 * k + 1, 2))::BIGINT >> b) & 1)))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295)"


def _levels(name: str, group: str, depth: int) -> str:
    """CTEs {name}0 ... : each level's nodes with their siblings to the left and right; above a group's root the node stays as it is."""
    out = []
    for k in range(depth):
        run = f"PARTITION BY {group}, i // 8 ORDER BY i"
        out.append(f"""{name}{k}s AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {group}) AS m FROM {name}{k})""")
        out.append(f"{name}{k + 1} AS (SELECT {group}, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k}s GROUP BY {group}, i // 8)")
    return ",\n".join(out)


#: Levels in the SQL: enough for 8**7 documents of a language and 64 languages.
_DEEP, _WIDE = 7, 2
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _chain(d: str) -> tuple[str, str]:
    """Columns d0, d1, ... each made of the one before, in nested selects: the folding of a digest."""
    steps = [*(f"a{k}" for k in range(_DEEP)), *(f"b{k}" for k in range(_WIDE))]
    sql = f"(SELECT *, {d} AS f0 FROM joined)"
    for k, s in enumerate(steps):
        sql = f"(SELECT *, CASE WHEN {s}m = 1 THEN f{k} ELSE sha256({s}l || f{k} || {s}r) END AS f{k + 1} FROM {sql})"
    return sql, f"f{len(steps)}"


_CHAIN, _LAST = _chain("changed")
_SIDES = ", ".join(f"a{k}.l AS a{k}l, a{k}.r AS a{k}r, a{k}.m AS a{k}m" for k in range(_DEEP)) + ", " + ", ".join(f"b{k}.l AS b{k}l, b{k}.r AS b{k}r, b{k}.m AS b{k}m" for k in range(_WIDE))
OP11_SQL = f"""
WITH t AS (SELECT *, CASE WHEN {crc32_sql("encode(doc_id::VARCHAR)")} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF("text")} AS leaf, {_LEAF("other")} AS changed FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
a0 AS (SELECT g, i, leaf AS d FROM placed),
{_levels("a", "g", _DEEP)},
b0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS i, d, g FROM a{_DEEP}),
{_levels("b", "z", _WIDE)},
joined AS (SELECT p.doc_id, p.leaf, p.changed, b0s.d AS subroot, b{_WIDE}.d AS root, {_SIDES}
  FROM placed p JOIN b0s ON b0s.g = p.g JOIN b{_WIDE} ON true
  {" ".join(f"JOIN a{k}s a{k} ON a{k}.g = p.g AND a{k}.i = p.i // {8**k}" for k in range(_DEEP))}
  {" ".join(f"JOIN b{k}s b{k} ON b{k}.i = b0s.i // {8**k}" for k in range(_WIDE))})
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{s}{k}l || {s}{k}r" for s, m in (("a", _DEEP), ("b", _WIDE)) for k in range(m))}) AS proof_sha256, {_LAST} AS folded_root, {_LAST} = root AS verified
FROM {_CHAIN}
"""
