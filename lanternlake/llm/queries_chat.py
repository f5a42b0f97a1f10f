"""The query on chat formatting: op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import saved, table

#: What both turns of the conversation -7 say.
ODD_TEXT = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more as records of several layouts, formatted, written, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    records = saved(chat.records_of(turns.unionByName(odd)), "chat-records")
    return chat.read_back(saved(chat.format_records(records, order_col="at"), "chat-formatted"))


_ESC = lambda c: rf"replace(replace(replace({c}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{ODD_TEXT}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.BEGIN) + len(chat.AFTER_ROLE) + len(chat.END)} + len(replace({_ESC("role")}, ':', '\:')) + len({_ESC("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
