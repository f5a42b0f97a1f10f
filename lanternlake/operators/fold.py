"""Decisions that depend on the decisions before: each group's rows in order, as a stream through one task with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, keys: list, order: list, args: list[Column], name: str, kind: tuple[str, pa.DataType], begin: Callable[[], Callable]) -> DataFrame:
    """df with column `name` of type `kind`: what begin()'s function, new for each group, gives for each row's args in the group's order.

    Null keys are one group. A group is never in memory as a whole, only its state is; but it is one task's, however many rows it has.
    A column of that name is replaced.
    """
    ddl, arrow = kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for key, arg in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if step is None or key != now:
                    now, step = key, begin()
                out.append(step(*arg.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], ["row", "value"])

    pack = lambda columns: F.struct(*(c.alias(f"c{i}") for i, c in enumerate(F.col(x) if isinstance(x, str) else x for x in columns)))
    rows = df.select(F.struct("*").alias("row"), pack(keys).alias("key"), pack(order).alias("place"), pack(args).alias("args"))
    schema = rows.select("row").schema.add("value", ddl)
    done = rows.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`") for c in df.columns if c != name), F.col("value").alias(name))
