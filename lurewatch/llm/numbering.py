"""Numbers along a sort order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import stored


def _running(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1).to_numpy()
        ends = total + np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array((ends - sizes).astype(np.int64))], names=names)


def placed(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """df(.., size) with ``place``: the sum of the sizes of all rows before it in the order. Rows are dealt by ranges of the order,
    which has to tell all rows apart; the driver sees one number a range, so at most as many as there are shuffle partitions."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c != size]
    names = [*kept, size, "__part", "__before"]
    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*kept, size]) + ", __part int, __before long"
    ranged = df.select(*kept, size).repartitionByRange(*order).sortWithinPartitions(*order)
    counted = stored(ranged.mapInArrow(lambda batches: _running(batches, names), schema), name)
    starts, total = [], 0
    for row in counted.groupBy("__part").agg(F.max(F.col("__before") + F.col(size)).alias("n")).orderBy("__part").collect():
        starts.append((row["__part"], total))
        total += row["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))  # a row for each range
    return counted.join(offsets, "__part").withColumn("place", F.col("__before") + F.col("__start")).drop("__part", "__before", "__start")
