"""Row numbers within groups in a total order, however large one group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritmill.session import materialise


def number_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`df` with `name`: 1, 2, ... within each `group` in `order`, which must be total.

    Rows are split by ranges of the order, so a hot group is spread; each range counts its rows a group, and the counts of
    the ranges before (one row for each range and group) are added by a join.
    """
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    cols = [f"__o{i}" for i in range(len(order))]
    ranged = df.select("*", *keys).repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = materialise(ranged.withColumn("__part", F.spark_partition_id()), "numbering")
    own = Window.partitionBy(group, "__part").orderBy(*cols)
    counts = ranged.groupBy(group, "__part").count()
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = ranged.withColumn("__n", F.row_number().over(own))
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, (F.col("__n") + F.col("__before")).cast("bigint")).drop(*cols, "__part", "__n", "__before", "__g", "__p")
