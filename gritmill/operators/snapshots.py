"""Changes between full snapshots, by gaps and islands.

Each key's presence over the snapshots of its group is folded into validity intervals: runs of consecutive
snapshots with one row hash. Interval starts, ends and adjacencies are the change events. All steps after the
first aggregation share one hash partitioning on (group, key), so there are two shuffles of the narrow rows
and one of the (group, snapshot) pairs, however many snapshots there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    """Both ends freed of every kind of blank, not of the space character alone."""
    return F.regexp_replace(c, _BLANKS, "")


def validity_intervals(df: DataFrame, group: str, key: Column, compared: list[Column], snapshot: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Intervals ``(g, k, lo, hi, hash)`` in positions of the group's own snapshot list, and ``(g, snaps)`` with that list.

    Of several rows of one key in a snapshot the one with the greatest `version` counts (pre-aggregated before the
    shuffle, so a key that holds a large part of all rows is harmless). Rows with a null key take part in the
    snapshot lists only. A null group is a group of its own; nulls in `compared` are values.
    """
    row_hash = F.xxhash64(*[x for c in compared for x in (c.isNull(), F.coalesce(c, F.lit("")))])
    rows = df.select(F.col(group).alias("g"), key.alias("k"), F.col(snapshot).alias("s"), F.col(version).alias("v"), row_hash.alias("h"))
    snaps = rows.groupBy("g", "s").agg(F.lit(1).alias("one")).groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("snaps"))
    last = rows.where("k IS NOT NULL AND s IS NOT NULL").groupBy("g", "k", "s").agg(F.max_by("h", "v").alias("h"))
    # No hint: the planner broadcasts the lists only if their measured size is under its threshold, else it joins by sorting and splits skewed groups.
    placed = last.alias("l").join(snaps.alias("p"), F.expr("l.g <=> p.g")).select("l.g", "l.k", "l.h", F.array_position("p.snaps", F.col("l.s")).cast("int").alias("pos"))
    w = Window.partitionBy("g", "k").orderBy("pos")
    fresh = ~((F.lag("pos").over(w) + 1 == F.col("pos")) & F.lag("h").over(w).eqNullSafe(F.col("h")))
    islands = placed.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    return islands.groupBy("g", "k", "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("h").alias("hash")).drop("island"), snaps


def snapshot_changes(df: DataFrame, group: str, key: Column, compared: list[Column], snapshot: str = "snapshot_id", version: str = "row_id") -> DataFrame:
    """``(g, k, snapshot, change)`` with change `added`, `removed` or `changed`, between consecutive snapshots of a group.

    Snapshots in which a group has no row are skipped, and a group's first snapshot gives no event. An empty
    table gives no rows; columns other than those named are never read, so clashing extra names do no harm.
    """
    iv, snaps = validity_intervals(df, group, key, compared, snapshot, version)
    w = Window.partitionBy("g", "k").orderBy("lo")
    iv = iv.withColumn("before", F.lag("hi").over(w)).withColumn("after", F.lead("lo").over(w))
    start = F.when(F.col("before") + 1 == F.col("lo"), "changed").otherwise("added")
    events = F.array(
        F.when(F.col("lo") > 1, F.struct(F.col("lo").alias("pos"), start.alias("change"))),
        F.when(~F.coalesce(F.col("after") == F.col("hi") + 1, F.lit(False)), F.struct((F.col("hi") + 1).alias("pos"), F.lit("removed").alias("change"))),
    )
    out = iv.select("g", "k", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    # an end at the group's last snapshot is no removal
    return (
        out.alias("o").join(snaps.alias("p"), F.expr("o.g <=> p.g AND o.e.pos <= size(p.snaps)"))
        .select("o.g", "o.k", F.expr("element_at(p.snaps, o.e.pos)").alias("snapshot"), F.col("o.e.change").alias("change"))
    )


def finding_changes(report_snapshot: DataFrame) -> DataFrame:
    """Added, removed and changed findings of `report_snapshot`: ids trimmed and upper-cased, severities compared without blanks and case."""
    ch = snapshot_changes(report_snapshot, "repo", F.upper(trimmed(F.col("findingId"))), [F.upper(trimmed(F.col("severity")))])
    return ch.select(F.col("snapshot").alias("snapshot_id"), F.col("g").alias("repo"), F.col("k").alias("finding_id"), "change")
