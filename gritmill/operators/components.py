"""Least labels over links, without collecting them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritmill.session import discard, materialise_at

#: Up to so many links and labels (about 50 MB) one task takes all rounds; beyond it each round is a job over all executors.
IN_ONE_TASK = 1_000_000


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rounds over rows (x, y, link): links x - y, and labels y of x."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    x, y, link = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in range(3))
    ids, at = np.unique(np.concatenate([x, y[link]]), return_inverse=True)
    a, b = at[: len(x)][link], at[len(x) :]
    label = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(label, at[: len(x)][~link], y[~link])
    label[a], label[b] = np.minimum(label[a], ids[a]), np.minimum(label[b], ids[b])
    while True:
        was = label.copy()
        np.minimum.at(label, a, was[b])
        np.minimum.at(label, b, was[a])
        up = np.minimum(np.searchsorted(ids, label), len(ids) - 1)
        label = np.where(ids[up] == label, np.minimum(label, label[up]), label)
        if (label == was).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "label"])


def least_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, label)``: the least label that reaches each node over undirected `links` ``(a, b)``.

    `labels` ``(id, label)`` gives start values; nodes that occur in links alone start with their own id. In each round
    every node takes the least label among itself and its neighbours, pre-aggregated before the shuffle; a label is
    itself a node's id in most cases, so taking the label's label as well halves long chains. Each round is written to the
    shared folder. Ends when nothing changes.
    """
    spark = labels.sparkSession
    rows = links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("link"))
    rows, rows_at = materialise_at(rows.unionByName(labels.select(F.col("id").alias("x"), F.col("label").alias("y"), F.lit(False).alias("link"))), "links")
    if rows.count() <= IN_ONE_TASK:
        return rows.coalesce(1).mapInArrow(_rounds, "id bigint, label bigint")
    links = rows.where("link").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = rows.where("NOT link").select(F.col("x").alias("id"), F.col("y").alias("label"))
    links, links_at = materialise_at(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    nodes = labels.unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("label")))
    cur, cur_at = materialise_at(nodes.groupBy("id").agg(F.min("label").alias("label")), "labels")
    discard(spark, rows_at)
    if links.isEmpty():
        discard(spark, links_at)
        return cur
    while True:
        near = links.join(cur, links.b == cur.id).select(F.col("a").alias("id"), "label", F.lit(None).cast("bigint").alias("was"))
        step = cur.select("id", "label", F.col("label").alias("was")).unionByName(near).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = cur.select(F.col("id").alias("label"), F.col("label").alias("top"))
        least = F.least("label", "top")
        nxt, nxt_at = materialise_at(step.join(up, "label", "left").select("id", least.alias("label"), (least < F.col("was")).alias("moved")), "labels")
        discard(spark, cur_at)
        cur, cur_at = nxt.select("id", "label"), nxt_at
        if nxt.where("moved").isEmpty():
            discard(spark, links_at)
            return cur
