"""Records that differ in outward form alone: one record for each set, with its copy count.

1. Every record gets a 128-bit hash of its canonical form (`canon.record_key`), once, in Arrow batches.
2. Two Bloom filters, of hashes seen once and of hashes seen repeatedly, are built for each partition and merged:
   ``once = a | b``, ``repeated = ra | rb | (a & b)``. Merging is associative and commutative, so it runs as
   a grouped fold over segments of the bit space; a partition sends only the positions it set, delta-coded.
3. Only records whose bits are all in `repeated` can have a copy. They alone are shuffled and grouped exactly by
   hash; all others are singletons and are put out where they stand.

A false positive of the filter costs a shuffled row, never a wrong result. Beyond `SHARD_KEYS` records the hashes are
written in shards of the hash space, without a shuffle, and each shard has filters of its own, one after the other: bits grow
with the records, while a task and the driver hold the filter of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritmill.llm import bloom
from gritmill.llm.canon import record_key
from gritmill.session import discard, fresh_path, materialise

#: As many as fill a filter of `bloom.MAX_BITS` at `bloom.BITS_PER_KEY`.
SHARD_KEYS = bloom.MAX_BITS // bloom.BITS_PER_KEY

_KEYS = "row_id bigint, h1 bigint, h2 bigint"


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, *cols = (c.to_pylist() for c in b.columns)
        keys = [record_key(*r) for r in zip(*cols)]
        raw = b"".join(bytes(16) if k is None else xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
        h = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        none = np.fromiter((k is None for k in keys), bool, len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0], mask=none), pa.array(h[:, 1], mask=none)], names=["row_id", "h1", "h2"])


def canonical_hashes(report: DataFrame) -> DataFrame:
    """``(row_id, h1, h2)``; the hashes are null for rows whose snippet is null, blank or withheld."""
    return report.select("row_id", F.col("evidence.snippet"), F.col("location.file"), "title").mapInArrow(_hash_rows, _KEYS)


def possible_repeats(report: DataFrame) -> DataFrame:
    """The hashes of all rows with ``maybe``: false for rows that certainly have no copy (and for those without a hash)."""
    spark = report.sparkSession
    shards = max(1, -(-report.count() // SHARD_KEYS))
    cols = ["h1", "h2"]
    if shards == 1:
        keys = materialise(canonical_hashes(report), "formdup-keys")
        return bloom.flagged(keys, cols, bloom.merged(keys, cols, keys.where("h1 IS NOT NULL").count(), repeated=True), "maybe")
    path, out = fresh_path(spark, "formdup-keys"), fresh_path(spark, "formdup-flagged")
    canonical_hashes(report).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    rows = spark.read.schema(f"{_KEYS}, shard int").parquet(path)
    for k in range(shards):
        keys = rows.where(F.col("shard") == k).drop("shard")
        f = bloom.merged(keys, cols, keys.where("h1 IS NOT NULL").count(), repeated=True)
        bloom.flagged(keys, cols, f, "maybe").write.mode("append").parquet(out)
        f.segments.destroy()
    discard(spark, path)
    return spark.read.schema(f"{_KEYS}, maybe boolean").parquet(out)


def _groups(flagged: DataFrame) -> DataFrame:
    return flagged.where("maybe").groupBy("h1", "h2").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))


def form_duplicates(report: DataFrame) -> DataFrame:
    """``(first_row_id, copy_row_id)``: every row that equals an earlier one but for outward form.

    Rows whose snippet is null, blank or a withheld notice never count; null file or title equals null. An empty
    table gives no rows. Further columns are never read. The largest group is pre-aggregated before the shuffle;
    its copies come back by a join that the planner splits where the group is hot.
    """
    flagged = possible_repeats(report)
    first = _groups(flagged).where("copies > 1")
    rows = flagged.where("maybe").select("h1", "h2", F.col("row_id").alias("copy_row_id"))
    return rows.join(first, ["h1", "h2"]).where("copy_row_id > first_row_id").select("first_row_id", "copy_row_id")


def collapsed_records(report: DataFrame) -> DataFrame:
    """``(first_row_id, copies)``: one row for each record after collapsing; rows that are never cases stand alone with 1 copy."""
    flagged = possible_repeats(report)
    single = flagged.where("NOT maybe").select(F.col("row_id").alias("first_row_id"), F.lit(1).cast("bigint").alias("copies"))
    return single.unionByName(_groups(flagged).select("first_row_id", "copies"))
