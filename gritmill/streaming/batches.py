"""Findings as a stream (an extension): every arriving batch is classified against the baseline and folded into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gritmill.functions.normalise import fingerprint, path_key
from gritmill.operators.baseline import ENTRY_DDL, classify


def start_classification(findings: DataFrame, baseline: str, out: str, checkpoint: str, now: str) -> StreamingQuery:
    """Classifies each micro-batch of `findings` and accepts its new fingerprints.

    `baseline` is a folder with one folder of entries for each batch, so a batch that runs again overwrites what it wrote and
    the result is the same: it reads the folders of earlier batches alone. Results go to ``out/batch=<n>``. FIXED rows are left
    out, for a batch is no full report.
    """
    spark: SparkSession = findings.sparkSession

    def known(batch: int) -> DataFrame:
        empty = spark.createDataFrame([], f"entry_seq bigint, {ENTRY_DDL}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(baseline).getFileSystem(spark._jsc.hadoopConfiguration())
        path = spark._jvm.org.apache.hadoop.fs.Path
        done = [f"{baseline}/{i}" for i in range(-1, batch) if fs.exists(path(f"{baseline}/{i}"))]
        return spark.read.schema(empty.schema).parquet(*done) if done else empty

    def take(df: DataFrame, batch: int) -> None:
        old = known(batch)
        classify(df, old, now).where("state <> 'FIXED'").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        new = df.select(F.col("seq").alias("entry_seq"), fingerprint().alias("fingerprint"), "findingId", "title", "severity", path_key(F.col("location.file")).alias("file"), F.lit(now).alias("firstSeen"), F.lit(None).cast("struct<justification string, expires string>").alias("suppressed"))
        new.join(old.select("fingerprint").distinct(), "fingerprint", "left_anti").select("entry_seq", *[c.split()[0] for c in ("fingerprint", "findingId", "title", "severity", "file", "firstSeen", "suppressed")]).write.mode("overwrite").parquet(f"{baseline}/{batch}")

    return findings.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
