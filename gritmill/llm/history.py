"""New batches against all history: sorted-neighbourhood runs over many keys, with windows that lose nothing.

A text is its set of distinct words. All words stand in one order, rare ones first. Two texts of m and n words that share
more than `SIMILAR` of the words of both must share one of their first n - floor(SIMILAR n) words: these are the sort keys
of a text, about two fifths of its words. Under a key, texts stand in order of size, and only those whose size is more than
SIMILAR times the new record's and less than 1 / SIMILAR times it can be similar: this is the window of a new record.
Neither the keys nor the window lose a pair, whatever the order of words; the order decides only how crowded keys are.

State, in one shared folder:

* ``keys``, a table of (word, n, pos, sig, fp1), cut into ranges of keys (buckets), sorted in each by key and size;
* ``texts``, a table of (fp1, fp2, row_id, first_row_id, words), cut into ranges of fingerprints.

Ingesting a batch sketches the batch alone and sets aside texts that are in the history word for word. Its keys are
appended as one sorted run to the key ranges; then the run is merged with the ranges, which stay where they are (no
shuffle of history), and each new record is compared with its windows: by what the places of the keys and the sizes leave
possible, and by 128 parity bits, of which at most as many differ as words differ. Both are bounds, not estimates. What
survives is compared exactly on word sets, for which only the batch and the ranges of fingerprints concerned are read. A
batch of at most `LOOKUP` texts reads only the ranges it touches. Links within the batch and to the classes of the history
give each new text the first row of its class. After every `COMPACT_EVERY` runs the runs are merged into one file for
each range; when the texts have doubled since the order of words was fixed, it is taken anew and the keys are made again,
so a word that has become frequent stops being a key of most texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.llm.canon import withheld
from gritmill.operators.components import least_labels
from gritmill.session import discard, fresh_path, materialise_at

#: Two texts repeat one another if more than this share of the distinct words of both is shared.
SIMILAR = 0.6
#: Words in more than this share of the texts are ordered by their frequency, all rarer ones stand before them.
COMMON_SHARE = 0.0005
COMPACT_EVERY = 6
#: Batches of at most so many texts name the keys they want, so that ranges without them are not read.
LOOKUP = 64
#: A range is split when it holds more keys.
RANGE_ROWS = 4_000_000

_WORD = re.compile(r"\w+")
_SKETCH = "row_id bigint, batch_id int, fp1 bigint, fp2 bigint, words array<int>"
_KEY = "word int, n int, pos int, sig1 bigint, sig2 bigint, fp1 bigint"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        rows, fps, words = [], [], []
        for row_id, batch_id, text in zip(*(c.to_pylist() for c in b.columns)):
            if row_id is None or withheld(text):
                continue
            ids = set()
            for w in set(_WORD.findall(text.casefold())):
                h = known.get(w)
                if h is None:
                    if len(known) > 500_000:  # bounds the worker's memory, not the words
                        known.clear()
                    h = known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
                ids.add(h)
            a = np.sort(np.fromiter(ids, np.uint32, len(ids))).view(np.int32)
            rows.append((row_id, batch_id))
            fps.append(xxhash.xxh3_128_digest(a.tobytes()))
            words.append(a)
        h = np.frombuffer(b"".join(fps), dtype="<i8").reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["row_id", "batch_id", "fp1", "fp2", "words"],
        )


def sketches(report: DataFrame) -> DataFrame:
    """``(row_id, batch_id, fp1, fp2, words)`` of every row with code in its snippet; a null batch counts as batch 0."""
    return report.select("row_id", F.coalesce("batch_id", F.lit(0)), F.col("evidence.snippet")).mapInArrow(_sketch, _SKETCH)


def _keys(order: Broadcast):
    """Key rows of texts given as (fp1, words): the first words of each text in the order of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        for b in batches:
            col = b.column("words")
            flat = col.flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            n = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(flat), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                rank = np.where(frequent[at] == flat, counts[at], 0)
            starts = np.cumsum(n) - n
            pos = np.arange(len(flat)) - starts[owner]
            key = np.lexsort((flat, rank, owner))[pos < (n - np.floor(SIMILAR * n).astype(np.int64))[owner]]
            bit = (flat.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            sig = [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == h, one, np.uint64(0)), starts).view(np.int64) for h in (0, 1)]
            o = owner[key]
            place = pos[pos < (n - np.floor(SIMILAR * n).astype(np.int64))[owner]]
            fp = b.column("fp1").to_numpy(zero_copy_only=False)
            cols = [flat[key], n[o].astype(np.int32), place.astype(np.int32), sig[0][o], sig[1][o], fp[o]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["word", "n", "pos", "sig1", "sig2", "fp1"])

    return run


class History:
    """Accepted texts, kept below `root` between batches."""

    def __init__(self, spark: SparkSession, root: str | None = None, ranges: int | None = None) -> None:
        self.spark = spark
        self.root = root or fresh_path(spark, "history")
        self.ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys: str | None = None
        self.texts: str | None = None
        self.runs = self.since = self.n_texts = self.ordered_at = 0
        self.order: Broadcast | None = None

    def _put(self, df: DataFrame, name: str | None, kind: str, by: str, part: str | None = None) -> str:
        """Appends a sorted run to every range of a table, or makes the table."""
        sort = (by, "n") if kind == "keys" else (by,)
        writer = df.repartition(self.ranges, by).write.bucketBy(self.ranges, by).sortBy(*sort)
        if part:
            writer = writer.partitionBy(part)
        if name:
            writer.mode("append").saveAsTable(name)
            return name
        name = f"gritmill_{kind}_{uuid.uuid4().hex}"
        writer.option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, f"{self.root}/{name}")

    def _set_order(self, texts: DataFrame, n: int) -> None:
        """Fixes the order of words; what is sent has at most (words of a mean text) / COMMON_SHARE entries."""
        df = texts.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") > F.lit(COMMON_SHARE) * n)
        got = df.toPandas()
        words, counts = got["w"].to_numpy(np.int32), got["count"].to_numpy(np.int64)
        at = np.argsort(words)
        self.order, self.ordered_at = self.spark.sparkContext.broadcast((words[at], counts[at])), n

    def _touched(self, table: str, by: str, wanted: DataFrame, few: bool) -> DataFrame:
        """A table without ranges that hold none of the wanted values, where these are few enough to be named."""
        df = self.spark.table(table)
        if not few:
            return df
        got = [r[0] for r in wanted.select(by).distinct().limit(100 * LOOKUP + 1).collect()]
        return df if len(got) > 100 * LOOKUP else df.where(F.col(by).isin(got) if got else F.lit(False))

    def ingest(self, rows: DataFrame) -> None:
        """Takes one batch of sketches and accepts it. An empty batch changes nothing.

        The class of a text is the first accepted row it leads to; a text that is in the history word for word keeps
        the class it has there.
        """
        texts = rows.groupBy("fp1", "fp2").agg(F.min("row_id").alias("row_id"), F.first("words").alias("words"))
        if self.texts:
            texts = texts.join(self.spark.table(self.texts).select("fp1", "fp2"), ["fp1", "fp2"], "left_anti")
        texts, texts_at = materialise_at(texts, "history-texts")
        if not (n_new := texts.count()):
            discard(self.spark, texts_at)
            return
        if self.order is None:
            self._set_order(texts, n_new)
        few = bool(self.texts) and n_new <= LOOKUP
        keys = texts.select("fp1", "words").mapInArrow(_keys(self.order), _KEY).withColumn("run", F.lit(self.runs))
        self.keys = self._put(keys, self.keys, "keys", "word", "run")
        new = self.spark.table(self.keys).where(F.col("run") == self.runs)
        x, y = new.alias("x"), self._touched(self.keys, "word", new, few).alias("y")
        # the windows of the new records: sizes, places, parity bits, and each pair once
        near = f"""
            x.word = y.word AND y.n > x.n * {SIMILAR}D AND y.n * {SIMILAR}D < x.n
            AND bit_count(x.sig1 ^ y.sig1) + bit_count(x.sig2 ^ y.sig2) < (x.n + y.n) * {(1 - SIMILAR) / (1 + SIMILAR)}D
            AND least(x.n - x.pos, y.n - y.pos) > (x.n + y.n) * {SIMILAR / (1 + SIMILAR)}D
            AND (y.run < {self.runs} OR x.fp1 < y.fp1)
        """
        pairs = x.join(y, F.expr(near)).selectExpr("x.fp1 AS a", "y.fp1 AS b").distinct()
        working = [texts_at]
        mine = texts.select("fp1", "row_id", "words", F.lit(None).cast("bigint").alias("first_row_id"))
        other = mine
        if self.texts:
            if few:
                pairs, at = materialise_at(pairs, "history-pairs")
                working.append(at)
            old = self._touched(self.texts, "fp1", pairs.select(F.col("b").alias("fp1")), few)
            other = mine.unionByName(old.select("fp1", "row_id", "words", "first_row_id"))
        links = pairs.join(mine.alias("x"), F.expr("a = x.fp1")).join(other.alias("y"), F.expr("b = y.fp1"))
        links = links.selectExpr("x.row_id AS a", "y.row_id AS b", "y.first_row_id AS old", "size(x.words) + size(y.words) AS n", "size(array_intersect(x.words, y.words)) AS shared")
        links = links.where(f"shared > {SIMILAR}D * (n - shared)").select("a", "b", "old")
        links, at = materialise_at(links, "history-links")
        working.append(at)
        start = links.groupBy("a").agg(F.min("old").alias("old")).select(F.col("a").alias("id"), F.least("a", "old").alias("label"))
        first = least_labels(start, links.where("old IS NULL").select("a", "b"))
        done = texts.join(first, texts.row_id == first.id, "left")
        done = done.select("fp1", "fp2", "row_id", F.coalesce("label", "row_id").alias("first_row_id"), "words")
        self.texts = self._put(done, self.texts, "texts", "fp1")
        discard(self.spark, *working)
        self.runs, self.since, self.n_texts = self.runs + 1, self.since + 1, self.n_texts + n_new
        if self.since > COMPACT_EVERY:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one file for each range; with twice the texts, keys are made in a new order of words."""
        texts, keys = self.spark.table(self.texts), self.spark.table(self.keys)
        if self.n_texts >= 2 * self.ordered_at:
            self._set_order(texts, self.n_texts)
            keys = texts.select("fp1", "words").mapInArrow(_keys(self.order), _KEY)
        else:
            keys = keys.drop("run")
        self.ranges = max(self.ranges, -(-keys.count() // RANGE_ROWS))
        old = self.keys, self.texts
        self.keys = self._put(keys.withColumn("run", F.lit(-1)), None, "keys", "word", "run")
        self.texts = self._put(texts, None, "texts", "fp1")
        for name in old:
            self._drop(name)
        self.since = 0

    def turned_away(self, rows: DataFrame) -> DataFrame:
        """``(earlier_row_id, later_row_id)`` of those sketches, already ingested, that are not the first of their class.

        It reads the state, so take it before a later batch is compacted.
        """
        if not self.texts:
            return self.spark.createDataFrame([], "earlier_row_id bigint, later_row_id bigint")
        known = self.spark.table(self.texts).select("fp1", "fp2", F.col("first_row_id").alias("earlier_row_id"))
        got = rows.select("fp1", "fp2", F.col("row_id").alias("later_row_id")).join(known, ["fp1", "fp2"])
        return got.where("earlier_row_id < later_row_id").select("earlier_row_id", "later_row_id")


def repeats_of_history(report: DataFrame) -> DataFrame:
    """``(earlier_row_id, later_row_id)``: rows of batches 1 and up to turn away, each with the first row of its class.

    The batches are ingested one after another, as they would arrive; a class once given to a text stays. Null, blank
    and withheld snippets are never cases; rows without an id are left out; an empty table gives no rows.
    """
    spark = report.sparkSession
    path = fresh_path(spark, "history-sketches")
    sketches(report).write.partitionBy("batch_id").parquet(path)
    rows = spark.read.schema(_SKETCH).parquet(path)
    history = History(spark)
    for b in sorted(r.batch_id for r in rows.select("batch_id").distinct().collect()):
        history.ingest(rows.where(F.col("batch_id") == b))
    return history.turned_away(rows.where("batch_id >= 1"))
