"""Reading level of documents, from vocabulary coverage and sentence length.

1. Each document's prose (`prose.read_prose`) becomes word counts and the sentence length in which the middle one of its
   words stands. Texts are read once; the counts are written, not the words.
2. Words are ranked by frequency over all documents of a language. Words of one count share the last of their places, so
   at most RANKED words have a place up to RANKED: the bound of what is broadcast.
3. A document's coverage rank at a share is the smallest vocabulary, by rank, that covers this share of its words. Where
   the broadcast ranks do not cover the share, the places of the document's rarer words come by a join, so every rank is exact.
4. Graded documents calibrate the features: class means and common covariance come from sums that SQL takes over all grades;
   the linear scores of the three levels go back into SQL. A language with too few grades of a level uses all languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritmill.llm.prose import read_prose
from gritmill.session import materialise

SHARES = (0.5, 0.75, 0.9)
RANKED = 100_000
LEVELS = (1, 2, 3)
FEATURES = (*(f"k{round(100 * s)}" for s in SHARES), "sentence")
#: A language is calibrated by itself from so many grades of every level on.
MIN_GRADES = 12

_COUNTS = "doc_id bigint, lang string, n_words int, sentence double, words array<int>, times array<int>"


def _middle(lengths: list[int]) -> int:
    """The length of the sentence in which the middle word stands, sentences in order of length."""
    lengths = sorted(lengths)
    half, total = sum(lengths) / 2, 0
    for n in lengths:
        total += n
        if total >= half:
            return n
    return 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        head, words, times, offsets = [], [], [], [0]
        for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            p = read_prose(text)
            if p.lang is None:
                continue
            c: Counter[str] = Counter()
            for s in p.sentences:
                c.update(s)
            if len(known) > 300_000:  # bounds the worker's memory
                known.clear()
            for w, n in c.items():
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
                words.append(h)
                times.append(n)
            offsets.append(len(words))
            head.append((doc_id, p.lang, p.n_words, float(_middle([len(s) for s in p.sentences]))))
        off = pa.array(offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(off, pa.array(np.array(words, np.uint32).view(np.int32))), pa.ListArray.from_arrays(off, pa.array(times, pa.int32()))]
        plain = [pa.array([h[i] for h in head], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*plain, *lists], names=["doc_id", "lang", "n_words", "sentence", "words", "times"])


def prose_counts(docs: DataFrame) -> DataFrame:
    """Word counts of every document that is prose; null, empty and other texts have no row."""
    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(_count, _COUNTS)


def word_counts(counts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all documents."""
    z = counts.select("lang", F.explode(F.arrays_zip("words", "times")).alias("z"))
    return z.groupBy("lang", F.col("z.words").alias("word")).agg(F.sum("z.times").alias("n"))


def word_ranks(n: DataFrame) -> DataFrame:
    """``(lang, word, place)`` of all words; words of one count share the last of their places."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"))
    places = n.groupBy("lang", "n").count().withColumn("place", F.sum("count").over(w))  # as many rows as there are different counts
    return n.join(places.select("lang", "n", "place"), ["lang", "n"]).select("lang", "word", "place")


def coverage_features(counts: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_words, *FEATURES)``; the coverage ranks as logarithms."""
    ranks: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    placed = word_ranks(materialise(word_counts(counts), "levels-words"))
    rows = placed.where(F.col("place") <= RANKED).toPandas()  # RANKED rows a language at most
    for lang, g in rows.groupby("lang"):
        o = np.argsort(g.word.to_numpy())
        ranks[lang] = g.word.to_numpy(np.int32)[o], g.place.to_numpy(np.int64)[o]
    shared = counts.sparkSession.sparkContext.broadcast(ranks)
    ks = FEATURES[: len(SHARES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        none = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in batches:
            lang = b.column("lang").to_pylist()
            out = np.full((len(lang), len(SHARES)), np.nan)
            ahead, rare, times = [], [], []
            for i in range(len(lang)):
                w, t = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("words", "times"))
                known, place = places.get(lang[i], none)
                at = np.minimum(np.searchsorted(known, w), len(known) - 1) if len(known) else np.zeros(len(w), int)
                hit = known[at] == w if len(known) else np.zeros(len(w), bool)
                p, n = place[at[hit]] if len(known) else place, t[hit]
                o = np.argsort(p, kind="stable")
                covered = np.cumsum(n[o])
                first = np.searchsorted(covered, [s * t.sum() for s in SHARES])
                inside = first < len(covered)
                out[i, inside] = np.log(p[o][first[inside]])
                ahead.append(int(n.sum()))
                rare.append([] if inside.all() else w[~hit].tolist())
                times.append([] if inside.all() else t[~hit].tolist())
            cols = [pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(len(SHARES))]
            sentence = pa.array(np.log(b.column("sentence").to_numpy(zero_copy_only=False)))
            lists = pa.array(ahead, pa.int64()), pa.array(rare, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "n_words")), *cols, sentence, *lists], names=["doc_id", "lang", "n_words", *FEATURES, "ahead", "rare", "times"])

    ddl = "doc_id bigint, lang string, n_words int, " + ", ".join(f"{f} double" for f in FEATURES)
    first = materialise(counts.mapInArrow(run, f"{ddl}, ahead bigint, rare array<int>, times array<int>"), "levels-ranked")
    cols = ["doc_id", "lang", "n_words", *FEATURES]
    behind = first.where(f"{ks[-1]} IS NULL")
    if behind.isEmpty():
        return first.select(cols)
    # the documents that the broadcast ranks do not cover: the places of their rarer words, a list for each document
    behind = materialise(behind.withColumn("uid", F.monotonically_increasing_id()), "levels-behind")
    words = behind.select("uid", "lang", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("uid", "lang", F.col("z.rare").alias("word"), F.col("z.times").alias("t"))
    lists = words.join(placed, ["lang", "word"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "t"))).alias("l"), F.sum("t").alias("rest"))

    def exact(k: str, share: float):
        step = f"(a, x) -> named_struct('c', a.c + x.t, 'p', if(a.p IS NULL AND a.c + x.t >= {share}D * (ahead + rest), x.place, a.p))"
        return F.coalesce(k, F.log(F.expr(f"aggregate(l, named_struct('c', ahead, 'p', cast(NULL AS bigint)), {step}).p"))).alias(k)

    solved = behind.join(lists, "uid").select("doc_id", "lang", "n_words", *(exact(k, s) for k, s in zip(ks, SHARES)), "sentence")
    return first.where(f"{ks[-1]} IS NOT NULL").select(cols).unionByName(solved)


class Sums:
    """Number, sums and sums of products of the features, for each level."""

    def __init__(self) -> None:
        d = len(FEATURES)
        self.n = {c: 0 for c in LEVELS}
        self.s = {c: np.zeros(d) for c in LEVELS}
        self.q = np.zeros((d, d))

    def add(self, level: int, n: int, s: np.ndarray, q: np.ndarray) -> None:
        self.n[level] += n
        self.s[level] += s
        self.q += q

    def scores(self) -> dict[int, tuple[float, np.ndarray]]:
        """Constant and coefficients of each level that has a grade, by linear discriminants with a little shrinkage."""
        total = sum(self.n.values())
        means = {c: self.s[c] / self.n[c] for c in LEVELS if self.n[c]}
        within = self.q - sum(self.n[c] * np.outer(m, m) for c, m in means.items())
        cov = (within + np.eye(len(FEATURES)) * 0.05) / (total + 1)
        inv = np.linalg.inv(cov)
        return {c: (float(-0.5 * m @ inv @ m + np.log(self.n[c] / total)), inv @ m) for c, m in means.items()}


def grade_sums(features: DataFrame, grades: DataFrame) -> dict[str, Sums]:
    """Sums for each language, taken by SQL over all grades; a grade outside 1 to 3 or of no prose counts for nothing."""
    g = grades.select(grades["doc_id"].cast("bigint").alias("doc_id"), F.col("reading_level").alias("level")).where(F.col("level").isin(*LEVELS))
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    aggs = [F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs)]
    out: dict[str, Sums] = {}
    for r in features.join(g, "doc_id").groupBy("lang", "level").agg(*aggs).collect():  # languages x levels
        q = np.zeros((len(FEATURES),) * 2)
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        out.setdefault(r.lang, Sums()).add(r.level, r.n, np.array([r[f"s{i}"] for i in range(len(FEATURES))]), q)
    return out


def reading_levels(docs: DataFrame, grades: DataFrame) -> DataFrame:
    """``(doc_id, reading_level, lang, n_words, *FEATURES)`` of every document that is prose of at least 50 words.

    Without any usable grade the level is null. Equal scores go to the lower level. Repeated documents have a row each.
    """
    features = materialise(coverage_features(materialise(prose_counts(docs), "levels-counts")), "levels-features")
    by_lang = grade_sums(features, grades)
    every = Sums()
    for s in by_lang.values():
        for c in LEVELS:
            every.n[c] += s.n[c]
            every.s[c] = every.s[c] + s.s[c]
        every.q = every.q + s.q
    if not sum(every.n.values()):
        return features.select("doc_id", F.lit(None).cast("int").alias("reading_level"), "lang", "n_words", *FEATURES)

    def level(sums: Sums):
        expr = {c: F.lit(k) + sum(F.lit(float(w)) * F.col(f) for w, f in zip(ws, FEATURES)) for c, (k, ws) in sums.scores().items()}
        best = F.greatest(*expr.values()) if len(expr) > 1 else next(iter(expr.values()))
        out = None
        for c, e in sorted(expr.items()):
            out = F.when(e >= best, c) if out is None else out.when(e >= best, c)
        return out

    picked = level(every)
    for lang, s in sorted(by_lang.items()):
        if min(s.n.values()) >= MIN_GRADES:
            picked = F.when(F.col("lang") == lang, level(s)).otherwise(picked)
    return features.select("doc_id", picked.cast("int").alias("reading_level"), "lang", "n_words", *FEATURES)
