"""A model's findings against those of tools (COR-11): agreements and contradictions are recorded, never resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritmill.functions.normalise import path_key
from gritmill.schema import SEVERITIES, rank

LINES_APART = 4


def cross_check(proposed: DataFrame, prior: DataFrame) -> DataFrame:
    """``(seq, outcome, counterpart, their_severity)`` for each proposed finding: agrees, CONTRADICTED, or alone.

    A counterpart is in the same file and at most LINES_APART lines away, where both have a line, or shares a CWE; the most
    severe counts, the first of equals. The prior findings reduce to the best of each line and of each CWE of a file before
    any join, so a file with very many findings makes no pairs.
    """
    empty = F.array().cast("array<string>")

    def side(df: DataFrame, p: str) -> DataFrame:
        line, cwe = F.coalesce("location.startLine", F.lit(0)), F.coalesce("cwe", empty)
        return df.select(F.col("seq").alias(f"{p}_seq"), path_key(F.col("location.file")).alias("file"), line.alias(f"{p}_line"), cwe.alias(f"{p}_cwe"), F.col("severity").alias(f"{p}_severity"))

    a, b = side(proposed, "a"), side(prior, "b")
    least = F.min(F.struct(rank(F.col("b_severity"), SEVERITIES).alias("r"), F.col("b_seq"), F.col("b_severity"))).alias("m")
    by_line = b.where("b_line > 0").groupBy("file", F.col("b_line").alias("at")).agg(least)
    by_cwe = b.select("*", F.explode(F.array_distinct("b_cwe")).alias("of")).where("of IS NOT NULL").groupBy("file", "of").agg(least)
    around = F.explode(F.sequence(F.col("a_line") - LINES_APART, F.col("a_line") + LINES_APART))
    near = a.where("a_line > 0").select("a_seq", "file", around.alias("at")).join(by_line, ["file", "at"]).select("a_seq", "m")
    alike = a.select("a_seq", "file", F.explode(F.array_distinct("a_cwe")).alias("of")).join(by_cwe, ["file", "of"]).select("a_seq", "m")
    best = near.unionByName(alike).groupBy("a_seq").agg(F.min("m").alias("m"))
    out = a.join(best, "a_seq", "left")
    state = F.when(F.col("m").isNull(), "alone").when(F.col("m.b_severity").eqNullSafe(F.col("a_severity")), "agrees").otherwise("CONTRADICTED")
    return out.select(F.col("a_seq").alias("seq"), state.alias("outcome"), F.col("m.b_seq").alias("counterpart"), F.col("m.b_severity").alias("their_severity"))
