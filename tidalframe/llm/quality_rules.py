"""Quality rules whose cutoffs adapt to each language and source.

Statistics of every text feed quantile sketches per (lang, source): counts of values in buckets whose
bounds grow by a fixed ratio, so a quantile read from them is within ACCURACY of the true one in
proportion.  Sketches merge by adding counts, in any order with the same result: into one per language and
one for all, which stand in where a group has too few rows.  A statistic's fence lies three
interquartile ranges outside the quartiles (with a least range, so that a constant statistic doesn't
reject on its first other value), and documents are joined with their group's fences.  Only built-in
functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, settle
from .text_stats import SHARES, share, with_statistics

#: Statistic: (least interquartile range, whether low values are rejected too).
FENCED = {"symbol_share": (0.02, False), "dup_line_share": (0.1, False), "repeat_share": (0.1, False), "upper_share": (0.04, False), "bang_share": (0.02, False), "word_length": (1.0, True)}
#: Ranges outside the quartiles, rows that a group's own fences need, and the sketches' relative accuracy.
RANGES, LEAST_ROWS, ACCURACY = 3.0, 200, 0.005
RATIO = (1 + ACCURACY) / (1 - ACCURACY)
#: The bucket of zeros, below that of any other value.
ZERO = -(1 << 20)


def bucket_of(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(RATIO))).cast("int")).otherwise(F.lit(ZERO))


def value_of(bucket: Column) -> Column:
    return F.when(bucket > ZERO, F.pow(F.lit(RATIO), bucket) * (2 / (RATIO + 1))).otherwise(F.lit(0.0))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, statistic, bucket, n): the sketches of all groups."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), bucket_of(F.col(name)).alias("bucket")) for name in FENCED])).alias("v")
    return stats.select("lang", "source", values).groupBy("lang", "source", "v.statistic", "v.bucket").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Of sketches merged to the keys: rows, and for each statistic the highest and lowest value inside."""
    merged = sketched.groupBy(*keys, "statistic", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "statistic")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(group))
    # the value at rank ceil(q * rows)
    quartile = lambda k: value_of(F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bucket"))))
    found = ranked.groupBy(*keys, "statistic").agg(F.max("rows").alias("rows"), quartile(1).alias("low"), quartile(3).alias("high"))
    out = [F.max("rows").alias("rows")]
    for name, (least, both) in FENCED.items():
        own = F.col("statistic") == name
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(least)) * RANGES
        out += [F.max(F.when(own, F.col("high") + spread)).alias(f"{name}_high"), (F.max(F.when(own, F.col("low") - spread)) if both else F.lit(float("-inf"))).alias(f"{name}_low")]
    return found.groupBy(*keys).agg(*out)


def group_fences(sketched: DataFrame) -> DataFrame:
    """(of_lang, of_source, <statistic>_high, <statistic>_low) for every group: its own, its language's or all rows'."""
    every = fences(sketched.withColumn("one", F.lit(1)), ["one"]).first()  # one row of thirteen numbers
    group, lang = fences(sketched, ["lang", "source"]).alias("g"), fences(sketched, ["lang"]).alias("l")
    chosen = [
        F.when(F.col("g.rows") >= LEAST_ROWS, F.col(f"g.{c}")).when(F.col("l.rows") >= LEAST_ROWS, F.col(f"l.{c}")).otherwise(F.lit(every[c] if every else None).cast("double")).alias(c)
        for c in (f"{name}_{side}" for name in FENCED for side in ("high", "low"))
    ]
    return group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang"))).select(F.col("g.lang").alias("of_lang"), F.col("g.source").alias("of_source"), *chosen)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ...) of every row.

    docs: (doc_id, text, lang, source).  base_failed: under 50 words, or over half the words in
    repeated windows of three.  kept: base passed and every fenced statistic within the fences of the
    row's (lang, source), of its language if that has under LEAST_ROWS rows, else of all rows.  Null
    lang and source are groups of their own; null and empty texts fail the base.  Sketches see only rows that
    pass the base.  Rows equal in all columns get equal results, and the result doesn't depend on how rows are
    dealt; other columns are ignored.  No rows give no rows.
    """
    stats = with_statistics(docs.select("doc_id", "text", "lang", "source"))
    for name in FENCED:
        stats = stats.withColumn(name, share(*SHARES[name]))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    stats = settle(stats, "statistics")
    sketched = settle(sketches(stats.where("not base_failed")), "sketches")
    chosen = settle(group_fences(sketched), "fences")
    discard(sketched)
    # the table of fences is broadcast while it is small; else a sort-merge join, whose hot groups Spark splits
    judged = stats.join(chosen, stats["lang"].eqNullSafe(chosen["of_lang"]) & stats["source"].eqNullSafe(chosen["of_source"]), "left")
    inside = F.lit(True)
    for name in FENCED:
        inside &= (F.col(name) <= F.col(f"{name}_high")) & (F.col(name) >= F.col(f"{name}_low"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), *FENCED)
