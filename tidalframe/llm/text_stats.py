"""Statistics of texts as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a word, and the signs that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(windows: Column) -> Column:
    """Words in windows of three (given by their hashes, in order) that occur twice or more."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        twins = F.filter(
            F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]), F.get(s, k)["i"])),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.sort_array(twins), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    # the array is bound once by a transform over a single element
    return F.transform(F.array(ranked), again)[0]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with word and line statistics of a text column in place of the text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs, n_pipes and
    n_distinct (long).  A null text counts as empty; every count of an empty text is 0.
    """
    keep = [c for c in df.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    split = df.select(*keep, whole.alias("_text"), F.array_remove(F.split(whole, SPACES), "").alias("_words"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    sized = split.withColumn("_n", F.size("_words"))
    windows = F.when(
        F.col("_n") >= 4,
        F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    )
    counted = sized.select(
        *keep,
        "_n",
        windows.alias("_windows"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"[A-Z\xC0-\xDE]")).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!")))).cast("long").alias("n_bangs"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("|")))).cast("long").alias("n_pipes"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_words(F.col("_windows"))).otherwise(0)
    return counted.select(
        *keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", "n_upper", "n_bangs", "n_pipes", "n_distinct",
    )


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


#: Scale-free statistics made of the counts.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bang_share": ("n_bangs", "word_chars"),
    "pipe_share": ("n_pipes", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
