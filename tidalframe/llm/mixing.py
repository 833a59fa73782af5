"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, settle

#: A table of sources up to this many rows (under 100 bytes each) is broadcast, a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """A seeded order of documents that DuckDB can repeat."""
    return F.md5(F.concat(F.lit(f"mix{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of the whole split by weight.

    Sources take the weights in turn, by code point, null last.  No target is above most times its
    source's size; the excess is shared again by weight until none is.  In closed form: in the order
    of cap / weight, sources are clamped while the level that the rest would get is above their own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = listed.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(whole)["level"]
    return levels.withColumn("final", level).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("final")), F.col("cap")).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and which documents get one more.

    Those are all with an order key up to `upto`, and the one of key `filler`, whose size comes closest to
    what is then still wanted.  Keys are summed in 4096 buckets first, so only one bucket of a source is ever
    ordered: no task holds a whole source.  sized: (source, size, place).
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    bucketed = sized.groupBy("source", F.substring("place", 1, 3).alias("bucket")).agg(F.sum("size").alias("size"))
    totals = bucketed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = settle(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = bucketed.withColumn("upto", F.sum("size").over(ordered))
    edge = filled.alias("f").join(goal.where("rest > 0").select("source", "rest").alias("g"), F.col("f.source").eqNullSafe(F.col("g.source"))).where("upto > rest").groupBy("f.source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("e"))
    edge = edge.select(F.col("source").alias("edge_source"), "rest", "e.bucket", "e.before")
    keys = sized.groupBy("source", "place").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    near = keys.join(edge, keys["source"].eqNullSafe(edge["edge_source"]) & (F.substring("place", 1, 3) == F.col("bucket")))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("edge_source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    taken = near.withColumn("total", running).where("total <= rest").groupBy("edge_source").agg(F.max(F.struct("total", "place")).alias("t"))
    cut = edge.alias("e").join(taken.alias("t"), F.col("e.edge_source").eqNullSafe(F.col("t.edge_source")), "left")
    cut = cut.select(F.col("e.edge_source").alias("source"), F.coalesce("t.t.place", "bucket").alias("upto"), (F.col("rest") - F.coalesce("t.t.total", "before")).alias("gap"))
    cut = settle(cut, "cuts")
    free = keys.alias("k").join(cut.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source"))).where("place > upto and abs(size - gap) < gap")
    filler = free.groupBy("k.source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "place")).alias("m")).select("source", F.col("m.place").alias("filler"))
    out = goal.join(cut.select(F.col("source").alias("cs"), "upto"), F.col("source").eqNullSafe(F.col("cs")), "left").join(filler.select(F.col("source").alias("fs"), "filler"), F.col("source").eqNullSafe(F.col("fs")), "left")
    out = settle(out.select("source", "source_size", "target", "whole", "upto", "filler"), "mix")
    discard(goal)
    discard(cut)
    return out


def with_repetitions(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows (with source and place) with source_size, target and repetitions of the plan."""
    right = planned.withColumnRenamed("source", "planned_source")
    right = F.broadcast(right) if planned.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else right
    # a source without a cut has its rest met by none (upto is null): no more than the whole repetitions
    extra = F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("place") == F.col("filler"), F.lit(False))
    return rows.join(right, rows["source"].eqNullSafe(right["planned_source"])).withColumn("repetitions", F.col("whole") + extra.cast("long")).drop("planned_source", "whole", "upto", "filler")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    size counts words (null text: 0); taken is size times the document's repetitions.  A source's taken
    words miss its target by no more than the document that comes closest to the gap leaves open.
    Rows that share a doc_id and source are taken alike.  Sources without words have target 0.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), order_key(seed).alias("place"))
    sized = settle(sized, "sizes")
    planned = plan(sized, weights, share, most)
    return with_repetitions(sized, planned).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """docs with every row repeated as the plan says (0, 1 or 2 times at the default cap); columns are those of docs."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"c{i}" for i, c in enumerate(names)])
    sized = settle(inner.select("source", word_count().alias("size"), order_key(seed).alias("place")), "sizes")
    planned = plan(sized, weights, share, most)
    rows = with_repetitions(inner.withColumn("place", order_key(seed)), planned).where("repetitions > 0")
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).select(*inner.columns).toDF(*names)
