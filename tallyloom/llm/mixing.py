"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import checkpoint, named, packed, unpacked

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target) for ``sizes(source, source_size)``, one row for each source.

    Sources by code point, null last, get the weights in turn. ``share`` of all sizes is dealt out by weight; a target
    stops at ``most_repeats`` times its source's size and the excess goes to the others by weight until none is
    above. That level is found in one pass: with sources ordered by cap / weight, the first k are full, where k is
    the first at which the level of the others fits under the next cap; after it the level only falls. Rows here are sources, never documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double")).withColumn("cap", most_repeats * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    reached = leveled.withColumn("final", F.max(F.when(F.col("fits"), F.col("level"))).over(whole))
    return reached.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def _digest(seed: str, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("~"))).cast("binary"))


def _unit(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(16**13)


def copies(sized: DataFrame, goal: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds source_size, target and copies to ``sized(source, size, key, ...)``: how often each row is to be emitted.

    The expected copies of a row are target / source_size of its source. Along an order within the source they are
    summed up, one offset in [0, 1) that the source's name and ``seed`` fix is added, and a row is emitted once for
    each integer that the running sum crosses. The order puts like sizes together (a fourth of a doubling), then goes
    by two digits of a digest of the key, then size and key, so that long and short texts are drawn evenly.

    No source is one sorted run: counts of (source, size class, digits) are summed first, at most some 25,000 rows for
    each source however many documents it holds, and the order inside such a bin is a window over that bin alone.
    """
    digits = F.substring(_digest(seed, F.col("key")), 1, 2)
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(-1).cast("int")
    binned = sized.withColumn("bin", F.struct(level.alias("level"), digits.alias("digits")))
    bins = binned.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    bins = bins.select("b.source", "b.bin", "b.ahead", "g.source_size", "g.target")
    bins = bins.withColumn("each", F.coalesce(F.expr("try_divide(target, cast(source_size as double))"), F.lit(0.0))).withColumn("offset", _unit(_digest(seed, F.col("source"))))
    inside = Window.partitionBy("source", "bin").orderBy("size", F.col("key").asc_nulls_last())
    placed = binned.withColumn("place", F.row_number().over(inside)).alias("d").join(bins.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin")))
    rank = F.col("ahead") + F.col("place")
    crossed = F.floor(F.col("offset") + F.col("each") * rank.cast("double")) - F.floor(F.col("offset") + F.col("each") * (rank - 1).cast("double"))
    kept = [F.col(f"d.{c}") for c in sized.columns]
    return placed.select(*kept, "source_size", "target", crossed.cast("long").alias("copies"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): one row for each row of ``docs``.

    Null or blank texts have size 0; a null source is a source of its own, the last. A source without words has target
    0 and is never taken. Rows with equal ids, and null ids, are ordered arbitrarily among themselves, which does not
    change how many copies they get in sum. An empty table gives no rows.
    """
    slim = docs.select(named(docs, id_col).cast("long").alias("key"), named(docs, source_col).cast("string").alias("source"), word_count(named(docs, text_col)).alias("size"))
    slim = checkpoint(slim)
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats, share)
    return copies(slim, goal, seed).withColumnRenamed("key", "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """The rows of the mix itself, with the columns of ``docs``; a text taken twice is there twice.

    Rows with equal ids are told apart by a digest of their source and text; among wholly equal rows each takes the
    same number of copies up to one. Null or blank texts have no words and are taken like others of their source, a
    source without any words never; a null source is the last. An empty table gives no rows.
    """
    key = F.concat_ws(":", F.coalesce(named(docs, id_col).cast("string"), F.lit("~")), F.xxhash64(named(docs, source_col), named(docs, text_col)).cast("string"))
    rows = docs.select(packed(docs), key.alias("key"))
    slim = checkpoint(docs.select(key.alias("key"), named(docs, source_col).cast("string").alias("source"), word_count(named(docs, text_col)).alias("size")))
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats, share)
    taken = copies(slim, goal, seed).groupBy("key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    met = rows.join(taken.where("copies > 0"), "key")
    alone = met.where("rows = 1").withColumn("own", F.col("copies"))
    several = met.where("rows > 1").withColumn("nth", nth).withColumn("own", F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).drop("nth")
    emitted = alone.unionByName(several).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("copy"))
    return emitted.select(*unpacked(docs.columns))
