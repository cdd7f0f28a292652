"""Mixing of sources to target weights, with DataFrame functions only.

Every source's words are packed into blocks of a fixed length: its documents follow each other in an order drawn by hash, and block b holds the words
from b * length on. A source's target becomes a number of slots (blocks to take). Output shards have a fixed number of slots, and
every slot of a shard draws a source by its share, so that the counts of a shard are multinomial. The draws of all shards then
get the numbers that the targets ask for: a source's slots are numbered over the shards, those beyond its number go to the sources
that drew too few (about the root of the number of slots). Slot i of a source takes the block at place i of a
pseudorandom permutation of its blocks (swap-or-not rounds, another permutation for each pass), found by a join on the block's index.

Running sums go over ranges of a sorted table with offsets between ranges, so a source that holds a third of all words is spread
over tasks like the others; nothing is collected but single numbers.

Targets: sources in order of code points, null last, weigh 3, 1, 2, repeating; they share 1.5 times all words by weight; none gets more than twice its
own words, and what is above goes to the others by weight. A pass takes each block once and there are two passes at most, so no document gives more than twice its words.

Defined results: a null text has no words; a source without words has the target 0; an empty or null source is a source of its own;
repeated rows are rows of their own (which of two equal rows gives which words isn't told apart); draws depend on ids, texts, sources
and the seed only; an empty table gives an empty result; other columns are ignored. A source of fewer words than a block is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, table, written

#: Words of a block, slots of an output shard, rounds of the permutations, and cells of the table in which draws are looked up.
LENGTH, SLOTS, ROUNDS, CELLS = 64, 1024, 16, 1024
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose figures are broadcast at most; those of more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def few(sources: DataFrame) -> DataFrame:
    """A table with a row for each source, with a broadcast hint if it is small; written tables are counted by their footers."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def running(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """df with, for each name of values, the sum of its column over all rows before in the order.

    Rows are sorted by ranges; a range adds up its own rows and gets the sum of the ranges before (a row for each range)."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_s{c}") for c, v in values.items()])
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s{c}").over(parts), F.lit(0)).alias(f"_o{c}") for c in values])
    inner = ranged.withColumns({f"_i{c}": F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in values.items()})
    out = inner.join(F.broadcast(offsets), "_part").withColumns({c: F.col(f"_i{c}") + F.col(f"_o{c}") for c in values})
    return out.drop("_part", *[f"{p}{c}" for c in values for p in ("_i", "_o")])


def targets(sizes: DataFrame) -> DataFrame:
    """source, idx (in order of code points, null last), source_size, target of frames with source and size."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = running(by, [F.col("source").asc_nulls_last()], {"idx": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int")).cast("long")
    by = by.select("source", F.col("idx").cast("long").alias("idx"), "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("most"))
    by = written(running(by, [F.col("most") / F.col("weight"), F.col("idx")], {"filled": F.col("most"), "passed": F.col("weight")}, "levels"), "levels")
    whole, weights = by.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole:
        return by.select("source", "idx", "source_size", F.lit(0.0).alias("target"))
    # all words a unit of weight gets if this source and those after it stay below their most
    level = (F.lit(SHARE * whole) - F.col("filled")) / (F.lit(weights) - F.col("passed"))
    found = by.withColumn("level", level).where(F.col("most") > F.col("weight") * F.col("level")).agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), "idx"))).first()[0]
    target = F.col("most").cast("double") if found is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(found))
    return by.select("source", "idx", "source_size", target.alias("target"))


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of i in a pseudorandom permutation of 0..n-1 (for n of 1 and more), by swap-or-not rounds under the key."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i, turn)


def _drawn(spark: SparkSession, sources: DataFrame, slots: int, seed: int) -> DataFrame:
    """idx, shard, n: the multinomial counts of every shard; sources: idx, slots, first (the slots of the sources before)."""
    cells = max(CELLS, 4 * sources.count())
    width = -(-slots // cells)
    at = sources.where("slots > 0").select("idx", "first", (F.col("first") + F.col("slots")).alias("last"))
    at = at.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))))
    draws = spark.range(slots).select(F.floor(F.col("id") / SLOTS).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slots)).alias("draw"))
    draws = draws.withColumn("cell", F.floor(F.col("draw") / width)).join(written(at, "cells"), "cell")
    return draws.where("draw >= first and draw < last").groupBy("idx", "shard").agg(F.count(F.lit(1)).alias("n"))


def assigned(spark: SparkSession, sources: DataFrame, seed: int = 0) -> DataFrame:
    """idx, shard, i: the source and the source's slot number of each slot of each shard; sources: idx, slots, first."""
    slots = sources.agg(F.sum("slots")).first()[0] or 0
    if not slots:
        return spark.createDataFrame([], "idx long, shard long, i long")
    drawn = _drawn(spark, sources, slots, seed)
    order = [F.col("idx"), F.xxhash64("idx", "shard", F.lit(seed)), F.col("shard")]
    drawn = written(running(drawn, order, {"before": F.col("n")}, "draws"), "draws")
    of = drawn.groupBy("idx").agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    sources = written(sources.join(of, "idx", "left").select("idx", "slots", "start", F.coalesce("total", F.lit(0)).alias("total")), "drawn")
    numbered = drawn.repartition(parallelism(spark), "idx", "shard").join(few(sources), "idx").select("idx", "shard", "n", "slots", (F.col("before") - F.col("start")).alias("i"))
    held = F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("i")))
    kept = numbered.withColumn("held", held).where("held > 0").select("idx", "shard", F.explode(F.sequence("i", F.col("i") + F.col("held") - 1)).alias("i"))
    over = numbered.withColumn("n", F.col("n") - held).where("n > 0").select("idx", "shard", "n")
    over = running(over, [F.xxhash64("shard", "idx", F.lit(seed)), F.col("shard"), F.col("idx")], {"e": F.col("n")}, "over")
    over = over.select("shard", F.explode(F.sequence("e", F.col("e") + F.col("n") - 1)).alias("e"))
    under = running(sources.where("total < slots").withColumn("n", F.col("slots") - F.col("total")), [F.col("idx")], {"e": F.col("n")}, "under")
    under = under.select("idx", F.posexplode(F.sequence("total", F.col("slots") - 1)).alias("at", "i"), "e").select("idx", "i", (F.col("e") + F.col("at")).alias("e"))
    return kept.unionByName(over.join(under, "e").select("idx", "shard", "i"))


def mix(docs: DataFrame, length: int = LENGTH, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, idx, size, source_size, target, at: the words before it in its source), and the mix.

    The mix: shard, idx, i (the source's slot number), block, doc_id, at, start and length (words of the document); the pieces of a slot
    lie side by side in the order of at. Blocks of a shard may be taken in any order."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    rows = written(rows, "sizes")
    sources = written(targets(rows), "targets")
    indexed = rows.join(few(sources), rows["source"].eqNullSafe(sources["source"])).drop("source")
    order = [F.col(c) for c in ("idx", "h", "doc_id", "size")]
    placed = written(running(indexed, order, {"before": F.col("size")}, "places"), "places")
    starts = written(placed.groupBy("idx").agg(F.min("before").alias("first")), "starts")
    placed = placed.join(few(starts), "idx").withColumn("at", F.col("before") - F.col("first")).drop("before", "first", "h")
    blocks = F.ceil(F.col("source_size") / length)
    sources = sources.where("source_size > 0").select("idx", blocks.alias("blocks"), F.least(MOST * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long")).alias("slots"))
    sources = written(running(sources, [F.col("idx")], {"first": F.col("slots")}, "slots"), "slots")
    turns = assigned(spark, sources.select("idx", "slots", "first"), seed).join(few(sources.select("idx", "blocks")), "idx")
    turn = F.floor(F.col("i") / F.col("blocks"))
    turns = turns.withColumn("block", permuted(F.pmod("i", "blocks"), F.col("blocks"), F.lit(seed), F.col("idx"), turn)).drop("blocks")
    end = F.col("at") + F.col("size")
    pieces = placed.where("size > 0").select("idx", "doc_id", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((end - 1) / length))).alias("block"))
    low = F.greatest(F.lit(0), F.col("block") * length - F.col("at"))
    pieces = pieces.withColumns({"start": low, "length": F.least(F.col("size"), (F.col("block") + 1) * length - F.col("at")) - low}).drop("size")
    return placed, turns.join(pieces, ["idx", "block"]).select("shard", "idx", "i", "block", "doc_id", "at", "start", "length")


def texts(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """shard, idx, i, text: the words of each slot of mix(), joined by spaces; doc_id must be unique in docs."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = mixed.join(docs.select("doc_id", "text"), "doc_id").select("shard", "idx", "i", "at", F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("words"))
    return cut.groupBy("shard", "idx", "i").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("p")).select("shard", "idx", "i", F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("text"))


def op12_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, mixed = mix(table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("idx", "at").agg(F.sum("length").alias("taken"))
    rows = placed.withColumn("key", F.when(F.col("size") > 0, F.col("at")))  # documents without words share their places
    found = rows.join(taken.withColumnRenamed("at", "key"), ["idx", "key"], "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
