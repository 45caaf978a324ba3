"""Mix sources to target weights by repetition rates.

A source's rate is its target over its size. Every document is emitted
floor(rate) times, and once more with the probability of the rest, drawn from a
hash of its id and a seed, so reruns agree. Documents draw by themselves, so a
source of few long documents can land far off its target: each source takes the
one of SEEDS successive seeds whose draws sum nearest to it.

Null texts have size 0; a null source is a source of its own, last in order.
A null doc_id draws by its text's hash. Repeated rows with one doc_id draw alike.
Sources of size 0 have rate 0 and target 0; an empty table gives no rows. Extra
columns are kept by ``mix``, packed in a struct meanwhile, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

WORD = r"[^\x20\x09-\x0D]+"
SEEDS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cyclic_weights(n: int = 3) -> Column:
    """1, 2, ..., n, repeating, by the source's place in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return ((place - 1) % n + 1).cast("double")


def targets(sizes: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """source, source_size -> with target and rate.

    Targets are min(most * size, weight * level) for the one level at which they
    sum to all sizes: sources fill in order of most * size / weight, so the level
    is where what the filled ones leave, over the other ones' weights, first lies
    below the next one's ratio. The table has a row a source, so one window may see it
    whole.
    """
    w = Window.orderBy("fill", "source")
    upto, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    t = sizes.select("*", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("cap") / F.col("weight"))
    every = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (every - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(Window.partitionBy())
    level = first["level"]
    t = t.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(0.0))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", F.col("target").cast("double").alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: Column) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(key, seed), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def seeded(rows: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Adds to ``rates`` each source's seed: of those tried, the first whose draws come nearest its target.

    rows: source, size, key. One sum a source and seed, combined before the shuffle.
    """
    drawn = rows.join(rates.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    tried = range(seed, seed + SEEDS)
    sums = drawn.groupBy("s").agg(*(F.sum(F.col("size") * copies(F.col("rate"), F.col("key"), F.lit(k))).alias(f"taken{k}") for k in tried))
    near = sums.join(rates, F.col("source").eqNullSafe(F.col("s")))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in tried)))
    return near.select("source", "source_size", "target", "rate", best["seed"].alias("seed"))


def plan(docs: DataFrame, weight: Column | None = None, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``row`` (a struct of the kept columns), size, source_size, target, copies."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"))).otherwise(F.xxhash64(F.col("doc_id")))
    kept = F.struct(*(docs.columns if keep is None else keep))
    sized = docs.select(kept.alias("row"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"), key.alias("key"))
    light = keep is not None and "text" not in keep
    small = written(sized if light else sized.drop("row"), "sizes")  # spares further looks at the texts
    if light:
        sized = small
    rates = written(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weight if weight is not None else cyclic_weights()), "targets")
    t = written(seeded(small, rates, seed), "seeds").withColumnRenamed("source", "s")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("s")))
    return out.select("row", "size", "source_size", "target", copies(F.col("rate"), F.col("key"), F.col("seed")).alias("copies"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """Every row as often as the mix takes it, with the columns of docs."""
    out = plan(docs, weight, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
