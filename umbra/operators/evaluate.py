"""Evaluation of recognised spans against annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(gold: DataFrame, pred: DataFrame, key: str = "ann_id") -> DataFrame:
    """Per type: tp, fp, fn, boundary_errors, precision, recall, f1.

    Spans (key, entity_type, start, end) match one to one by equal bounds. Of
    those left over, each gold span in order takes the first free prediction of
    its type that overlaps it: a boundary error, which stays a false positive and
    a false negative.
    """
    on = [key, "entity_type", "start", "end"]
    number = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(1))))
    both = number(gold).withColumn("_g", F.lit(True)).join(number(pred).withColumn("_p", F.lit(True)), [*on, "_n"], "full")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col(side).isNull(), F.struct("start", "end", "_n"))))
    left = both.where("_g is null or _p is null").groupBy(key, "entity_type").agg(of("_p").alias("g"), of("_g").alias("p"))

    def take(acc: Column, g: Column) -> Column:
        hit = F.get(F.filter(acc["free"], lambda p: (g["start"] < p["end"]) & (p["start"] < g["end"])), F.lit(0))
        free = F.when(hit.isNull(), acc["free"]).otherwise(F.filter(acc["free"], lambda p: p != hit))
        return F.struct(free.alias("free"), (acc["n"] + F.when(hit.isNull(), 0).otherwise(1)).alias("n"))

    errors = F.aggregate("g", F.struct(F.col("p").alias("free"), F.lit(0).alias("n")), take, lambda acc: acc["n"])
    near = left.groupBy("entity_type").agg(F.sum(errors).alias("boundary_errors"))
    n = both.groupBy("entity_type").agg(F.count(F.when(F.col("_g") & F.col("_p"), 1)).alias("tp"), F.count(F.when(F.col("_g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_p").isNull(), 1)).alias("fn"))
    return scored(n.join(near, "entity_type", "left").fillna(0, ["boundary_errors"]))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scored(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4)})
    return out.withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))


def overall(per_type: DataFrame) -> DataFrame:
    return scored(per_type.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "boundary_errors"))))


def recall_gate(per_type: DataFrame, least: float = 0.9) -> DataFrame:
    return per_type.agg(F.min("recall").alias("worst_recall")).withColumn("passed", F.coalesce(F.col("worst_recall") >= least, F.lit(True)))


def drop_gate(full: DataFrame, small: DataFrame, most: float = 0.03) -> DataFrame:
    both = full.select("entity_type", F.col("recall").alias("a")).join(small.select("entity_type", F.col("recall").alias("b")), "entity_type", "left")
    return both.agg(F.max(F.col("a") - F.coalesce("b", F.lit(0.0))).alias("worst_drop")).withColumn("passed", F.coalesce(F.col("worst_drop") <= most, F.lit(True)))


def bio(text: Column, spans: Column, scheme: str = "BIO") -> Column:
    """A label for each code point; spans: array of struct(entity_type, start, end)."""

    def label(i: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(0))
        first, last = i == s["start"], i == s["end"] - 1
        mark = F.when(first, "B").otherwise("I")
        if scheme == "BIOES":
            mark = F.when(first & last, "S").when(first, "B").when(last, "E").otherwise("I")
        return F.when(s.isNull(), "O").otherwise(F.concat(mark, F.lit("-"), s["entity_type"]))

    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1), label)).otherwise(F.array().cast("array<string>"))


def problems(text: Column, spans: Column) -> Column:
    """Hard errors of an annotation: range, order, text, overlap."""
    bad = F.transform(
        spans,
        lambda s: F.when((s["start"] < 0) | (s["end"] > F.length(text)), "out_of_range")
        .when(s["start"] >= s["end"], "empty")
        .when(F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"], "text_mismatch")
        .when(F.size(F.filter(spans, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))) > 1, "overlap"),
    )
    return F.array_distinct(F.filter(bad, lambda x: x.isNotNull()))


#: Types that annotations may use; the rules find all others.
ANNOTATED = ["PERSON", "ORG", "LOCATION", "MONEY"]


def checked(text: Column, spans: Column, tags: Column) -> Column:
    """struct(errors, warnings) of one annotation; with errors it is unusable.

    spans: array of struct(entity_type, start, end, text) in order of start.
    """
    some = lambda test, name: F.when(F.exists(spans, test), F.lit(name))
    errors = F.array(
        some(lambda s: F.coalesce(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("")) != s["text"], "text_mismatch"),
        some(lambda s: s["start"] >= s["end"], "empty_span"),
        some(lambda s: ~s["entity_type"].isin(ANNOTATED), "not_annotated_type"),
        F.when(F.size(tags) != F.length(text), "tag_count"),
    )
    wrong = F.exists(F.arrays_zip(tags.alias("a"), bio(text, spans).alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))
    after = F.transform(spans, lambda s, i: s["end"] > F.coalesce(F.get(F.transform(spans, lambda o: o["start"]), i + 1), s["end"]))
    warned = F.array(F.when(wrong, "tag_mismatch"), F.when(F.exists(after, lambda x: x), "overlap"))
    return F.struct(F.array_compact(errors).alias("errors"), F.array_compact(warned).alias("warnings"))
