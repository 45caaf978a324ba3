"""Review blocks, candidates, human decisions and term searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S


def blocks(segments: DataFrame, doc: str, seg: str, text: str = "text") -> DataFrame:
    """Adds block_id and char_offset: each block's start in its document, a newline between."""
    w = Window.partitionBy(doc).orderBy(seg)
    before = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumns({"block_id": F.concat(F.lit("b"), F.row_number().over(w).cast("string")), "char_offset": F.coalesce(before, F.lit(0)).cast("int")})


def candidates(spans: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    """Document spans (doc, start, end, …) to their blocks: start within, end clipped, the rest dropped."""
    end = F.col("b.char_offset") + F.length("b.text")
    on = (F.col("s." + doc) == F.col("b." + doc)) & (F.col("s.start") >= F.col("b.char_offset")) & (F.col("s.start") < end)
    joined = spans.alias("s").join(parts.alias("b"), on)
    return joined.select(
        F.col("s." + doc).alias(doc), F.col("b.block_id").alias("block_id"), (F.col("s.start") - F.col("b.char_offset")).alias("start"),
        (F.least(F.col("s.end"), end) - F.col("b.char_offset")).alias("end"), F.col("s.entity_type").alias("entity_type"), F.col("s.engine").alias("engine"),
    )


def judged(decisions: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    """Decisions with ``failure``: missing_block, out_of_range, overlap (the later of two), or null."""
    d = decisions.join(parts.select(doc, "block_id", F.col("text").alias("_text"), "char_offset"), [doc, "block_id"], "left")
    w = Window.partitionBy(doc, "block_id", F.col("action") == "redact").orderBy("start", "end")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    failure = (
        F.when(F.col("_text").isNull(), "missing_block")
        .when((F.col("start") < 0) | (F.col("end") > F.length("_text")) | (F.col("start") >= F.col("end")), "out_of_range")
        .when((F.col("action") == "redact") & (F.col("start") < last), "overlap")
    )
    original = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return d.withColumns({"failure": failure, "original": original})


def apply_decisions(decisions: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    """A row a document: masked text, or null and the failures if any decision fails."""
    j = judged(decisions, parts, doc)
    mask = M.decision_mask(F.col("original"), F.col("entity_type"))
    edit = F.struct("start", "end", F.col("original").alias("o"), mask.alias("m"), "entity_type")
    per_block = j.groupBy(doc, "block_id").agg(
        F.count("failure").alias("n_failed"), F.count(F.lit(1)).alias("n_decisions"), F.array_sort(F.collect_list(F.when((F.col("action") == "redact") & F.col("failure").isNull(), edit))).alias("edits")
    )
    joined = parts.join(per_block, [doc, "block_id"], "full")
    spans = F.transform(
        F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,o:string,m:string,entity_type:string>>")),
        lambda e: F.struct(
            e["entity_type"].alias("entity_type"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["o"].alias("text"),
            F.lit("decision").alias("engine"), e["m"].alias("rule_id"), F.lit(0).alias("priority"), F.lit(0).alias("ord"),
        ),
    ).cast(S.SPANS)
    out = S.pinned(joined, _x=S.replaced(F.coalesce("text", F.lit("")), spans, lambda s: s["rule_id"]))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_offset", F.col("_x.text").alias("t")))), lambda x: x["t"]), "\n")
    done = out.groupBy(doc).agg(F.sum(F.coalesce("n_failed", F.lit(0))).alias("n_failed"), F.sum(F.size("_x.occurrences")).alias("n_applied"), texts.alias("t"))
    return done.withColumn("text", F.when(F.col("n_failed") == 0, F.col("t"))).drop("t")


def terms_present(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, ignoring case."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t))) if terms else F.array().cast("array<string>")


def term_spans(text: Column, terms: list[str], entity_type: str = "MANUAL") -> Column:
    """Every place of every term, as spans."""
    return S.as_spans(S.located(text, F.array(*map(F.lit, terms))), entity_type, "denylist", None, 100)


def not_whitelisted(spans: Column, terms: list[str]) -> Column:
    """Drops spans whose text contains a whitelisted term."""
    return F.filter(spans, lambda s: ~F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(s["text"], t))) if terms else spans


def relocated(text: Column, start: Column, original: Column) -> Column:
    """The start itself if the original stands there, else its first place, else null."""
    at = F.locate(original, text) if isinstance(original, str) else F.expr("1") * F.position(original, text)
    return F.when(F.substring(text, start + 1, F.length(original)) == original, start).otherwise(F.when(at > 0, at - 1))
