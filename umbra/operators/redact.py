"""Redaction, its position map, restoration and audit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import scanner as B
from ..functions import spans as S
from ..rules import LABOR, STRICT, Policy, Rule, label_prefix
from . import detect as D


def labels_of(policy: Policy) -> dict[str, str]:
    """Type -> its label under the policy; others stand in brackets."""
    return {t: policy.label(t) for t in sorted({*policy.labels, *LABOR.labels, *STRICT.labels, "LOC", "LOCATION", "PER"})}


def numbered_prefix(entity_type: Column, number: Column, types: list[str]) -> Column:
    """Labels without a policy: the type's prefix and its number."""
    return F.concat(M.mapped({t: label_prefix(t) for t in types}, entity_type, entity_type), number.cast("string"))


ADDED = (*D.DETECTED, "redacted_text", "occurrences")


def redact(segments: DataFrame, policy: Policy = LABOR, rules: list[Rule] | None = None, extra: Column | None = None, text: str = "text", wanted: tuple[str, ...] = ADDED) -> DataFrame:
    """Adds redacted_text and occurrences to what ``detect`` adds, or those that are wanted."""
    if taken := set(ADDED).intersection(segments.columns):
        raise ValueError(f"redact adds columns of these names, rename yours: {', '.join(sorted(taken))}")
    return D.detect(segments, policy, rules, extra, text, wanted, labels_of(policy))


def digests(redacted: DataFrame, text: str = "text") -> DataFrame:
    return redacted.withColumns({"source_sha256": F.sha2(F.col(text), 256), "redacted_sha256": F.sha2("redacted_text", 256)})


def occurrences(redacted: DataFrame, doc: str, seg: str | None = None) -> DataFrame:
    """A row an occurrence, with its place in the document."""
    keys = [doc] + ([seg] if seg else [])
    return redacted.select(*keys, F.posexplode("occurrences").alias("pos", "o")).select(*keys, "pos", "o.*")


def entities(occ: DataFrame, doc: str, seg: str | None = None) -> DataFrame:
    """A row a document, type and original: numbered in its type by first appearance.

    Grouped before it is ranked, so a text that repeats costs one row; the rank
    is taken among a document's distinct entities of one type.
    """
    place = F.struct(*([seg] if seg else []), "pos")
    seen = occ.groupBy(doc, "entity_type", "original").agg(
        F.min(place).alias("first"), F.min_by("replacement", place).alias("replacement"), F.count(F.lit(1)).alias("n_occurrences"), F.min(F.struct(place, "engine"))["engine"].alias("engine")
    )
    number = F.row_number().over(Window.partitionBy(doc, "entity_type").orderBy("first"))
    return seen.withColumn("entity_id", F.concat_ws("_", "entity_type", number.cast("string"))).drop("first")


def with_entity_ids(occ: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    return occ.join(found.select(doc, "entity_type", "original", "entity_id"), [doc, "entity_type", "original"])


def restore(redacted: DataFrame, strict: bool = False) -> DataFrame:
    """Adds restored_text and restore_status: ok, sha_mismatch (before), source_mismatch (after).

    Needs redacted_text, occurrences, redacted_sha256, source_sha256.
    """

    def back(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from (B.restored(*x) for x in batches)

    places = F.transform("occurrences", lambda o: F.struct(o["redacted_start"].alias("redacted_start"), o["redacted_end"].alias("redacted_end"), o["original"].alias("original")))
    out = S.pinned(redacted, restored_text=F.arrow_udf(back, "string")(F.col("redacted_text"), places))
    status = (
        F.when(F.sha2("redacted_text", 256) != F.col("redacted_sha256"), "sha_mismatch")
        .when(F.sha2("restored_text", 256) != F.col("source_sha256"), "source_mismatch")
        .otherwise("ok")
    )
    if strict:
        status = F.when(status == "ok", status).otherwise(F.raise_error(F.concat(F.lit("restore failed: "), status)).cast("string"))
    return out.withColumn("restore_status", status)


def residual(redacted: DataFrame, policy: Policy = LABOR, rules: list[Rule] | None = None, text: str = "redacted_text") -> DataFrame:
    """Adds findings (pattern rules only) and residual_passed."""
    out = D.with_rule_spans(redacted.drop("spans", "findings"), rules, text, D.types_off(policy), "findings")
    return out.withColumn("residual_passed", F.size("findings") == 0)


def audit(redacted: DataFrame, doc: str, policy: Policy = LABOR) -> DataFrame:
    """Per document: entities, occurrences, counts by type and by engine, residual result.

    One pass: a row of findings and one an occurrence go into the same counts,
    combined before each shuffle.
    """
    r = residual(redacted.select(doc, "redacted_text", "occurrences"), policy).select(doc, "residual_passed", F.size("findings").alias("f"), F.posexplode_outer("occurrences").alias("pos", "o"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    keys = [doc, F.col("o.entity_type").alias("t"), F.col("o.engine").alias("e")]
    seen = r.groupBy(*keys, F.col("o.original").alias("x")).agg(F.count("o").alias("n"), F.sum(F.when(first, F.col("f")).otherwise(0)).alias("f"), F.bool_and("residual_passed").alias("ok"))
    by = seen.groupBy(doc, "t", "e").agg(F.sum("n").alias("n"), F.count("x").alias("d"), F.sum("f").alias("f"), F.bool_and("ok").alias("ok"))
    pairs = F.filter(F.collect_list(F.struct("t", "e", "n")), lambda p: p["t"].isNotNull())
    out = by.groupBy(doc).agg(F.bool_and("ok").alias("residual_passed"), F.sum("f").alias("n_findings"), F.sum("n").alias("total_occurrences"), F.sum("d").alias("total_entities"), pairs.alias("_pairs"))

    def counts(field: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("_pairs", lambda p: p[field])))
        total = lambda name: F.aggregate(F.filter("_pairs", lambda p: p[field] == name), F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
        return F.map_from_arrays(names, F.transform(names, total))

    return out.withColumns({"by_entity_type": counts("t"), "by_engine": counts("e")}).drop("_pairs")


def engines(occ: DataFrame, doc: str) -> DataFrame:
    """A row an entity: the engines that found it, distinct, in order of their first place.

    The first places are plain minima, combined before the shuffle; the few of
    an entity are listed by a window, which doesn't build lists of all groups.
    """
    keys = [doc, "entity_type", "original"]
    first = occ.groupBy(*keys, "engine").agg(F.min("pos").alias("p"))
    own = Window.partitionBy(*keys).orderBy("p", "engine")
    listed = F.collect_list(F.struct("engine")).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return first.select(*keys, listed.alias("_x"), F.row_number().over(own).alias("_n")).where("_n = 1").select(*keys, F.col("_x.engine").alias("engines"))


def warnings(redacted: DataFrame, doc: str) -> DataFrame:
    """Dropped overlaps, then bare long numbers, a row each."""
    kind = "array<struct<type:string,entity_type:string,start:int,end:int,text_preview:string>>"

    def as_warning(name: str):
        return lambda s: F.struct(F.lit(name), s["entity_type"], s["start"], s["end"], F.substring(s["text"], 1, 20))

    both = F.concat(F.transform("dropped", as_warning("overlap_discarded")).cast(kind), F.transform("bare_numbers", as_warning("bare_long_digits_no_context")).cast(kind))
    return redacted.select(doc, F.posexplode(both).alias("pos", "w")).select(doc, "pos", "w.*")


def export(detected: DataFrame, style: str = "star", text: str = "text") -> DataFrame:
    """Adds exported_text: spans as star masks, or as numbered placeholders.

    Placeholders count every occurrence of a type in its document's text.
    """

    def put(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from (B.exported(*x, style) for x in batches)

    spans = F.transform("kept", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "text", "entity_type"))))
    return S.pinned(detected, exported_text=F.arrow_udf(put, "string")(F.col(text), spans))
