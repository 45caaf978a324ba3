"""Whole cases: documents together, page and cell maps, exports, verification of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..rules import LABOR, Policy
from . import gate as G
from . import redact as R

# Types that a list of allowed terms never exempts, and those that it may.
STRUCTURAL = ["PHONE", "LANDLINE", "ID_CARD", "EMAIL", "BANK_ACCOUNT", "BANK_INFO", "ORG_CODE", "CASE_NO"]
EXEMPTIBLE = ["ORG", "ADDRESS"]
#: The ranges of Han characters.
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def is_structural(entity_type: Column) -> Column:
    return entity_type.isin(STRUCTURAL)


def is_exemptible(entity_type: Column) -> Column:
    return entity_type.isin(EXEMPTIBLE)


def all_han(text: Column) -> Column:
    return F.rlike(text, F.lit(f"^{HAN}+$"))


def page_estimate(path: Column, segments: Column) -> Column:
    """Pages of a document: a paragraph text has about 40 segments a page, a workbook a page a sheet, others one."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".docx", F.floor(segments / 40) + 1).when(ext.isin(".xlsx", ".pdf"), segments).otherwise(F.lit(1)).cast("long")


def counts_of_entities(found: DataFrame, doc: str) -> DataFrame:
    """Per document and type: distinct entities (scans count these, not occurrences)."""
    return found.groupBy(doc, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def cell_entities(found: DataFrame, row: str, col: str) -> DataFrame:
    """Entities of single cells as entities of their file: the cell stands in the identifier."""
    return found.withColumn("entity_id", F.concat(F.lit("R"), F.col(row).cast("string"), F.lit("C"), F.col(col).cast("string"), F.lit("_"), F.col("entity_id")))


def page_entities(found: DataFrame, doc: str, page: str) -> DataFrame:
    """Entities of single pages as entities of their document: numbered through by page, then type and number."""
    number = F.row_number().over(Window.partitionBy(doc).orderBy(page, "entity_type", F.length("entity_id"), "entity_id"))
    return found.withColumn("entity_id", F.concat(F.lit("p"), F.col(page).cast("string"), F.lit("_"), number.cast("string")))


def joined_pages(pages: DataFrame, doc: str, page: str, text: str = "redacted_text") -> DataFrame:
    """A row a document: its pages' texts in order, each under its heading."""
    part = F.struct(F.col(page).alias("p"), F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n\n"), F.coalesce(text, F.lit(""))).alias("t"))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))


def merged_addresses(text: Column, spans: Column, most: int = 2) -> Column:
    """Successive LOC and ADDRESS spans with a short gap of separators or Han characters become one ADDRESS.

    spans: in order of start; any other span between two parts them.
    """
    kind = "array<struct<open:boolean,n:int,s:" + S.SPAN + ">>"
    part = lambda s: s["entity_type"].isin("LOC", "ADDRESS")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.substring(text, last["s"]["end"] + 1, s["start"] - last["s"]["end"])
        fits = (F.size(acc) > 0) & last["open"] & part(s) & (s["start"] - last["s"]["end"] <= most) & F.rlike(gap, F.lit(f"^(?:[ ,，、·]|{HAN})*$"))
        grown = S.changed(last["s"], entity_type=F.lit("ADDRESS"), end=s["end"], text=F.substring(text, last["s"]["start"] + 1, s["end"] - last["s"]["start"]))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.lit(True).alias("open"), (last["n"] + 1).alias("n"), grown.alias("s"))))
        alone = F.concat(acc, F.array(F.struct(part(s).alias("open"), F.lit(1).alias("n"), s.alias("s"))))
        return F.when(fits, joined).otherwise(alone).cast(kind)

    return F.transform(F.aggregate(spans, F.array().cast(kind), step), lambda x: x["s"]).cast(S.SPANS)


def export_spans(spans: Column, given: Column, whitelist: list[str], least: int = 2) -> Column:
    """Spans for a text export: the given ones, then the rules' of ``least`` characters or more at other places, without whitelisted ones."""
    new = F.filter(spans, lambda s: (F.length(s["text"]) >= least) & ~F.exists(given, lambda g: (g["start"] == s["start"]) & (g["end"] == s["end"])))
    both = F.concat(given, new)
    return F.filter(both, lambda s: ~F.exists(F.array(*map(F.lit, whitelist)), lambda w: F.contains(s["text"], w))) if whitelist else both


def longest_first(spans: Column) -> Column:
    """Spans for replacement by text: the longest original first, so none is cut by a shorter one."""
    keyed = F.transform(spans, lambda s: F.struct((-F.length(s["text"])).alias("a"), s["start"].alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"]).cast(S.SPANS)


def page_boxes(chars: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """A row a key and page: the bounds of its characters' boxes (left, top, right, bottom)."""
    return chars.groupBy(*key, page).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def located(decisions: DataFrame, locators: DataFrame, on: list[str]) -> DataFrame:
    """Decisions with ``locator_failure``: their block has no locator, or one of another part or paragraph."""
    there = locators.select(*on, F.col("part").alias("_part"), F.col("paragraph").alias("_paragraph"))
    j = decisions.join(there, on, "left")
    failure = F.when(F.col("_part").isNull(), "missing_locator").when((F.col("part") != F.col("_part")) | (F.col("paragraph") != F.col("_paragraph")), "locator_mismatch")
    return j.withColumn("locator_failure", failure).drop("_part", "_paragraph")


def verified(applied: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """Applied decisions with ``finding``: missing_block, out_of_bounds, replacement_mismatch, or null.

    applied: key, start, original, replacement; exported: key, text. Each is
    looked for where the earlier ones of its block have moved it.
    """
    w = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("replacement") - F.length("original")).over(w), F.lit(0))
    j = applied.withColumn("_at", F.col("start") + moved).join(exported.select(*key, F.col("text").alias("_text")), key, "left")
    n = F.length("replacement")
    finding = (
        F.when(F.col("_text").isNull(), "missing_block")
        .when(F.col("_at") + n > F.length("_text"), "out_of_bounds")
        .when(F.substring("_text", F.col("_at") + 1, n) != F.col("replacement"), "replacement_mismatch")
    )
    return j.withColumn("finding", finding).drop("_at", "_text")


def invariants(counts: DataFrame) -> DataFrame:
    """counts: requested, applied, entities, occurrences. Adds ``mismatches``: which of them differ from what was applied."""
    differs = lambda c, name: F.when(F.col(c) != F.col("applied"), F.lit(name))
    found = F.array(differs("requested", "count_mismatch"), differs("entities", "entity_count_mismatch"), differs("occurrences", "occurrence_count_mismatch"))
    return counts.withColumn("mismatches", F.array_compact(found))


def allowed_terms(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """One list of both, lower-cased, each term once. Both: a column term."""
    return builtin.select(F.lower(F.trim("term")).alias("term")).union(own.select(F.lower(F.trim("term")))).where("term <> ''").distinct()


def batch(segments: DataFrame, doc: str, policy: Policy = LABOR, denylist: list[str] | None = None, most: int = 20) -> DataFrame:
    """A case: a row a document with its counts, checks and text; the text is null unless it may be published.

    Fails closed: a document with a failed check gives no text. ``warnings`` has
    the first ``most``. One row a document comes in, one goes out, judged where
    it stands: nothing shuffles.
    """
    red = R.residual(R.redact(segments, policy, wanted=("dropped", "redacted_text", "occurrences", "n_entities")), policy)
    none = F.array().cast("array<string>")
    failed = F.concat(*(F.when(bad, F.array(F.lit(name))).otherwise(none) for name, bad, _ in sorted(G.tests(policy, denylist), key=lambda x: x[0])))
    out = R.digests(S.pinned(red, failed_checks=failed))
    warned = F.transform(F.slice("dropped", 1, most), lambda s: F.substring(s["text"], 1, 20))
    released = F.size("failed_checks") == 0
    return out.select(
        doc, F.col("n_entities").cast("long").alias("n_entities"), F.size("occurrences").cast("long").alias("n_occurrences"), "failed_checks", released.alias("released"),
        F.when(released, F.col("redacted_text")).alias("text"), F.when(released, F.col("redacted_sha256")).alias("redacted_sha256"), warned.alias("warnings"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


def case_gate(cases: DataFrame) -> DataFrame:
    """One row: documents, failed documents, occurrences, and whether the whole case may be published."""
    return cases.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(~F.col("released"), 1)).alias("n_failed"), F.sum("n_occurrences").alias("n_occurrences")).withColumn("passed", F.col("n_failed") == 0)
