"""Registered queries of whole cases, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import cases as C
from ..operators import detect as D
from ..operators import redact as R
from .lines import case_lines
from .queries import _CTES, _ner, _redacted, query

_FIRSTS = _CTES + ", firsts AS (SELECT line_id, entity_type, m, min(pos) AS p, any_value(label) AS label FROM occ GROUP BY line_id, entity_type, m), ents AS (SELECT *, entity_type || '_' || row_number() OVER (PARTITION BY line_id, entity_type ORDER BY p) AS entity_id FROM firsts)"
_FAILED = "EXISTS (SELECT 1 FROM flagged f JOIN flagged k USING (line_id) WHERE f.line_id = r.line_id AND NOT f.is_kept AND f.entity_type = 'PHONE' AND k.is_kept AND k.entity_type = 'MONEY' AND k.s < f.e AND f.s < k.e)"


def _entities(spark, sf_dir):
    return R.entities(R.occurrences(_redacted(spark, sf_dir), "line_id"), "line_id")


@query(_FIRSTS + f", j AS (SELECT line_id, {_FAILED} AS residual, contains(redacted_text, '元整') AS deny, redacted_text FROM redacted r) SELECT line_id, (SELECT count(*) FROM ents e WHERE e.line_id = j.line_id) AS n_entities, (SELECT count(*) FROM occ o WHERE o.line_id = j.line_id) AS n_occurrences, concat_ws(',', CASE WHEN deny THEN 'denylist' END, CASE WHEN residual THEN 'residual' END) AS failed, NOT (deny OR residual) AS released, CASE WHEN NOT (deny OR residual) THEN sha256(redacted_text) END AS redacted_sha256 FROM j")
def batch_case(spark, sf_dir):
    b = C.batch(case_lines(spark, sf_dir), "line_id", denylist=["元整"])
    return b.select("line_id", "n_entities", "n_occurrences", F.array_join("failed_checks", ",").alias("failed"), "released", "redacted_sha256")


@query(_FIRSTS + ", agg AS (SELECT entity_type, count(*) AS n FROM ents GROUP BY entity_type) SELECT * FROM agg")
def scan_entity_counts(spark, sf_dir):
    return C.counts_of_entities(_entities(spark, sf_dir), "line_id").groupBy("entity_type").agg(F.sum("n").alias("n"))


@query(_CTES + "SELECT DISTINCT line_id, entity_type, m AS original, 'regex' AS engines FROM occ")
def entity_engines(spark, sf_dir):
    e = R.engines(R.occurrences(_redacted(spark, sf_dir), "line_id"), "line_id")
    return e.select("line_id", "entity_type", "original", F.array_join("engines", ",").alias("engines"))


@query(_FIRSTS + " SELECT line_id, 'R' || substring(line_id, 2) || 'C' || length(line_id) || '_' || entity_id AS entity_id, m AS original FROM ents")
def csv_map_merge(spark, sf_dir):
    e = _entities(spark, sf_dir).withColumns({"r": F.substring("line_id", 2, 20), "c": F.length("line_id")})
    return C.cell_entities(e, "r", "c").select("line_id", "entity_id", "original")


_PAGE = "CAST(substring(line_id, 2) AS BIGINT)"


@query(_FIRSTS + f", p AS (SELECT *, left(line_id, 1) || {_PAGE} // 50 AS doc, {_PAGE} % 50 AS page FROM ents) SELECT doc, page, 'p' || page || '_' || row_number() OVER (PARTITION BY doc ORDER BY page, entity_type, length(entity_id), entity_id) AS entity_id, m AS original FROM p")
def page_map_merge(spark, sf_dir):
    e = _entities(spark, sf_dir).withColumn("k", F.substring("line_id", 2, 20).cast("long"))
    e = e.withColumns({"doc": F.concat(F.substring("line_id", 1, 1), F.floor(F.col("k") / 50).cast("string")), "page": F.col("k") % 50})
    return C.page_entities(e, "doc", "page").select("doc", "page", "entity_id", "original")


@query(_CTES + f", p AS (SELECT redacted_text, left(line_id, 1) || {_PAGE} // 50 AS doc, {_PAGE} % 50 AS page FROM redacted) SELECT doc, string_agg('## Page ' || page || chr(10) || chr(10) || redacted_text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc")
def page_text_merge(spark, sf_dir):
    r = _redacted(spark, sf_dir).withColumn("k", F.substring("line_id", 2, 20).cast("long"))
    r = r.withColumns({"doc": F.concat(F.substring("line_id", 1, 1), F.floor(F.col("k") / 50).cast("string")), "page": F.col("k") % 50})
    return C.joined_pages(r, "doc", "page")


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size // 40 + 1 WHEN 1 THEN p_size ELSE 1 END AS pages FROM part")
def page_estimates(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".DOCX", ".xlsx", ".txt", ".csv"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("k"), C.page_estimate(F.concat(F.lit("a/b"), ext), F.col("p_size")).alias("pages"))


_ADDRESS = "SELECT s_suppkey AS k, '甲省' || (CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '、' WHEN 2 THEN 'xy' ELSE '、、、' END) || '乙路' || s_suppkey AS text, (CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS gap FROM supplier"


@query(f"SELECT k, 'ADDRESS' AS entity_type, left(text, 4 + gap) AS s_text FROM ({_ADDRESS}) WHERE gap < 2 UNION ALL SELECT k, 'LOC', '甲省' FROM ({_ADDRESS}) WHERE gap >= 2 UNION ALL SELECT k, 'LOC', '乙路' FROM ({_ADDRESS}) WHERE gap >= 2")
def address_merge_short_gaps(spark, sf_dir):
    t = spark.sql(_ADDRESS.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    two = F.array(_ner("LOC", F.lit(0), F.lit(2)), _ner("LOC", 2 + F.col("gap"), 4 + F.col("gap")))
    s = S.pinned(t, two=two).select("k", F.explode(C.merged_addresses(F.col("text"), F.col("two"))).alias("a"))
    return s.select("k", "a.entity_type", F.col("a.text").alias("s_text"))


@query(_CTES + "SELECT line_id, m AS s_text FROM hits WHERE rule_id <> 'phone_cn' AND length(m) >= 2 AND NOT contains(m, '2026') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.line_id = hits.line_id AND h.rule_id = 'phone_cn' AND h.s = hits.s AND h.e = hits.e) UNION ALL SELECT line_id, m FROM hits WHERE rule_id = 'phone_cn' AND NOT contains(m, '2026')")
def export_span_union(spark, sf_dir):
    """Phones as the given spans; all rules' spans at other places join them."""
    d = D.with_rule_spans(case_lines(spark, sf_dir))
    given = F.filter("spans", lambda s: s["rule_id"] == "phone_cn")
    return S.pinned(d, x=C.export_spans(F.col("spans"), given, ["2026"])).select("line_id", F.explode("x").alias("s")).select("line_id", F.col("s.text").alias("s_text"))


@query(_CTES + "SELECT line_id, string_agg(m, '|' ORDER BY length(m) DESC, s) AS texts FROM redactable GROUP BY line_id")
def longest_original_first(spark, sf_dir):
    d = S.pinned(D.detect(case_lines(spark, sf_dir), wanted=("kept",)), k=F.col("kept")).where(F.size("k") > 0)
    return d.select("line_id", F.array_join(F.transform(C.longest_first(F.col("k")), lambda s: s["text"]), "|").alias("texts"))


@query("SELECT l_orderkey AS k, l_linenumber % 3 AS page, CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(min(l_discount) AS DOUBLE) AS y0, CAST(max(l_quantity) + 1 AS DOUBLE) AS x1, CAST(max(l_tax) AS DOUBLE) AS y1 FROM lineitem GROUP BY 1, 2")
def char_boxes_by_page(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_quantity").alias("left"), F.col("l_discount").alias("top"), (F.col("l_quantity") + 1).alias("right"), F.col("l_tax").alias("bottom"))
    b = C.page_boxes(x, ["k"])
    return b.select("k", "page", *(F.col(c).cast("double").alias(n) for c, n in (("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'missing_locator' WHEN 1 THEN 'locator_mismatch' WHEN 2 THEN 'locator_mismatch' END AS failure FROM orders")
def decision_locators(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    n = F.col("k") % 4
    given = o.select("k", F.lit("word/document.xml").alias("part"), F.lit(3).alias("paragraph"))
    there = o.where(n > 0).select("k", F.when(n == 1, "word/header1.xml").otherwise("word/document.xml").alias("part"), F.when(n == 2, 4).otherwise(3).alias("paragraph"))
    return C.located(given, there, ["k"]).select("k", F.col("locator_failure").alias("failure"))


@query("SELECT o_orderkey AS k, i, CASE WHEN o_orderkey % 4 = 0 THEN 'missing_block' WHEN o_orderkey % 4 = 1 AND i = 2 THEN 'out_of_bounds' WHEN o_orderkey % 4 = 2 AND i = 1 THEN 'replacement_mismatch' END AS finding FROM orders, (VALUES (1), (2)) v(i)")
def decision_verification(spark, sf_dir):
    """'abcdefgh' with b and efg replaced: exported whole, cut, changed, or not at all."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    n = F.col("k") % 4
    edit = lambda i, start, old, new: F.struct(F.lit(i).alias("i"), F.lit(start).alias("start"), F.lit(old).alias("original"), F.lit(new).alias("replacement"))
    applied = o.select("k", F.explode(F.array(edit(1, 1, "b", "***"), edit(2, 4, "efg", "e***"))).alias("e")).select("k", "e.*")
    exported = o.where(n > 0).select("k", F.when(n == 1, "a***cde**").when(n == 2, "a*x*cde***h").otherwise("a***cde***h").alias("text"))
    return C.verified(applied, exported, ["k"]).select("k", "i", "finding")


@query("SELECT s_suppkey AS k, concat_ws(',', CASE WHEN s_suppkey % 2 = 1 THEN 'count_mismatch' END, CASE WHEN s_suppkey % 3 = 1 THEN 'entity_count_mismatch' END, CASE WHEN s_suppkey % 5 = 1 THEN 'occurrence_count_mismatch' END) AS mismatches FROM supplier")
def decision_invariants(spark, sf_dir):
    k = F.col("s_suppkey")
    c = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("k"), F.lit(7).alias("applied"), *(F.when(k % m == 1, 8).otherwise(7).alias(n) for m, n in ((2, "requested"), (3, "entities"), (5, "occurrences"))))
    return C.invariants(c).select("k", F.array_join("mismatches", ",").alias("mismatches"))


@query("SELECT lower(n_name) AS term FROM nation UNION SELECT lower(r_name) FROM region")
def allowlist_union(spark, sf_dir):
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    own = r.select(F.concat(F.lit("  "), "r_name").alias("term")).union(n.select(F.lower("n_name"))).union(n.select(F.lit(" ")))
    return C.allowed_terms(n.select(F.col("n_name").alias("term")), own)


@query(_CTES + "SELECT entity_type, entity_type IN ('PHONE', 'LANDLINE', 'ID_CARD', 'EMAIL', 'BANK_ACCOUNT', 'BANK_INFO', 'ORG_CODE', 'CASE_NO') AS structural, entity_type IN ('ORG', 'ADDRESS') AS exemptible, count(*) FILTER (regexp_full_match(m, '[㐀-䶿一-鿿豈-﫿]+')) AS n_han FROM hits GROUP BY entity_type")
def type_memberships(spark, sf_dir):
    s = D.with_rule_spans(case_lines(spark, sf_dir)).select(F.explode("spans").alias("s")).select("s.entity_type", "s.text")
    kind = F.col("entity_type")
    return s.groupBy("entity_type").agg(F.any_value(C.is_structural(kind)).alias("structural"), F.any_value(C.is_exemptible(kind)).alias("exemptible"), F.count(F.when(C.all_han(F.col("text")), 1)).alias("n_han"))
