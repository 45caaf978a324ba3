"""The registered queries of the span engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import gate as G
from ..operators import geometry as O
from ..operators import names as N
from ..operators import redact as R
from ..operators import review as V
from ..rules import LABOR, RULES, STRICT, scan_order
from .lines import LINES_SQL, case_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---- SQL shared by the oracles: raw hits, bank numbers, greedy resolution ----------------------

#: Each rule in a dialect without look-around: group 1 is the match, extra conditions follow.
_RE2 = {
    "api_token": (r"(?:^|[^A-Za-z0-9])((?:sk|ak|token|key|secret|password)[_\-]?[A-Za-z0-9]{20,})", ""),
    "bank_branch_cn": (r"((?:开户行\s*[:：]?\s*)?[一-鿿]{2,30}(?:银行|信用社)[一-鿿]{0,30}(?:支行|分行|营业部))", ""),
    "bank_card_cn": (r"([0-9]+)", "regexp_full_match(m, '6[0-9]{15,18}|4[0-9]{12,15}|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}')"),
    "case_no": (r"(\([0-9]{4}\)[一-鿿0-9]+号)", ""),
    "case_no_contract": (r"((?:(?:合同编号|案号)\s*)?[\[【（(]\s*[0-9０-９oO]{2,4}\s*[\]】）)]?\s*[一-鿿A-Za-z0-9０-９oO」\-－—（）()\[\]【】]{2,30}号)", ""),
    "case_no_contract#2": (r"(?:^|[^A-Za-z0-9])([0-9A-Za-z]{2,8}[-－—][0-9A-Za-z]{2,12})(?:[^A-Za-z0-9]|$)", "regexp_matches(m, '[A-Za-z]')"),
    "email": (r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", ""),
    "execution_no": (r"((?:执|执行)(?:字|案件)?[\(（]?[0-9]{4}[\)）]?[一-鿿]?[0-9]+号?)", ""),
    "id_card_cn": (r"([0-9]+[Xx]?)", "regexp_full_match(m, '[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]')"),
    "landline_cn": (r"([0-9]+[-－—]?[0-9]*)", "regexp_full_match(m, '0[0-9]{2,3}[-－—]?[0-9]{7,8}(?:[-－—]?[0-9]{1,6})?')"),
    "money_cn": (r"(?:^|[^A-Za-z0-9])((?:人民币\s*)?(?:[¥￥]\s*)?(?:[0-9０-９]+(?:[.,，][0-9０-９]+)?|[零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+)\s*(?:亿元|万元|元|圆|块)(?:整)?)", ""),
    "org_code": (r"(?:^|[^0-9A-Za-z])([0-9A-HJ-NP-RTUW-Y]{2}[0-9]{6}[0-9A-HJ-NP-RTUW-Y]{10})(?:[^0-9]|$)", ""),
    "passport_cn": (r"(?:^|[^A-Za-z0-9])([A-Z][0-9]{8})(?:[^A-Za-z0-9]|$)", ""),
    "phone_cn": (r"([0-9]+)", "regexp_full_match(m, '1[3-9][0-9]{9}')"),
    "plate_cn": (r"([京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤川青藏琼宁][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳])", ""),
    "property_cert": (r"([（(]?[一-鿿]{1,10}[)）]?\s*(?:不动产权?|房权证|土地证)\s*(?:第|字第)?\s*[A-Za-z0-9\-－—]+号)", ""),
}


def _hits() -> str:
    rank = {r.rule_id: i for i, r in enumerate(scan_order())}
    by = {r.rule_id: r for r in RULES}
    parts = []
    for name, (pattern, keep) in _RE2.items():
        r = by[name.split("#")[0]]
        one = f"SELECT line_id, text, unnest(regexp_extract_all(text, '{pattern}', 1)) AS m FROM lines"
        parts.append(f"SELECT line_id, '{r.rule_id}' AS rule_id, '{r.entity_type}' AS entity_type, {r.priority} AS priority, {rank[r.rule_id]} AS rnk, m, strpos(text, m) - 1 AS s, strpos(text, m) - 1 + length(m) AS e FROM ({one}) WHERE {keep or 'true'}")
    return " UNION ALL ".join(parts)


_CTES = f"""WITH RECURSIVE lines AS ({LINES_SQL}), hits AS ({_hits()}),
nums AS (SELECT line_id, text, m, strpos(text, m) - 1 AS s, strpos(text, m) - 1 + length(m) AS e FROM (SELECT line_id, text, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM lines) WHERE length(m) BETWEEN 12 AND 19),
free AS (SELECT * FROM nums n WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.line_id = n.line_id AND h.s < n.e AND n.s < h.e)),
bank AS (SELECT *, regexp_matches(substring(text, greatest(0, s - 30) + 1, e + 30 - greatest(0, s - 30)), '账号|银行卡号|收款账户|开户行|银行|尾号|卡号|账户') AS near FROM free),
spans AS (SELECT h.line_id, rule_id, entity_type, priority, rnk, m, s, e FROM hits h JOIN lines l USING (line_id)
   WHERE NOT (entity_type = 'MONEY' AND regexp_full_match(m, '(19|20)[0-9]{{2}}元') AND substring(text, e + 1, 1) = '年')
  UNION ALL SELECT line_id, 'bank_account_context', 'BANK_ACCOUNT', 110, 99, m, s, e FROM bank WHERE near),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY e - s DESC, priority DESC, rnk, s) AS rk FROM spans),
rec(line_id, rk, kept) AS (SELECT DISTINCT line_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT, rk BIGINT)[]) FROM ranked
  UNION ALL SELECT r.line_id, r.rk, CASE WHEN len(list_filter(rec.kept, lambda k: k.s < r.e AND r.s < k.e)) > 0 THEN rec.kept
     ELSE list_append(rec.kept, CAST({{'s': r.s, 'e': r.e, 'rk': r.rk}} AS STRUCT(s BIGINT, e BIGINT, rk BIGINT))) END
   FROM rec JOIN ranked r ON r.line_id = rec.line_id AND r.rk = rec.rk + 1),
last AS (SELECT line_id, kept FROM rec QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY rk DESC) = 1),
flagged AS (SELECT r.*, len(list_filter(l.kept, lambda k: k.rk = r.rk)) > 0 AS is_kept FROM ranked r JOIN last l USING (line_id)),
redactable AS (SELECT * FROM flagged WHERE is_kept AND entity_type NOT IN ('DATE', 'NER_MISC', 'TIME', 'MONEY')),
labels(entity_type, label) AS (VALUES {", ".join(f"('{t}', '{x}')" for t, x in LABOR.labels.items())}),
occ AS (SELECT r.*, label, row_number() OVER w AS pos, s + coalesce(sum(length(label) - (e - s)) OVER (PARTITION BY line_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rs,
   coalesce(lag(e) OVER w, 0) AS prev FROM redactable r JOIN labels USING (entity_type) WINDOW w AS (PARTITION BY line_id ORDER BY s)),
redacted AS (SELECT l.line_id, l.text, coalesce(string_agg(substring(l.text, prev + 1, s - prev) || label, '' ORDER BY s), '') || substring(l.text, coalesce(max(e), 0) + 1) AS redacted_text FROM lines l LEFT JOIN occ o ON o.line_id = l.line_id GROUP BY l.line_id, l.text)
"""


def _detected(spark, sf_dir, policy=LABOR, wanted="kept"):
    return D.detect(case_lines(spark, sf_dir), policy, wanted=(wanted,))


def _redacted(spark, sf_dir, policy=LABOR):
    return R.digests(R.redact(case_lines(spark, sf_dir), policy, wanted=("redacted_text", "occurrences")))


def _long(df: DataFrame, col: str, key: str = "line_id") -> DataFrame:
    s = df.select(key, F.explode(col).alias("s"))
    return s.select(key, "s.entity_type", F.col("s.start").cast("long").alias("s_start"), F.col("s.end").cast("long").alias("s_end"), F.col("s.text").alias("s_text"))


_COLS = "line_id, entity_type, CAST(s AS BIGINT) AS s_start, CAST(e AS BIGINT) AS s_end, m AS s_text"

for _rule in scan_order():

    def _scan(spark, sf_dir, rule=_rule):
        lines = case_lines(spark, sf_dir)
        return _long(D.with_rule_spans(lines, [rule]), "spans")

    QUERIES[f"scan_{_rule.rule_id}"] = _scan
    SQL[f"scan_{_rule.rule_id}"] = _CTES + f"SELECT {_COLS} FROM hits WHERE rule_id = '{_rule.rule_id}'"


@query(_CTES + "SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id")
def spans_by_rule(spark, sf_dir):
    s = D.with_rule_spans(case_lines(spark, sf_dir)).select(F.explode("spans").alias("s"))
    return s.groupBy(F.col("s.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


@query(_CTES + f"SELECT {_COLS} FROM flagged WHERE is_kept")
def resolve_overlaps(spark, sf_dir):
    return _long(_detected(spark, sf_dir, LABOR.with_overrides(force=LABOR.preserved - {"TIME"})), "kept")


@query(_CTES + f"SELECT {_COLS} FROM flagged WHERE NOT is_kept")
def discarded_spans(spark, sf_dir):
    return _long(_detected(spark, sf_dir, wanted="dropped"), "dropped")


@query(_CTES + f"SELECT {_COLS} FROM redactable")
def policy_labor(spark, sf_dir):
    return _long(_detected(spark, sf_dir), "kept")


@query()
def policy_strict(spark, sf_dir):
    return _long(_detected(spark, sf_dir, STRICT), "kept")


@query(_CTES + f"SELECT {_COLS} FROM flagged WHERE is_kept AND entity_type NOT IN ('DATE', 'NER_MISC', 'TIME', 'EMAIL')")
def policy_override(spark, sf_dir):
    return _long(_detected(spark, sf_dir, LABOR.with_overrides(preserve=["EMAIL"], force=["MONEY", "EMAIL"])), "kept")


@query(_CTES + f"SELECT {_COLS} FROM flagged f WHERE NOT is_kept AND entity_type <> 'MONEY' AND EXISTS (SELECT 1 FROM flagged k WHERE k.line_id = f.line_id AND k.is_kept AND k.entity_type = 'MONEY' AND k.s < f.e AND f.s < k.e)")
def preserve_shadowing(spark, sf_dir):
    d = D.detect(case_lines(spark, sf_dir), LABOR.with_overrides(force=["MONEY"]), wanted=("kept", "dropped"))
    d = S.pinned(d, money=F.filter("kept", lambda k: k["entity_type"] == "MONEY"))
    hit = lambda s: F.exists("money", lambda k: S.overlaps(s, k))
    return _long(d.withColumn("shadowed", F.filter("dropped", lambda s: (s["entity_type"] != "MONEY") & hit(s))), "shadowed")


@query(_CTES + "SELECT line_id, 'BANK_ACCOUNT' AS entity_type, CAST(s AS BIGINT) AS s_start, CAST(e AS BIGINT) AS s_end, m AS s_text FROM bank WHERE near")
def bank_account_context(spark, sf_dir):
    d = _detected(spark, sf_dir, wanted="spans")
    return _long(d.withColumn("b", F.filter("spans", lambda s: s["rule_id"] == "bank_account_context")), "b")


@query(_CTES + "SELECT line_id, 'BANK_ACCOUNT' AS entity_type, CAST(s AS BIGINT) AS s_start, CAST(e AS BIGINT) AS s_end, m AS s_text FROM bank WHERE NOT near")
def bare_digit_warnings(spark, sf_dir):
    return _long(_detected(spark, sf_dir, wanted="bare_numbers"), "bare_numbers")


@query(_CTES + "SELECT h.line_id, m AS s_text FROM hits h JOIN lines l USING (line_id) WHERE entity_type = 'MONEY' AND regexp_full_match(m, '(19|20)[0-9]{2}元') AND substring(text, e + 1, 1) = '年'")
def yuan_nian_suppression(spark, sf_dir):
    d = D.with_rule_spans(case_lines(spark, sf_dir))
    gone = F.array_except(F.transform("spans", lambda s: s["text"]), F.transform(D.without_first_years(F.col("text"), F.col("spans")), lambda s: s["text"]))
    return d.select("line_id", F.explode(gone).alias("s_text"))


@query()
def time_expressions(spark, sf_dir):
    lines = case_lines(spark, sf_dir)
    return _long(lines.withColumn("t", D.time_spans(F.col("text"), S.none())), "t")


@query(_CTES + "SELECT line_id, redacted_text FROM redacted")
def redacted_text(spark, sf_dir):
    return _redacted(spark, sf_dir).select("line_id", "redacted_text")


@query(_CTES + "SELECT line_id, sha256(text) AS source_sha256, sha256(redacted_text) AS redacted_sha256 FROM redacted")
def redact_sha(spark, sf_dir):
    return _redacted(spark, sf_dir).select("line_id", "source_sha256", "redacted_sha256")


@query(_CTES + "SELECT line_id, entity_type, m AS original, label AS replacement, CAST(s AS BIGINT) AS original_start, CAST(e AS BIGINT) AS original_end, CAST(rs AS BIGINT) AS redacted_start, CAST(rs + length(label) AS BIGINT) AS redacted_end FROM occ")
def occurrences(spark, sf_dir):
    o = R.occurrences(_redacted(spark, sf_dir), "line_id")
    return o.select("line_id", "entity_type", "original", "replacement", *(F.col(c).cast("long").alias(c) for c in ("original_start", "original_end", "redacted_start", "redacted_end")))


@query(
    _CTES + ", firsts AS (SELECT line_id, entity_type, m, min(pos) AS p, count(*) AS n, any_value(label) AS label FROM occ GROUP BY ALL) "
    "SELECT line_id, entity_type || '_' || row_number() OVER (PARTITION BY line_id, entity_type ORDER BY p) AS entity_id, entity_type, m AS original, label AS replacement, n AS n_occurrences FROM firsts".replace("GROUP BY ALL", "GROUP BY line_id, entity_type, m")
)
def entities(spark, sf_dir):
    e = R.entities(R.occurrences(_redacted(spark, sf_dir), "line_id"), "line_id")
    return e.select("line_id", "entity_id", "entity_type", "original", "replacement", "n_occurrences")


@query(f"WITH lines AS ({LINES_SQL}) SELECT line_id, text AS restored_text, 'ok' AS restore_status FROM lines")
def restore_roundtrip(spark, sf_dir):
    return R.restore(_redacted(spark, sf_dir)).select("line_id", "restored_text", "restore_status")


@query(_CTES + "SELECT f.line_id, CAST(count(*) AS BIGINT) AS n_findings FROM flagged f WHERE NOT is_kept AND entity_type = 'PHONE' AND EXISTS (SELECT 1 FROM flagged k WHERE k.line_id = f.line_id AND k.is_kept AND k.entity_type = 'MONEY' AND k.s < f.e AND f.s < k.e) GROUP BY f.line_id")
def residual_scan(spark, sf_dir):
    r = R.residual(_redacted(spark, sf_dir))
    return r.where("not residual_passed").select("line_id", F.size("findings").cast("long").alias("n_findings"))


@query(_CTES + "SELECT entity_type, count(*) AS n, count(DISTINCT m) AS n_distinct FROM occ GROUP BY entity_type")
def audit_by_type(spark, sf_dir):
    o = R.occurrences(_redacted(spark, sf_dir), "line_id")
    return o.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("original").alias("n_distinct"))


@query(_CTES + "SELECT 'regex' AS engine, count(*) AS n FROM occ")
def audit_by_engine(spark, sf_dir):
    return R.occurrences(_redacted(spark, sf_dir), "line_id").groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query(_CTES + "SELECT line_id, count(*) AS total_occurrences, count(DISTINCT entity_type || m) AS total_entities FROM occ GROUP BY line_id")
def audit_totals(spark, sf_dir):
    a = R.audit(_redacted(spark, sf_dir), "line_id")
    return a.where("total_occurrences > 0").select("line_id", "total_occurrences", "total_entities")


_STAR = """CASE WHEN entity_type IN ('PHONE', 'LANDLINE') THEN CASE WHEN length(m) >= 11 THEN left(m, 3) || '****' || right(m, 4) ELSE left(m, 1) || '***' END
 WHEN entity_type IN ('ID_CARD', 'PASSPORT', 'ORG_CODE') THEN CASE WHEN length(m) >= 15 THEN left(m, 4) || repeat('*', length(m) - 8) || right(m, 4) ELSE left(m, 3) || repeat('*', greatest(1, length(m) - 6)) || right(m, 3) END
 WHEN entity_type IN ('ORG', 'BANK_BRANCH') THEN CASE WHEN length(m) > 4 THEN left(m, 2) || repeat('*', greatest(2, length(m) - 4)) || right(m, 2) ELSE left(m, 1) || repeat('*', length(m) - 1) END
 WHEN entity_type = 'EMAIL' THEN left(m, least(2, strpos(m, '@') - 1)) || '***' || substring(m, strpos(m, '@'))
 WHEN entity_type = 'BANK_CARD' THEN CASE WHEN length(m) >= 8 THEN repeat('*', length(m) - 4) || right(m, 4) ELSE repeat('*', greatest(1, length(m) - 2)) || right(m, 2) END
 WHEN entity_type = 'MONEY' THEN '****' || right(m, 1) ELSE left(m, 1) || '***' END"""


@query(_CTES + f"SELECT line_id, entity_type, m AS s_text, {_STAR} AS masked FROM flagged WHERE is_kept")
def star_masks(spark, sf_dir):
    s = resolve_overlaps(spark, sf_dir)
    return s.select("line_id", "entity_type", "s_text", M.star(F.col("s_text"), F.col("entity_type")).alias("masked"))


_DECISION = _STAR.replace("WHEN entity_type IN ('PHONE', 'LANDLINE')", "WHEN entity_type = 'LANDLINE' THEN CASE WHEN length(m) >= 8 THEN left(m, 3) || '****' || right(m, 4) ELSE left(m, 1) || '***' END WHEN entity_type = 'PHONE'")
_DECISION = _DECISION.replace("('ID_CARD', 'PASSPORT', 'ORG_CODE')", "('ID_CARD')").replace("('ORG', 'BANK_BRANCH')", "('ORG')").replace("least(2, strpos(m, '@') - 1)", "strpos(m, '@') - 1")


@query(_CTES + f"SELECT line_id, entity_type, m AS s_text, {_DECISION} AS masked FROM flagged WHERE is_kept")
def decision_masks(spark, sf_dir):
    s = resolve_overlaps(spark, sf_dir)
    return s.select("line_id", "entity_type", "s_text", M.decision_mask(F.col("s_text"), F.col("entity_type")).alias("masked"))


@query(
    _CTES + f", names(entity_type, name) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in M.PLACEHOLDERS.items())}) "
    "SELECT line_id, CAST(s AS BIGINT) AS s_start, '<' || coalesce(name, '敏感信息') || row_number() OVER (PARTITION BY line_id, r.entity_type ORDER BY s) || '>' AS tag FROM redactable r LEFT JOIN names USING (entity_type)"
)
def placeholder_numbering(spark, sf_dir):
    from pyspark.sql import Window

    s = policy_labor(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("line_id", "entity_type").orderBy("s_start"))
    return s.select("line_id", "s_start", M.placeholder(F.col("entity_type"), n).alias("tag"))


@query(
    _CTES + f", starred AS (SELECT *, {_STAR} AS x, coalesce(lag(e) OVER (PARTITION BY line_id ORDER BY s), 0) AS prev FROM redactable) "
    "SELECT l.line_id, coalesce(string_agg(substring(l.text, prev + 1, s - prev) || x, '' ORDER BY s), '') || substring(l.text, coalesce(max(e), 0) + 1) AS exported_text FROM lines l LEFT JOIN starred o ON o.line_id = l.line_id GROUP BY l.line_id, l.text"
)
def text_export_star(spark, sf_dir):
    return R.export(_detected(spark, sf_dir)).select("line_id", "exported_text")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, (CASE WHEN contains(lower(text), 'license') THEN 'license' ELSE '' END) || (CASE WHEN contains(lower(text), 'reserved') THEN '+reserved' ELSE '' END) AS terms FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'reserved')")
def denylist_search(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", V.terms_present(F.col("text"), ["License", "Reserved"]))
    has = lambda x: F.array_contains("t", x)
    label = F.concat(F.when(has("License"), "license").otherwise(""), F.when(has("Reserved"), "+reserved").otherwise(""))
    return d.where(F.size("t") > 0).select("doc_id", F.length("text").cast("long").alias("n"), label.alias("terms"))


@query(_CTES + f"SELECT {_COLS} FROM redactable WHERE NOT contains(m, '2026') AND NOT contains(m, 'example')")
def whitelist_filter(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return _long(d.withColumn("k", V.not_whitelisted(F.col("kept"), ["2026", "example"])), "k")


# ---- spans of models, as a supplied table ------------------------------------------------------


def _ner(kind: str, start, end, text=None, engine: str = "ner"):
    t = F.substring("text", start + 1, end - start) if text is None else text
    return F.struct(F.lit(kind).alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), t.alias("text"), F.lit(engine).alias("engine"), F.lit(None).cast("string").alias("rule_id"), F.lit(50).alias("priority"), F.lit(0).alias("ord")).cast(S.SPAN)


_ORG_TEXT = "SELECT s_suppkey AS k, (CASE s_suppkey % 3 WHEN 0 THEN '原告' ELSE '昨天' END) || '甲' || s_suppkey || (CASE s_suppkey % 4 WHEN 0 THEN '有限公司' WHEN 1 THEN '银行' ELSE '饭馆' END) || '的事情已经说过了' AS text, '甲' || s_suppkey || (CASE s_suppkey % 4 WHEN 0 THEN '有限公司' WHEN 1 THEN '银行' ELSE '饭馆' END) AS name FROM supplier"


@query(f"SELECT k, CASE WHEN name = '甲7饭馆' THEN 'denylist' WHEN name = '甲8有限公司' THEN 'allowlist' WHEN regexp_matches(name, '(公司|银行)$') THEN 'suffix' WHEN contains(text, '原告') OR contains(text, '公司') THEN 'context' ELSE 'no_match' END AS reason FROM ({_ORG_TEXT})")
def org_gate(spark, sf_dir):
    t = spark.sql(_ORG_TEXT.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    span = _ner("ORG", F.lit(2), 2 + F.length("name"))
    return t.select("k", N.org_reason(F.col("text"), span, F.array(F.lit("甲8有限公司")), F.array(F.lit("甲7饭馆"))).alias("reason"))


_ADDRESS = "SELECT p_partkey AS k, '住址福田区' || (CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '街' ELSE '和' END) || '乙' || p_partkey || '路号楼。' AS text, length('乙' || p_partkey || '路') AS n, (CASE p_partkey % 3 WHEN 0 THEN 0 ELSE 1 END) AS gap FROM part"


@query(f"SELECT k, CAST(2 AS BIGINT) AS s_start, CAST(5 + gap + n + 1 AS BIGINT) AS s_end FROM ({_ADDRESS}) WHERE k % 3 <> 2 UNION ALL SELECT k, 2, 5 FROM ({_ADDRESS}) WHERE k % 3 = 2 UNION ALL SELECT k, 6, 6 + n FROM ({_ADDRESS}) WHERE k % 3 = 2")
def address_merge(spark, sf_dir):
    t = spark.sql(_ADDRESS.replace("FROM part", "FROM {p}"), p=spark.read.parquet(f"{sf_dir}/part.parquet"))
    locs = F.array(_ner("LOC", F.lit(2), F.lit(5)), _ner("LOC", 5 + F.col("gap"), 5 + F.col("gap") + F.col("n")))
    merged = S.pinned(t, locs=locs).select("k", F.explode(N.addresses(F.col("text"), F.col("locs"))).alias("a"))
    return merged.select("k", F.col("a.start").cast("long").alias("s_start"), F.col("a.end").cast("long").alias("s_end"))


_NAMES = "SELECT c_custkey AS k, (CASE c_custkey % 2 WHEN 0 THEN '欧阳' ELSE '张三' END) || '丙' || c_custkey || '提交，丙' || c_custkey || '签字' AS text, length('丙' || c_custkey) AS n FROM customer"


@query(f"SELECT k, CAST(0 AS BIGINT) AS s_start, CAST(2 + n AS BIGINT) AS s_end FROM ({_NAMES}) WHERE k % 2 = 0 UNION ALL SELECT k, 0, 2 FROM ({_NAMES}) WHERE k % 2 = 1 UNION ALL SELECT k, 2, 2 + n FROM ({_NAMES}) WHERE k % 2 = 1")
def surname_merge(spark, sf_dir):
    t = spark.sql(_NAMES.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    two = F.array(_ner("PERSON", F.lit(0), F.lit(2)), _ner("PERSON", F.lit(2), 2 + F.col("n")))
    s = S.pinned(t, two=two).select("k", F.explode(N.surnames_joined(F.col("text"), F.col("two"))).alias("a"))
    return s.select("k", F.col("a.start").cast("long").alias("s_start"), F.col("a.end").cast("long").alias("s_end"))


@query(f"SELECT k, CAST(2 AS BIGINT) AS s_start, 'ner' AS engine FROM ({_NAMES}) UNION ALL SELECT k, 2 + n + 3, 'ner_expanded' FROM ({_NAMES})")
def expand_mentions(spark, sf_dir):
    t = spark.sql(_NAMES.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    s = t.select("k", F.explode(N.expanded(F.col("text"), F.array(_ner("PERSON", F.lit(2), 2 + F.col("n"))))).alias("a"))
    return s.select("k", F.col("a.start").cast("long").alias("s_start"), "a.engine")


_ABBREV = "SELECT s_suppkey AS k, '深圳市丁' || s_suppkey || '科技有限公司起诉，丁' || s_suppkey || '科技公司到庭' AS text, length('深圳市丁' || s_suppkey || '科技有限公司') AS n FROM supplier"


@query(f"SELECT k, CAST(n + 3 AS BIGINT) AS s_start, CAST(n + 3 + n - 5 AS BIGINT) AS s_end FROM ({_ABBREV})")
def org_abbreviations(spark, sf_dir):
    t = spark.sql(_ABBREV.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    s = t.select("k", F.explode(N.abbreviation_spans(F.col("text"), F.array(_ner("ORG", F.lit(0), F.col("n"))))).alias("a"))
    return s.select("k", F.col("a.start").cast("long").alias("s_start"), F.col("a.end").cast("long").alias("s_end"))


# ---- review, gate, evaluation, geometry --------------------------------------------------------


def _blocks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return V.blocks(c.select("conv_id", "turn", "text"), "conv_id", "turn")


_BLOCKS = "blocks AS (SELECT conv_id, turn, text, 'b' || row_number() OVER w AS block_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_BLOCKS} SELECT conv_id, block_id, CAST(char_offset AS BIGINT) AS char_offset FROM blocks")
def review_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("conv_id", "block_id", F.col("char_offset").cast("long").alias("char_offset"))


@query(f"WITH {_BLOCKS}, spans AS (SELECT DISTINCT conv_id, x AS s, x + 40 AS e FROM blocks, (VALUES (0), (100), (333), (100000)) v(x)) SELECT s.conv_id, block_id, CAST(s - char_offset AS BIGINT) AS s_start, CAST(least(e, char_offset + length(text)) - char_offset AS BIGINT) AS s_end FROM spans s JOIN blocks b ON b.conv_id = s.conv_id AND s >= char_offset AND s < char_offset + length(text)")
def span_to_block(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    ids = b.select("conv_id").distinct()
    spans = ids.select("conv_id", F.explode(F.array(*map(F.lit, (0, 100, 333, 100000)))).alias("start"), F.lit("X").alias("entity_type"), F.lit("regex").alias("engine")).withColumn("end", F.col("start") + 40)
    c = V.candidates(spans, b, "conv_id")
    return c.select("conv_id", "block_id", F.col("start").cast("long").alias("s_start"), F.col("end").cast("long").alias("s_end"))


def _decisions(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    one = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("redact").alias("action")),
        F.struct(F.when(F.col("conv_id") % 7 == 0, 3).otherwise(5).alias("start"), F.lit(9).alias("end"), F.lit("redact").alias("action")),
    )
    d = b.where((F.length("text") >= 10) & (F.col("turn") == 0)).select("conv_id", "block_id", F.explode(one).alias("d"), F.lit("PERSON").alias("entity_type"))
    return d.select("conv_id", "block_id", "d.*", "entity_type"), b


@query(f"WITH {_BLOCKS}, d AS (SELECT conv_id FROM blocks WHERE length(text) >= 10 AND turn = 0) SELECT b.conv_id, CASE WHEN d.conv_id IS NULL OR b.conv_id % 7 <> 0 THEN string_agg(CASE WHEN d.conv_id IS NOT NULL AND turn = 0 THEN left(text, 1) || '***' || substring(text, 5, 1) || substring(text, 6, 1) || '***' || substring(text, 10) ELSE text END, chr(10) ORDER BY char_offset) END AS text FROM blocks b LEFT JOIN d USING (conv_id) GROUP BY b.conv_id, d.conv_id")
def decisions_apply(spark, sf_dir):
    d, b = _decisions(spark, sf_dir)
    return V.apply_decisions(d, b, "conv_id").select("conv_id", "text")


@query(f"WITH {_BLOCKS} SELECT conv_id, block_id, 'overlap' AS failure FROM blocks WHERE length(text) >= 10 AND turn = 0 AND conv_id % 7 = 0")
def decision_failures(spark, sf_dir):
    d, b = _decisions(spark, sf_dir)
    return V.judged(d, b, "conv_id").where("failure is not null").select("conv_id", "block_id", "failure")


@query(_CTES + "SELECT 'residual' AS check_name, CAST((SELECT count(*) FROM part) AS BIGINT) AS n_failed UNION ALL SELECT 'denylist', count(*) FROM redacted WHERE contains(redacted_text, '元整')")
def gate_checks(spark, sf_dir):
    c = G.checks(_redacted(spark, sf_dir), "line_id", LABOR, ["元整"])
    return c.where("not passed").groupBy(F.col("check").alias("check_name")).agg(F.count(F.lit(1)).alias("n_failed"))


@query(_CTES + "SELECT line_id, sha256(redacted_text) AS redacted_sha256, (SELECT count(*) FROM occ o WHERE o.line_id = r.line_id) AS n FROM redacted r")
def manifest(spark, sf_dir):
    m = G.manifest(_redacted(spark, sf_dir), "line_id")
    j = F.from_json("entry", "line_id string, occurrences long, redacted_sha256 string")
    return m.select("line_id", j["redacted_sha256"].alias("redacted_sha256"), j["occurrences"].alias("n"))


@query(_CTES + ", n AS (SELECT line_id, entity_type, m, count(*) AS n, any_value(label) AS label FROM occ GROUP BY line_id, entity_type, m) SELECT line_id, entity_type, replace(m, '|', '\\|') AS original, label AS replacement, n AS n_occurrences FROM n")
def report_rows(spark, sf_dir):
    return G.report_rows(_redacted(spark, sf_dir), "line_id").drop("entity_id")


@query("SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 6 AND 10)) AS s_text FROM documents")
def manual_review(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gated = F.when(F.rlike("text", F.lit(r"[0-9]{6}|签|代表|委托|受托|甲方|乙方")), G.manual_review(F.col("text"))).otherwise(S.none())
    return d.select("doc_id", F.explode(gated).alias("s")).select("doc_id", F.col("s.text").alias("s_text"))


_GOLD = "SELECT o_orderkey AS ann_id, CASE o_orderkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'MONEY' END AS entity_type, 0 AS s, 5 AS e FROM orders"


@query(f"WITH g AS ({_GOLD}), c AS (SELECT entity_type, count(*) FILTER (ann_id % 5 > 1) AS tp, count(*) FILTER (ann_id % 5 = 1) AS fp, count(*) FILTER (ann_id % 5 <= 1) AS fn FROM g GROUP BY entity_type) SELECT entity_type, tp, fp, fn, fp AS boundary_errors, round(tp / (tp + fp), 4) AS \"precision\", round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM c")
def eval_prf(spark, sf_dir):
    g, p = _eval(spark, sf_dir)
    return E.matched(g, p)


def _eval(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "PERSON").when(F.col("o_orderkey") % 3 == 1, "ORG").otherwise("MONEY")
    g = o.select(F.col("o_orderkey").alias("ann_id"), kind.alias("entity_type"), F.lit(0).alias("start"), F.lit(5).alias("end"))
    return g, g.where("ann_id % 5 > 0").withColumn("end", F.when(F.col("ann_id") % 5 == 1, 4).otherwise(5))


@query("SELECT 'ORG' AS entity_type, CAST(sum(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END) AS BIGINT) AS boundary_errors, count(*) FILTER (o_orderkey % 4 = 3) AS tp FROM orders")
def eval_boundaries(spark, sf_dir):
    """By key: one gold span and two predictions; two and one; two and two; an equal pair beside an overlapping one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ann_id"), F.lit("ORG").alias("entity_type"))
    pair = lambda *xs: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in xs))
    k = F.col("ann_id") % 4
    g = F.when(k == 0, pair((0, 10))).when(k == 1, pair((0, 4), (6, 10))).when(k == 2, pair((0, 4), (4, 10))).otherwise(pair((0, 5), (5, 9)))
    p = F.when(k == 0, pair((1, 5), (5, 9))).when(k == 1, pair((2, 8))).when(k == 2, pair((1, 5), (3, 6))).otherwise(pair((0, 5), (4, 8)))
    long = lambda x: o.select("ann_id", "entity_type", F.explode(x).alias("s")).select("ann_id", "entity_type", "s.*")
    return E.matched(long(g), long(p)).select("entity_type", "boundary_errors", "tp")


@query(f"WITH g AS ({_GOLD}), c AS (SELECT entity_type, round(count(*) FILTER (ann_id % 5 > 1) / count(*), 4) AS r FROM g GROUP BY entity_type) SELECT min(r) AS worst_recall, min(r) >= 0.9 AS passed FROM c")
def recall_gate(spark, sf_dir):
    return E.recall_gate(E.matched(*_eval(spark, sf_dir)))


@query(_CTES + "SELECT l.line_id, array_to_string(list_transform(range(length(text)), lambda i: CASE WHEN i = s THEN 'B-PHONE' WHEN i > s AND i < e THEN 'I-PHONE' ELSE 'O' END), ' ') AS tags FROM lines l JOIN hits h ON h.line_id = l.line_id AND h.rule_id = 'phone_cn'")
def bio_tags(spark, sf_dir):
    phone = [r for r in RULES if r.rule_id == "phone_cn"]
    d = D.with_rule_spans(case_lines(spark, sf_dir), phone).where(F.size("spans") > 0)
    return d.select("line_id", F.array_join(E.bio(F.col("text"), F.col("spans")), " ").alias("tags"))


@query(_CTES + "SELECT l.line_id, CAST(s AS BIGINT) AS s_start, CAST(e AS BIGINT) AS s_end FROM lines l JOIN hits h ON h.line_id = l.line_id AND h.rule_id = 'phone_cn'")
def bio_decode(spark, sf_dir):
    phone = [r for r in RULES if r.rule_id == "phone_cn"]
    d = D.with_rule_spans(case_lines(spark, sf_dir), phone).where(F.size("spans") > 0)
    back = d.select("line_id", F.explode(N.decoded(E.bio(F.col("text"), F.col("spans"), "BIOES"))).alias("s"))
    return back.select("line_id", F.col("s.start").cast("long").alias("s_start"), F.col("s.end").cast("long").alias("s_end"))


@query("SELECT p_partkey AS k, round(CAST(10 + p_size * 2 * 1 / 5.0 AS DOUBLE), 4) AS x_left, round(CAST(10 + p_size * 2 * 3 / 5.0 AS DOUBLE), 4) AS x_right, CAST(20 AS DOUBLE) AS y_top, CAST(20 + p_size AS DOUBLE) AS y_bottom FROM part")
def ocr_line_polygons(spark, sf_dir):
    b = O.bounds(O.polygon(_box(), F.lit(5), F.lit(1), F.lit(3)))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("b", b)
    return p.select(F.col("p_partkey").alias("k"), F.round("b.left", 4).alias("x_left"), F.round("b.right", 4).alias("x_right"), F.col("b.top").alias("y_top"), F.col("b.bottom").alias("y_bottom"))


def _box():
    w, h = F.col("p_size") * 2.0 + 10, F.col("p_size") + 20.0
    return F.array(F.array(F.lit(10.0), F.lit(20.0)), F.array(w, F.lit(20.0)), F.array(w, h), F.array(F.lit(10.0), h))


@query("SELECT p_partkey AS k, round(10 / 500.0, 6) AS x, round(20 / 400.0, 6) AS y, round(p_size * 2 / 500.0, 6) AS width, round(p_size / 400.0, 6) AS height, 10 + p_size * 2 >= 40 AS meets FROM part")
def normalised_boxes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("b", O.bounds(_box()))
    other = F.struct(F.lit(40.0).alias("left"), F.lit(0.0).alias("top"), F.lit(60.0).alias("right"), F.lit(30.0).alias("bottom"))
    n = O.normalised(F.col("b"), F.lit(500.0), F.lit(400.0))
    return p.select(F.col("p_partkey").alias("k"), n["x"].alias("x"), n["y"].alias("y"), n["width"].alias("width"), n["height"].alias("height"), O.meet(F.col("b"), other).alias("meets"))


@query("SELECT p_partkey AS k, CAST(10 - greatest(3, p_size * 2 * 0.25) AS DOUBLE) AS x_left, CAST(10 + p_size * 2 + greatest(3, p_size * 2 * 0.25) AS DOUBLE) AS x_right, round(CAST(20 + p_size + greatest(2, p_size * 0.15) AS DOUBLE), 4) AS y_bottom, 10 - greatest(3, p_size * 2 * 0.25) <= 5 AS meets FROM part")
def retried_boxes(spark, sf_dir):
    b = O.widened(O.bounds(_box()))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("b", b)
    edge = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(5.0).alias("right"), F.lit(30.0).alias("bottom"))
    return p.select(F.col("p_partkey").alias("k"), F.col("b.left").alias("x_left"), F.col("b.right").alias("x_right"), F.round("b.bottom", 4).alias("y_bottom"), O.meet(F.col("b"), edge).alias("meets"))


_PARTS = "(SELECT o_orderkey AS k, unnest(range(1, 6)) AS i FROM orders)"


def _parts(spark, sf_dir):
    """Five numbered parts an order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))


@query(f"""WITH l AS (SELECT k, i, k * i % 13 + 1 AS n, coalesce(sum(k * i % 13 + 2) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {_PARTS})
SELECT k, i, CAST(greatest(0, 3 - o) AS BIGINT) AS line_from, CAST(least(n, 22 - o) AS BIGINT) AS line_to FROM l WHERE 3 < o + n AND o < 22""")
def ocr_span_lines(spark, sf_dir):
    lines = _parts(spark, sf_dir).select("k", "i", F.repeat(F.lit("x"), (F.col("k") * F.col("i") % 13 + 1).cast("int")).alias("text"))
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.lit(3).alias("start"), F.lit(22).alias("end"))
    out = O.span_lines(spans, O.line_offsets(lines, ["k"], "i"), ["k"])
    return out.select("k", *(F.col(c).cast("long").alias(c) for c in ("i", "line_from", "line_to")))


@query("""WITH c AS (SELECT p_partkey AS k, p_size * 4.0::DOUBLE AS w, p_size * 2.0::DOUBLE + p_partkey % 90 AS h, p_partkey % 3 AS m FROM part),
d AS (SELECT *, w * h * 0.7::DOUBLE AS area, 4 * pi() * (w * h * 0.7::DOUBLE) / ((2 * (w + h)) * (2 * (w + h))) AS circ FROM c),
e AS (SELECT *, CASE WHEN m = 1 THEN greatest(circ, 0.5) ELSE circ END AS conf FROM d)
SELECT k, round(w / 500, 6) AS width, round(h / 400, 6) AS height, round(area / 200000, 6) AS area_ratio, round(conf, 4) AS confidence
FROM e WHERE area / 200000 BETWEEN 0.0005 AND 0.2 AND least(w, h) / greatest(w, h) >= 0.3 AND conf >= 0.3""")
def seal_boxes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w, h = F.col("p_size") * 4.0, F.col("p_size") * 2.0 + F.col("p_partkey") % 90
    c = p.select(F.col("p_partkey").alias("k"), F.lit(10.0).alias("left"), F.lit(20.0).alias("top"), w.alias("box_width"), h.alias("box_height"))
    size = F.col("box_width") * F.col("box_height")
    c = c.withColumns({"area": size * 0.7, "perimeter": (F.col("box_width") + F.col("box_height")) * 2, "page_width": F.lit(500.0), "page_height": F.lit(400.0), "ellipse_area": F.when(F.col("k") % 3 == 1, size * 0.785).when(F.col("k") % 3 == 2, size * 2)})
    return O.seals(c).select("k", "width", "height", "area_ratio", "confidence")


@query("""WITH f AS (SELECT p_partkey % 200 AS k, p_size AS x FROM part), m AS (SELECT s_suppkey % 300 AS k, s_suppkey % 40 AS x FROM supplier)
SELECT f.k, CASE WHEN bool_or(coalesce(f.x + 2 >= m.x AND m.x + 5 >= f.x, false)) THEN 'pixel_undercoverage' ELSE 'unmapped_residual' END AS category FROM f LEFT JOIN m ON f.k = m.k GROUP BY f.k""")
def residual_categories(spark, sf_dir):
    def box(x, wide):
        return F.struct(x.cast("double").alias("left"), F.lit(0.0).alias("top"), (x + wide).cast("double").alias("right"), F.lit(9.0).alias("bottom")).alias("box")

    p, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "supplier"))
    found = p.select((F.col("p_partkey") % 200).alias("k"), box(F.col("p_size"), 2))
    return O.residual_classes(found, s.select((F.col("s_suppkey") % 300).alias("k"), box(F.col("s_suppkey") % 40, 5)), ["k"])


#: The rules as their file lists them; of one priority the first that is found names the line.
_LISTED = """('phone_cn', 1), ('landline_cn', 2), ('id_card_cn', 3), ('passport_cn', 4), ('email', 5), ('case_no', 6), ('case_no_contract', 7), ('execution_no', 8),
 ('org_code', 9), ('bank_card_cn', 11), ('bank_branch_cn', 12), ('money_cn', 13), ('plate_cn', 15), ('property_cert', 16), ('api_token', 17)"""


@query(_CTES + f", listed(rule_id, place) AS (VALUES {_LISTED}) SELECT line_id, first(entity_type ORDER BY priority DESC, place) AS line_type FROM hits JOIN listed USING (rule_id) GROUP BY line_id")
def line_types(spark, sf_dir):
    return case_lines(spark, sf_dir).select("line_id", D.line_type(F.col("text")).alias("line_type")).where("line_type IS NOT NULL")


@query("SELECT k, CAST(s AS BIGINT) AS w_start, CAST(least(s + 510, n) AS BIGINT) AS w_end FROM (SELECT o_orderkey AS k, o_orderkey % 2000 + 1 AS n, unnest(range(0, greatest(o_orderkey % 2000 - 63, 1), 446)) AS s FROM orders)")
def token_windows(spark, sf_dir):
    w = N.windows((F.col("o_orderkey") % 2000 + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.explode(w).alias("w"))
    return o.select("k", F.col("w.start").cast("long").alias("w_start"), F.col("w.end").cast("long").alias("w_end"))


@query(f"SELECT k, k * i % 3 AS s, k * i % 3 + 1 AS e, arg_min('T' || CAST(i AS string), i) AS tag FROM {_PARTS} GROUP BY 1, 2, 3")
def window_tags(spark, sf_dir):
    at = F.col("k") * F.col("i") % 3
    tokens = _parts(spark, sf_dir).select("k", at.alias("start"), (at + 1).alias("end"), F.col("i").alias("window"), F.concat(F.lit("T"), F.col("i").cast("string")).alias("tag"))
    return N.merged_windows(tokens, ["k"]).select("k", F.col("start").alias("s"), F.col("end").alias("e"), "tag")


@query(f"""WITH b AS (SELECT k, i, 17 * (k * i % 13 + 1) / sum(k * i % 13 + 1) OVER (PARTITION BY k) AS x FROM {_PARTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x - floor(x) DESC, i) AS rk, 17 - sum(floor(x)) OVER (PARTITION BY k) AS rest FROM b)
SELECT k, i, CAST(floor(x) + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def run_shares(spark, sf_dir):
    parts = _parts(spark, sf_dir).select("k", "i", (F.col("k") * F.col("i") % 13 + 1).alias("n"), F.lit(17).alias("total"))
    return O.largest_remainder(parts, ["k"], "n", "total", "i").select("k", F.col("i").cast("long").alias("i"), F.col("share").cast("long").alias("share"))


@query("""SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 5 = 1 THEN 'text_mismatch' END, CASE WHEN o_orderkey % 7 = 1 THEN 'not_annotated_type' END, CASE WHEN o_orderkey % 3 = 1 THEN 'tag_count' END) AS errors,
concat_ws(',', CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 = 1 THEN 'tag_mismatch' END, CASE WHEN o_orderkey % 2 = 1 THEN 'overlap' END) AS warnings FROM orders""")
def annotation_checks(spark, sf_dir):
    k = F.col("o_orderkey")

    def span(kind, a, b, shown):
        return F.struct(kind.alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end"), shown.alias("text"))

    text = F.lit("abcdefgh")
    first = span(F.when(k % 7 == 1, "PHONE").otherwise("ORG"), 0, 3, F.when(k % 5 == 1, "xyz").otherwise("abc"))
    second = F.when(k % 2 == 1, span(F.lit("PERSON"), 2, 5, F.lit("cde"))).otherwise(span(F.lit("PERSON"), 4, 6, F.lit("ef")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), k, text.alias("text"), F.array(first, second).alias("spans"))
    tags = E.bio(F.col("text"), F.col("spans"))
    tags = F.when(k % 4 == 1, F.concat(F.array(F.lit("O")), F.slice(tags, 2, 7))).otherwise(tags)
    tags = F.when(k % 3 == 1, F.slice(tags, 1, 7)).otherwise(tags)
    o = o.select("k", E.checked(F.col("text"), F.col("spans"), tags).alias("c"))
    return o.select("k", F.array_join("c.errors", ",").alias("errors"), F.array_join("c.warnings", ",").alias("warnings"))


@query(f"WITH g AS ({_GOLD}), c AS (SELECT entity_type, round(count(*) FILTER (ann_id % 5 > 1) / count(*), 4) AS r FROM g GROUP BY entity_type) SELECT max(1.0::DOUBLE - r) AS worst_drop, max(1.0::DOUBLE - r) <= 0.03 AS passed FROM c")
def recall_drop_gate(spark, sf_dir):
    g, p = _eval(spark, sf_dir)
    return E.drop_gate(E.matched(g, g), E.matched(g, p))


@query("SELECT p_partkey AS k, p_size / 50 AS confidence, p_name[1:50] AS text_preview FROM part WHERE p_size / 50 < 0.7")
def low_confidence_lines(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 50).alias("confidence"), F.col("p_name").alias("text"))
    return O.low_confidence(p).select("k", "confidence", "text_preview")


# ---- other tables ------------------------------------------------------------------------------


@query()
def documents_redact(spark, sf_dir):
    """Whole documents with something redacted: counts and digests."""
    r = R.digests(R.redact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), wanted=("redacted_text", "occurrences")))
    return r.where(F.size("occurrences") > 0).select("doc_id", F.size("occurrences").cast("long").alias("n"), "redacted_sha256")


_RUN = "SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '{0}'), lambda x: regexp_full_match(x, '{1}'))) AS m, '{2}' AS entity_type FROM documents"


@query(
    "SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ("
    + _RUN.format("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", ".*", "EMAIL") + " UNION ALL "
    + _RUN.format("[0-9]+", "6[0-9]{15,18}|4[0-9]{12,15}|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}", "BANK_CARD") + ") GROUP BY entity_type"
)
def documents_by_type(spark, sf_dir):
    few = [r for r in RULES if r.rule_id in ("email", "bank_card_cn")]
    d = D.with_rule_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), few)
    s = d.select("doc_id", F.explode("spans").alias("s"))
    return s.groupBy(F.col("s.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query()
def pages_redact(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text"))
    r = R.digests(R.redact(p, wanted=("redacted_text", "occurrences")))
    return r.where(F.size("occurrences") > 0).select("page_id", F.size("occurrences").cast("long").alias("n"), "redacted_sha256")


@query("SELECT conv_id, turn, sha256(text) AS redacted_sha256 FROM conversations")
def conversations_redact(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return R.digests(R.redact(c, wanted=("redacted_text",))).select("conv_id", "turn", "redacted_sha256")
