"""The publication gate, reports, manifests and manual-review findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S
from ..rules import LABOR, Policy
from . import redact as R
from .review import terms_present

# Numbered labels of old outputs, labels of preserved types, surnames of signers.
OLD_LABEL = r"(?:人物|机构|地点|手机号|身份证|邮箱|案号|银行卡|金额|日期|电话)\d+"
PRESERVED = {"TIME": "【时间】", "MONEY": "【金额】"}
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐"
    "费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
)


def checks(redacted: DataFrame, doc: str, policy: Policy = LABOR, denylist: list[str] | None = None, status: str | None = None) -> DataFrame:
    """A row a document and check: passed, reason. Failed documents have one row."""
    every = tests(policy, denylist)
    r = S.pinned(R.residual(redacted, policy), _failed=F.struct(*(failed.alias(n) for n, failed, _ in every)))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), (~F.col(f"_failed.{n}")).alias("passed"), F.when(~F.col(f"_failed.{n}"), "").otherwise(F.array_join(found, ",")).alias("reason")) for n, _, found in every))
    if status:
        failed = F.array(F.struct(F.lit("processing").alias("check"), F.lit(False).alias("passed"), F.col(status).alias("reason")))
        rows = F.when(F.col(status) != "ok", failed).otherwise(rows)
    return r.select(doc, F.explode(rows).alias("c")).select(doc, "c.*")


def tests(policy: Policy, denylist: list[str] | None) -> list[tuple[str, Column, Column]]:
    """Checks of a redacted text and its residual findings: name, whether it fails, what was found.

    Whether it fails costs little; what was found is asked of failed ones only.
    """
    kept = [t for t in PRESERVED if not policy.redacts(t)]
    text = F.col("redacted_text")
    olds = F.lit("(?U)" + OLD_LABEL)
    wrong = F.array_intersect(F.col("occurrences.entity_type"), F.array(*map(F.lit, kept))) if kept else F.array().cast("array<string>")
    shows = [(F.coalesce(F.contains(text, F.lit(PRESERVED[t])), F.lit(False)), F.lit(PRESERVED[t])) for t in kept]
    left = terms_present(text, denylist or [])
    return [
        ("residual", F.size("findings") > 0, F.transform("findings", lambda s: F.substring(s["text"], 1, 20))),
        ("old_label", F.rlike(text, olds), F.slice(F.regexp_extract_all(text, olds, F.lit(0)), 1, 5)),
        ("preserved_type", F.size(wrong) > 0, wrong),
        ("preserved_label", reduce(Column.__or__, (x for x, _ in shows), F.lit(False)), F.array_compact(F.array(*(F.when(x, label) for x, label in shows))).cast("array<string>")),
        ("denylist", F.size(left) > 0, left),
    ]


def gate(rows: DataFrame) -> DataFrame:
    """One row: passed, and the number of failures."""
    return rows.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("n_failures"))


def report_rows(redacted: DataFrame, doc: str) -> DataFrame:
    """Replacement table: a row a document and entity, cells made safe for Markdown."""
    e = R.entities(R.occurrences(redacted, doc), doc)
    return e.select(doc, "entity_id", "entity_type", M.cell(F.col("original")).alias("original"), M.cell(F.col("replacement")).alias("replacement"), "n_occurrences")


def manifest(redacted: DataFrame, doc: str) -> DataFrame:
    """A row a document as JSON, without any original text."""
    counts = redacted.select(doc, F.size("occurrences").alias("occurrences"), F.sha2("redacted_text", 256).alias("redacted_sha256"))
    return counts.select(doc, F.to_json(F.struct(doc, "occurrences", "redacted_sha256")).alias("entry"))


def map_json(redacted: DataFrame, doc: str, policy: Policy = LABOR) -> DataFrame:
    """The position map of each document as JSON; it holds the originals, keep it apart."""
    body = F.struct(F.lit("1.0").alias("schema_version"), F.lit(policy.name).alias("profile"), F.sha2("text", 256).alias("source_sha256"), F.sha2("redacted_text", 256).alias("redacted_sha256"), "occurrences")
    return redacted.select(doc, F.to_json(body).alias("map"))


def numbered_documents(paths: DataFrame, path: str = "path") -> DataFrame:
    """doc_01, doc_02, … by full path."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(path))
    return paths.withColumn("doc_id", F.format_string("doc_%02d", n))


def manual_review(text: Column) -> Column:
    """Short digit runs, and lone surnames after a signing cue: array of spans."""
    digits = S.as_spans(S.found(text, r"(?<!\d)\d{6,10}(?!\d)"), "SHORT_DIGITS", "review", "manual_review_suspicious_short_digits", 0)
    cue = rf"(?:签名|签字|授权代表|法定代表人|代表人|委托人|受托人|甲方|乙方)[\s:：]*[{SURNAMES}](?=$|[\s，。；;、])"
    signers = S.as_spans(S.found(text, cue), "SIGNER", "review", "manual_review_single_char_signer", 0)
    last = F.transform(signers, lambda s: S.changed(s, start=s["end"] - 1, text=F.right(s["text"], F.lit(1))))
    return F.concat(digits, last)
