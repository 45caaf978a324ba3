"""Partial masks and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _left(x: Column, n) -> Column:
    return F.substring(x, 1, n) if isinstance(n, int) else F.substring(x, F.lit(1), n)


def _right(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def _stars(n: Column, least: int = 1) -> Column:
    return F.repeat(F.lit("*"), F.greatest(F.lit(least), n))


def _phone(x: Column, full: int) -> Column:
    return F.when(F.length(x) >= full, F.concat(_left(x, 3), F.lit("****"), _right(x, 4))).otherwise(F.concat(_left(x, 1), F.lit("***")))


def _identity(x: Column) -> Column:
    n = F.length(x)
    return F.when(n >= 15, F.concat(_left(x, 4), _stars(n - 8, 0), _right(x, 4))).otherwise(F.concat(_left(x, 3), _stars(n - 6), _right(x, 3)))


def _person(x: Column) -> Column:
    return F.concat(_left(x, 1), _stars(F.length(x) - 1))


def _organisation(x: Column) -> Column:
    n = F.length(x)
    return F.when(n > 4, F.concat(_left(x, 2), _stars(n - 4, 2), _right(x, 2))).otherwise(_person(x))


def _email(x: Column, most: int | None) -> Column:
    at = F.locate("@", x)
    keep = at - 1 if most is None else F.least(F.lit(most), at - 1)
    return F.when(at > 0, F.concat(_left(x, keep), F.lit("***"), F.substring(x, at, F.length(x)))).otherwise(F.concat(_left(x, 2), F.lit("***")))


def _card(x: Column) -> Column:
    n = F.length(x)
    return F.when(n >= 8, F.concat(_stars(n - 4, 0), _right(x, 4))).otherwise(F.concat(_stars(n - 2), _right(x, 2)))


def _money(x: Column) -> Column:
    return F.concat(F.lit("****"), _right(x, 1))


def _time(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)[^年月日号时分秒]", "*")


def _other(x: Column) -> Column:
    return F.concat(_left(x, 1), F.lit("***"))


def star(x: Column, entity_type: Column) -> Column:
    """Star mask by type; an empty text stays empty."""
    t = entity_type
    return (
        F.when(x == "", "")
        .when(t.isin("PHONE", "LANDLINE"), _phone(x, 11))
        .when(t.isin("ID_CARD", "PASSPORT", "ORG_CODE"), _identity(x))
        .when(t == "PERSON", _person(x))
        .when(t.isin("ORG", "BANK_BRANCH"), _organisation(x))
        .when(t == "EMAIL", _email(x, 2))
        .when(t == "BANK_CARD", _card(x))
        .when(t == "MONEY", _money(x))
        .when(t.isin("DATE", "TIME"), _time(x))
        .otherwise(_other(x))
    )


def decision_mask(x: Column, entity_type: Column) -> Column:
    """The reviewers' mask: landlines in full from 8, local parts whole, fewer types known."""
    t = entity_type
    return (
        F.when(x == "", "")
        .when(t == "PHONE", _phone(x, 11))
        .when(t == "LANDLINE", _phone(x, 8))
        .when(t == "ID_CARD", _identity(x))
        .when(t == "PERSON", _person(x))
        .when(t == "ORG", _organisation(x))
        .when(t == "EMAIL", _email(x, None))
        .when(t == "BANK_CARD", _card(x))
        .when(t == "MONEY", _money(x))
        .when(t.isin("DATE", "TIME"), _time(x))
        .otherwise(_other(x))
    )


# Names in numbered placeholders.
PLACEHOLDERS = {
    "PERSON": "姓名", "ORG": "单位", "PHONE": "手机", "LANDLINE": "电话", "ID_CARD": "证件号", "PASSPORT": "护照", "EMAIL": "邮箱", "CASE_NO": "案号",
    "ORG_CODE": "信用代码", "BANK_CARD": "银行卡", "BANK_BRANCH": "银行网点", "MONEY": "金额", "DATE": "日期", "TIME": "时间", "LOC": "地点",
    "ADDRESS": "地址", "API_TOKEN": "密钥", "SEAL": "公章", "MANUAL": "敏感信息",
}


def mapped(values: dict[str, str], key: Column, default: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(table[key], default)


def placeholder(entity_type: Column, number: Column) -> Column:
    return F.concat(F.lit("<"), mapped(PLACEHOLDERS, entity_type, F.lit("敏感信息")), number.cast("string"), F.lit(">"))


def cell(x: Column) -> Column:
    """A text as a Markdown table cell."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " ")
    return F.trim(F.replace(x, F.lit("|"), F.lit("\\|")))
