"""The catalog: detection rules, label policies and term lists, as plan-time data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Rule:
    """pattern: Python/Java syntax. needs: a cheap test that any matching text passes."""

    rule_id: str
    entity_type: str
    label_prefix: str
    pattern: str
    priority: int = 100
    needs: tuple[str, str] | None = None
    enabled: bool = True


# Identifiers, types, labels, patterns, priorities; their order decides the type of a line.
RULES = [
    Rule("phone_cn", "PHONE", "手机号", r"(?<!\d)1[3-9]\d{9}(?!\d)", needs=("like", r"\p{Nd}{9}")),
    Rule("landline_cn", "LANDLINE", "电话", r"(?<!\d)(?:0\d{2,3}[-－—]?\d{7,8})(?:[-－—]?\d{1,6})?(?!\d)", needs=("like", r"\p{Nd}{7}")),
    Rule("id_card_cn", "ID_CARD", "身份证", r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", needs=("like", r"\p{Nd}{17}")),
    Rule("passport_cn", "PASSPORT", "护照", r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[EeGgSsDdMmHhPp]\d{8}(?![A-Za-z0-9])", needs=("like", r"\p{Nd}{8}")),
    Rule("email", "EMAIL", "邮箱", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 90, ("any", "@")),
    Rule("case_no", "CASE_NO", "案号", r"\(\d{4}\)[一-鿿\d]+号", needs=("any", "号")),
    Rule(
        "case_no_contract", "CASE_NO", "案号",
        r"(?:(?:合同编号|案号)\s*)?(?:[\[【（(]\s*[0-9０-９oO]{2,4}\s*[\]】）)]?\s*[一-鿿A-Za-z0-9０-９oO」\-－—（）()\[\]【】]{2,30}号"
        r"|(?<![A-Za-z0-9])(?=[0-9A-Za-z]{2,8}[-－—][0-9A-Za-z]{2,12}(?![A-Za-z0-9]))(?=[0-9A-Za-z\-－—]*[A-Za-z])[0-9A-Za-z]{2,8}[-－—][0-9A-Za-z]{2,12}(?![A-Za-z0-9]))",
        needs=("any", "号|-|－|—"),
    ),
    Rule("execution_no", "EXECUTION_NO", "执行依据", r"(?:执|执行)(?:字|案件)?[\(（]?\d{4}[\)）]?[一-鿿]?\d+号?", needs=("any", "执")),
    Rule("org_code", "ORG_CODE", "统一社会信用代码", r"(?<!\d)[0-9A-HJ-NP-RTUW-Y]{2}\d{6}[0-9A-HJ-NP-RTUW-Y]{10}(?!\d)", needs=("like", r"\p{Nd}{6}")),
    Rule("bank_account_cn", "BANK_ACCOUNT", "银行账号", r"(?<!\d)\d{12,19}(?!\d)", 80, enabled=False),
    Rule("bank_card_cn", "BANK_CARD", "银行卡", r"(?<![0-9])(?:6[0-9]{15,18}|4[0-9]{12,15}|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11})(?![0-9])", 90, ("like", "[0-9]{13}")),
    Rule("bank_branch_cn", "BANK_BRANCH", "银行信息", r"(?:开户行\s*[:：]?\s*)?[一-鿿]{2,30}(?:银行|信用社)[一-鿿]{0,30}(?:支行|分行|营业部)", 80, ("any", "银行|信用社")),
    Rule(
        "money_cn", "MONEY", "金额",
        r"(?<![A-Za-z0-9])(?:(?:人民币\s*)?(?:[¥￥]\s*)?(?:[0-9０-９]+(?:[.,，][0-9０-９]+)?|[零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+)\s*(?:亿元|万元|元|圆|块)(?:整)?"
        r"|[¥￥]\s*[0-9０-９]+(?:[.,，][0-9０-９]+)?)(?![A-Za-z0-9])",
        needs=("any", "元|圆|块|¥|￥"),
    ),
    Rule("date_cn", "DATE", "日期", r"(?:[0-9]{4}年)?(?:[0-9]{1,2}月)(?:[0-9]{1,2}[日号])|(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", 50, enabled=False),
    Rule("plate_cn", "PLATE", "车牌", r"(?:[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤川青藏琼宁][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳])", needs=("like", "[京-鿿一-亿][A-Z]")),
    Rule("property_cert", "PROPERTY_CERT", "不动产权证", r"(?:[（(]?[一-鿿]{1,10}[)）]?\s*(?:不动产权?|房权证|土地证)\s*(?:第|字第)?\s*[A-Za-z0-9\-－—]+号)", needs=("any", "不动产|房权证|土地证")),
    Rule("api_token", "API_TOKEN", "密钥", r"(?<![A-Za-z0-9])(?:sk|ak|token|key|secret|password)[_\-]?[A-Za-z0-9]{20,}(?![A-Za-z0-9])", needs=("like", "[A-Za-z0-9]{20}")),
]

# Dates, and words near an account number.
TIME_PATTERN = (
    r"(?<![A-Za-z0-9])(?:(?:[0-3][0-9]{3})\s*(?:年\s*(?:0?[1-9]|1[0-2])\s*月(?:\s*(?:0?[1-9]|[12][0-9]|3[01])\s*[日号])?"
    r"|[./\-－—]\s*(?:0?[1-9]|1[0-2])(?:\s*[./\-－—]\s*(?:0?[1-9]|[12][0-9]|3[01]))?)"
    r"|(?:19|20)[0-9]{2}年(?!\s*[0-9]{1,2}\s*月)|(?:19|20)[0-9]{2}(?!\s*(?:年\s*[0-9]{1,2}\s*月|[./\-－—]))|(?:19|20)[0-9]{6})(?![A-Za-z0-9])"
)
BANK_CONTEXT = "账号|银行卡号|收款账户|开户行|银行|尾号|卡号|账户|汇款账号|收款账号"

# Labels of both policies; types without a label are preserved.
_COMMON = {
    "PERSON": "【姓名】", "ORG": "【机构】", "ADDRESS": "【地址】", "PHONE": "【手机号】", "LANDLINE": "【电话】", "ID_CARD": "【身份证号】",
    "EMAIL": "【邮箱】", "ORG_CODE": "【统一社会信用代码】", "BANK_ACCOUNT": "【银行账号】", "BANK_BRANCH": "【银行信息】", "CASE_NO": "【案号】",
    "EXECUTION_NO": "【执行依据】", "PASSPORT": "【护照】", "BANK_CARD": "【银行卡】", "PLATE": "【车牌】", "PROPERTY_CERT": "【不动产权证】", "API_TOKEN": "【密钥】",
}
_FALLBACK = {"PER": "人物", "PERSON": "人物", "LOC": "地点", "LOCATION": "地点", "ORG": "机构", "LANDLINE": "电话", "BANK_ACCOUNT": "银行账号", "BANK_BRANCH": "银行信息", "MONEY": "金额", "ADDRESS": "地址"}


@dataclass(frozen=True)
class Policy:
    """Which types are redacted, and as what. Types it doesn't know are redacted."""

    name: str
    labels: dict[str, str]
    preserved: frozenset[str]
    overrides: dict[str, bool] = field(default_factory=dict)

    def redacts(self, entity_type: str) -> bool:
        return self.overrides.get(entity_type, entity_type not in self.preserved)

    def with_overrides(self, preserve=(), force=()) -> Policy:
        """Preserving beats forcing, and both beat the policy."""
        return Policy(self.name, self.labels, self.preserved, {**dict.fromkeys(force, True), **dict.fromkeys(preserve, False)})

    def label(self, entity_type: str) -> str:
        return self.labels.get(entity_type) or f"【{label_prefix(entity_type)}】"


LABOR = Policy("labor", _COMMON, frozenset({"DATE", "NER_MISC", "TIME", "MONEY"}))
STRICT = Policy("strict", {**_COMMON, "DATE": "【日期】", "TIME": "【时间】", "MONEY": "【金额】"}, frozenset({"NER_MISC"}))
POLICIES = {p.name: p for p in (LABOR, STRICT)}


def label_prefix(entity_type: str, rules: list[Rule] | None = None) -> str:
    for r in rules or RULES:
        if r.entity_type == entity_type:
            return r.label_prefix
    return _FALLBACK.get(entity_type, entity_type)


def scan_order(rules: list[Rule] | None = None) -> list[Rule]:
    """Enabled rules, higher priority first, then by identifier: the order decides ties."""
    return sorted((r for r in (RULES if rules is None else rules) if r.enabled), key=lambda r: (-r.priority, r.rule_id))


def resolve_policy(profile: str | None = None, level: str | None = None) -> Policy:
    if profile:
        if profile not in POLICIES:
            raise FileNotFoundError(f"no policy named {profile}")
        return POLICIES[profile]
    return STRICT if level == "strict" else LABOR


def load_rules(path: str) -> list[Rule]:
    """Rules from a JSON list with id, entity_type, label_prefix, pattern, enabled, priority."""
    rows = json.loads(Path(path).read_text("utf-8"))
    return [Rule(r["id"], r["entity_type"], r["label_prefix"], r["pattern"], r.get("priority", 100), None, r.get("enabled", True)) for r in rows]


def load_policy(path: str) -> Policy:
    raw = json.loads(Path(path).read_text("utf-8"))
    types = raw["types"]
    labels = {k: v["label"] for k, v in types.items() if v.get("label")}
    return Policy(raw["name"], labels, frozenset(k for k, v in types.items() if v.get("action") == "preserve"))


def read_terms(path: str, lower: bool = True, missing_ok: bool = True) -> list[str]:
    """A term list: stripped lines, without blank ones and comments."""
    p = Path(path)
    if not p.exists() and missing_ok:
        return []
    lines = (x.strip() for x in p.read_text("utf-8").splitlines())
    return [x.lower() if lower else x for x in lines if x and not x.startswith("#")]
