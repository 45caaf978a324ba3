"""Operators on spans of recognition models: they take the spans as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S

# Model types and ours, surnames, endings, context words, prefixes.
TYPES = {
    "PER": "PERSON", "LOC": "LOC", "LOCATION": "LOC", "name": "PERSON", "company": "ORG", "government": "ORG", "organization": "ORG",
    "address": "LOC", "scene": "LOC", "book": "NER_MISC", "game": "NER_MISC", "movie": "NER_MISC", "position": "NER_MISC",
}
SURNAMES = "欧阳 司马 上官 诸葛 公孙 皇甫 令狐 慕容 宇文 东方 西门 南宫 独孤 长孙 百里 鲜于 轩辕 端木".split()
ADDRESS_WORDS = "路 街 道 巷 弄 号 楼 层 室 栋 座 区 村 镇 乡 县 市 省 旗 苑 花园 新村 小区 大厦 广场 公寓 别墅 号楼 单元 号院 院 胡同".split()
ORG_ENDINGS = (
    "公司 有限公司 有限责任公司 股份有限公司 股份公司 集团 集团公司 律师事务所 法律服务所 法律援助中心 事务所 银行 支行 分行 信用社 法院 中级人民法院 基层人民法院 "
    "最高人民法院 检察院 人民检察院 仲裁委 仲裁委员会 中心 研究院 研究所 研究中心 大学 学院 学校 医院 人民医院 管委会 管理委员会 协会 学会 商会 基金会 局 厅"
).split()
ORG_CONTEXT = (
    "被申请人 申请人 用人单位 用工单位 开户行 开户银行 收款行 住所地 注册地 经营地 所在地 法定代表人 负责人 代表人 甲方 乙方 丙方 原告 被告 上诉人 被上诉人 委托人 受托人 "
    "发包人 承包人 分包人 买方 卖方 借款人 贷款人 出租人 承租人 转让方 受让方 质押人 质权人 担保人 保证人 监护人 股东 董事 监事 公司 企业 机构"
).split()
STEM_ENDINGS = (
    "有限责任公司 股份有限公司 有限公司 股份公司 律师事务所 法律服务所 法律援助中心 人民法院 中级人民法院 基层人民法院 人民检察院 集团 银行 信用社 研究院 研究所 研究中心 医院 学校 大学 学院"
).split()
STEM_PREFIXES = (
    "中国 中华 国家 全国 北京市 上海市 天津市 重庆市 广东省 深圳市 广州市 浙江省 杭州市 江苏省 南京市 四川省 成都市 湖北省 武汉市 湖南省 长沙市 山东省 济南市 河南省 郑州市 "
    "河北省 石家庄市 福建省 厦门市 安徽省 合肥市 江西省 南昌市 辽宁省 沈阳市 吉林省 长春市 黑龙江省 哈尔滨市 陕西省 西安市 甘肃省 兰州市 云南省 昆明市 贵州省 贵阳市 海南省 "
    "广西壮族自治区 内蒙古自治区 西藏自治区 新疆维吾尔自治区 宁夏回族自治区 青海省 北京 上海 天津 重庆 广东 深圳 广州 浙江 杭州 江苏 南京 四川 成都 湖北 武汉 湖南 长沙 山东 "
    "济南 河南 郑州 河北 石家庄 福建 厦门 安徽 合肥 江西 南昌 辽宁 沈阳 吉林 长春 黑龙江 哈尔滨 陕西 西安 甘肃 兰州 云南 昆明 贵州 贵阳 海南 广西 内蒙古 西藏 新疆 宁夏 青海"
).split()
COMMON_STEMS = "人民 中国 中华 国家 工商 建设 农业 发展".split()


def longest_first(words: list[str]) -> str:
    return "|".join(sorted(dict.fromkeys(words), key=len, reverse=True))


def remapped(spans: Column) -> Column:
    """Model types as ours; only spans that the model itself found."""
    return F.transform(spans, lambda s: S.changed(s, entity_type=F.when(s["engine"] == "ner", M.mapped(TYPES, s["entity_type"], s["entity_type"])).otherwise(s["entity_type"])))


def confident(spans: Column, confidence: Column, least: float = 0.5) -> Column:
    """confidence: an array beside spans; a null confidence keeps its span."""
    both = F.arrays_zip(spans.alias("s"), confidence.alias("c"))
    return F.transform(F.filter(both, lambda x: F.coalesce(x["c"], F.lit(1.0)) >= least), lambda x: x["s"]).cast(S.SPANS)


def surnames_joined(text: Column, spans: Column) -> Column:
    """Adjacent person spans (a blank may part them) that begin with a double surname become one.

    A pair is used up by its join; every span may join the one after it once.
    """
    kind = f"struct<out:{S.SPANS},open:boolean>"
    empty = F.struct(F.array().alias("out"), F.lit(False).alias("open")).cast(kind)
    person = lambda s: s["entity_type"].isin("PER", "PERSON", "name")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        n = F.size(acc["out"])
        gap = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        joined = F.concat(last["text"], s["text"])
        fits = acc["open"] & person(last) & person(s) & (s["start"] >= last["end"]) & (F.trim(gap) == "") & F.rlike(joined, F.lit("^(" + "|".join(SURNAMES) + ")"))
        one = S.changed(last, end=s["end"], text=F.substring(text, last["start"] + 1, s["end"] - last["start"]))
        merged = F.concat(F.slice(acc["out"], 1, n - 1), F.array(one))
        more = F.concat(acc["out"], F.array(s))
        yes = F.struct(merged.alias("out"), F.lit(False).alias("open")).cast(kind)
        no = F.struct(more.alias("out"), F.lit(True).alias("open")).cast(kind)
        return F.when((n > 0) & fits, yes).otherwise(no)

    return F.aggregate(S.by_start(spans), empty, step, lambda a: a["out"])


def expanded(text: Column, spans: Column) -> Column:
    """Further mentions of the spans' texts, where no span contains them."""
    kinds = F.array_distinct(F.transform(spans, lambda s: F.struct(s["entity_type"].alias("t"), s["text"].alias("x"))))

    def mentions(k: Column) -> Column:
        return F.transform(
            S.located(text, F.array(k["x"])),
            lambda m: F.struct(
                k["t"].alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"),
                F.lit("ner_expanded").alias("engine"), F.lit(None).cast("string").alias("rule_id"), F.lit(45).alias("priority"), F.lit(0).alias("ord"),
            ),
        ).cast(S.SPANS)

    kind = S.SPANS
    new = F.flatten(F.transform(kinds, mentions))
    covered = lambda s, m: (s["start"] <= m["start"]) & (s["end"] >= m["end"])
    both = F.aggregate(new, spans.cast(kind), lambda acc, m: F.when(F.exists(acc, lambda s: covered(s, m)), acc).otherwise(F.concat(acc, F.array(m))).cast(kind))
    return S.by_start(both)


def addresses(text: Column, spans: Column) -> Column:
    """LOC spans with nothing or one address word between them become one ADDRESS.

    The address takes one address word that follows it. Islands are built from
    the LOC spans alone, by start; all other LOC spans turn into ADDRESS too.
    """
    words = "|".join(ADDRESS_WORDS)
    kind = "array<struct<first:int,last:int>>"
    ordered = S.by_start(spans)
    locs = F.filter(ordered, lambda s: s["entity_type"] == "LOC")
    # an island: the places of its first and last LOC
    places = F.sequence(F.lit(0), F.size(locs) - 1)

    def step(acc: Column, i: Column) -> Column:
        isle = F.element_at(acc, -1)
        a, b = F.get(locs, i - 1), F.get(locs, i)
        gap = F.trim(F.substring(text, a["end"] + 1, F.greatest(F.lit(0), b["start"] - a["end"])))
        together = (F.size(acc) > 0) & F.rlike(gap, F.lit(f"^({words})?$"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(isle["first"].alias("first"), i.alias("last"))))
        return F.when(together, grown).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last"))))).cast(kind)

    isles = F.when(F.size(locs) > 0, F.aggregate(places, F.array().cast(kind), step)).otherwise(F.array().cast(kind))

    def as_address(isle: Column) -> Column:
        a, b = F.get(locs, isle["first"]), F.get(locs, isle["last"])
        tail = F.length(F.regexp_extract(F.substring(text, b["end"] + 1, F.lit(10)), f"^({words})", 0))
        end = F.when(isle["first"] < isle["last"], b["end"] + tail).otherwise(b["end"])
        return S.changed(a, entity_type=F.lit("ADDRESS"), end=end, text=F.substring(text, a["start"] + 1, end - a["start"]))

    rest = F.filter(ordered, lambda s: s["entity_type"] != "LOC")
    return S.by_start(F.concat(rest, F.transform(isles, as_address)).cast(S.SPANS))


def org_reason(text: Column, span: Column, allow: Column, deny: Column) -> Column:
    """denylist, allowlist, suffix, context or no_match; allow and deny: lower-cased arrays."""
    name = F.trim(span["text"])
    start = F.greatest(F.lit(0), span["start"] - 20)
    around = F.substring(text, start + 1, span["end"] + 20 - start)
    return (
        F.when(F.array_contains(deny, F.lower(name)), "denylist")
        .when(F.array_contains(allow, F.lower(name)), "allowlist")
        .when(F.rlike(name, F.lit(f"({longest_first(ORG_ENDINGS)})$")), "suffix")
        .when(F.rlike(around, F.lit("|".join(ORG_CONTEXT))), "context")
        .otherwise("no_match")
    )


def org_gate(text: Column, spans: Column, allow: Column, deny: Column) -> Column:
    """struct(passed, filtered): organisations need an ending, a context word or the denylist."""
    judged = F.transform(spans, lambda s: F.struct(s.alias("s"), F.when(s["entity_type"] == "ORG", org_reason(text, s, allow, deny)).otherwise("other").alias("why")))
    bad = lambda x: x["why"].isin("allowlist", "no_match")
    passed = F.transform(F.filter(judged, lambda x: ~bad(x)), lambda x: x["s"]).cast(S.SPANS)
    return F.struct(passed.alias("passed"), F.filter(judged, bad).alias("filtered"))


def allowlisted_addresses(spans: Column, allow: Column) -> Column:
    """Drops addresses that are on the list, compared as they are."""
    return F.filter(spans, lambda s: ~((s["entity_type"] == "ADDRESS") & F.array_contains(allow, F.lower(s["text"]))))


def stem(name: Column) -> Column:
    """An organisation's distinctive part; null if too short or too common."""
    x = F.regexp_replace(name, f"^({longest_first(STEM_PREFIXES)})", "")
    x = F.trim(F.regexp_replace(x, f"({longest_first(STEM_ENDINGS)})$", ""))
    return F.when((F.length(x) >= 2) & ~x.isin(COMMON_STEMS), x)


def abbreviations(name: Column) -> Column:
    """Short forms of an organisation's name that a document may use."""
    x = stem(name)
    forms = F.array(
        F.concat(x, F.lit("公司")),
        F.when(F.rlike(name, F.lit("律|事务所")), F.concat(x, F.lit("所"))),
        F.when(F.contains(name, F.lit("法院")), F.concat(x, F.lit("法院"))),
    )
    return F.filter(forms, lambda f: f.isNotNull() & (f != name) & (F.length(f) >= 4))


def abbreviation_spans(text: Column, spans: Column) -> Column:
    """Places of the text's own organisations' short forms that meet no span."""
    names = F.array_distinct(F.transform(F.filter(spans, lambda s: s["entity_type"] == "ORG"), lambda s: s["text"]))
    forms = F.array_distinct(F.flatten(F.transform(names, abbreviations)))
    found = S.as_spans(S.located(text, forms), "ORG", "ner", "org_abbrev", 60)
    return S.apart_from(found, spans)


def decoded(labels: Column) -> Column:
    """BIO or BIOES labels as array<struct(entity_type, start, end)>, end exclusive.

    An I or E that continues nothing starts a span; B always does; E and S end one.
    """
    item = "struct<entity_type:string,start:int,end:int>"
    kind = f"struct<out:array<{item}>,t:string,s:int,i:int>"
    empty = F.struct(F.array().alias("out"), F.lit(None).alias("t"), F.lit(None).alias("s"), F.lit(0).alias("i")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        tag = F.when(F.contains(x, F.lit("-")), F.substring_index(x, "-", 1)).otherwise("O")
        kind_ = F.substring(x, F.length(tag) + 2, F.length(x))
        i = acc["i"]
        goes_on = tag.isin("I", "E") & acc["t"].eqNullSafe(kind_)
        closed = F.when(acc["t"].isNotNull() & ~goes_on, F.concat(acc["out"], F.array(F.struct(acc["t"].alias("entity_type"), acc["s"].alias("start"), i.alias("end")).cast(item)))).otherwise(acc["out"])
        inside = tag.isin("B", "I", "E", "S")
        start = F.when(goes_on, acc["s"]).otherwise(i)
        ends = tag.isin("E", "S")
        done = F.when(inside & ends, F.concat(closed, F.array(F.struct(kind_.alias("entity_type"), start.alias("start"), (i + 1).alias("end")).cast(item)))).otherwise(closed)
        goes = inside & ~ends
        return F.struct(done.alias("out"), F.when(goes, kind_).alias("t"), F.when(goes, start).alias("s"), (i + 1).alias("i")).cast(kind)

    def finish(acc: Column) -> Column:
        return F.when(acc["t"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["t"].alias("entity_type"), acc["s"].alias("start"), acc["i"].alias("end")).cast(item)))).otherwise(acc["out"])

    return F.aggregate(labels, empty, step, finish)


def windows(n_tokens: Column, size: int = 510, overlap: int = 64) -> Column:
    """array<struct(start, end)> of token windows; the first window owns a shared token."""
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n_tokens).alias("end")))


def merged_windows(tokens: DataFrame, key: list[str], window: str = "window", tag: str = "tag") -> DataFrame:
    """One row an offset: the tag that the first window holding it gave."""
    return tokens.groupBy(*key, "start", "end").agg(F.min_by(tag, window).alias(tag))
