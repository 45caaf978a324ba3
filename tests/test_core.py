import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from umbra.functions import masks as M
from umbra.functions import spans as S
from umbra.operators import detect as D
from umbra.operators import evaluate as E
from umbra.operators import gate as G
from umbra.operators import names as N
from umbra.operators import redact as R
from umbra.plans import cases  # noqa: F401
from umbra.plans import queries as Q
from umbra.rules import LABOR, RULES, STRICT, resolve_policy, scan_order
from umbra.sources import files as X

GOLDEN = [
    ("张三的手机号是13800138000，身份证号为110101199001011234。", "张三的手机号是【手机号】，身份证号为【身份证号】。", None),
    ("李四的邮箱是lisi@example.com，案号为(2024)京0101民初12345号。", "李四的邮箱是【邮箱】，案号为【案号】。", None),
    ("于2022年9月1日入职，月工资15000元。", "于2022年9月1日入职，月工资15000元。", "于【时间】入职，月工资【金额】。"),
    ("证据显示银行账号6222021234567890123收到转账￥50,000.00。", "证据显示银行账号【银行卡】收到转账￥50,000.00。", "证据显示银行账号【银行卡】收到转账【金额】.00。"),
    ("联系电话13800138000和0755-23982682均已记录。", "联系电话【手机号】和【电话】均已记录。", None),
    ("深劳人仲案【2026】8155号仲裁裁决书已送达。", "深劳人仲案【案号】仲裁裁决书已送达。", None),
    ("开户行平安银行深圳江苏大厦支行账户信息已确认。", "【银行信息】账户信息已确认。", None),
    ("收款账号11005545236302，联系电话15817465075。", "收款账号【银行账号】，联系电话【手机号】。", None),
    ("工号100234567890。", "工号100234567890。", None),
    ("日期2023元年工资15000元。", "日期2023元年工资15000元。", "日期【时间】元年工资【金额】。"),
    ("13800138000元", "13800138000元", "【金额】"),
    ("", "", None),
    (None, None, None),
]


@pytest.mark.parametrize("policy,column", [(LABOR, 1), (STRICT, 2)])
def test_golden_and_round_trip(spark, policy, column):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id long, text string")
    for r in R.restore(R.digests(R.redact(df, policy))).collect():
        g = GOLDEN[r.id]
        assert r.redacted_text == (g[column] if g[column] is not None else g[1])
        assert r.restored_text == r.text


def test_spans_equal_python_regexes(spark):
    texts = [g[0] or "" for g in GOLDEN] + ["😊13800138000😊 a@b.cn　￥ 5元", "（粤）不动产权第12号粤B12345学", "sk-" + "a" * 24]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for r in D.with_rule_spans(df).collect():
        want = [(x.rule_id, *m.span(), m[0]) for x in scan_order() for m in re.finditer(x.pattern, r.text)]
        assert [(s.rule_id, s.start, s.end, s.text) for s in r.spans] == want
        assert [s.ord for s in r.spans] == list(range(len(want)))


def test_resolution_order(spark):
    def span(start, end, priority=100, engine="regex", order=0):
        return ("T", start, end, "x" * (end - start), engine, None, priority, order)

    cases = [[span(0, 5), span(0, 10)], [span(0, 5, 90), span(0, 5, 100, order=1)], [span(0, 5, engine="ner"), span(0, 5, order=1)], [span(0, 4), span(3, 8, order=1), span(7, 9, order=2)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"id int, s {S.SPANS}")
    got = {r.id: r.r for r in df.select("id", S.resolved(F.col("s")).alias("r")).collect()}
    assert [(s.start, s.end) for s in got[0].kept] == [(0, 10)]
    assert got[1].kept[0].priority == 100 and got[2].kept[0].engine == "regex"
    assert [(s.start, s.end) for s in got[3].kept] == [(3, 8)] and len(got[3].dropped) == 2


def test_policy_precedence():
    p = LABOR.with_overrides(preserve=["EMAIL"], force=["EMAIL", "MONEY"])
    assert not p.redacts("EMAIL") and p.redacts("MONEY") and p.redacts("UNKNOWN") and not LABOR.redacts("TIME")
    assert resolve_policy(None, "strict") is STRICT and resolve_policy() is LABOR


def test_restore_detects_changes(spark):
    df = R.digests(R.redact(spark.createDataFrame([("电话13800138000",)], "text string")))
    assert R.restore(df.withColumn("redacted_text", F.lit("x"))).first().restore_status == "sha_mismatch"
    assert R.restore(df.withColumn("source_sha256", F.lit("x"))).first().restore_status == "source_mismatch"


def test_masks(spark):
    cases = {("13800138000", "PHONE"): "138****8000", ("110101199001011234", "ID_CARD"): "1101**********1234", ("张三", "PERSON"): "张*", ("test@example.com", "EMAIL"): "te***@example.com", ("15000元", "MONEY"): "****元", ("2026年6月20日", "DATE"): "****年*月**日", ("", "PHONE"): ""}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "x string, t string, want string")
    assert df.where(M.star(F.col("x"), F.col("t")) != F.col("want")).count() == 0
    assert df.limit(4).where("t = 'EMAIL'").select(M.decision_mask(F.col("x"), F.col("t"))).first()[0] == "test***@example.com"


def test_decode_bio(spark):
    df = spark.createDataFrame([(["B-A", "I-A", "O", "I-B", "B-B"],), (["S-A", "B-A", "I-A", "E-A", "E-B"],), ([],)], "l array<string>")
    got = [[tuple(s) for s in r[0]] for r in df.select(N.decoded(F.col("l"))).collect()]
    assert got == [[("A", 0, 2), ("B", 3, 4), ("B", 4, 5)], [("A", 0, 1), ("A", 1, 4), ("B", 4, 5)], []]


def test_csv_round_trip(spark):
    text = '姓名,备注\r\n"张,三","a ""b"""\r\n\r\n李四,\r\n'
    files = spark.createDataFrame([("a.csv", X.BOM + text.encode())], "path string, content binary")
    t = X.as_text(files)
    back = X.csv_text(X.csv_cells(t), t).first()
    assert back.text == text and back.has_bom
    assert X.parse_line("a,") == [("a", False), ("", False)]


def test_ooxml_round_trip(spark):
    w = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>电话138</w:t></w:r><w:r><w:t>00138000</w:t></w:r></w:p></w:body></w:document>'
    x = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><f>A1</f></c></row></sheetData></worksheet>'
    s = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>13800138000</t></si></sst>'

    def zipped(parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return b.getvalue()

    rows = [("a.docx", zipped({"word/document.xml": w})), ("b.xlsx", zipped({"xl/worksheets/sheet1.xml": x, "xl/sharedStrings.xml": s}))]
    files = spark.createDataFrame(rows, "path string, content binary")
    red = R.redact(X.ooxml_segments(files)).cache()
    assert {r.redacted_text for r in red.collect()} == {"电话【手机号】", "【手机号】", None}
    texts = [r.text for r in X.ooxml_segments(X.ooxml_with(files, red)).collect()]
    assert sorted(t for t in texts if t) == ["【手机号】", "电话【手机号】"]
    assert X.ref_of(*X.cell_ref("AB2")) == "AB2"
    back = X.ooxml_segments(X.ooxml_with(X.ooxml_with(files, red), red, restored=True)).collect()
    assert sorted((r.text or "" for r in back)) == sorted((r.text or "" for r in red.collect()))


def test_ooxml_keeps_what_nothing_was_found_in(spark):
    """A number, a formatted paragraph without findings, and formats inside a changed one stay."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    plain = '<w:p><w:r><w:t>plain </w:t></w:r><w:r><w:rPr><w:b /></w:rPr><w:t>bold</w:t></w:r></w:p>'
    w = f'<w:document {ns}><w:body>{plain}<w:p><w:r><w:t>电话1380</w:t></w:r><w:r><w:rPr><w:b /></w:rPr><w:t>0138000请回</w:t></w:r></w:p></w:body></w:document>'
    x = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1"><v>42.5</v></c><c r="B1" t="inlineStr"><is><t>13800138000</t></is></c></row></sheetData></worksheet>'

    def zipped(name, body):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, body)
        return b.getvalue()

    files = spark.createDataFrame([("a.docx", zipped("word/document.xml", w)), ("b.xlsx", zipped("xl/worksheets/sheet1.xml", x)), ("c.docx", zipped("word/document.xml", f'<w:document {ns}>{plain}</w:document>'))], "path string, content binary")
    out = {r.path: r.content for r in X.ooxml_with(files, R.redact(X.ooxml_segments(files))).collect()}
    part = lambda path, name: zipfile.ZipFile(io.BytesIO(out[path])).read(name).decode()
    doc, sheet = part("a.docx", "word/document.xml"), part("b.xlsx", "xl/worksheets/sheet1.xml")
    assert plain in doc and "ns0" not in doc + sheet and "<w:b />" in doc.split(plain)[1]
    assert "".join(re.findall("<w:t[^>]*>([^<]*)", doc.split(plain)[1])) == "电话【手机号】请回"
    assert '<c r="A1"><v>42.5</v></c>' in sheet and "【手机号】" in sheet
    assert out["c.docx"] == {r.path: r.content for r in files.collect()}["c.docx"]


def test_edits_are_dealt_over_runs():
    assert X.spread(["ab", "cd", "ef"], [(1, 5, "XYZW")]) == ["aX", "YZ", "Wf"]
    assert X.spread(["ab", "cd"], [(0, 1, ""), (2, 4, "Q")]) == ["b", "Q"]
    assert X.spread(["138", "0013", "8000"], [(0, 11, "【手机号】")]) == ["【", "手机", "号】"]


def test_files_of_one_name_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", b"1"), ("b/x.txt", b"2")], "name string, content binary")
    assert X.write_files(rows, str(tmp_path)) == 2 and (tmp_path / "b/x.txt").read_bytes() == b"2"
    for bad in (rows.union(rows), spark.createDataFrame([("../x", b"1")], "name string, content binary")):
        with pytest.raises(ValueError):
            X.write_files(bad, str(tmp_path))


def test_places_of_terms(spark):
    df = spark.createDataFrame([("aaa.b\\\\Ea aaa😊aa", 1), ("", 2), ("b" * 80_000 + "a", 3)], "text string, i int")
    terms = ["aa", "\\\\E", ".b", "a"]
    for r in df.select("text", S.located(F.col("text"), F.array(*map(F.lit, terms))).alias("p")).collect():
        assert [(p.start, p.text) for p in r.p] == [(i, t) for t in terms for i in range(len(r.text)) if r.text.startswith(t, i)]


def test_line_type_follows_the_files_order(spark):
    df = spark.createDataFrame([("(2024)京0101民初12号 电话13812345678",)], "text string")
    assert df.select(D.line_type(F.col("text"))).first()[0] == "PHONE"


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="spans"):
        R.redact(spark.createDataFrame([("x", 1)], "text string, spans int"))


def test_gate_and_review(spark):
    df = spark.createDataFrame([("d", "13800138000元 人物1 违禁词")], "doc string, text string")
    bad = {r.check for r in G.checks(R.redact(df), "doc", LABOR, ["违禁词"]).where("not passed").collect()}
    assert bad == {"residual", "old_label", "denylist"}
    found = spark.createDataFrame([("甲方：王，编号1234567",)], "t string").select(F.explode(G.manual_review(F.col("t"))).alias("s")).select("s.text").collect()
    assert [r.text for r in found] == ["1234567", "王"]


def test_eval(spark):
    gold = spark.createDataFrame([(1, "A", 0, 2), (1, "A", 5, 9)], "ann_id int, entity_type string, start int, end int")
    pred = spark.createDataFrame([(1, "A", 0, 2), (1, "A", 6, 9)], "ann_id int, entity_type string, start int, end int")
    r = E.matched(gold, pred).first()
    assert (r.tp, r.fp, r.fn, r.boundary_errors, r.f1) == (1, 1, 1, 1, 0.5)


def test_stream(spark, tmp_path):
    from umbra.streaming.redaction import redact_stream

    spark.createDataFrame([("电话13800138000",)], "text string").write.parquet(str(tmp_path / "in"))
    q = redact_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).select("redacted_text")
    run = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().redacted_text == "电话【手机号】"


@pytest.mark.parametrize("name", ["resolve_overlaps", "redacted_text", "entities", "decisions_apply", "org_gate", "address_merge", "ocr_span_lines", "seal_boxes", "residual_categories", "line_types", "token_windows", "window_tags", "run_shares", "annotation_checks", "eval_boundaries", "audit_totals", "batch_case", "page_map_merge", "page_estimates", "address_merge_short_gaps", "export_span_union", "longest_original_first", "decision_locators", "decision_verification", "decision_invariants", "allowlist_union", "type_memberships"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "nation region customer supplier part orders lineitem documents conversations pages benchmark".split():
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    q = c.execute(Q.SQL[name])
    cols = [x[0] for x in q.description]
    want = sorted(map(repr, q.fetchall()))
    got = sorted(repr(tuple(r[c] for c in cols)) for r in Q.QUERIES[name](spark, d).collect())
    assert got == want and got


def test_rules_table():
    assert len(RULES) == 17 and len(scan_order()) == 15
