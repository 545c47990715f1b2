"""Cells to facts, staging files, masking and streams on invented records."""

import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import etl, masking
from quarrystone.sources import staging
from quarrystone.sources.workbook import read_workbooks
from quarrystone.streaming import events


def cells(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "person_id int, cell string")


def got(df, *columns):
    return [tuple(r) for r in df.orderBy("person_id", *(["position"] if "position" in df.columns else [])).select(*columns).collect()]


def test_T11_assets(spark):
    df = etl.assets(cells(spark, "个人总资产约12.5亿元；企业股权占比约60%；约7亿元；流动性资产占比约8%", "无", None), ["person_id"], "cell")
    assert got(df, "category", "amount", "percentage") == [("TOTAL_ASSET", Decimal("12.5000"), None), ("EQUITY", Decimal("7.0000"), None), ("LIQUID_ASSET_RATIO", None, Decimal("8.0000"))]


def test_T12_T13_T37_events(spark):
    df = cells(spark, "现金管理1.2亿元；债券；私募3亿元", "追加某基金2亿元；偿还借款500万元")
    assert got(etl.holdings(df, ["person_id"], "cell"), "kind", "amount") == [("CASH", Decimal("1.2000")), ("PRIVATE_EQUITY", Decimal("3.0000"))]
    assert got(etl.financial_events(df, ["person_id"], "cell"), "kind") == [("INVESTMENT",)]
    again = got(etl.financial_events_again(df, ["person_id"], "cell"), "kind", "amount")
    assert again == [("DEBT_REPAYMENT", Decimal("0.05"))]


def test_T07_T14_T15(spark):
    df = cells(spark, "稳健型（C3）；最大回撤约15%；投资期限偏好 3年；对流动性要求较高；实际投资偏保守", "私银客户年限：6.5年；专属客户经理服务3年；重点关注传承；偏好电话；平淡")
    r = etl.risk_preference(df, ["person_id"], "cell").orderBy("person_id").collect()
    assert (r[0].risk_level, r[0].max_drawdown, r[0].horizon, r[0].liquidity, r[0].actual) == ("C3", Decimal("15.0000"), "3年", "较高", "保守") and r[1].risk_level == "UNKNOWN"
    assert got(etl.services(df, ["person_id"], "cell"), "service_type", "years") == [("PRIVATE_BANKING", Decimal("6.50")), ("DEDICATED_MANAGER", Decimal("3.00"))]
    assert got(etl.notes(df.where("person_id = 2"), ["person_id"], "cell"), "note_type")[2:] == [("EXPLICIT_NEED",), ("PREFERENCE",), ("GENERAL_NOTE",)]


def test_T18_T20(spark):
    df = cells(spark, "核心产品：云服务、网盘；社交、游戏（手游、端游）", "上游：甲厂（华东）、乙厂；竞争对手:丙司；其他：丁", "回购股份；被处罚；无；连任")
    assert got(etl.business_lines(df.where("person_id = 1"), ["person_id"], "cell"), "kind", "line") == [("CORE_PRODUCTS", "云服务、网盘"), ("BUSINESS_LINE", "社交"), ("BUSINESS_LINE", "游戏（手游、端游）")]
    assert got(etl.market_relations(df.where("person_id = 2"), ["person_id"], "cell"), "relation", "name") == [("UPSTREAM", "甲厂"), ("UPSTREAM", "乙厂"), ("COMPETITOR", "丙司")]
    assert got(etl.enterprise_events(df.where("person_id = 3"), ["person_id"], "cell", "OPERATING"), "event_type", "risk_level") == [("CAPITAL_OPERATION", "PENDING_VERIFICATION"), ("REGULATORY_OR_LEGAL", "MEDIUM"), ("CORPORATE_GOVERNANCE", "PENDING_VERIFICATION")]


def test_T22_T29(spark):
    df = cells(spark, "妻子：李某（教师）；儿子：1人；儿子：未公开；朋友：王某", "某商会副会长；某大学校董；某商会理事", "碳中和捐赠；捐赠；捐赠", "时代人物；媒体关注", "无；被调查")
    assert got(etl.family_members(df.where("person_id = 1"), ["person_id"], "cell"), "relation", "name", "alias") == [("SPOUSE", "李某", False), ("SON", "SON_1", True), ("SON", "SON_2", True)]
    social = etl.social_relations(df.where("person_id = 2"), ["person_id"], "cell")
    assert got(social, "organization", "role", "organization_type") == [("某商会", "副会长", "INDUSTRY_ASSOCIATION"), ("某大学", "校董", "ACADEMIC"), ("某商会", "理事", "INDUSTRY_ASSOCIATION")]
    assert etl.organizations(social, "position").count() == 2
    assert got(etl.activities(df.where("person_id = 3"), ["person_id"], "cell", "CHARITY_ESG"), "activity_type", "name") == [("ESG", "碳中和捐赠"), ("CHARITY_ESG", "捐赠")]
    assert got(etl.reputations(df.where("person_id = 4"), ["person_id"], "cell"), "reputation_type", "publisher") == [("HONOR_OR_PUBLIC_EVALUATION", "TIME"), ("MEDIA_ATTENTION", None)]
    assert got(etl.reputation_risks(df.where("person_id = 5"), ["person_id"], "cell"), "topic", "risk_level") == [("被调查", "MEDIUM")]


def test_T31_T34_metrics(spark):
    df = cells(spark, "2024年总营收约1.2万亿元，归母净利润 30亿元；" + "长" * 40 + "营收900亿元；净亏损5亿美元，毛利率40%", "没有")
    facts = etl.financial_metrics(df, ["person_id"], "cell")
    found = {tuple(r) for r in facts.select("metric", "period", "value", "unit").collect()}
    assert found == {("TOTAL_REVENUE", "2024", Decimal("12000.0000"), "CNY_100M"), ("TOTAL_REVENUE", "2025", Decimal("900.0000"), "CNY_100M"), ("NET_PROFIT", "2024", Decimal("30.0000"), "CNY_100M"), ("NET_PROFIT", "2025", Decimal("-5.0000"), "USD_100M"), ("GROSS_MARGIN", "2025", Decimal("40.0000"), "PERCENT")}
    issues = etl.quality_issues(df, ["person_id"], facts, "FINANCIAL_METRIC_PARSE_EMPTY", "MEDIUM")
    assert got(issues, "person_id", "status") == [(2, "OPEN")]
    assert got(etl.resolved(issues, ["person_id"], df.where("person_id = 2")), "status") == [("RESOLVED",)]


def test_S01_S09_staging(spark, tmp_path):
    rows = [(1, "PERSON", i, f"人{i}", "某司", "f.xlsx", "S", i + 1, {"a": 'x"y', "b": "c\nd"}) for i in range(3)]
    df = spark.createDataFrame(rows, staging.STAGING.replace("raw_cells string", "raw_cells map<string,string>"))
    staging.write_staging(df, str(tmp_path / "s"))
    back = staging.read_staging(spark, str(tmp_path / "s")).orderBy("source_sequence")
    assert [tuple(r)[:-1] for r in back.collect()] == rows and back.where("problem is not null").count() == 0
    (tmp_path / "bad.csv").write_text("h\n" + '"1","PERSON","x","n","e","f","s","2","{}"\n"1","PERSON","1","","e","f","s","2","{}"\n"1","PERSON","1","n","e","f","s","2","[1"\n')
    assert [r.problem for r in staging.read_staging(spark, str(tmp_path / "bad.csv")).collect()] == ["source_sequence: no int", "person_name: missing", "raw_cells: no JSON object"]
    assert [(r.data_dimension, r.ok) for r in staging.counts_as_expected(back, {"PERSON": 3, "SOCIAL": 1}).orderBy("data_dimension").collect()] == [("PERSON", True), ("SOCIAL", False)]
    out = str(tmp_path / "t")
    both = df.unionByName(df.withColumn("import_batch_id", F.lit(2).cast("long"))).select("import_batch_id", "source_sequence")
    staging.replace_batch(both, out)
    staging.replace_batch(both.where("import_batch_id = 2").limit(1), out)
    assert spark.read.parquet(out).groupBy("import_batch_id").count().orderBy("import_batch_id").collect() == [(1, 3), (2, 1)]
    assert staging.file_manifest(spark, str(tmp_path / "bad.csv")).first().sha256


def test_S03_evidence(spark):
    df = spark.createDataFrame([("f", "S", 4, ["h"] * 28, ["v", " ", None] + ["w"] * 25)], "file_name string, sheet_name string, source_row_number int, header array<string>, cells array<string>")
    found = staging.evidence(df).collect()
    assert len(found) == 26 and found[0].source_locator == "f!S!A4" and found[-1].cell_reference == "AB4"


def test_S03_header():
    assert staging.checked_header(["、", " a "], ["a"]) == ["序号", "a"]
    for header in (["a", "a"], ["a", None], ["b"]):
        with pytest.raises(ValueError, match="header"):
            staging.checked_header(header, ["a"])


def test_S18_vectors(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"chunk_id":"a","vector":[1,2]}\n{"chunk_id":"b","vector":[1]}\n{"chunk_id":"c","vector":[1,2]}\n{"chunk_id":"c","vector":[1,2]}\n{broken\n{"chunk_id":" ","vector":[1,2]}\n')
    assert sorted(str(r.problem) for r in staging.read_vectors(spark, str(tmp_path / "v.jsonl"), 2).collect()) == ["BLANK_ID", "DIMENSION", "DUPLICATE_ID", "DUPLICATE_ID", "INVALID_LINE", "None"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("a/D000012_AB1234_某产品_产品说明书.pdf", ("D000012", "AB1234", "AB1234", "某产品", None)), ("D000012_AB1234_CD56789_甲_乙.PDF", ("D000012", "AB1234", "CD56789", "甲_乙", None)), ("D12_AB1234_x.pdf", "DOCUMENT_ID"), ("D000012_ABCDEF_x.pdf", "PRODUCT_CODE"), ("D000012_x.pdf", "TOO_FEW_FIELDS"), ("x.doc", "NOT_PDF")],
)
def test_S22_filenames(spark, name, want):
    r = spark.createDataFrame([(name,)], "n string").select(staging.filename_metadata(F.col("n")).alias("m")).first().m
    assert r.error == want if isinstance(want, str) else tuple(r) == want


def test_P08_P17_aliases(spark):
    entities = spark.createDataFrame([(1, "Person", "p9", True), (1, "Person", "p1", False), (1, "Enterprise", "e2", False), (1, "Enterprise", "e1", False)], "person_id int, entity_type string, entity_id string, is_customer boolean")
    assert {r.entity_id: r.alias for r in masking.aliases(entities).collect()} == {"p9": "P-1", "p1": "P-2", "e1": "E-1", "e2": "E-2"}
    named = spark.createDataFrame([(1, "华光控股有限公司", "E-1"), (1, "王大明", "P-1"), (1, "平安", "E-2"), (1, "平安集团", "O-1")], "person_id int, name string, alias string")
    bound = masking.name_bindings(named)
    assert {(r.name, r.alias) for r in bound.collect()} == {("华光控股有限公司", "E-1"), ("华光", "E-1"), ("王大明", "P-1"), ("平安集团", "O-1")}
    rows = spark.createDataFrame([(1, "王 大​明任职华光，手机13812345678"), (2, "王大明"), (1, None)], "person_id int, t string")
    out = {(r.person_id, r.t) for r in masking.masked_text(rows, bound, "t").collect()}
    assert out == {(1, "P-1任职E-1,手机[PHONE_REDACTED]"), (2, "王大明"), (1, None)}
    back = masking.restored(spark.createDataFrame([(1, "P-1和E-9，XP-1")], "person_id int, t string"), named, "t").first().t
    assert back == "王大明和E-9，XP-1"
    hit = spark.createDataFrame([("王 大明 abcd 123", ["王大明", "bc", "abcd", "12"])], "t string, terms array<string>").select(masking.prohibited(F.col("t"), F.col("terms"))).first()[0]
    assert hit == ["王大明", "abcd"]


def test_P18_P21(spark):
    rows = spark.createDataFrame([(1, " ", "ok"), (2, "a@b.com", None), (3, "x" * 700, "fine")], "person_id int, a string, b string")
    assert {(r.person_id, r.field, r.problem) for r in masking.unsafe_fields(rows, ["person_id"], ["a", "b"]).collect()} == {(1, "a", "BLANK"), (2, "a", "EMAIL"), (3, "a", "TOO_LONG")}
    many = spark.range(150).select(F.lit(1).alias("person_id"), F.col("id").alias("position"), F.lit("f").alias("field"), F.lit("TEXT_TRUNCATED").alias("reason"))
    kept = masking.omissions(many).collect()
    assert len(kept) == 100 and kept[0].total == 150
    body, digest, fits = masking.sealed(F.struct(F.lit("v").alias("k")))
    assert tuple(spark.range(1).select(body, digest, fits).first())[::2] == ('{"k":"v"}', True)
    assert masking.evidence_numbers(spark.createDataFrame([(1, 7), (1, 3), (1, 7), (1, None)], "person_id int, source_id int")).where("evidence = 'SRC-1'").first().source_id == 3


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_E01_E02_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, 5, 10), (1, 4, 11), (2, 1, 12)], "workflow_id long, t long, event_id long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in drained(spark, events.numbered(stream), "numbered", tmp_path).collect()} == {(1, 11, 1), (1, 10, 2), (2, 12, 1)}
    steps = spark.createDataFrame([(1, 1, "STARTED"), (1, 2, "DESIGNED"), (1, 3, "PROFILED"), (1, 4, "RESEARCHED"), (1, 5, "DESIGNED"), (1, 6, "PROFILED")], "workflow_id long, t long, step string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))
    out = drained(spark, events.advanced(stream), "advanced", tmp_path).collect()
    assert [(r.step, r.accepted) for r in out] == [("STARTED", True), ("DESIGNED", False), ("PROFILED", True), ("RESEARCHED", True), ("DESIGNED", True), ("PROFILED", False)]


def test_I09_once_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 2.0), ("b", 90, 4.0)], "key string, t long, value double").withColumn("ts", F.timestamp_seconds("t")).withColumn("event_type", F.lit("x")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "actions"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "actions"))
    assert sorted(r.key for r in drained(spark, events.once(stream), "once", tmp_path).collect()) == ["a", "b"]
    batch = events.windowed(rows).collect()
    assert [(r.n, r.total) for r in batch] == [(3, 7.0)]


def test_E04_resume(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "chunk_id string")
    cached = spark.createDataFrame([("a", "m", "h", [1.0, 2.0]), ("b", "m", "old", [1.0, 2.0]), ("c", "m", "h", [1.0]), ("d", "m", "h", [1.0, 2.0]), ("d", "m", "h", [1.0, 2.0])], "chunk_id string, model string, source_hash string, vector array<double>")
    todo, use = events.resumable(chunks, cached, "m", 2, "h")
    assert sorted(r.chunk_id for r in todo.collect()) == ["b", "c", "d"] and [r.chunk_id for r in use.collect()] == ["a"]


def workbook(path, rows):
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f'<row r="{i}">' + "".join(cell(i, j, v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="x" r:id="r1"/><sheet name="S" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="y"><Relationship Id="r1" Target="worksheets/none.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>甲</t></si><si><r><t>乙</t></r><r><t>丙</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_S01_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["姓名", "企业", "注"], [0, 1, None], [None, " ", None], [0, "某司", "n"], [None, "某司", "n"], ["a", "b", "c", "d"]])
    workbook(tmp_path / "b.xlsx", [["姓名", "姓名"]])
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    rows = workbooks(spark, tmp_path)
    assert [(r.file_name, r.source_row_number, r.cells, r.problem) for r in rows] == [
        ("a.xlsx", 2, ["甲", "乙丙", None], None), ("a.xlsx", 4, ["甲", "某司", "n"], None), ("a.xlsx", 5, [None, "某司", "n"], "missing 姓名"), ("a.xlsx", 6, ["a", "b", "c", "d"], "row is wider than the header"),
        ("b.xlsx", 1, None, "header must be complete and unique"), ("c.xlsx", None, None, "unreadable workbook: BadZipFile"),
    ]
    assert rows[0].sheet_name == "S"


def workbooks(spark, path):
    return read_workbooks(spark, f"{path}/*.xlsx", ["姓名", "企业"]).orderBy("file_name", "source_row_number").collect()
