from pyspark.sql import functions as F

from logaudit.operators import briefs, redact

IP = "203.0.113.9"
FINDING = (
    "host string, round_id string, pos int, rule string, severity int, title string, detail string, labels map<string,string>, "
    "evidence array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>, baseline string, correlations array<string>"
)
CLAIM = "host string, round_id string, pos int, text string, kind string, accepted boolean, reason string, confidence string, note string, refs array<string>"


def _parts(spark):
    heads = spark.createDataFrame([("h", "1", 3, f"own {IP}"), ("h", "2", 1, "nothing to report"), ("h", "3", 1, None)], "host string, round_id string, severity int, headline string")
    found = [
        ("h", "1", 2, "r.b", 1, f"b {IP}", None, {}, None, None, None),
        ("h", "1", 1, "r.a", 3, f"a {IP}", f"d {IP}", {"source": IP}, [("log", f"r{{source={IP}}}", f"from {IP}", 7)], f"at {IP}", [f"c {IP}"]),
    ]
    claims = [
        ("h", "1", 1, "", "observation", False, "empty claim", None, None, []),
        ("h", "1", 0, f"see {IP}", "observation", True, None, "derived", f"n {IP}", [f"k{{source={IP}}}"]),
    ]
    models = spark.createDataFrame([("h", "1", "m", None, f"said {IP}", False), ("h", "2", "m", f"lost {IP}", "bad", True)], "host string, round_id string, model string, error string, headline string, replaced boolean")
    return heads, spark.createDataFrame(found, FINDING), spark.createDataFrame(claims, CLAIM), models


def test_whole_briefs_are_redacted(spark):
    rows = briefs.briefs(*_parts(spark))
    assert rows.where(F.to_json(F.struct("*")).contains(IP)).count() == 2
    told = redact.redact_briefs(rows, redact.Policy(b"salt"))
    one, two, three = told.orderBy("round_id").collect()
    assert IP not in str((one, two, three))
    assert (one.headline_source, two.headline_source, three.headline_source) == ("llm", "rules", "rules")
    assert one.headline.startswith("said ip:") and two.headline == "nothing to report" and two.llm_error.startswith("lost ip:") and three.headline is None
    assert [f.rule for f in one.findings] == ["r.a", "r.b"] and one.findings[0].evidence[0].line_no == 7 and one.findings[1].detail is None
    token = one.findings[0].labels["source"]
    assert one.findings[0].title == f"a {token}" and one.findings[0].correlations == [f"c {token}"] and one.claims[0].refs == [f"k{{source={token}}}"]
    assert one.claims[0].note == f"n {token}" and [r.reason for r in one.rejected] == ["empty claim"] and one.severity == 3
    assert two.findings == [] and two.claims == [] and two.rejected == []


def test_briefs_without_model_or_findings(spark):
    heads, found, _, _ = _parts(spark)
    rows = briefs.briefs(heads, found.where("false")).collect()
    assert len(rows) == 3 and all(r.headline_source == "rules" and r.model is None and r.findings == [] and r.claims == [] for r in rows)
    assert briefs.briefs(heads.where("false"), found).count() == 0
