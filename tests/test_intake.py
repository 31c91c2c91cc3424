import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from logaudit.sources import intake
from logaudit.sources import logs as L


def plain(data: bytes):
    text = data.decode("utf-8", "replace")
    return text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []


@pytest.fixture()
def many_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_equal_a_plain_readers_over_many_splits(spark, tmp_path, many_splits):
    rnd = random.Random(2)
    line = lambda: "".join(rnd.choice("abé\r ") for _ in range(rnd.choice([0, 0, 3, 40, 300, 9000])))
    members = {"x.log.10.gz": 40, "x.log.2": 60, "x.log.1": 0, "x.log": 80, "y.log-20240131": 9, "y.log-20240201.gz": 5, "y.log": 3}
    files = {}
    folder = tmp_path / "host=h" / "container=c"
    folder.mkdir(parents=True)
    for name, n in members.items():
        data = "\n".join(line() for _ in range(n)).encode() + (b"\n" if n % 2 else b"")
        files[name] = plain(data)
        (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    rows = L.read_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20
    got = rows.withColumn("name", F.regexp_extract("file", "([^/]*)$", 1)).collect()
    assert {(r.host, r.container) for r in got} == {("h", "c")}
    for name, lines in files.items():
        assert sorted((r.line_no, r.raw) for r in got if r.name == name) == list(enumerate(lines, 1)), name
    for log, order in (("x.log", ["x.log.10.gz", "x.log.2", "x.log.1", "x.log"]), ("y.log", ["y.log-20240131", "y.log-20240201.gz", "y.log"])):
        assert sorted((r.log_line, r.raw) for r in got if r.log.endswith("/" + log)) == list(enumerate([x for m in order for x in files[m]], 1))


def test_changed_splits_are_told(spark, tmp_path, many_splits):
    (tmp_path / "x.log").write_text("\n".join(f"line {i}" for i in range(2000)))
    rows = L.read_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3100")
    with pytest.raises(Exception, match="splits have changed"):
        rows.collect()


T0 = dt.datetime(2026, 8, 1)


def test_a_missing_and_a_corrupt_source_become_error_rows(spark, tmp_path):
    root = str(tmp_path / "round")
    kind = "host string, round_id string, source string, as_of timestamp, name string, kind string, value_num double, labels map<string,string>"
    rows = [("h", "r", s, T0, n, "metric", float(i), {"a": s}) for s in ("disk", "mail", "cert") for i, n in enumerate(("x", "y"))]
    intake.deliver(spark.createDataFrame(rows, kind), root)
    folder = tmp_path / "round" / "host=h" / "round_id=r" / "source=cert"
    for f in folder.glob("*.txt"):
        whole = gzip.compress(b"".join(f.read_bytes() for _ in range(2000)))
        f.unlink()
        (folder / "part.json.gz").write_bytes(whole[: len(whole) // 2])  # damaged: it can't be read to its end
    manifest = intake.expected_sources(spark.createDataFrame([("h", "r", T0)], "host string, round_id string, as_of timestamp"), spark.createDataFrame([("h", s) for s in ("disk", "mail", "cert", "gone", "gone")], "host string, source string"))
    out = intake.collect_round(spark, root, manifest)
    got = sorted((r.source, r.name, r.kind, r.key) for r in out.collect())
    assert got == [
        ("cert", "source_failed", "error", "source_failed{source=cert}"), ("disk", "x", "metric", "x{a=disk}"), ("disk", "y", "metric", "y{a=disk}"),
        ("gone", "source_failed", "error", "source_failed{source=gone}"), ("mail", "x", "metric", "x{a=mail}"), ("mail", "y", "metric", "y{a=mail}"),
    ]
    reasons = {r.source: r.value_text for r in out.where("kind = 'error'").collect()}
    assert reasons["gone"] == "nothing was delivered" and reasons["cert"]
    assert {r.source for r in intake.collect_round(spark, root, manifest, keep_partial=True).where("kind = 'metric'").collect()} >= {"disk", "mail"}


def test_an_empty_root_gives_an_error_for_each_source(spark, tmp_path):
    (tmp_path / "none").mkdir()
    manifest = spark.createDataFrame([("h", "r", T0, "disk")] * 2, "host string, round_id string, as_of timestamp, source string")
    assert [(r.source, r.value_text) for r in intake.collect_round(spark, str(tmp_path / "none"), manifest).collect()] == [("disk", "nothing was delivered")]
