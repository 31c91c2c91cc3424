import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logaudit.llm import divergence, resampling, warc
from logaudit.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_block_divergence", "op12_warc_archive", "op13_bucket_resampling"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert len(want) and rows_of(got[list(want.columns)]) == rows_of(want)


# Resampling


def plain_resampling(rows, target, percent=5, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    every = [(i, *features(t)) for i, t in rows]
    s, t = (collections.Counter(b for f in fs for b in f) for fs in ([f for *_, f in every], [features(x)[1] for x in target]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in every:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return out


def test_resampling_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PACKED", 500)  # many packed rows, in the driver's copy of the module alone
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Été", "x-y", "A1", "日本"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(200)]
    rows += [(None, None), (None, "a b c"), (500, ""), (501, "!!"), (7, rows[7][1]), (7, rows[7][1]), (502, "one"), (503, "one two"), (504, "long " * 30_000)]
    target = [" ".join(words[:20]), "W1 w2 w3", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("x"), "_id": F.lit(1), "stream": F.lit(2)})
    aims = spark.createDataFrame([(t,) for t in target], "text string").withColumn("doc_id", F.lit(None))
    scores = resampling.importance(docs, aims)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, scores.collect()), key=key) == sorted(map(tuple, plain_resampling(rows, target)), key=key)
    chosen = resampling.drawn(docs, scores)
    assert set(chosen.columns) == set(docs.columns) and chosen.count() >= 5


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (2, None)], "doc_id long, text string")
    assert resampling.importance(none, some).count() == 0
    rows = {r.doc_id: r for r in resampling.importance(some, none, percent=100).collect()}
    assert rows[1].rank == 1 and rows[2].rank is None and rows[2].weight == 0 and rows[1].n_features == 177


def test_a_longer_run_carries_on_the_checksum_of_a_shorter_one():
    n, stream = resampling.bucket_stream("The cat, sat".encode())
    assert n == 3 and stream.tolist() == [zlib.crc32(x) % 10_000 for x in (b"the", b"cat", b"sat", b"the cat", b"cat sat", b"the cat sat")]
    assert resampling.bucket_stream(None)[1].tolist() == [] and len(resampling.bucket_stream(b"a b")[1]) == 3


# Divergence


def plain_audit(rows, least=30, top=50):
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n.update((lang, source, w) for w in words)
        docs.update({(lang, w) for w in words})
    out = []
    for lang, source in groups:
        kept = [w for (x, w), k in docs.items() if x == lang and k >= least]
        share = lambda count, total: 1 + 10**9 * (count + 5) // (total + 5 * len(kept))
        of = lambda s: {w: share(n[lang, s, w], sum(n[lang, s, x] for x in kept)) for w in kept}
        mine, others = of(source), [s for x, s in groups if x == lang]
        pairs = [(s, sum(abs(mine[w] - q) for w, q in of(s).items())) for s in others if s != source]
        sums = {w: sum(n[lang, s, w] for s in others) for w in kept}
        whole = {w: share(sums[w], sum(sums.values())) for w in kept}
        terms = [(w, mine[w] - whole[w]) for w in kept if n[lang, source, w] and mine[w] > whole[w]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, w, v, k) for k, (w, v) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, span", [(32, 16_384, 16), (2, 7, 2), (1, 3, 1)])
def test_audit_equals_a_plain_one(spark, monkeypatch, block, chunk, span):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SPAN", span)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "é"]
    rows = [(" ".join(words[min(int(rnd.expovariate(0.05)), 61)] for _ in range(rnd.randrange(80))), "en", f"s{min(int(rnd.expovariate(0.4)), 6)}") for _ in range(300)]
    rows += [("only few words", "de", s) for s in ("a", "b", "c")] + [(None, None, None), ("x", None, "a"), ("", "en", "bare"), ("1 2 3", "fr", "alone")]
    rows += [(rows[0][0], "en", "s0")] * 3 + [("wa " * 20_000, "en", "s1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "group": F.lit(2), "rank": F.lit("x")})
    got = divergence.audit(docs)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)
    assert got.where("source = 'bare' and part = 'term'").count() == 0 and got.where("source = 'bare'").count() == 7


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n = np.array([[0, 10**13, 7]], dtype=np.int64)
    total = np.array([[9 * 10**15]], dtype=np.int64)
    want = [1 + 10**9 * (int(k) + 5) // int(total[0, 0]) for k in n[0]]
    assert divergence.shares(n, total)[0].tolist() == want
    df = spark.createDataFrame([(int(k), int(total[0, 0])) for k in n[0]], "n long, t long")
    assert [r.s for r in df.select(divergence.share(F.col("n"), F.col("t")).alias("s")).collect()] == want


# Archives

LONG = "<html>" + "äb" * 80 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip_and_edges(spark, tmp_path):
    big = "".join(random.Random(1).choice("abc\r\n WARC/1.1") for _ in range(300_000))
    rows = [
        (5, "http://a/x y\r\nEvil: 1", LONG), (2, "http://b/", LONG), (None, None, LONG), (9, "http://c/", None), (10, "", ""), (3, "http://d/", "short"),
        (4, "http://e/", "short"), (11, "http://f/", "x" * 100), (12, "http://f/", "x" * 100), (13, "http://g/", "x" * 99), (14, "http://g/", "x" * 99), (15, "u", big),
        (2, "http://b/", LONG), (16, "http://h/", "WARC/1.1\r\n\r\n" * 20),
    ]
    warc.archive(pages(spark, rows).withColumns({"digest": F.lit(1), "payload": F.lit("q")}), str(tmp_path / "a"))
    back = warc.read(spark, str(tmp_path / "a")).where("record_type <> 'warcinfo'").collect()
    assert len(back) == len(rows)
    first = {LONG: 2, "x" * 100: 11}
    for r in back:
        i = r.record_id[len("<urn:x-page:") : -1]
        of = {(None if i == "" else int(i), u, h or "") for p, u, h in rows if str(p if p is not None else "") == i}
        ((page, url, html),) = of
        again = html in first and page != first[html]
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (f"<urn:x-page:{first[html]}>" if again else None)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert (r.payload is None) if again else (bytes(r.payload).decode() == html)
        assert (r.target_uri or "") == re.sub(r"[\s]", lambda m: f"%{ord(m[0]):02X}", url or "") and r.content_type == "text/html"


def test_files_are_gzip_and_records_stand_apart(spark, tmp_path):
    import gzip

    warc.archive(pages(spark, [(i, "u", f"{i} " * 200) for i in range(50)]), str(tmp_path / "a"), fileBytes="4000", cutBytes="1500")
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 2
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC-Type: response\r\n") == 50 and whole.count(b"WARC-Type: warcinfo\r\n") == len(files)
    read = warc.read(spark, str(tmp_path / "a"), ("record_id", "offset", "file"), partitionBytes="2000")
    assert read.rdd.getNumPartitions() > len(files) and read.distinct().count() == 50 + len(files)


def test_headers_decide_before_payloads_are_inflated(spark, tmp_path):
    text = "".join(chr(97 + random.Random(i).randrange(26)) for i in range(60_000))
    warc.archive(pages(spark, [(1, "http://a/", text), (2, "http://b/", text), (3, "http://c/", "small")]).coalesce(1), str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("*.warc.gz")
    offset = {r.record_id: r.offset for r in warc.read(spark, str(tmp_path / "a"), ("record_id", "offset")).collect()}["<urn:x-page:1>"]
    data = bytearray(file.read_bytes())
    data[offset + 20_000 : offset + 20_050] = bytes(50)  # within the payload of page 1
    file.write_bytes(data)
    read = lambda *where: warc.read(spark, str(tmp_path / "a"), None, where).collect()
    assert [r.record_id for r in read(("record_type", "=", "revisit"))] == ["<urn:x-page:2>"]
    assert [bytes(r.payload) for r in read(("record_type", "=", "response"), ("target_uri", "startswith", "http://c"))] == [b"small"]
    assert warc.read(spark, str(tmp_path / "a"), ("record_type", "target_uri")).count() == 4
    with pytest.raises(Exception, match="Error -3|incorrect data check|invalid"):
        read(("target_uri", "=", "http://a/"))


def test_predicates_give_the_rows_of_a_filter(spark, tmp_path):
    warc.archive(pages(spark, [(i, f"http://h{i % 3}/{i}" if i % 5 else None, LONG if i % 4 == 0 else f"p{i}") for i in range(40)]), str(tmp_path / "a"))
    held = warc.read(spark, str(tmp_path / "a"))
    cases = {
        "record_type = 'revisit'": [("record_type", "=", "revisit")], "target_uri like 'http://h1%'": [("target_uri", "startswith", "http://h1")],
        "target_uri is null": [("target_uri", "isnull")], "target_uri is not null": [("target_uri", "isnotnull")], "payload_bytes > 100": [("payload_bytes", ">", 100)],
        "payload_bytes <= 3": [("payload_bytes", "<=", 3)], "record_id in ('<urn:x-page:3>', 'x')": [("record_id", "in", ["<urn:x-page:3>", "x"])],
        "target_uri >= 'http://h2/' and payload_bytes < 9": [("target_uri", ">=", "http://h2/"), ("payload_bytes", "<", 9)],
    }
    for text, where in cases.items():
        assert sorted(r.record_id for r in warc.read(spark, str(tmp_path / "a"), ("record_id",), where).collect()) == sorted(r.record_id for r in held.where(text).collect()), text
    for wrong in (("payload", "=", "x"), ("record_type", "like", "x")):
        with pytest.raises(Exception, match="no header column|no predicate"):
            warc.read(spark, str(tmp_path / "a"), None, [wrong]).collect()


def test_archives_of_others(spark, tmp_path):
    import gzip

    one = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello")
    two = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<b>", "Content-Type": "text/plain"}, b"x" * 9000)
    (tmp_path / "1.warc").write_bytes(one + two)
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one))  # members that don't tell their length
    got = sorted((r.record_id, r.content_type, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [("<a>", "text/plain", b"hello")] * 2 + [("<b>", "text/plain", b"x" * 9000)] * 2
    assert warc.read(spark, str(tmp_path), ("record_id",)).count() == 4
    (tmp_path / "3.warc").write_bytes(b"no record at all\r\n\r\n")
    with pytest.raises(Exception, match="no record at 0"):
        warc.read(spark, str(tmp_path)).collect()


def test_no_pages_and_rewriting(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive(pages(spark, []), path)
    assert warc.read(spark, path).count() == 0
    rows = spark.createDataFrame([("<x>", "response", b"1")], "record_id string, record_type string, payload binary")
    for _ in range(2):
        rows.write.format("warc").mode("overwrite").save(path)
    assert warc.read(spark, path).where("record_type = 'response'").count() == 1 and len(list((tmp_path / "a").glob("*.warc.gz"))) == 1


def test_many_groups_are_joined_without_a_large_one_in_a_task(spark, tmp_path):
    rows = [(i, "u", f"{i % 7} " * 60 if i % 3 else "hot " * 40) for i in range(120)]
    texts = collections.defaultdict(list)
    for i, _, h in rows:
        texts[h].append(i)
    warc.archive(pages(spark, rows), str(tmp_path / "a"), broadcast_groups=1)
    got = {r.record_id: r.refers_to for r in warc.read(spark, str(tmp_path / "a"), ("record_id", "refers_to", "record_type")).where("record_type <> 'warcinfo'").collect()}
    assert got == {f"<urn:x-page:{i}>": None if i == min(texts[h]) else f"<urn:x-page:{min(texts[h])}>" for i, _, h in rows}
