"""WARC archives as a PySpark Python data source, and an archive that keeps equal payloads once.

``spark.read.format("warc")`` plans partitions from the files' sizes: small files share one, large ones are cut where a
record begins, as the writer has noted. Predicates on record type and headers go down to the reader, which parses a
record's headers first, takes the next record by the length in the gzip member's extra field, and inflates a payload
only if the record is wanted and the schema has a column for it.

Predicates are given with the read, not by ``pushFilters``: Spark 4.1 keeps what was pushed last in the relation, so two
queries over one DataFrame, or two branches of one query, would get each other's rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from logaudit.llm.common import shared_dir, written

SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, date string, content_type string, "
    "payload_digest string, refers_to string, payload_bytes long, payload binary"
)
#: Fixed names of the format's header fields.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
#: Bytes after which a file is closed, a place to cut it is noted, and a partition is full.
FILE_BYTES, CUT_BYTES, PARTITION_BYTES = 1 << 30, 32 << 20, 128 << 20
#: Bytes read and inflated for the headers of a record at first; more only if they are longer.
FIRST_BYTES = 4096
#: Payloads under so many bytes are stored each time.
LEAST_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or address to the store that holds it and the path there: executors open it with the same call."""
    return pafs.FileSystem.from_uri(path)


# Records


def _clean(value: str) -> str:
    """A header's value: what would end its line, and blanks in it, as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(head: dict[str, str | None], block: bytes) -> bytes:
    """One record: its headers (those without a value are left out) and its block."""
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` tells its length and that of the data, where these fit into 32 bits."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    known = size < 1 << 32 and len(data) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, size if known else 0, len(data) if known else 0)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_size(head: bytes) -> int:
    """The length of the member that begins here, or 0 if it isn't told."""
    if len(head) < 24 or not head[3] & 4:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8 and at + 8 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return 0


class _Plain:
    """The bytes of one record of a file that isn't compressed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""

    def more(self, n: int) -> bool:
        """Tries to hold n bytes more; false at the end of the file."""
        got = self.file.read(n)
        self.data += got
        return bool(got)

    def end(self, size: int) -> int:
        return self.start + size


class _Gzip(_Plain):
    """The bytes of one record that is a gzip member, inflated as far as asked for."""

    def __init__(self, file, start: int):
        super().__init__(file, start)
        self.inflate, self.read, self.told = zlib.decompressobj(31), 0, 0

    def more(self, n: int) -> bool:
        before = len(self.data)
        while len(self.data) - before < n and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                left = self.told - self.read if self.told else n
                raw = self.file.read(min(max(n, FIRST_BYTES), left) if left > 0 else n)
                if not self.read:
                    self.told = _member_size(raw)
                self.read += len(raw)
            if not raw:
                if self.read:
                    raise ValueError(f"a record is cut short at {self.start}")
                break
            self.data += self.inflate.decompress(raw, n)
        return len(self.data) > before

    def end(self, size: int) -> int:
        """Where the next member begins: told, or found by inflating this one to its end."""
        if self.told:
            return self.start + self.told
        while not self.inflate.eof and self.more(1 << 20):
            self.data = b""
        return self.start + self.read - len(self.inflate.unused_data)


def _head(block, start: int, most: int = 1 << 24) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) from ``start`` on, and where they end."""
    while (end := block.data.find(b"\r\n\r\n", start)) < 0:
        if len(block.data) - start > most or not block.more(FIRST_BYTES):
            return {}, -1
    fields = {}
    for line in block.data[start:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return fields, end + 4


def records(file, name: str, start: int, stop: int, accepts: Callable[[dict], bool], payloads: bool) -> Iterator[dict]:
    """The wanted records that begin between two offsets. ``accepts`` sees the headers; a payload is inflated after it
    has agreed, and only if payloads are asked for. A record that isn't one stops the reading with an error."""
    compressed = name.endswith(".gz")
    while start < stop:
        file.seek(start)
        block = (_Gzip if compressed else _Plain)(file, start)
        head, at = _head(block, 0)
        if at < 0 and not block.data.strip():
            return
        if at < 0 or not block.data.startswith(b"WARC/") or not head.get("content-length", "").isdigit():
            raise ValueError(f"no record at {start} of {name}")
        size = int(head["content-length"])
        row = {c: head.get(f.lower()) for c, f in FIELDS.items()}
        row |= {"file": name, "offset": start, "payload_digest": (row["payload_digest"] or "").rpartition(":")[2].lower() or None}
        begins, row["payload_bytes"] = at, size
        if (row["content_type"] or "").startswith("application/http"):
            http, begins = _head(block, at)
            if begins < 0:
                raise ValueError(f"no HTTP headers at {start} of {name}")
            row["content_type"] = http.get("content-type")
            told = http.get("content-length", "")
            row["payload_bytes"] = int(told) if row["record_type"] == "revisit" and told.isdigit() else size - (begins - at)
        if accepts(row):
            row["payload"] = None
            if payloads and row["record_type"] != "revisit":
                while len(block.data) < at + size:
                    if not block.more(at + size - len(block.data)):
                        raise ValueError(f"a record is cut short at {start} of {name}")
                row["payload"] = block.data[begins : at + size]
            yield row
        start = block.end(at + size + 4)


# Reading


def _bytes(v):
    """Texts compare by their bytes, as in Spark."""
    return v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v


_OPERATORS: dict[str, Callable] = {
    "=": lambda v, x: v == x, "in": lambda v, x: v in x, "startswith": lambda v, x: v.startswith(x), "isnotnull": lambda v, x: True,
    ">": lambda v, x: _bytes(v) > _bytes(x), ">=": lambda v, x: _bytes(v) >= _bytes(x),
    "<": lambda v, x: _bytes(v) < _bytes(x), "<=": lambda v, x: _bytes(v) <= _bytes(x),
}


def _test(column: str, operator: str, value=None) -> Callable[[dict], bool]:
    """A predicate over a record's headers. Like in SQL, none holds for a null but ``isnull``."""
    if column not in FIELDS and column != "payload_bytes":
        raise ValueError(f"no header column {column}")
    if operator == "isnull":
        return lambda row: row[column] is None
    if operator not in _OPERATORS:
        raise ValueError(f"no predicate {operator}")
    holds = _OPERATORS[operator]
    return lambda row: row[column] is not None and holds(row[column], value)


@dataclass
class Part(InputPartition):
    """Byte ranges of files that one task reads."""

    ranges: list[tuple[str, int, int]] = field(default_factory=list)

    def __init__(self, ranges):
        super().__init__(None)
        self.ranges = ranges


def archive_files(path: str) -> list[tuple[str, int, list[int]]]:
    """Name, size and cuts of each archive file of a folder: those of its manifests, so that files of failed attempts
    don't count; without manifests all that are named like one."""
    store, root = filesystem(path)
    found = store.get_file_info(pafs.FileSelector(root, recursive=False))
    out = []
    for info in found:
        if info.base_name.startswith("_manifest-"):
            with store.open_input_stream(info.path) as f:
                out += [(f"{root}/{x['file']}", x["size"], x["cuts"]) for x in map(json.loads, f.read().decode().splitlines())]
    if not any(i.base_name.startswith("_manifest-") for i in found):
        out = [(i.path, i.size, []) for i in found if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
    return sorted(out)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.where = json.loads(options.get("where", "[]"))
        for predicate in self.where:
            _test(*predicate)  # a wrong one is told while the query is planned

    def partitions(self) -> Sequence[InputPartition]:
        """Pieces between cuts, put together in order up to ``partitionBytes``; no file, one empty partition."""
        out: list[list[tuple[str, int, int]]] = [[]]
        held = 0
        for name, size, cuts in archive_files(self.path):
            for a, b in zip([0, *cuts], [*cuts, size], strict=True):
                if held and held + b - a > self.most:
                    out.append([])
                    held = 0
                held += b - a
                if out[-1] and out[-1][-1][0] == name and out[-1][-1][2] == a:
                    out[-1][-1] = (name, out[-1][-1][1], b)
                else:
                    out[-1].append((name, a, b))
        return [Part(r) for r in out]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        tests = [_test(*p) for p in self.where]
        store, _ = filesystem(self.path)
        kinds = {n: pa.int64() if n in ("offset", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in self.names}
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in self.names], names=self.names)

        for name, start, stop in partition.ranges:
            with store.open_input_file(name) as file:
                for row in records(file, name, start, stop, lambda row: all(t(row) for t in tests), "payload" in self.names):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


# Writing


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own name; those of the attempts that count are named in a manifest
    when all are done, so a lost executor leaves files that no reader sees."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.software = options.get("software", "logaudit")
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", 3))
        self.file_bytes, self.cut_bytes = int(options.get("filebytes", FILE_BYTES)), int(options.get("cutbytes", CUT_BYTES))
        self.job = uuid.uuid4().hex
        missing = {"record_id", "record_type", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")

    def _record(self, row: dict) -> bytes:
        get = lambda c: None if row.get(c) is None else _clean(str(row[c]))
        revisit, payload = row["record_type"] == "revisit", row["payload"] or b""
        full = row.get("payload_bytes")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {get('content_type') or 'text/html'}\r\nContent-Length: {len(payload) if full is None else full}\r\n\r\n"
        digest = get("payload_digest")
        head = {
            "WARC-Type": get("record_type"), "WARC-Record-ID": get("record_id"), "WARC-Date": get("date") or self.date, "WARC-Target-URI": get("target_uri"),
            "WARC-Payload-Digest": None if digest is None else f"sha256:{digest}", "WARC-Refers-To": get("refers_to") if revisit else None,
            "WARC-Profile": _PROFILE if revisit else None, "Content-Type": "application/http;msgtype=response",
        }
        return record(head, http.encode() + (b"" if revisit else payload))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = filesystem(self.path)
        attempt, files, out = uuid.uuid4().hex, [], None
        about = record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(attempt)}>", "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, f"software: {self.software}\r\nformat: WARC File Format 1.1\r\n".encode())
        try:
            for batch in iterator:
                for row in _rows(batch):
                    if out is None:
                        now = {"file": f"{self.job[:8]}-{attempt}-{len(files):05d}.warc.gz", "size": 0, "cuts": []}
                        out, cut = store.open_output_stream(f"{root}/{now['file']}", compression=None), 0
                        files.append(now)
                        now["size"] += out.write(member(about, self.level))
                    if now["size"] - cut >= self.cut_bytes:
                        now["cuts"].append(cut := now["size"])
                    now["size"] += out.write(member(self._record(row), self.level))
                    if now["size"] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        old = [i.path for i in store.get_file_info(pafs.FileSelector(root)) if i.is_file and i.base_name.startswith("_manifest-")] if self.overwrite else []
        with store.open_output_stream(f"{root}/_manifest-{self.job}.json", compression=None) as f:
            for m in messages:
                for x in m.files if m is not None else ():
                    f.write(json.dumps(x).encode() + b"\n")
        for manifest in old:  # the files of an older one stay until its manifest has gone
            with store.open_input_stream(manifest) as f:
                gone = [json.loads(x)["file"] for x in f.read().decode().splitlines()]
            store.delete_file(manifest)
            for name in gone:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                store.delete_file(f"{root}/{x['file']}")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that only one payload is copied at once."""
    names = batch.schema.names
    for values in zip(*batch.columns, strict=True):
        yield {n: v.as_py() for n, v in zip(names, values, strict=True)}


class WarcSource(DataSource):
    """``format("warc")``. Reading takes any columns of ``SCHEMA`` as its schema; without ``payload`` among them no
    payload is inflated. Options of reading: ``partitionBytes``, ``where`` (JSON, see ``read``); of writing:
    ``fileBytes``, ``cutBytes``, ``level``, ``date``, ``software``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        store, root = filesystem(self.options["path"])
        store.create_dir(root, recursive=True)
        return Writer(schema, self.options, overwrite)


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Sequence[tuple] = (), **options) -> DataFrame:
    """Records of an archive with these columns of ``SCHEMA``, or with all of them.

    ``where`` lists predicates that all have to hold, as ``(column, operator, value)`` over the header columns: ``=``,
    ``in``, ``startswith``, ``>``, ``>=``, ``<``, ``<=``, ``isnull``, ``isnotnull``. They are applied to the headers,
    before anything of a payload is inflated."""
    spark.dataSource.register(WarcSource)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    wanted = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(wanted).options(where=json.dumps([list(p) for p in where]), **options).load(path)


# An archive that keeps equal payloads once

#: Groups of equal payloads that are broadcast with their digest and their first id: some 20 MB.
BROADCAST_GROUPS = 200_000


def _with_first(rows: DataFrame, firsts: DataFrame, groups: int, most: int) -> DataFrame:
    """Adds ``first``, the least id of a row's group. Many groups are joined by a shuffle, but for those so large that
    there can be only ``most`` of them: these are broadcast, and so no task gets a large group."""
    if groups <= most:
        return rows.join(F.broadcast(firsts.select("digest", "first")), "digest", "left")
    total = firsts.agg(F.sum("n").alias("n")).first().n
    large = firsts.where(F.col("n") > max(10_000, total // most))
    hot = F.broadcast(large.select("digest", "first"))
    cold = firsts.join(large.select("digest"), "digest", "left_anti").select("digest", "first")
    return rows.join(hot, "digest").unionByName(rows.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(cold, "digest", "left"))


def record_id(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def page_id(id_: Column) -> Column:
    """The integer in a record's id."""
    return F.nullif(F.regexp_extract(id_, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")


def archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = LEAST_BYTES, broadcast_groups: int = BROADCAST_GROUPS, **options,
) -> None:
    """Writes a record for each row: a response with its payload, or a revisit that names the response of the least id
    among the rows of equal payload, if that has ``least_bytes`` bytes at least.

    A null payload is an empty one. Rows of a null id are never first, unless all of their group are: then each is a
    response. Repeated rows of the least id are each a response. A null address is left out, and blanks and control
    characters in one become percent codes. Payloads of any length that a task can hold; an empty table leaves an
    archive without files; further columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = written(same.where("n > 1 and first is not null"), "firsts")
    joined = _with_first(rows, firsts, firsts.count(), broadcast_groups)
    again = F.coalesce(~F.col("id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    out = joined.select(
        record_id(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lower(F.hex("digest")).alias("payload_digest"), F.when(again, record_id(F.col("first"))).alias("refers_to"), "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    pages.sparkSession.dataSource.register(WarcSource)
    out.write.format("warc").mode("append").options(**options).save(path)


def query(spark, sf_dir: str) -> DataFrame:
    """All pages, archived and read back: of responses the payload itself is measured, revisits tell of theirs."""
    path = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    names = ("record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload")
    back = read(spark, path, names, [("record_type", "in", ["response", "revisit"])])
    held = F.col("record_type") == "response"
    return back.select(
        page_id(F.col("record_id")).alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_id(F.col("refers_to")).alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), g AS (
  SELECT *, payload_bytes >= {LEAST_BYTES} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM g
"""
