"""WARC archives: written by Spark's text writer, read by a Python data source.

A WARC record ends with two line ends, so a file of records is a text file whose line
separator is those two, and Spark's committed writes put it on any file system.  The
reader plans a partition per file, takes predicates on the record type and on headers
that the planner pushes down, parses a record's headers first, and steps over the
blocks of records that they reject, or of all where no payload is asked for.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this many bytes on are stored once.
LEAST_BYTES = 100
#: Revisits whose ids may be broadcast (24 bytes a row, about 60 MB as a hash table); beyond it the join shuffles.
MOST_BROADCAST = 500_000


def new_folder(parent: str) -> str:
    return f"{parent}/warc-{uuid.uuid4().hex}"


def _urn(key: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES, compression: str = "none") -> None:
    """One record for each row of ``pages`` (page_id, url, html), its payload the html in UTF-8.

    Of rows with equal payloads of ``least_bytes`` or more, that with the least page_id
    is a response, and the others revisit it without a payload.  A null html is an
    empty payload, and a null url leaves its header out.  A null page_id leaves its
    header out, and the row is always a response; so are rows that repeat both the
    least page_id and the payload.  No rows give a folder without records; other
    columns are ignored.  ``compression`` is none or gzip.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    known = base.select("page_id", "bytes", "digest").where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    from ..runtime import Scratch

    scratch = Scratch(pages.sparkSession, "warc")
    firsts = scratch.save(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_BROADCAST else firsts
    revisits = scratch.save(known.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct(), "revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= MOST_BROADCAST else revisits
    rows = base.join(revisits, ["page_id", "digest"], "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    page = F.col("page_id").cast("string")
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.concat_ws(":", page, "digest"))),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, line("WARC-Profile", F.lit(REVISIT))).otherwise(F.lit("")),
        F.when(again, line("WARC-Refers-To", _urn(F.concat_ws(":", F.col("first").cast("string"), "digest")))).otherwise(F.lit("")),
        optional("X-Page-Id", page),
        optional("X-Refers-To-Page", F.col("first").cast("string")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END + END).option("compression", compression).text(folder)
    scratch.drop(firsts, revisits)


COLUMNS = "record_type string, record_id string, page_id long, refers_to_page long, target_uri string, payload_digest string, payload_length long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "page_id": "x-page-id", "refers_to_page": "x-refers-to-page", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length"}
LONGS = {"page_id", "refers_to_page", "payload_length"}


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parse(stream, wanted, payload: bool):
    """(headers by lower-case name, payload or None) of the records that ``wanted`` takes.

    ``stream`` has readline, read and seek.  Blocks that are not wanted are stepped over.
    """
    while line := stream.readline():
        if not line.strip():
            continue  # between records
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = int(headers.get("content-length", 0))
        if not (keep := wanted(headers)) or not payload:
            stream.seek(length, io.SEEK_CUR)
            if keep:
                yield headers, None
            continue
        block = stream.read(length)
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, set | None]] = []  # values a header may have, any if None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In):
                values = f.value if isinstance(f, In) else [f.value]
                self.tests.append((HEADERS[name], {str(v) for v in values if v is not None}))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[name], None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else "file://"
        found = [WarcFile(prefix + x.path) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", "."))]
        return found or [WarcFile("")]

    def wanted(self, headers: dict) -> bool:
        return all(name in headers and (values is None or headers[name] in values) for name, values in self.tests)

    def read(self, partition):
        if not partition.path:
            return
        system, path = _file_system(partition.path)
        with system.open_input_file(path) as raw:
            stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(_Seekable(raw), 1 << 20)
            rows, held = [], 0
            for headers, payload in parse(stream, self.wanted, self.payload):
                row = [headers.get(h) for h in HEADERS.values()]
                rows.append((*(int(v) if v is not None and c in LONGS else v for c, v in zip(HEADERS, row, strict=True)), payload))
                held += len(payload or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


class _Seekable(io.RawIOBase):
    """A pyarrow file as a raw stream that a buffered reader takes."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, b):
        return self.file.readinto(b)

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def tell(self):
        return self.file.tell()


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64() if c in LONGS else pa.string() for c in HEADERS] + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*HEADERS, "payload"])


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option payload=false reads headers only."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path`` (a file or folder that pyarrow's file systems reach).

    Spark hands a Python source its filters but not the columns that a query needs, so a
    query without payloads says ``payload=False``, and blocks are then stepped over.  The
    session keeps pushing filters to Python sources, as that is decided when a query runs.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
