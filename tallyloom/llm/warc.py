"""WARC archives: writing captures with request, response and metadata records, reading them back, and joining them again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, named, utf8
from tallyloom.llm.components import connected_components

#: Fixed values of the format (WARC 1.1) and of base 32 (RFC 4648).
VERSION, CRLF = "WARC/1.1", "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Types that a capture is made of besides requests and metadata.
CAPTURED = ("response", "revisit", "resource")
#: Bytes of an archive before compression, about; payloads shared by several captures up to which they are broadcast.
ARCHIVE_BYTES, MOST_SHARED = 256 << 20, 200_000
#: Bytes that are unpacked at once, and payload bytes after which a batch of records is sent on.
CHUNK, BATCH_BYTES = 1 << 20, 4 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a binary column: 160 bits are four times eight digits of five bits."""
    quarter = lambda k: F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[quarter(k) for k in range(4)]), BASE32_DIGITS, BASE32)


# -- writing ----------------------------------------------------------------------------------------------------------


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as bytes: version, fields (those that are null are left out), and the block with its length."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    head = F.concat(F.lit(VERSION + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(head.cast("binary"), block, F.lit(CRLF + CRLF).cast("binary"))


def _urn(*of: Column | str) -> Column:
    """A record's id, from what tells it apart: the same if a lost task writes it again."""
    h = F.md5(F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in of]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit(end)) for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", least_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES, most_shared: int = MOST_SHARED) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row, as gzip-compressed WARC files under ``path``.

    Payloads (texts as UTF-8; null ones are empty) of ``least_revisit`` bytes or more that are equal are written once, in
    the response of the smallest id; the others are revisits that refer to it. Of several rows with that id one is the
    response, that of the smallest url. The three records follow each other, and request and metadata name the response as
    concurrent; the row's id is a field of the metadata. Null ids come last and are left out of the metadata, null urls
    out of the header; line breaks in urls are percent-encoded. An empty table gives a folder without records.

    Files are Spark's own output, so a lost task is written again and any store will do. Whether a payload is shared is
    found on digests; payloads are shuffled only if more than ``most_shared`` are, else those are broadcast.
    """
    payload = utf8(named(pages, payload_col)) if dict(pages.dtypes)[payload_col] != "binary" else F.coalesce(named(pages, payload_col), F.lit(b""))
    url = F.replace(F.replace(named(pages, url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(named(pages, id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    same = checkpoint(rows.groupBy("digest", "bytes", "id", "url").agg(F.count(F.lit(1)).alias("copies")))
    total = same.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("bytes")).alias("bytes")).first()
    key = F.struct(F.col("id").isNull().alias("last"), "id", F.col("url").isNull().alias("none"), "url")
    shared = same.where(F.col("bytes") >= least_revisit).groupBy("digest", "bytes").agg(F.sum("copies").alias("of"), F.min(key).alias("first")).where("of > 1")
    shared = checkpoint(shared.select("digest", "bytes", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("is_shared")))
    shared = F.broadcast(shared) if shared.count() <= most_shared else shared
    repeated = same.where("copies > 1")
    if not repeated.isEmpty():
        # rows with one id, url and payload: each gets a number of its own, written out from one row and its count
        mark = repeated.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("id").alias("i"), F.col("url").alias("u"))
        hit = (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u"))
        mark = F.broadcast(mark) if mark.count() <= most_shared else mark
        alone = rows.join(mark, hit, "left_anti").withColumn("copy", F.lit(1).cast("long"))
        many = rows.join(mark, hit, "left_semi").groupBy("digest", "bytes", "id", "url").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies"))
        many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        rows = alone.unionByName(many.select(*alone.columns))
    else:
        rows = rows.withColumn("copy", F.lit(1).cast("long"))
    rows = rows.join(shared, ["digest", "bytes"], "left")
    first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 1)
    rows = rows.withColumn("revisits", F.coalesce(F.col("is_shared"), F.lit(False)) & ~first)
    urn = lambda kind: _urn(kind, F.col("id"), F.col("url"), F.col("digest"), F.col("copy"))
    rows = rows.withColumns({"own": urn("response"), "to": _urn("response", F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(1))})
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    if_revisit = lambda x: F.when(F.col("revisits"), x)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)).cast("binary")
    path_of = F.regexp_replace(F.coalesce("url", F.lit("/")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    get = F.concat(F.lit("GET "), F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), path_of)), F.lit(" HTTP/1.1\r\n\r\n")).cast("binary")
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("fetch-copy: "), F.col("copy").cast("string"), F.lit(CRLF)).cast("binary")
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", urn("request")), *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/http; msgtype=request")], get)
    response = _record(
        [("WARC-Type", F.when(F.col("revisits"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("own")), *common, ("WARC-Payload-Digest", digest),
         ("WARC-Profile", if_revisit(F.lit(IDENTICAL))), ("WARC-Refers-To", if_revisit(F.col("to"))), ("WARC-Refers-To-Target-URI", if_revisit(F.col("first_url"))), ("Content-Type", "application/http; msgtype=response")],
        F.when(F.col("revisits"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", urn("metadata")), *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/warc-fields")], about)
    # the writer puts the last line break, half of what ends the last record
    capture = F.concat(request, response, metadata)
    lines = rows.select(F.substring(capture, F.lit(1), F.length(capture) - len(CRLF)).cast("string").alias("value"))
    mean = 1200 + (total["bytes"] or 0) / max(1, total["n"] or 0)
    lines.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


# -- reading ----------------------------------------------------------------------------------------------------------

RECORD = "path string, record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, headers map<string,string>, http_headers map<string,string>, payload binary, payload_bytes long, payload_digest string"
_SCHEMA = pa.schema([
    ("path", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


class _Stream:
    """The bytes of an archive from its start, plain or gzip-compressed, whole or record by record; a part at a time."""

    def __init__(self, content: memoryview):
        self.content, self.at, self.held, self.start = content, 0, bytearray(), 0
        self.packed, self.inflater = bytes(content[:2]) == b"\x1f\x8b", None

    def more(self) -> bool:
        """Adds to what is held; False at the end."""
        del self.held[: self.start]
        self.start = 0
        while self.at < len(self.content):
            part = self.content[self.at : self.at + CHUNK]
            if not self.packed:
                self.at += len(part)
                self.held += part
                return True
            self.inflater = self.inflater or zlib.decompressobj(31)
            out = self.inflater.decompress(part)
            self.at += len(part) - len(self.inflater.unused_data)
            if self.inflater.eof:
                self.inflater = None
            if out:
                self.held += out
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        """The bytes before ``end``, which is passed over; None if it doesn't come."""
        looked = self.start
        while (found := self.held.find(end, looked)) < 0:
            seen = len(self.held) - self.start
            if not self.more():
                return None
            looked = max(0, seen - len(end) + 1)
        out, self.start = bytes(self.held[self.start : found]), found + len(end)
        return out

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes; an error where there are fewer."""
        while len(self.held) - self.start < size:
            if not self.more():
                raise ValueError("archive ends inside a record")
        out, self.start = bytes(self.held[self.start : self.start + size]), self.start + size
        return out

    def blank(self) -> bool:
        """Passes over line breaks between records; whether any bytes are left."""
        while True:
            while self.start < len(self.held) and self.held[self.start] in b"\r\n":
                self.start += 1
            if self.start < len(self.held):
                return True
            if not self.more():
                return False


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Named fields, names in lower case; a line that starts with a blank goes on with the field before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _records(path: str, content: memoryview, payloads: bool) -> Iterator[tuple]:
    """The rows of one archive. What is repeated among fields comes joined by a comma; Concurrent-To is a list."""
    stream = _Stream(content)
    while stream.blank():
        head = stream.until(b"\r\n\r\n")
        lines = (head or b"").decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{path} is no WARC archive, or damaged")
        fields = _fields(lines[1:])
        headers: dict[str, str] = {}
        for name, value in fields:
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
        block, kind = stream.take(int(headers["content-length"])), headers.get("warc-type")
        http: dict[str, str] | None = None
        payload: bytes | None = block
        if headers.get("content-type", "").startswith("application/http"):
            start, _, payload = block.partition(b"\r\n\r\n")
            http = dict(_fields(start.decode("utf-8", "replace").split(CRLF)[1:]))
        size: int | None = len(payload)
        if kind == "revisit":  # its block has no payload, but tells how long that is
            payload, size = None, int(http["content-length"]) if http and http.get("content-length", "").isdigit() else None
        digest = headers.get("warc-payload-digest", "")
        yield (
            path, headers.get("warc-record-id"), kind, headers.get("warc-date"), headers.get("warc-target-uri"), [v for n, v in fields if n == "warc-concurrent-to"], headers.get("warc-refers-to"),
            list(headers.items()), None if http is None else list(http.items()), payload if payloads or kind not in CAPTURED else None, size, digest.removeprefix("sha1:") if digest.startswith("sha1:") else None,
        )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path`` (plain or gzip, whole files or single records compressed).

    path, record_id, type, date, target_uri, concurrent_to (a list), refers_to, headers and http_headers (names in lower
    case), payload (the block without its HTTP head; null in revisits), payload_bytes (of the whole payload, in revisits
    as the HTTP head says), payload_digest (base 32, as the record says). With ``payloads`` False those of captures are left
    out. An archive is read by one task, which holds it compressed and unpacks a part at a time; it may have 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
        for batch in batches:
            for k in range(batch.num_rows):
                for row in _records(batch.column("path")[k].as_py(), memoryview(batch.column("content")[k].as_buffer()), payloads):
                    held.append(row)
                    size += 500 + len(row[9] or b"")
                    if size >= BATCH_BYTES:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(run, RECORD)


# -- assembling -------------------------------------------------------------------------------------------------------


def _transactions(heads: DataFrame) -> DataFrame:
    """(record_id, capture_id) for records that are no captures, by the records named as concurrent, whichever names the other.

    Nearly all name their response or are named by it: one join. The rest go by the connected parts that they are in.
    """
    named_ = heads.select("record_id", F.explode("concurrent_to").alias("other"))
    edges = named_.unionByName(named_.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    anchors = heads.where(F.col("type").isin(*CAPTURED)).select(F.col("record_id").alias("other"))
    others = heads.where(~F.coalesce(F.col("type").isin(*CAPTURED), F.lit(False))).select("record_id").where("record_id is not null").distinct()
    direct = checkpoint(edges.join(others, "record_id", "left_semi").join(anchors, "other").groupBy("record_id").agg(F.min("other").alias("capture_id")))
    rest = checkpoint(others.join(direct, "record_id", "left_anti"))
    if rest.isEmpty():
        return direct
    number = checkpoint(rest.withColumn("node", F.monotonically_increasing_id()))
    inner = edges.join(number, "record_id").join(number.select(F.col("record_id").alias("other"), F.col("node").alias("b")), "other")
    parts = connected_components(inner.select(F.col("node").alias("a"), "b"))
    own = checkpoint(number.join(parts, "node", "left").select("record_id", F.coalesce("component", "node").alias("part")))
    led = own.join(edges, "record_id").join(direct.select(F.col("record_id").alias("other"), "capture_id"), "other").groupBy("part").agg(F.min("capture_id").alias("capture_id"))
    alone = own.groupBy("part").agg(F.min("record_id").alias("least"))
    settled = own.join(alone, "part").join(led, "part", "left").select("record_id", F.coalesce("capture_id", "least").alias("capture_id"))
    return direct.unionByName(settled)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row for each capture in the archives under ``path``: (capture_id, response, requests, metadata).

    ``response`` is the response, revisit or resource record; ``requests`` and ``metadata`` are lists of the records
    (metadata's are all others) that belong to it by Concurrent-To, in whichever direction and over however many steps; a record that could belong to
    several goes to the smallest id. Records without any capture make one of their own, with a null response.

    The archives are read twice: once for everything but the captures' payloads, which is kept, and once for these, which
    move once, to meet the rest. An empty folder gives no rows.
    """
    heads = checkpoint(read_records(spark, path, payloads=False))
    small = heads.where(~F.coalesce(F.col("type").isin(*CAPTURED), F.lit(False)))
    one = F.struct("record_id", "type", "date", "target_uri", "headers", "http_headers", "payload")
    is_request = F.col("type") == "request"
    lists = small.join(_transactions(heads), "record_id").groupBy("capture_id").agg(F.collect_list(F.when(is_request, one)).alias("requests"), F.collect_list(F.when(~F.coalesce(is_request, F.lit(False)), one)).alias("metadata"))
    responses = read_records(spark, path).where(F.col("type").isin(*CAPTURED))
    responses = responses.select(F.col("record_id").alias("capture_id"), F.struct("record_id", "type", "date", "target_uri", "refers_to", "headers", "http_headers", "payload", "payload_bytes", "payload_digest").alias("response"))
    return responses.join(lists, "capture_id", "full")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives that ``write_archives`` wrote.

    Sizes and digests of responses are those of the payloads that were read, of revisits those that their records state;
    ``refers_to`` is the page of the response that a revisit names. A null id comes back as null.
    """
    text = F.decode(F.col("metadata")[0]["payload"], "UTF-8")
    page = F.nullif(F.regexp_extract(text, r"(?m)^page-id: (-?\d+)\r?$", 1), F.lit("")).cast("long")
    payload, whole = F.col("response.payload"), F.col("response.type") != "revisit"
    rows = captures(spark, path).where("response is not null").select(
        "capture_id", page.alias("page_id"), F.when(whole, F.octet_length(payload).cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(whole, base32_sha1(payload)).otherwise(F.col("response.payload_digest")).alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"),
    )
    rows = checkpoint(rows)
    firsts = rows.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    revisits = rows.where("record_type = 'revisit'").join(firsts, "to", "left")
    none = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return none.select(*columns).unionByName(revisits.select(*columns))
