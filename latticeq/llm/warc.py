"""WARC archives: writing with segmentation and chunked framing, reading with segment reassembly.

Writing. A page becomes a ``response`` record whose block is an HTTP response in chunked transfer framing; a block
longer than ``SEGMENT_BYTES`` is cut into a first segment and ``continuation`` records. Of records with equal
payloads of at least ``REVISIT_LEAST`` bytes, that with the largest page id is the response and the others are
``revisit`` records that name it. Spark's own text writer stores the records: a record ends in two line ends, which
are the writer's line separator, so the files are plain WARC files (gzip) on whatever store Spark can write to.

Reading. Files are parsed record by record by their declared lengths. Continuations are grouped by their origin's
identifier, ordered by segment number, checked for gaps and against the declared total length, and only then is the
chunked framing decoded. Revisits take size and digest from the response with their digest.

Defined cases: null html is an empty payload; a null url is written as an empty one; null page ids are left out of
the header and read back as null, and never become the response of a revisit; repeated rows that hold the largest
page id are responses all; other columns, whatever their names, are not looked at; an empty table gives none.
A record that breaks a rule comes back with ``fault`` saying which, and without a payload; what it still tells of
itself is kept. Where a file's records cannot be told apart any more (a header without an end or a length, or a
length that leads nowhere) one faulty row stands for it, and reading goes on at the next line that opens a record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_slices, remove, shared_path

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
REVISIT_LEAST = 1000
FILE_RECORDS = 4000
SALTS = 16
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


class Fault(ValueError):
    """A record or a segment group that breaks a rule of the format."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        try:
            n = int(body[at:stop].split(b";")[0], 16) if stop >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            raise Fault("chunk size is missing")
        if n == 0:
            return b"".join(parts)
        at = stop + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise Fault("chunk is cut short")
        parts.append(body[stop + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, its transfer framing decoded."""
    head, gap, body = block.partition(END)
    if not gap:
        raise Fault("HTTP header has no end")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None, date: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without their closing line ends. ``owner``: the response that a revisit names."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    common = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    if owner is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", owner), ("Content-Type", "application/http;msgtype=response")], HTTP_HEAD)
        return
    block, kind = HTTP_HEAD + chunked(payload), ("Content-Type", "application/http;msgtype=response")
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *common, kind], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), kind], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        last = at + segment >= len(block)
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if last else None)],
            block[at : at + segment],
        )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT_BYTES) -> None:
    """Write every row of ``pages`` below ``path``."""
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= REVISIT_LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    # pages are dealt by themselves, not by their digest, so that one payload's many copies do not meet in one task
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    owners = groups.select(F.col("digest").alias("__digest"), F.col("size").alias("__size"), "owner", salts.alias("__salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("salt", salt).join(owners, (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")) & (F.col("salt") == F.col("__salt")), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("owner"))
    joined = joined.select("page_id", "url", F.when(F.col("owner").isNotNull() & revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", F.when(revisit, F.col("owner")).alias("owner"))
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches):
            rows = zip(*(c.to_pylist() for c in piece.columns))
            yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in records(*row, date, segment)], pa.binary())], schema=schema)

    out = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of a plain or gzip file, and what is wrong with its compression; what came before that is kept."""
    parts: list[bytes] = []
    while content[:2] == b"\x1f\x8b":  # members may follow one another
        inflate = zlib.decompressobj(31)
        try:
            for at in range(0, len(content), 1 << 16):
                parts.append(inflate.decompress(content[at : at + (1 << 16)]))
                if inflate.eof:
                    content = inflate.unused_data + content[at + (1 << 16) :]
                    break
            else:
                return b"".join(parts), "gzip data are cut short"
        except zlib.error as e:
            return b"".join(parts), f"gzip: {e}"
    return (b"".join(parts), "bytes after the gzip data" if content.strip(b"\0") else None) if parts else (content, None)


OPENING = re.compile(rb"(?:^|\r\n)(?=WARC/1\.[01]\r\n)")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (lower-case names), block and fault of every record of one file, plain or gzip."""
    content, flaw = inflated(content)
    at = 0
    while at < len(content):
        fields: dict[str, str] = {}
        block, fault = b"", None
        stop = content.find(END, at)
        if content[at : at + 5] != b"WARC/" or stop < 0:
            fault = "no record where one is due"
        else:
            lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            n = _number(fields.get("content-length"))
            if n is None or n < 0:
                fault = "content length is missing"
            else:
                block = content[stop + 4 : stop + 4 + n]
                after = stop + 4 + n + len(END)
                if len(block) < n or content[after - len(END) : after] != END:
                    fault = "record is cut short"
        yield fields, block, fault
        if fault is None:
            at = after
        else:  # go on where the next record opens
            opening = OPENING.search(content, at + 5)
            at = opening.end() if opening else len(content)
    if flaw:
        yield {}, b"", flaw


def reassemble(parts: list[tuple[int, bytes, int | None]]) -> bytes:
    """One block from its segments ``(number, bytes, total length)``, in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise Fault("segment numbers have a gap or a repeat")
    block = b"".join(p[1] for p in parts)
    if parts[-1][2] != len(block):
        raise Fault("total length differs")
    return block


def _number(text: str | None) -> int | None:
    """A header's number; None if there is none or it is not one."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


READ_FIELDS = [("page_id", "bigint"), ("url", "string"), ("record_type", "string"), ("digest", "string"), ("refers_to", "bigint"), ("payload", "binary"), ("fault", "string")]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _described(fields: dict[str, str], block: bytes | None, fault: str | None = None) -> tuple:
    payload = None
    if fault is None and fields.get("warc-type") == "response":
        try:
            payload = http_payload(block)
            told = fields.get("warc-payload-digest")
            if told is not None and told.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != told.removeprefix("sha1:"):
                payload, fault = None, "digest differs"
        except Fault as e:
            fault = str(e)
    if fault is None and "x-page-id" in fields and _number(fields["x-page-id"]) is None:
        payload, fault = None, "page id is no number"
    return _number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("x-refers-to-page-id")), payload, fault


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, digest, refers_to, payload, fault`` of every response and revisit below ``path``.

    All files count, whatever their names, but those that begin with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole_schema = pa.schema([(n, _ARROW[k]) for n, k in READ_FIELDS])
    part_fields = [("origin", "string"), ("number", "bigint"), ("total", "bigint"), ("block", "binary"), ("head", "binary")]
    part_schema = pa.schema([(n, _ARROW[k]) for n, k in part_fields])

    def contents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py()

    def gathered(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows:
            held.append(r)
            if len(held) == 256:
                yield _batches(held, schema)
                held = []
        if held:
            yield _batches(held, schema)

    def whole(batches):
        def told(f: dict[str, str], fault: str | None) -> bool:
            return fault is not None or "warc-segment-number" not in f and f.get("warc-type", "response") in ("response", "revisit")

        yield from gathered((_described(f, b, fault) for c in contents(batches) for f, b, fault in parse(c) if told(f, fault)), whole_schema)

    def segments(batches):
        def rows():
            for content in contents(batches):
                for f, block, fault in parse(content):
                    if "warc-segment-number" in f and fault is None:
                        head = None if f.get("warc-type") == "continuation" else "\n".join(f"{k}:{v}" for k, v in f.items()).encode("utf-8", "surrogatepass")
                        yield f.get("warc-segment-origin-id") or f.get("warc-record-id") or "", _number(f["warc-segment-number"]) or 0, _number(f.get("warc-segment-total-length")), block, head

        yield from gathered(rows(), part_schema)

    def joined(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next((r["head"] for r in rows if r["head"] is not None), None)
        if head is None:
            out = (None, None, "response", None, None, None, "origin record is missing")
        else:
            fields = {k: v for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\n"))}
            try:
                out = _described(fields, reassemble([(r["number"], r["block"], r["total"]) for r in rows]))
            except Fault as e:
                out = _described(fields, None, str(e))
        return pa.Table.from_batches([_batches([out], whole_schema)])

    ddl = ", ".join(f"{n} {k}" for n, k in READ_FIELDS)
    parts = files.mapInArrow(segments, ", ".join(f"{n} {k}" for n, k in part_fields))
    return files.mapInArrow(whole, ddl).unionByName(parts.groupBy("origin").applyInArrow(joined, ddl))


def resolve(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, fault``; a revisit has its response's size.

    Faulty records keep their fault and have no payload; a revisit without a sound response is at fault itself.
    """
    told = cut(found.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "digest", "refers_to", "fault"))
    sound = F.col("fault").isNull()
    responses = told.where(~(sound & F.col("record_type").eqNullSafe("revisit")))
    sizes = responses.where(sound).groupBy(F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("bytes"))
    sizes = sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = told.where(sound & (F.col("record_type") == "revisit")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = revisits.join(sizes, (F.col("digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt")), "left")
    lost = F.when(F.col("bytes").isNull(), "its response is missing")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "fault").unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", lost.alias("fault"))
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 6: all pages, written into the shared folder and read back."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = resolve(read_archives(spark, path))  # what it keeps is in the checkpoint folder by now
    remove(spark, path)
    return found


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS owner FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to, NULL::VARCHAR AS fault
FROM o
"""
