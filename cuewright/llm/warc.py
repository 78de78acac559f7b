r"""WARC archives written and read by Spark, and their transactions put together.

``write_captures`` makes a request, a response (or a revisit) and a metadata record of every
row of a page table. Of captures with equal payloads of at least MIN_REVISIT bytes the one
with the smallest id holds the payload; the others are revisit records that refer to it. The
archives are gzip files of WARC/1.1 records, each followed by two line ends, written by Spark's
text writer, so that they land in whatever store the folder is in.

``read_records`` reads archives of any origin (gzip, one member or one a record, or plain) as
rows, by the lengths that records state, so that a payload may hold anything. Files of any size are
streamed: Spark's text reader cuts them where a record could begin, and a task holds one record. Gzip
files are those named .gz in any case; all others are plain, which several tasks read, and whose parts are sorted.
``transactions`` joins request, response and metadata records through their
WARC-Concurrent-To identifiers into one nested row a capture.

Nulls and ties: a null payload is empty; a null id sorts after the others and comes back as
null; a null url is written as an empty target; rows that repeat an id are captures of their
own (if they share the smallest id and a payload, one of them is the response); an empty table
gives an empty result. Extra columns are not read. A file holds at most FILE_ROWS captures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_hot, saved, shared_path, table

MIN_REVISIT = 100
FILE_ROWS = 2000
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, record_id: Column, fields: dict[str, Column], block: Column) -> Column:
    """The text of a record; fields with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END * 2), block)


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), id_, F.lit(">"))


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of ``pages`` in the folder ``path``."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("number"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    rows = saved(
        rows.withColumn("digest", F.sha2(F.encode("payload", "utf-8"), 256)).withColumn("bytes", F.octet_length("payload")).withColumn("capture", F.uuid()),
        "captures",
    )  # written, since record ids are drawn at random
    order = F.struct(F.col("number").isNull().alias("none"), "number", "capture")
    narrow = rows.where(F.col("bytes") >= MIN_REVISIT).select("capture", "digest", "number")
    first = saved(narrow.groupBy(F.col("digest").alias("of")).agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("of", F.col("f.capture").alias("first")), "firsts")
    repeats = join_hot(narrow.select("capture", "digest"), first, {"digest": "of"}, ["capture"], 160, "inner").where(F.col("first") != F.col("capture"))
    repeats = saved(repeats.select(F.col("capture").alias("_capture"), "first"), "repeats")
    rows = rows.join(broadcast_if_small(repeats, 160), F.col("capture") == F.col("_capture"), "left").drop("_capture")
    revisit = F.col("first").isNotNull()

    at, sha = F.lit("2024-01-01T00:00:00Z"), F.concat(F.lit("sha256:"), F.col("digest"))
    response_id = _urn(F.col("capture"))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": at}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    reply = {**common, "WARC-Payload-Digest": sha, "Content-Type": F.lit("application/http; msgtype=response")}
    path_of = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path_of == "", F.lit("/")).otherwise(path_of), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[a-zA-Z]+://([^/]*)", 1), F.lit(_END * 2))
    about = F.concat(F.concat_ws(_END, F.concat(F.lit("page-id: "), F.col("id")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"))), F.lit(_END))
    beside = {**common, "WARC-Concurrent-To": response_id}
    records = F.array(
        _record("request", _urn(F.uuid()), {**beside, "Content-Type": F.lit("application/http; msgtype=request")}, asked),
        F.when(revisit, _record("revisit", response_id, {**reply, "WARC-Profile": F.lit(_PROFILE), "WARC-Refers-To": _urn(F.col("first"))}, http)).otherwise(_record("response", response_id, reply, F.concat(http, F.col("payload")))),
        _record("metadata", _urn(F.uuid()), {**beside, "Content-Type": F.lit("application/warc-fields")}, about),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", _END * 2).option("maxRecordsPerFile", 3 * FILE_ROWS).option("compression", "gzip").text(path)


_BETWEEN = b"WARC/1."


def _stated(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers (names in lower case) of the record that begins at a place, where its block begins and where it ends."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at) or end < 0:
        raise ValueError(f"no WARC record: {data[at : at + 40]!r}")
    headers = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, end + 4, end + 4 + int(headers["content-length"])


def whole_records(parts: Iterator[tuple[object, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from (file, part) in order: files cut at _BETWEEN.

    Only the stated lengths say where a record ends. Where _BETWEEN stands in a payload, parts are put
    together again; where a reader missed it, a part holds several records, and each comes out. What
    is neither a record nor line ends between two is an error, so that nothing is lost unseen."""
    file, held, size, need = None, [], 0, 0

    def finished() -> Iterator[tuple[dict[str, str], bytes]]:
        data, at = b"".join(held), 0
        while at < len(data):
            headers, begins, ends = _stated(data, at)
            if ends > len(data):
                raise ValueError(f"a WARC record lacks {ends - len(data)} bytes")
            yield headers, data[begins:ends]
            at = ends
            while data[at : at + 2] == b"\r\n":
                at += 2

    for name, part in parts:
        if name == file and held and size < need:
            held += [_BETWEEN, part]
            size += len(_BETWEEN) + len(part)
            continue
        if held:
            # a record that was begun behind another one in the same part may go on in this one
            rest = _begun(b"".join(held)) if name == file else 0
            if rest:
                held += [_BETWEEN, part]
                size += len(_BETWEEN) + len(part)
                need = size + rest - len(_BETWEEN) - len(part)
                continue
            yield from finished()
        start = _BETWEEN + part if name == file else part.lstrip(b"\r\n")
        file, held, size = name, [start] if start else [], len(start)
        need = _stated(start)[2] if start else 0
    if held:
        yield from finished()


def _begun(data: bytes) -> int:
    """Bytes that the last record in ``data`` lacks."""
    at = 0
    while at < len(data):
        at = _stated(data, at)[2]
        if at > len(data):
            return at - len(data)
        while data[at : at + 2] == b"\r\n":
            at += 2
    return 0


_FIELDS = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")
_RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, content_type string, http_head string, content string, content_bytes long, content_digest string"


def _told(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.int64() if n == "content_bytes" else pa.string() for n in names]
    out, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    for headers, block in records:
        head, body = "", block
        if headers.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head, body = (block[:cut].decode("latin-1"), block[cut + 4 :]) if cut >= 0 else (block.decode("latin-1"), b"")
        out.append((*(headers.get(f) for f in _FIELDS), head, body.decode("utf-8", "replace"), len(body), hashlib.sha256(body).hexdigest()))
        size += len(body) + 200
        if size > 1 << 22:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _told(whole_records((f.as_py(), v.as_py()) for b in batches for f, v in zip(b.column(0), b.column(1), strict=True)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``, whatever their names; content is the block without its HTTP head."""
    parts = spark.read.option("lineSep", _BETWEEN.decode()).text(path)
    parts = parts.select(F.lower("_metadata.file_name").alias("name"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    packed = F.col("name").endswith(".gz")
    # a plain file is read by several tasks; its parts come together again in their order, by way of sorted files on disk
    plain = parts.where(~packed).select("file", "block", F.monotonically_increasing_id().alias("n"), "value")
    plain = plain.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "value")
    return parts.where(packed).select("file", "value").mapInArrow(_streamed, _RECORD).union(plain.mapInArrow(_streamed, _RECORD))


def transactions(records: DataFrame) -> DataFrame:
    """A nested row for each capture: record_id, response (or revisit), request, metadata (null where missing)."""
    main = records.where(F.col("type").isin("response", "revisit"))
    part = lambda kind: records.where(F.col("type") == kind)
    whole = lambda names: F.struct(*names)
    names = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    out = main.select("record_id", whole(names).alias("response"))
    for kind in ("request", "metadata"):
        beside = part(kind).where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("_to")).agg(F.min(F.struct("record_id", *names)).alias(kind))
        out = out.join(beside, F.col("record_id") == F.col("_to"), "left").drop("_to")
    return out


def captures(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """``transactions`` of the archives in ``path``, with id, payload_bytes and payload_digest of the
    whole payload, and for revisits the id of the response that they refer to. Without content, what
    a response holds is left out once its length and digest are taken."""
    records = read_records(spark, path)
    if not with_content:
        records = records.withColumn("content", F.when(F.col("type") == "metadata", F.col("content")))
    records = saved(records, "records")
    out = transactions(records)
    field = lambda name: F.nullif(F.regexp_extract("metadata.content", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    out = out.withColumn("id", field("page-id"))
    revisit = F.col("response.type") == "revisit"
    out = out.withColumn("payload_bytes", F.when(revisit, F.regexp_extract("response.http_head", r"(?mi)^content-length: *(\d+)", 1).cast("long")).otherwise(F.col("response.content_bytes")))
    out = out.withColumn("payload_digest", F.when(revisit, F.regexp_extract("response.payload_digest", "^sha256:([0-9a-f]{64})$", 1)).otherwise(F.col("response.content_digest")))
    ids = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("_target"), F.regexp_extract("content", r"(?m)^page-id: (.*?)\r?$", 1).alias("refers_to"))
    # only revisits refer to a record, many of them perhaps to the same; of all ids, those that are referred to are told
    out = saved(out.withColumn("_at", F.col("response.refers_to")), "transactions")
    wanted = saved(out.where("_at is not null").select(F.col("_at").alias("_wanted")).distinct(), "wanted")
    ids = ids.join(broadcast_if_small(wanted, 96), F.col("_target") == F.col("_wanted"), "left_semi")
    told = join_hot(out.where("_at is not null"), saved(ids, "ids"), {"_at": "_target"}, ["record_id"], 160).drop("_at")
    out = out.drop("_at")
    return told.unionByName(out.where(F.col("response.refers_to").isNull()).withColumn("refers_to", F.lit(None).cast("string")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    write_captures(pages, path)
    kind = pages.schema["page_id"].dataType
    return captures(spark, path, with_content=False).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("response.type").alias("record_type"), F.nullif("refers_to", F.lit("")).cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id) AS r FROM pages),
q AS (SELECT page_id, r, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS f, row_number() OVER w AS n FROM q WINDOW w AS (PARTITION BY payload_digest ORDER BY r))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND n > 1 THEN f END AS refers_to FROM f
"""
