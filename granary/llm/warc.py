"""WARC archives with revisit resolution.

Writing: headers (page id, url, digest, length) are shuffled by payload digest;
of equal payloads the page with the largest id becomes the response and all
others become revisit records that refer to it, without payload. Payloads
aren't shuffled but where they must be: two filters of fixed size over the
repeated digests and over the rows that may be their responses tell where they
are read which pages are surely alone (written right there) and which are
surely revisits (their headers suffice). The rest, a page for each repeated
digest and a few by chance, is settled by an exact join.

Archives hold a warcinfo record and then records of ARCHIVE_BYTES together
before compression, or one larger record. Each record is a gzip member of its
own, so that readers can seek to it. Spark's own text sink writes the archives,
a row each, with its commit protocol, on any file system; a member's last
octet, zero in all members that are written here, serves as the sink's line
separator. The sink names the files part-*.txt; their content is .warc.gz.

Reading: each archive is parsed member by member and by Content-Length,
responses' digests are computed again from their payloads, and revisit records
are joined to their responses by payload digest.

Defined results: a null html is an empty payload; a null url gives an empty
target; a null page id ranks below all others; a page of any length is one
record; of pages with one payload and one id that with the larger hash of its
url is the response, and of rows alike in id, url and html one; an empty table
gives an empty result; other columns aren't read, whatever their names. What
the path held before is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, hash_filter, scratch, table, with_hit

MIN_BYTES = 0
ARCHIVE_BYTES = 16 << 20
LEVEL = 6
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32(digest: Column) -> Column:
    """Base32 of 20 octets: eight groups of five hex digits, each four letters."""
    letters = []
    for i in range(8):
        value = F.conv(F.substring(F.hex(digest), 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), sha, bytes and record_type of each row of ``pages`` (page_id, url, html)."""
    html = F.coalesce(pages["html"], F.lit(""))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha"), F.octet_length(html).cast("long").alias("bytes"), F.xxhash64(pages["url"]).alias("tie"))
    heads = checkpointed(own.select("page_id", "url", "sha", "bytes", "tie").where(F.col("bytes") >= min_bytes))
    shared = heads.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "tie")).alias("w")).where("n > 1")
    winners = checkpointed(shared.select("sha", F.col("w.page_id").alias("first_id"), F.col("w.tie").alias("first_tie")))
    digest, row = F.xxhash64("sha"), F.xxhash64("sha", "page_id", F.col("page_id").isNull(), "tie")
    wins = F.col("first_tie").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))

    repeated = hash_filter(winners.select(digest.alias("h")))
    held = with_hit(heads, "__shared", digest, repeated).where("__shared")
    needed = held.join(winners, "sha", "left").where(wins).select(row.alias("h"))
    payloads = hash_filter(needed)
    kind = lambda response: F.when(response, "response").otherwise("revisit").alias("record_type")
    names = ["page_id", "url", "html", "sha", "bytes"]

    rows = with_hit(with_hit(own, "__shared", digest, repeated), "__payload", row, payloads)
    open_ = F.col("__shared") & (F.col("bytes") >= min_bytes)
    alone = rows.where(~open_).select(*names, kind(F.lit(True)))
    bare = with_hit(held, "__payload", row, payloads).where("not __payload").select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "bytes", kind(F.lit(False)))
    alike = rows.where(open_ & F.col("__payload")).groupBy("sha", "page_id", "tie", "bytes").agg(F.count(F.lit(1)).alias("n"), F.first("url").alias("url"), F.first("html").alias("html"))
    each = alike.join(winners, "sha", "left").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    first = wins & ((F.col("nth") == 1) | F.col("first_tie").isNull())
    return alone.unionByName(bare).unionByName(each.select("page_id", "url", F.when(first, F.col("html")).alias("html"), "sha", "bytes", kind(first)))


def record(run: str, date: str, min_bytes: int = MIN_BYTES) -> Column:
    """A record with fresh headers. Ids are made of the run's name and, for responses that others may refer to, the digest alone."""
    revisit = F.col("record_type") == "revisit"
    digest = base32(F.col("sha"))
    original = _uuid(F.lit(run), F.lit("response"), digest)
    ident = F.when(revisit | (F.col("bytes") < min_bytes), _uuid(F.lit(run), "record_type", digest, F.monotonically_increasing_id().cast("string"))).otherwise(original)
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), ident),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), original)),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http, F.coalesce("html", F.lit("")), F.lit(CRLF * 2))


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose last octet is zero. That is the top octet of the data's length; longer data is followed by a member without data."""
    import gzip

    found = gzip.compress(data, level, mtime=0)
    return found if found[-1] == 0 else found + gzip.compress(b"", level, mtime=0)


def _archives(date: str):
    """Rows of records to rows of archives, each without its last octet."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def archive(members):
            body = f"software: granary{CRLF}format: WARC File Format 1.1{CRLF}".encode()
            head = [f"WARC/1.1{CRLF}WARC-Type: warcinfo", f"WARC-Record-ID: {uuid.uuid4().urn.join('<>')}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
            info = member(CRLF.join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *members])[:-1]], pa.binary())], names=["value"])

        held, size = [], 0
        for batch in batches:
            for value in batch.column("value"):
                data = value.as_py()
                if held and size + len(data) > ARCHIVE_BYTES:
                    yield archive(held)
                    held, size = [], 0
                held.append(member(data))
                size += len(data)
        if held:
            yield archive(held)

    return run


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Writes a record for each row (page_id, url, html) to archives in the folder ``path``. date: of the records, now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = decided(pages, min_bytes).select(record(uuid.uuid4().hex, date, min_bytes).cast("binary").alias("value"))
    archives = records.mapInArrow(_archives(date), "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def members(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The data of each gzip member that has any. What follows a member is looked at ``step`` octets at a time, since it is copied."""
    import zlib

    view, at = memoryview(content), 0
    while at < len(view):
        stream, parts = zlib.decompressobj(31), []
        while not stream.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a member")
            piece = view[at : at + step]
            parts.append(stream.decompress(piece))
            at += len(piece)
        at -= len(stream.unused_data)
        if data := b"".join(parts):
            yield data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at octet {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, stop = end + 4, end + 4 + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record ends badly at octet {stop}")
        yield headers, data[start:stop]
        at = stop + 4


RECORDS = "page_id long, url string, record_id string, record_type string, refers_to_record string, payload_digest string, payload_bytes long, digest_ok boolean"


def _parsed(batches: Iterator) -> Iterator:
    import base64
    import hashlib

    import pyarrow as pa

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            columns: list[list] = [[] for _ in names]
            for h, block in (x for data in members(content.as_py()) for x in parse(data)):
                if h["warc-type"] == "warcinfo":
                    continue
                response = h["warc-type"] == "response"
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                stated = h["warc-payload-digest"].removeprefix("sha1:")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else stated
                row = (int(h["x-page-id"]) if "x-page-id" in h else None, h["warc-target-uri"], h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), digest, len(payload) if response else None, digest == stated)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all archives under path, but for warcinfo."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parsed, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to. Revisits take length and page from the response with their digest that they refer to."""
    kept = ["page_id", "payload_digest", "record_type"]
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    originals = responses.select("payload_digest", F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes")
    joined = revisits.select(*kept, "refers_to_record").join(originals, ["payload_digest", "refers_to_record"], "left")
    return responses.select(*kept, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(joined.drop("refers_to_record")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path))


def _oracle() -> str:
    chunk = "CAST('0x' || substr(h, {i}, 5) AS BIGINT)"
    letters = " || ".join(f"substr('{BASE32}', CAST((({chunk.format(i=5 * i + 1)} >> {s}) & 31) + 1 AS INTEGER), 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {letters} AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM w"""


ORACLE = _oracle()
