"""WARC: records written with segments and chunked framing, and read back by segment reassembly.

Every page becomes an HTTP response (chunked) in one record, or in one record and continuation records where it is
longer than a segment. Spark's text writer puts the records into files, one after another, each ended by CRLF CRLF.
Reading takes whole files, whose size the writer bounds, and finds records by their Content-Length. Segments meet by
WARC-Segment-Origin-ID, are put in the order of WARC-Segment-Number, must have the total length that the last one
states, and the chunked framing is then taken away.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table

CRLF = b"\r\n"
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Records a file holds at most; with segments of SEGMENT_BYTES a file stays under about 20 MB.
FILE_RECORDS = 512
#: Stands for a null page id; URL encoding leaves no "!" in others.
NULL_ID = "!"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_chunks(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"


def unframe_chunks(b: bytes) -> bytes:
    """The body of chunked transfer framing (extensions and trailers are skipped); ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = b.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(b[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        if n < 0 or b[end + 2 + n : end + 4 + n] != CRLF:
            raise ValueError("chunk is short")
        out.append(b[end + 2 : end + 2 + n])
        at = end + 4 + n


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF CRLF that ends it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def record_id(page: str, sha: str, copy: int) -> str:
    """The record id of a page: its id (URL-encoded text), the SHA-1 of its payload, and a running number among equal rows."""
    return f"<urn:page:{page}:{sha}:{copy}>"


def page_of(rid: str | None) -> str | None:
    """The page id in a record id; None where there is none."""
    page = rid[10:-1].split(":")[0] if rid else NULL_ID
    return None if page == NULL_ID else unquote_plus(page)


def page_records(page: str, url: str, payload: bytes, refers_to: str | None, copy: int = 0, segment: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> list[bytes]:
    """The records of a page: one response or revisit, with continuations. page and refers_to are URL-encoded ids."""
    sha = hashlib.sha1(payload).hexdigest()
    rid = record_id(page, sha, copy)
    head = [("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        # A revisit holds the headers alone: the payload is that of the record it refers to.
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha, 0)), ("Content-Type", "application/http; msgtype=response")]
        return [_record([*more, *head], http)]
    block = http + frame_chunks(payload)
    more = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [_record([*more, *head], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record([*more, *head, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k)), *last], part))
    return out


def parse_records(b: bytes):
    """(headers by lower-case name, block) of each record of a file; ValueError where a record is broken."""
    at = 0
    while at < len(b):
        if b.startswith(CRLF, at):  # blank lines between records
            at += 2
            continue
        if not b.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = b.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("header is cut off")
        head = dict(((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in b[at:end].decode("utf-8", "replace").split("\r\n")[1:])))
        n = int(head["content-length"])
        if end + 4 + n > len(b):
            raise ValueError("block is cut off")
        yield head, b[end + 4 : end + 4 + n]
        at = end + 4 + n


def first_of_equal(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page, sha, refers_to) of pages (page_id, page, sha, bytes) that revisit a page with a smaller id and an equal payload of at least min_bytes."""
    keys = pages.filter(F.col("bytes") >= min_bytes).select("page_id", "page", "sha")
    least = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    return keys.join(least, "sha").filter("page_id is null or page_id != first").select("page", "sha", F.url_encode(F.col("first").cast("string")).alias("refers_to")).distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """WARC files of pages under path. Null html is an empty payload, a null url an empty one.

    Every row is written, ids of any type: rows with a null id revisit the smallest id with their payload, or are
    responses where there is none. Repeated rows (one id and one payload) are records of their own, all responses or all
    revisits; rows that share an id but not the payload are different pages.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("page", F.coalesce(F.url_encode(F.col("page_id").cast("string")), F.lit(NULL_ID))).withColumn("sha", F.sha1("payload"))
    again = first_of_equal(rows.select("page_id", "page", "sha", F.octet_length("payload").alias("bytes")), min_bytes)
    # The running number and the join share one shuffle, by page and payload.
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page", "sha").orderBy("url")) - 1).join(again, ["page", "sha"], "left")

    def make(batches):
        for pdf in batches:
            out = []
            for i, u, p, r, c in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["copy"], strict=True):
                out += page_records(i, u, p, r if isinstance(r, str) else None, c)
            yield pd.DataFrame({"record": out})

    records = rows.select("page", "url", "payload", "refers_to", "copy").mapInPandas(make, "record binary")
    # Bytes pass through the text writer as they are; its line separator is the end of a WARC record.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_records(spark, path: str) -> DataFrame:
    """(record_id, type, origin, number, total, uri, refers_to, digest, block) of all records of WARC files under path."""

    def parse(batches):
        import gzip

        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for h, block in parse_records(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    rid = h.get("warc-record-id")
                    rows.append((rid, h.get("warc-type"), h.get("warc-segment-origin-id", rid), int(h.get("warc-segment-number", 0)), int(h.get("warc-segment-total-length", -1)), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), block))
                yield pd.DataFrame(rows, columns=["record_id", "type", "origin", "number", "total", "uri", "refers_to", "digest", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, "record_id string, type string, origin string, number int, total long, uri string, refers_to string, digest string, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, type, uri, refers_to, digest, block) of whole records: unsegmented ones as they are, segments joined by origin.

    A repeated segment counts once. An origin without its first segment, with a gap, or whose joined length is not the
    stated total gives no row with a block: its block is null.
    """
    whole = records.filter("number = 0").select("record_id", "type", "uri", "refers_to", "digest", "block")
    parts = records.filter("number > 0").groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.struct("type", "uri", "refers_to", "digest"))).alias("first"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("s"),
    )
    ok = (F.element_at("s", 1)["number"] == 1) & (F.element_at("s", -1)["number"] == F.size("s")) & (F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"])) == F.col("total"))

    @F.pandas_udf("binary")
    def together(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else b"".join(b))

    # A page's segments are one row's size in all.
    joined = parts.select(F.col("origin").alias("record_id"), "first.type", "first.uri", "first.refers_to", "first.digest", F.when(ok, F.col("s.block")).alias("blocks"))
    joined = joined.select("record_id", "type", "uri", "refers_to", "digest", together("blocks").alias("block"))
    return whole.unionByName(joined)


def read_pages(spark, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload, stated_digest, record_type, refers_to, uri): payloads decoded; that of a revisit is null here."""

    def decode(batches):
        for pdf in batches:
            out = []
            for rid, kind, uri, to, d, block in zip(pdf["record_id"], pdf["type"], pdf["uri"], pdf["refers_to"], pdf["digest"], pdf["block"], strict=True):
                payload = None
                if kind == "response" and block is not None:
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = unframe_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if d and d != f"sha1:{digest(payload)}":
                        raise ValueError(f"{rid}: payload differs from its digest")
                out.append((page_of(rid), payload, d[5:] if d else None, kind, page_of(to), uri))
            # Ids pass through Python as text: numbers next to nulls would become floats.
            yield pd.DataFrame(out, columns=["page_id", "payload", "stated_digest", "record_type", "refers_to", "uri"], dtype=object)

    pages = reassemble(read_records(spark, path)).filter("type in ('response', 'revisit')").mapInPandas(decode, "page_id string, payload binary, stated_digest string, record_type string, refers_to string, uri string")
    return pages.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def page_digests(spark, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page that was written: both of the full payload, which a revisit takes from its response."""
    pages = read_pages(spark, path, id_type).select("page_id", F.octet_length("payload").cast("long").alias("n"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")
    pages = persist_table(pages, "pages")
    of = pages.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("of"))
    return pages.join(of, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("n", "of").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
