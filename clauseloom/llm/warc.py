"""WARC archives: a writer with revisit records and a splittable reader.

Writing: payloads of at least ``min_revisit`` bytes that are equal form a group; the record with the
largest page_id is the response, the others are revisits of it. Each record is one gzip member. The
members go through Spark's text sink, so they reach any store that Spark can write and lost tasks are
committed once. Its line separator is the byte 0, which is the last byte of every gzip member of less than
16 MB of data; longer ones are followed by an empty member.

Reading: the text source cuts the byte range of each task at the gzip magic 1f 8b 08. Its rule that a
piece belongs to the range in which it begins makes a task own the records that start inside. The first piece
of a range that is a member by its header and its first decoded bytes, those of a WARC record, is where the task
begins; from there on members follow each other, and a piece that ends before its member does goes on in the
next, as the data happened to hold the magic. Members cut by the end of a range are joined with the pieces
that open the next ranges. (A range that begins inside a payload which is itself an uncompressed archive can take a
inner record for its first; the member around it is then found cut and reported as damaged.) Archives must not be named .gz, which Hadoop would not split.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import batch, lean, public_id, row_id, stage_dir

_MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = _MAGIC + bytes(6) + b"\xff\x03\x00" + bytes(8)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _uri(text: str | None) -> str | None:
    return None if text is None else "".join(c if "!" <= c <= "~" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in text)


def record(page: int | None, url: str | None, payload: bytes, sha1: bytes, refers: int | None, date: str) -> bytes:
    """One WARC record; a revisit (refers) holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    name = "null" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(date: str):
    out = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for page, url, html, sha, refers in zip(b["page"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), b["sha"].to_pylist(), b["refers"].to_pylist(), strict=True):
                done.append(member(record(page, url, html or b"", bytes.fromhex(sha), refers, date))[:-1])
            yield batch(out, value=done)

    return run, "value binary"


def write_archives(pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for every row of pages (page_id, url, html) under path.

    A null html is an empty payload; a null url leaves its header out; rows that repeat a page_id are records
    of their own. Other columns are not read.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(row_id("page_id").alias("_p"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha1("html"))
    large = F.octet_length("html") >= min_revisit
    groups = rows.where(large).groupBy("sha").agg(F.max("_p").alias("newest"), F.count("*").alias("copies")).where("copies > 1").select("sha", "newest")
    # Payloads too small for revisits have keys of their own, so that empty pages do not meet in one task.
    keyed = rows.withColumn("_key", F.when(large, F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("_p", "url").cast("string"))))
    joined = keyed.join(groups.withColumnRenamed("sha", "_key"), "_key", "left")
    refers = F.when(large & (F.col("newest") != F.col("_p")), F.col("newest"))
    write, schema = _write(date)
    members = joined.select(public_id("_p").alias("page"), "url", "html", "sha", refers.alias("refers")).mapInArrow(lean(write), schema)
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> dict | None:
    """Header fields (lower case), type and payload of one uncompressed record; None if it isn't one."""
    if not data.startswith(b"WARC/"):
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {":http": http, ":payload": payload}


def starts_record(piece: bytes) -> bool:
    """Whether the bytes after a magic begin a gzip member that holds a WARC record, or one that is whole and empty."""
    z = zlib.decompressobj(31)
    try:
        first = z.decompress(_MAGIC + piece, 16)
    except zlib.error:
        return False
    return first.startswith(b"WARC/") or (not first and z.eof)


#: What a damaged member gives: no page, no payload, record_type damaged.
_DAMAGED = (None, None, None, "damaged", None, None, None)


_FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_FIELDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _number(urn: str | None) -> int | None:
    end = (urn or "").strip("<>").rpartition(":")[2]
    return int(end) if end.lstrip("-").isdigit() else None


def _fields(data: bytes, keep: bool) -> tuple | None:
    r = parse(data)
    if r is None:
        return None
    length = next((int(v) for k, _, v in (x.partition(b":") for x in r[":http"].split(b"\r\n")) if k.strip().lower() == b"content-length"), len(r[":payload"]))
    kind = r.get("warc-type")
    digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in r else hashlib.sha1(r[":payload"]).hexdigest()
    if kind == "response" and digest != hashlib.sha1(r[":payload"]).hexdigest():
        return (_number(r.get("warc-record-id")), *_DAMAGED[1:])
    return _number(r.get("warc-record-id")), length, digest, kind, _number(r.get("warc-refers-to")), r.get("warc-target-uri"), r[":payload"] if keep else None


class _Members:
    """Puts members together from the pieces between magics, one inflation over all of a member's pieces."""

    def __init__(self, keep: bool):
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.z, self.pieces, self.out, self.began = None, [], [], False

    def push(self, piece: bytes) -> list[tuple] | None:
        """The records that end with the piece; None for a piece before the first start. Behind a damaged member, what was taken into it
        is looked through for the next start."""
        if self.z is None and not self.began and not starts_record(piece):
            return None
        rows, queue = [], deque([piece])
        while queue:
            own = queue.popleft()
            if self.z is None:
                if not self.began and not starts_record(own):
                    continue
                self.began, self.z, self.pieces, self.out = True, zlib.decompressobj(31), [], []
            self.pieces.append(own)
            try:
                self.out.append(self.z.decompress(_MAGIC + own))
            except zlib.error:
                queue.extendleft(reversed(self.pieces[1:]))
                self.reset()
                rows.append(_DAMAGED)
                continue
            if self.z.eof:
                got = _fields(b"".join(self.out), self.keep)
                self.z, self.pieces, self.out = None, [], []
                if got:
                    rows.append(got)
        return rows

    def finish(self) -> list[tuple]:
        """What is still open is damaged, and what was taken into it is looked through."""
        rows = []
        while self.z is not None:
            rows.append(_DAMAGED)
            held = self.pieces[1:]
            self.reset()
            for piece in held:
                rows += self.push(piece) or []
        return rows


def _scan(keep: bool):
    """Decodes the members that lie whole in a range; kind 0: a record, 1: the start of a cut member, 2: a piece without a start before
    it in its range, 3: a place behind which pieces belong to no cut member, as a damaged one stands there."""
    out = pa.schema([("kind", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("piece", pa.binary()), *_FIELDS])
    none = [None] * len(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, seq, members = None, 0, _Members(keep)
        rows: list[tuple] = []

        def close():
            if members.z is not None:
                rows.append((1, *where, seq, _MAGIC.join(members.pieces), *none))
            members.reset()

        for b in batches:
            for file, at, piece in zip(b["file"].to_pylist(), b["at"].to_pylist(), b["piece"].to_pylist(), strict=True):
                if (file, at) != where:
                    close()
                    where, seq = (file, at), 0
                seq += 1
                if at == 0 and seq == 1 and not piece:
                    continue  # what stands before the first magic
                found = members.push(piece)
                if found is None:
                    rows.append((2, *where, seq, piece, *none))
                    continue
                for got in found:
                    rows.append((0, *where, seq, None, *got))
                    if got is _DAMAGED:
                        rows.append((3, *where, seq, None, *none))
            if len(rows) > 500:
                cols = list(zip(*rows, strict=True))
                rows = []
                yield batch(out, **dict(zip(out.names, cols, strict=True)))
        close()
        cols = list(zip(*rows, strict=True)) or [[]] * len(out)
        yield batch(out, **dict(zip(out.names, cols, strict=True)))

    return run, "kind int, file string, at long, seq long, piece binary, " + _FIELDS_DDL


def _stitch(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts in b["parts"].to_pylist():
                members = _Members(keep)
                for p in sorted(parts, key=lambda p: (p["at"], p["seq"])):
                    for piece in p["piece"].split(_MAGIC):
                        rows += members.push(piece) or []
                rows += members.finish()
            cols = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
            yield batch(_FIELDS, **dict(zip(_FIELDS.names, cols, strict=True)))

    return run, _FIELDS_DDL


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) for every record of the archives under path.

    A revisit has the length and digest of the full payload, and no payload. A damaged or cut member, and a response that does not
    match its digest, give a row of record_type damaged; reading goes on at the next record behind it.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\x1f\x8b\x08").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))
    scan, schema = _scan(payload)
    found = pieces.mapInArrow(lean(scan), schema)
    whole = found.where("kind = 0").select(*_FIELDS.names)
    # At most one cut member a range, and the pieces that follow it.
    cut = found.where("kind > 0").select("kind", "file", "at", "seq", "piece")
    owner = F.last(F.when(F.col("kind").isin(1, 3), F.struct("kind", "at", "seq")), ignorenulls=True).over(W.partitionBy("file").orderBy("at", "seq", "kind"))
    parts = cut.withColumn("owner", owner).where("owner.kind = 1").groupBy("file", "owner").agg(F.collect_list(F.struct("at", "seq", "piece")).alias("parts"))
    stitch, schema = _stitch(payload)
    return whole.unionByName(parts.mapInArrow(lean(stitch), schema))


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{stage_dir(spark, 'warc')}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM m
"""
