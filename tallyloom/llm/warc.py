"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

``write`` makes archives that are one gzip stream each. ``normalise`` inflates
such a stream once, front to back, and rewrites every record as a gzip member
of its own beside an offset index (one JSON line a record), so that ``read``
fetches any record by seeking to its member. Only a record is held at a time.

Equal payloads (of ``min_revisit`` bytes or more) are stored once: the row with
the greatest id is the ``response``, the others are ``revisit`` records that keep
the response's HTTP header and name its record. Which one that is comes from
digests alone, pre-aggregated before they are shuffled; pages meet it by id.

Defined results: a null or empty html is an empty payload; a null url becomes
an empty target; a null id is written without its header, read as null, and is
never a revisit's target while an id is there (rows with null ids and a payload
that no id has are all responses). Rows that repeat the greatest id are all
responses. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import files, textops as tx
from .scratch import Scratch, partitions

MIN_REVISIT = 1000
#: Payload bytes after which a task begins the next archive.
ROLL = 256 << 20
PIECE = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, index string, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_revisits(pages: DataFrame, id_col: str, html_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, digest and refers_to (the response's id) of each row that revisits another."""
    digests = pages.select(F.col(id_col).alias("id"), F.sha1(F.coalesce(F.col(html_col), F.lit(""))).alias("digest"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).alias("n"))
    large = digests.where(F.col("n") >= min_revisit)
    keep = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls"))
    keep = keep.where((F.col("refers_to") > F.col("least")) | (F.col("refers_to").isNotNull() & (F.col("nulls") > 0)))
    found = large.join(keep.select("digest", "refers_to"), "digest").where(F.col("id").isNull() | (F.col("id") < F.col("refers_to")))
    return found.groupBy("id", "digest").agg(F.max("refers_to").alias("refers_to"))


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def record(page, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC record; ``refers_to`` is the response's id for a revisit."""
    raw = hashlib.sha1(payload)
    digest = raw.hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(0x21, 0x7F)))}", "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(raw.digest()).decode(), f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes monolithic gzip archives below ``folder``; one manifest row for each."""
    revisits = plan_revisits(pages, id_col, html_col, min_revisit)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    # A row meets its plan by id and digest, so rows that repeat an id with another payload stay apart.
    same = F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.digest") == F.col("r.digest"))
    rows = rows.alias("p").join(revisits.alias("r"), same, "left").select("p.id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in tx.slices(batches, "html"):
            for page, url, text, target in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                if out is None:
                    name = files.own_name(folder, "archive", ".warc.gz")
                    stack = files.writing(name)
                    out, pack, n, size = stack.__enter__(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                raw = record(page, url, text.encode("utf-8"), target)
                out.write(pack.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= ROLL:
                    out.write(pack.flush())
                    stack.__exit__(None, None, None)
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "index": [""], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.write(pack.flush())
            stack.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [name], "index": [""], "n_records": [n], "n_bytes": [size]})

    return rows.mapInArrow(run, MANIFEST)


def records(source) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records with their heads from a gzip stream of one or more members, inflated once."""
    inflate, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal inflate
        while True:
            data = inflate.unconsumed_tail or (inflate.unused_data if inflate.eof else b"")
            if inflate.eof:
                if not data:
                    data = source.read(PIECE)
                if not data:
                    return False
                inflate = zlib.decompressobj(31)
            elif not data:
                data = source.read(PIECE)
                if not data:
                    raise ValueError("the gzip stream ends early")
            new = inflate.decompress(data, 4 * PIECE)
            if new:
                held.extend(new)
                return True

    while True:
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            del held[:at]
            at = 0
            if not more():
                if held.strip():
                    raise ValueError("bytes after the last record")
                return
            end = held.find(b"\r\n\r\n")
        head = parse_head(bytes(held[at:end]))
        size = end + 4 - at + int(head["content-length"]) + 4
        while len(held) - at < size:
            if at:
                del held[:at]
                at = 0
            if not more():
                raise ValueError("the last record is cut off")
        yield bytes(held[at : at + size]), head
        at += size


def normalise_file(source, out, index) -> tuple[int, int]:
    """Rewrites one archive with a member for each record, and its offsets to ``index``."""
    offset = n = 0
    for raw, head in records(source):
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = pack.compress(raw) + pack.flush()
        out.write(member)
        line = {"offset": offset, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "url": head.get("warc-target-uri", ""), "digest": head.get("warc-payload-digest", "")}
        index.write(json.dumps(line).encode() + b"\n")
        offset += len(member)
        n += 1
    return n, offset


def _spread(manifest: DataFrame) -> DataFrame:
    """The files dealt out evenly, one at a time to a task."""
    return manifest.repartition(max(1, partitions(manifest.sparkSession)), "path")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = files.own_name(folder, "members", ".warc.gz")
                with files.reading(path) as source, files.writing(name) as out, files.writing(name + ".idx") as index:
                    n, size = normalise_file(source, out, index)
                yield pa.RecordBatch.from_pydict({"path": [name], "index": [name + ".idx"], "n_records": [n], "n_bytes": [size]})

    return _spread(manifest).mapInArrow(run, MANIFEST)


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes, int]:
    """Head, payload and the payload's full length (which a revisit states) of one record."""
    source.seek(offset)
    raw = zlib.decompress(source.read(length), 31)
    head_end = raw.index(b"\r\n\r\n") + 4
    head = parse_head(raw[: head_end - 4])
    block = raw[head_end : head_end + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n") + 4
    stated = next(int(x.partition(b":")[2]) for x in block[:http_end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return head, block[http_end:], stated


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                with files.reading(index) as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                with files.reading(path) as source:
                    for a in range(0, len(lines), 256):
                        rows = []
                        for x in lines[a : a + 256]:
                            head, payload, stated = read_member(source, x["offset"], x["length"])
                            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                            response = head["warc-type"] == "response"
                            if response and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{head['warc-record-id']}: the payload is damaged")
                            number = lambda k: int(head[k]) if k in head else None
                            rows.append((number("x-page-id"), head["warc-target-uri"], payload if response else None, stated, digest, head["warc-type"], number("x-refers-to-page-id")))
                        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _spread(manifest).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark, "warc")
    whole = scratch.keep(write(pages, scratch.at("whole")), "manifest")
    members = scratch.keep(normalise(whole, scratch.at("members")), "member-manifest")
    scratch.drop("whole", "manifest")
    return read(members).drop("payload", "url")
