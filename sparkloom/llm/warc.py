"""WARC archives: a writer, and a reader that salvages what damage leaves.

Archives hold one gzip member for each record, or plain records.  The reader
checks every member (its own checksum) and every record (version line, headers,
length, end mark, payload digest).  After a failed check it searches for the
next member or version line from which a record can be read, in the archive and
in what a member's content gives, goes on there, and logs the bytes in between
as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of payload for each archive file, on average.
FILE_BYTES = 16 << 20
VERSION = b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_HTTP_END = re.compile(rb"\r?\n\r?\n")
_CHUNK_SIZE = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r\n")
#: Labels of digests that can be compared.
_ALGORITHMS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}
#: A gzip member without content; it stands between the records' members.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column."""
    return common.base32(F.sha1(payload))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Mark pages (page_id, uri, payload, digest) as response or revisit of the smallest page with that payload.

    Digests alone are grouped, with a map-side part.  The groups of two or more
    are written first, so that Spark knows their size: while that is within its
    broadcast bound the payloads stay where they are, beyond it they are joined by
    digest and Spark splits a hot one among tasks.
    """
    eligible = F.octet_length("payload") >= min_bytes
    keyed = pages.withColumn("key", F.when(eligible, F.concat_ws(":", "digest", F.octet_length("payload"))))
    first = (
        keyed.filter("key is not null")
        .groupBy("key")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
        .drop("n")
    )
    found = keyed.join(common.stage(first, "repeated"), "key", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id",
        "uri",
        "payload",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _record(page: DataFrame) -> Column:
    """The bytes of each page's record.  A revisit has the HTTP headers alone."""
    lit = lambda s: F.lit(s)
    length = F.octet_length("payload").cast("string")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, lit("\r\n\r\n")
    )
    block_length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    head = F.concat(
        lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), lit("")),
        lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.when(
            F.col("uri").isNotNull(),
            F.concat(lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]", ""), lit("\r\n")),
        ).otherwise(""),
        F.when(
            revisit,
            F.concat(
                lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                lit("WARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"),
                lit(">\r\n"),
            ),
        ).otherwise(""),
        lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_length.cast("string"),
        lit("\r\n\r\n"),
        http,
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(head.cast("binary"), body, F.lit(_END))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    gzip: bool = True,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write one record for each row; equal payloads after the first become revisits.

    A null payload is an empty one.  A null page id gives a record without a
    number, which is never referred to.  Rows that repeat a page id and its
    payload are each written; all that carry the smallest id are responses.
    Tasks write where the rows lie and begin a new file after as many records as
    make ``file_bytes`` on average.
    Spark's own writer writes the files, so a task that runs again replaces its
    file and any file system of Spark's will do.
    """
    spark = common.prepare(pages.sparkSession)
    own = common.only(pages, page_id=page_id, uri=uri, payload=payload).withColumn(
        "payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    )
    mean = own.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    per_file = max(1, int(file_bytes / max(mean, 512)))
    marked = with_revisits(own.withColumn("digest", payload_digest(F.col("payload"))), min_revisit_bytes)
    records = marked.select(_record(marked).alias("record"))
    if gzip:

        def members(batch: pa.RecordBatch) -> pa.RecordBatch:
            return common.record_batch(
                record=pa.array([zlib.compress(r, 6, wbits=31) for r in batch.column(0).to_pylist()], pa.binary())
            )

        records = common.map_batches(records, members, "record binary")
        between = EMPTY_MEMBER
    else:  # the mark's last byte ends the line
        records = records.select(F.expr("substring(record, 1, octet_length(record) - 1)").alias("record"))
        between = _END[-1:]
    (
        records.select(F.col("record").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", between.decode("latin-1"))
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


class _Bad(ValueError):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(content, end, what is wrong) of the gzip member at ``at``.

    A member that breaks off or whose checksum fails gives all that could be
    decompressed before, and the place where that ended.
    """
    for step in (1 << 18, 1 << 16):  # large steps first; only a member that fails is read again, with a state to go back to
        d = zlib.decompressobj(wbits=31)
        out, pos = [], at
        careful = step < 1 << 18
        while not d.eof and pos < len(data):
            before = d.copy() if careful else None
            try:
                out.append(d.decompress(data[pos : pos + step]))
                pos += step
            except zlib.error as e:
                if not careful:
                    break
                if step == 1:
                    return b"".join(out), pos, str(e)
                d, step = before, max(1, step >> 8)  # again in smaller steps, for what comes before the failure
        else:
            if not d.eof:
                return b"".join(out), len(data), "member cut off"
            return b"".join(out), min(pos, len(data)) - len(d.unused_data), None
    raise AssertionError("a member ends or fails")


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    m = _VERSION_LINE.match(data, at)
    if not m:
        raise _Bad("no version line")
    # headers may have any length; the window grows so that a record without their end costs its own bytes only
    window, seen = 1 << 16, m.end()
    while True:
        stop = data.find(_END, max(m.end() - 2, seen - 3), at + window)
        if _VERSION_LINE.search(data, max(m.end(), seen - 9), stop if stop >= 0 else at + window):
            raise _Bad("another record begins in the headers")
        if stop >= 0:
            break
        if at + window >= len(data):
            raise _Bad("headers have no end")
        seen, window = at + window, window * 2
    headers = {}
    # a line that begins with white space goes on with the header before it
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[m.end() : stop]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("malformed header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise _Bad("no length")
    start = stop + 4
    end = start + int(length)
    if data[end : end + 4] != _END:
        raise _Bad("record doesn't end where its length says")
    return headers, data[start:end], end + 4


def digest_differs(declared: str, payload: bytes) -> bool | None:
    """Whether a labelled digest isn't that of the payload; None where its algorithm or form is unknown.

    The label may be in capitals or missing (SHA-1); the value may be base32 in
    capitals or not, with or without its filling, base64, or hexadecimal.
    """
    label, colon, value = declared.rpartition(":")
    name = label.strip().lower().replace("-", "") if colon else "sha1"
    value = value.strip()
    if name not in _ALGORITHMS:
        return None
    digest = hashlib.new(name, payload).digest()
    bare = value.rstrip("=")
    if len(bare) == 2 * len(digest):
        return bare.lower() != digest.hex()
    if len(bare) == -(-len(digest) * 8 // 5):
        return bare.upper() != base64.b32encode(digest).decode().rstrip("=")
    if len(bare) == -(-len(digest) * 8 // 6):
        return bare.replace("-", "+").replace("_", "/") != base64.b64encode(digest).decode().rstrip("=")
    return None


def _unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunks; None if it isn't one."""
    out, at = [], 0
    while m := _CHUNK_SIZE.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return None


def _checked(headers: dict, block: bytes) -> dict:
    """What a record says of its payload, after its digests have been compared.

    A record whose payload or whole block has the digest that it names is intact.
    What can't be compared, or contradicts nothing that vouches for the content
    (an HTTP length of a decoded or truncated capture), is a note, not damage.
    """
    kind = headers.get("warc-type", "").lower()
    payload, length, notes = block, len(block), []
    declared, of_block = headers.get("warc-payload-digest", ""), headers.get("warc-block-digest", "")
    form = headers.get("content-type", "").lower()
    chunked = False
    if form.startswith("application/http") and "msgtype=request" not in form:
        end = _HTTP_END.search(block)
        http, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        chunked = bool(re.search(rb"(?im)^transfer-encoding:.*chunked", http))
        length = len(payload) if kind != "revisit" or not m else int(m[1])
        if not end:
            notes.append("HTTP headers have no end")
        if kind != "revisit" and m and int(m[1]) != len(payload):
            notes.append("HTTP length differs")
    whole = digest_differs(of_block, block) if of_block else None
    if whole:
        raise _Bad("block digest differs")
    if kind != "revisit" and declared:
        differs = digest_differs(declared, payload)
        if differs and chunked:
            differs = digest_differs(declared, _unchunked(payload) or b"")
        if differs and whole is None:
            raise _Bad("payload digest differs")
        if differs is None:
            notes.append("unknown digest")
        elif differs:
            notes.append("payload digest is of another form of the payload")
    return {
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "uri": headers.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": _bare(declared) or None,
        "refers_to": headers.get("warc-refers-to"),
        "payload": None if kind == "revisit" else payload,
        "note": "; ".join(notes) or None,
    }


def _bare(declared: str) -> str:
    """A SHA-1 in base32 without its label; others as they are."""
    label, _, value = declared.rpartition(":")
    return value.strip() if label.strip().lower() in ("", "sha1", "sha-1") else declared


def _inside(content: bytes) -> list[dict]:
    """Records of a member's content and its gaps, by ``inner_offset`` and ``inner_end``."""
    rows, at, bad_from, reason = [], 0, None, ""
    while at < len(content):
        try:
            headers, block, end = _parse(content, at)
            found = _checked(headers, block)
        except _Bad as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            line = _VERSION_LINE.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if bad_from is not None:
            rows.append({"inner_offset": bad_from, "inner_end": at, "gap": reason})
            bad_from = None
        rows.append(found | {"inner_offset": at, "inner_end": end, "gap": None})
        at = end
    if bad_from is not None:
        rows.append({"inner_offset": bad_from, "inner_end": len(content), "gap": reason})
    return rows


def salvage(data: bytes | memoryview) -> Iterator[dict]:
    """Records of an archive, and the gaps that can't be read.

    A record has ``gap`` None.  A gap has ``offset``, ``end`` and the reason in
    ``gap``.  Search starts one byte after the place where a check failed, so a
    record whose start is intact is never stepped over.  The content of a member
    is searched in the same way, as far as it can be decompressed; what is found
    there has the member's range and its own place in the content
    (``inner_offset``, ``inner_end``).  A broken member is a gap also where
    records have been recovered from it; ``unverified`` then says what is wrong
    with the member, since no checksum vouches for these records' headers.
    """
    whole = data if isinstance(data, bytes) else bytes(data)
    at, n = 0, len(whole)
    bad_from, reason = None, ""
    member = line = 0  # the next member and version line, as far as they are known
    # a broken member may hold its records uncompressed, where the search meets them a second time
    again: Counter[bytes] = Counter()
    again_to = 0
    while at < n:
        try:
            if whole.startswith(_MAGIC, at):
                content, end, wrong = _member(whole, at)
                found = _inside(content)
                some = any(r["gap"] is None for r in found)
                if wrong or found and not some:
                    # a checksum that contradicts a lone record is that record's own
                    if some and not (len(found) == 1 and "incorrect" in (wrong or "")):
                        yield from (r | {"offset": at, "end": end, "unverified": wrong} for r in found)
                        own = (content[r["inner_offset"] : r["inner_end"]] for r in found if r["gap"] is None)
                        again, again_to = Counter(hashlib.sha1(r).digest() for r in own), end
                    raise _Bad(wrong or found[0]["gap"])
            else:
                headers, block, end = _parse(whole, at)
                found = [_checked(headers, block) | {"gap": None}]
                key = hashlib.sha1(whole[at:end]).digest() if at < again_to else None
                if again[key]:
                    again[key] -= 1
                    at = end
                    continue
        except _Bad as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            if member <= at:
                found_at = whole.find(_MAGIC, at + 1)
                member = n if found_at < 0 else found_at
            if line <= at:
                match = _VERSION_LINE.search(whole, at + 1)
                line = match.start() if match else n
            at = min(member, line)
            continue
        if bad_from is not None:
            yield {"offset": bad_from, "end": at, "gap": reason}
            bad_from = None
        yield from (r | {"offset": at, "end": end} for r in found)
        at = end
    if bad_from is not None:
        yield {"offset": bad_from, "end": n, "gap": reason}


_FIELDS = {
    "file": pa.string(),
    "offset": pa.int64(),
    "end": pa.int64(),
    "inner_offset": pa.int64(),
    "inner_end": pa.int64(),
    "gap": pa.string(),
    "unverified": pa.string(),
    "record_id": pa.string(),
    "record_type": pa.string(),
    "uri": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.string(),
    "note": pa.string(),
    "payload": pa.binary(),
}
_SCHEMA = (
    "file string, offset long, end long, inner_offset long, inner_end long, gap string, unverified string, "
    "record_id string, record_type string, uri string, "
    "payload_bytes long, payload_digest string, refers_to string, note string, payload binary"
)


def read_warc(spark: SparkSession, path: str, *, glob: str = "part-*", payloads: bool = True) -> DataFrame:
    """Rows for all records and all quarantined gaps (``gap`` is their reason, else null) of the archives in a folder.

    One task reads a file, which must fit its memory and Spark's two gigabytes for a
    value; archives of some hundred megabytes or less, as :func:`write_warc` makes
    them unless very large pages lie side by side, keep tasks small.
    An empty file gives no rows, damage gives rows with ``gap`` set.  ``note`` says what
    of an intact record couldn't be compared or contradicts itself.
    """
    common.prepare(spark)
    names = [n for n in _FIELDS if payloads or n != "payload"]
    schema = _SCHEMA if payloads else _SCHEMA.removesuffix(", payload binary")

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return common.record_batch(**{n: pa.array([r.get(n) for r in rows], _FIELDS[n]) for n in names})

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for r in salvage(content.as_py()):
                    rows.append(r | {"file": file})
                    size += len(r.get("payload") or b"") * payloads
                    if len(rows) == 4096 or size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return common.map_arrow(files.select("path", "content"), run, schema)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined byte ranges: file, offset, end, inner_offset, inner_end, gap."""
    return records.filter("gap is not null").select("file", "offset", "end", "inner_offset", "inner_end", "gap")
