"""Archives by other writers, columns with our names, and very many rows with one id."""

import base64
import gzip
import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, linededup, quality, records, warc
from tests.llm.data import documents, prose

BODY = b"<p>the payload</p>"
SHA1 = hashlib.sha1(BODY).digest()


def record(block=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + BODY, form="application/http; msgtype=response", **headers):
    own = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "Content-Type": form, **{k.replace("_", "-"): v for k, v in headers.items()}}
    lines = "".join(f"{k}: {v}\r\n" for k, v in own.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Length: 5000\r\n\r\n" + BODY
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"7\r\n" + BODY[:7] + b"\r\n%x;x=y\r\n" % (len(BODY) - 7) + BODY[7:] + b"\r\n0\r\n\r\n"
DIALECTS = {
    "sha256 in hexadecimal": (record(WARC_Payload_Digest="sha256:" + hashlib.sha256(BODY).hexdigest()), None),
    "sha1 in hexadecimal": (record(WARC_Payload_Digest="sha1:" + SHA1.hex().upper()), None),
    "base32 in small letters": (record(WARC_Payload_Digest="sha1:" + base64.b32encode(SHA1).decode().lower()), None),
    "label in capitals": (record(WARC_Payload_Digest="SHA1:" + base64.b32encode(SHA1).decode()), None),
    "no label": (record(WARC_Payload_Digest=base64.b32encode(SHA1).decode()), None),
    "base64": (record(WARC_Payload_Digest="sha-256:" + base64.b64encode(hashlib.sha256(BODY).digest()).decode()), None),
    "md5": (record(WARC_Payload_Digest="md5:" + hashlib.md5(BODY).hexdigest()), None),
    "unknown algorithm": (record(WARC_Payload_Digest="blake9:abc"), "unknown digest"),
    "no digest": (record(), None),
    "folded header": (record(WARC_Target_URI="http://a.example/\r\n \tb", WARC_Payload_Digest="sha1:" + SHA1.hex()), None),
    "another HTTP length": (record(HTTP, WARC_Payload_Digest="sha1:" + SHA1.hex()), "HTTP length differs"),
    "another HTTP length, no digest": (record(HTTP), "HTTP length differs"),
    "type in capitals": (record(form="Application/HTTP;msgtype=response", WARC_Payload_Digest="sha1:" + SHA1.hex()), None),
    "chunks, digest of what they carry": (record(CHUNKED, WARC_Payload_Digest="sha1:" + SHA1.hex()), None),
    "digest of another form, block vouched for": (record(WARC_Payload_Digest="sha1:" + "0" * 40, WARC_Block_Digest="sha1:" + hashlib.sha1(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + BODY).hexdigest()), "payload digest is of another form of the payload"),
    "bare line ends in HTTP": (record(b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n" + BODY, WARC_Payload_Digest="sha1:" + SHA1.hex()), None),
}


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("name", DIALECTS)
def test_valid_records_of_every_dialect_are_read(name, compressed):
    data, note = DIALECTS[name]
    around = record(WARC_Record_ID="<urn:x:0>"), record(WARC_Record_ID="<urn:x:2>")
    whole = b"".join(gzip.compress(r) if compressed else r for r in (around[0], data, around[1]))
    rows = list(warc.salvage(whole))
    assert [r["gap"] for r in rows] == [None] * 3 and [r["record_id"] for r in rows] == ["<urn:x:0>", "<urn:x:1>", "<urn:x:2>"]
    assert rows[1]["note"] == note and rows[1]["record_type"] == "response"
    assert rows[1]["payload"] == (BODY if not name.startswith("chunks") else CHUNKED.partition(b"\r\n\r\n")[2])


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_is_still_a_gap(compressed):
    good = record(WARC_Payload_Digest="sha256:" + hashlib.sha256(BODY).hexdigest())
    bad = good.replace(b"the payload", b"the paylaod")
    block = record(WARC_Block_Digest="sha1:" + hashlib.sha1(b"other").hexdigest())
    whole = b"".join(gzip.compress(r) if compressed else r for r in (good, bad, good, block, good))
    assert [r["gap"] for r in warc.salvage(whole)] == [None, "payload digest differs", None, "block digest differs", None]


def test_other_records_and_long_members():
    request = record(b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Type="request")
    info = record(b"software: x\r\n", "application/warc-fields", WARC_Type="WARCINFO")
    long = record(b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 5000)
    rows = list(warc.salvage(gzip.compress(request) + gzip.compress(info) + gzip.compress(long) + gzip.compress(request)))
    assert [(r["gap"], r["record_type"]) for r in rows] == [(None, "request"), (None, "warcinfo"), (None, "response"), (None, "request")]
    assert len(rows[2]["payload"]) == 1_280_000
    member = gzip.compress(long)
    broken = member[:-2000] + b"\xff" * 100 + member[-1900:]
    content, end, wrong = warc._member(broken, 0)
    assert wrong and content[:5000] == long[:5000]
    assert warc._member(member, 0) == (long, len(member), None)


NAMES = ["__lines_n_lines", "__LINES_kept_sha256", "__bench_n_hit", "__bench_contaminated", "__q_n_words", "__q_votes", "__votes", "__votes_quality", "_lines_x"]


def test_columns_with_our_names_pass_by(spark):
    docs = documents(spark, [prose(i, 150) for i in range(6)] + ["line one is long enough\n" * 2] * 2)
    own = docs.withColumns({c: F.lit(7) for c in NAMES})
    bench = spark.createDataFrame([(1, prose(2, 150)[:300])], "item_id long, text string")
    for fn in (linededup.keep_lines, lambda d: quality.keep_good(d, threshold=0.0), lambda d: decontaminate.remove_contaminated(d, bench)):
        got, plain = fn(own), fn(docs)
        assert got.dtypes == own.dtypes
        rows = got.collect()
        assert rows and all(r[c] == 7 for r in rows for c in NAMES)
        assert sorted(map(repr, got.drop(*NAMES).collect())) == sorted(map(repr, plain.collect()))


def test_rows_without_an_id_make_many_files(spark, tmp_path):
    text = F.when(F.col("id") % 4 < 2, F.lit("the same text again and again " * 3)).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of some length" * 4)))
    docs = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), text.alias("text"))
    path = str(tmp_path / "r")
    records.write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard_bytes=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "r").glob("part-*")]
    assert len(sizes) >= 12 and max(sizes) < 4 * sum(sizes) / len(sizes)
    rows = records.write_index(spark, path, str(tmp_path / "i")).orderBy("start").collect()
    assert len(rows) == 20_000 and [r.doc_id is None for r in rows] == sorted((r.doc_id is None for r in rows), reverse=True)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids)
    ends = [r.start + r.n_tokens for r in rows]
    assert rows[0].start == 0 and [r.start for r in rows[1:]] == ends[:-1]
