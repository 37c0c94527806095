"""WARC archives in Zstandard: written with a dictionary in the leading skippable frame, one frame a record, and read back."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, shared_dir, slices, table

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What a record holds besides its payload, about.
RECORD_BYTES = 1000

RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, archive string"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id & (1 << 128) - 1)}>"


def _page_id(record_id: str) -> int:
    n = uuid.UUID(record_id.removeprefix("<urn:uuid:").removesuffix(">")).int
    return n - (1 << 128) if n >> 127 else n


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str, payload: bytes | None, digest: str, refers_to: int | None, when: str) -> bytes:
    """One record; without page_id its id is a random one and no Page-ID names it. A revisit (refers_to is set) holds the HTTP headers only; digest is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"\r\n" if refers_to is not None else head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else _record_id(page_id),
        "WARC-Date": when,
        "WARC-Target-URI": "".join(url.split()) or "about:blank",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Refers-To": _record_id(refers_to), "WARC-Profile": REVISIT_PROFILE}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Checks version, named fields, length, digests and end of one record and takes it apart."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(VERSION):
        raise WarcError("no WARC/1.1 header")
    fields = {}
    for line in head[len(VERSION) :].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise WarcError(f"missing {sorted(missing)}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError("bad Content-Length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} does not fit the record of {len(rest)} bytes")
    block = rest[:n]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1(block):
        raise WarcError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header in the block")
    kind = fields["warc-type"]
    if kind == "response":
        if fields.get("warc-payload-digest", _sha1(payload)) != _sha1(payload):
            raise WarcError("payload digest differs")
        if f"content-length: {len(payload)}".encode() not in http.lower().split(b"\r\n"):
            raise WarcError("HTTP Content-Length differs")
    elif kind != "revisit" or "warc-refers-to" not in fields or payload:
        raise WarcError(f"unexpected {kind} record")
    return {"fields": fields, "payload": payload if kind == "response" else None}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive: dictionary from the leading skippable frame, then exactly one record in each frame."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8 : 8 + n])
        if len(raw) != n:
            raise WarcError("the dictionary frame is cut short")
        at = 8 + n
        if raw[:4] == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise WarcError("the last frame is cut short")
            chunk = view[at : at + 16_384]
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield decode_record(b"".join(parts))


def _train(payloads: list[bytes], most: int) -> bytes:
    """A dictionary for these payloads, or none where there are too few to train on."""
    try:
        return zstandard.train_dictionary(most, payloads).as_bytes() if len(payloads) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, dictionary_bytes: int = 32 << 10, sample: int = 256) -> DataFrame:
    """Writes pages (page_id, url, html, digest, refers_to) as archives in `folder`, an address all executors reach.

    Each partition writes archives of about `archive_bytes`; the first `sample` payloads of an archive train its
    dictionary. Names depend on partition and number only and a file appears when it is whole, so a repeated task
    replaces what a lost one wrote. Returns (archive, records); the caller acts on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        task, number, when = TaskContext.get(), 0, datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            raw = _train([r[2] for r in rows if r[2]][:sample], dictionary_bytes)
            writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=3)
            name = f"part-{task.partitionId():06d}-{number:06d}.warc.zst"
            number += 1
            with store.open_output_stream(hidden := f"{top}/_{name}.{task.taskAttemptId()}") as out:
                out.write(dictionary_frame(raw))
                for page_id, url, payload, digest, refers_to in rows:
                    out.write(writer.compress(encode_record(page_id, url, payload, digest, refers_to, when)))
            store.move(hidden, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(rows)], pa.int64())})

        rows, held = [], 0
        for b in slices(batches):
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                payload = html or b""
                rows.append((page_id, url or "", None if refers_to is not None else payload, "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                held += RECORD_BYTES + (0 if refers_to is not None else len(payload))
                if held >= archive_bytes:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    cols = [F.col("page_id"), F.col("url"), F.when(F.col("refers_to").isNull(), F.col("html")).cast("binary").alias("html"), F.col("digest"), F.col("refers_to")]
    return pages.select(*cols).mapInArrow(run, "archive string, records long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in `folder`, see RECORD; the payload of a revisit is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for r in read_archive(data):
                    f = r["fields"]
                    digest = f.get("warc-payload-digest", "")
                    hexed = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
                    refers = _page_id(f["warc-refers-to"]) if "warc-refers-to" in f else None
                    rows.append((int(f["page-id"]) if "page-id" in f else None, f.get("warc-target-uri"), f["warc-type"], refers, r["payload"], hexed, path.rsplit("/", 1)[-1]))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    return files.select("path", "content").mapInPandas(run, RECORD)


def archive_pages(pages: DataFrame, folder: str, least: int = 1000, broadcast_rows: int = 1_000_000) -> int:
    """Writes a record for each row of pages (page_id, url, html; more columns are ignored); returns how many.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response
    and the others revisit it. Null html is an empty payload. Each row is one record: rows without page_id are responses,
    and repeated rows are repeated records, which share their record id; an empty table writes none. Whole pages are
    shuffled only where more than `broadcast_rows` records are revisits.
    """
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = cut(pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    top = cut(narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low"))
    refs = cut(narrow.join(small(top), "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct())
    return write_archives(pages.join(small(refs), ["page_id", "digest"], "left"), folder).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def op3_warc_zstd(spark: SparkSession, sf_dir: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    archive_pages(table(spark, sf_dir, "pages"), folder)
    # archives are decoded once; what is kept of them is narrow
    own = cut(read_archives(spark, folder).select("page_id", F.octet_length("payload").cast("long").alias("own"), "payload_digest", "record_type", "refers_to"))
    revisits = own.where("record_type = 'revisit'")
    wanted = cut(revisits.select("refers_to", "payload_digest").distinct())
    full = own.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("own").alias("full"), "payload_digest")
    full = cut(full.join(small(wanted), ["refers_to", "payload_digest"], "left_semi").distinct())
    joined = revisits.join(small(full), ["refers_to", "payload_digest"], "left").withColumn("own", F.col("full"))
    cols = ["page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return own.where("record_type = 'response'").select(*cols).unionByName(joined.select(*cols))
