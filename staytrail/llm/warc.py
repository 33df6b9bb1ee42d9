"""Content-addressed WARC archive.

An archive folder holds two Parquet tables.  ``payloads`` stores each distinct payload once under its SHA-256
(zstandard-compressed); ``headers`` stores for every record the exact bytes of its WARC header block and the digest
of its payload.  The original records come back by joining the two; each payload is checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stage

#: fixed value: every record carries the same date, so that archives are reproducible
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6  # of payload compression: payloads move twice and are stored once
HEADERS = "rec_no long, page_id long, sha256 string, n_bytes long, record_type string, header binary"
PAYLOADS = "sha256 string, payload binary"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, record binary")


def _header(record_type, rec_no, page_id, url, n_bytes, sha1, sha256, to_rec, to_page) -> bytes:
    """The header block of a record, up to and with the empty line."""
    lines = ["WARC/1.0", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:record:{rec_no}>"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        broken = "\r" in url or "\n" in url  # can't stand in a header line
        lines.append("WARC-Target-URI-Base64: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()
                     if broken else f"WARC-Target-URI: {url}")
    lines += [f"WARC-Date: {DATE}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
              f"WARC-Block-Digest: sha256:{sha256}"]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:record:{to_rec}>"]
        if to_page is not None:
            lines.append(f"WARC-Refers-To-Page-ID: {to_page}")
    lines.append(f"Content-Length: {0 if record_type == 'revisit' else n_bytes}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def parse_header(header: bytes) -> dict[str, str]:
    first, *lines = header.decode("utf-8", "surrogatepass").removesuffix("\r\n\r\n").split("\r\n")
    if first != "WARC/1.0":
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of the bytes of one whole record."""
    at = record.index(b"\r\n\r\n") + 4
    h = parse_header(record[:at])
    end = at + int(h["Content-Length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError(f"record {h['WARC-Record-ID']} does not fit its header")
    return h, record[at:end]


def write_archive(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Archive ``pages`` (``page_id``, ``url``, ``html``; further columns are ignored) under ``path``.

    Of records with equal payloads of at least ``min_payload`` bytes the one with the largest page_id (ties: the
    last row) becomes a response, the others revisits of it; smaller payloads are all responses.  A null html is
    an empty payload; a null url leaves out its header line; a null page_id sorts before all others.  An empty
    table makes an empty archive.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = stage(pages.select(F.monotonically_increasing_id().alias("rec_no"), F.col("page_id").cast("long").alias("page_id"),
                              "url", payload.alias("_p"))
                 .select("rec_no", "page_id", "url", F.octet_length("_p").cast("long").alias("n_bytes"),
                         F.sha1("_p").alias("sha1"), F.sha2("_p", 256).alias("sha256")), "records")
    # one row a distinct payload: its response (a maximum, combined before the exchange); written, so that the join deals
    # both sides anew and can split the rows of a payload that very many pages share
    large = rows.filter(F.col("n_bytes") >= min_payload)
    last = stage(large.groupBy("sha256").agg(F.max(F.struct("page_id", "rec_no")).alias("to")), "responses")
    typed = rows.join(last, "sha256", "left").select(
        "*", F.coalesce((F.col("n_bytes") >= min_payload) & (F.col("rec_no") != F.col("to.rec_no")), F.lit(False)).alias("revisit"))

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rs = b.to_pylist()
            kinds = ["revisit" if r["revisit"] else "response" for r in rs]
            made = [_header(k, r["rec_no"], r["page_id"], r["url"], r["n_bytes"], r["sha1"], r["sha256"],
                            r["to_rec"], r["to_page"]) for k, r in zip(kinds, rs)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["rec_no"] for r in rs], pa.int64()), pa.array([r["page_id"] for r in rs], pa.int64()),
                pa.array([r["sha256"] for r in rs], pa.string()), pa.array([r["n_bytes"] for r in rs], pa.int64()),
                pa.array(kinds, pa.string()), pa.array(made, pa.binary())],
                ["rec_no", "page_id", "sha256", "n_bytes", "record_type", "header"])

    (typed.select("rec_no", "page_id", "url", "n_bytes", "sha1", "sha256", "revisit",
                  F.col("to.rec_no").alias("to_rec"), F.col("to.page_id").alias("to_page"))
     .mapInArrow(headers, HEADERS).write.parquet(f"{path}/headers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            data = [p.as_py() for p in b.column(0)]
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.sha256(p).hexdigest() for p in data], pa.string()),
                pa.array([compressor.compress(p) for p in data], pa.binary())], ["sha256", "payload"])

    (pages.select(payload.alias("_p")).mapInArrow(pack, PAYLOADS).dropDuplicates(["sha256"])
     .write.option("compression", "none").parquet(f"{path}/payloads"))


def read_archive(spark: SparkSession, path: str, with_records: bool = True) -> DataFrame:
    """RECORDS of the archive at ``path``, each rebuilt from its header and payload and parsed again.

    A payload whose bytes don't have the stored digest, or a record whose length is not its header's, raises.
    All columns come from parsing the record's bytes.  ``record`` is the exact WARC record (null with
    ``with_records=False``, when the bytes are made and parsed but not returned); payload_bytes and payload_digest are of
    the full payload also for revisits, whose own block is empty.
    """
    bounded_batches(spark)
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers").select("sha256", "header")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = [x.strip().split()[0] for x in RECORDS.split(",")]
        number = lambda h, k: int(h[k]) if k in h else None
        for b in batches:
            out = []
            for digest, header, packed in zip(*(c.to_pylist() for c in b.columns)):
                data = unpack.decompress(packed)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"payload {digest} is damaged")
                revisit = parse_header(header)["WARC-Type"] == "revisit"
                record = header + (b"" if revisit else data) + b"\r\n\r\n"
                h, block = parse_record(record)
                full = data if revisit else block  # a revisit's payload is that of the record it refers to
                sha1 = base64.b32encode(hashlib.sha1(full).digest()).decode()
                if h["WARC-Payload-Digest"] != f"sha1:{sha1}":
                    raise ValueError(f"record {h['WARC-Record-ID']} does not fit its header")
                url = h.get("WARC-Target-URI")
                if "WARC-Target-URI-Base64" in h:
                    url = base64.b64decode(h["WARC-Target-URI-Base64"]).decode("utf-8", "surrogatepass")
                out.append((number(h, "WARC-Page-ID"), len(full), sha1, h["WARC-Type"], number(h, "WARC-Refers-To-Page-ID"),
                            url, record if with_records else None))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names)

    return headers.join(payloads, "sha256").select("sha256", "header", "payload").mapInArrow(rebuild, RECORDS)
