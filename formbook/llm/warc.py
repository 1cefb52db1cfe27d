"""WARC archives: writing pages, and normalising whole-file gzip to one member per record.

``write_monolithic`` writes archives as many crawlers leave them: one gzip stream for
the whole file, in which no record can be reached without inflating all before it. They are
plain Spark text files: a row is a record, and the line separator is the blank lines that end one.

``normalise`` inflates each such stream once, in pieces, cuts it at the records' own
lengths and writes every record as a gzip member of its own, with an index of offsets beside the
archive. ``read_records`` follows that index and inflates single members.

Archives are rolled at a number of records and may be of any size: a task reads, inflates and writes them in pieces and
holds no more than a piece and one record. Neighbouring members are fetched in one read. Writers put a file under a temporary name into the same folder and rename it when it is
whole; a task that runs again writes the same file again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import nullable
from formbook.operators.durable import fresh_folder, written

_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_INDEX = "page_id long, record_type string, archive string, offset long, length long"
_RECORD = "page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long, url string, payload binary"


def digest32(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def record_types(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, url, html, _digest, _first``: of payloads of at least ``least_bytes`` that are equal (by
    SHA-1 and length), ``_first`` is the smallest page. Groups are folded before they are shuffled, and pages
    meet their group by page, so a payload that a third of pages share burdens no task."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"))
    keys = written(
        pages.select("page_id", digest32(payload.cast("binary")).alias("_digest"), F.octet_length("html").alias("_bytes"))
    )
    groups = keys.filter(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    later = keys.join(groups.filter("_n > 1"), ["_digest", "_bytes"]).filter("page_id > _first").select("page_id", "_digest", "_first")
    named = pages.withColumn("_digest", digest32(payload.cast("binary")))
    return named.join(later.distinct(), ["page_id", "_digest"], "left")


def _record() -> Column:
    """A page as one WARC record, without the blank lines that end it."""
    size, revisit = F.octet_length("html").cast("string"), F.col("_first").isNotNull()
    http = F.concat(F.lit(_HTTP), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("_first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block)


def write_monolithic(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_archive: int = 2_000) -> None:
    """Write ``pages`` (page_id, url, html) as gzip files that are one stream each."""
    records = record_types(pages, least_bytes).select(_record().alias("value"))
    (
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_archive).text(folder)
    )


def _inflated(source: BinaryIO, step: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file's content in pieces of bounded size; several members follow one another."""
    unzip = zlib.decompressobj(31)
    while part := source.read(step):
        while part:
            yield unzip.decompress(part, step)
            part = unzip.unconsumed_tail or unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def split_records(source: BinaryIO | bytes) -> Iterator[bytes]:
    """The records of an archive, each with the blank lines that end it."""
    held, pieces, need = bytearray(), _inflated(io.BytesIO(source) if isinstance(source, bytes) else source), 0
    for piece in pieces:
        held += piece
        while held:
            if not need:
                stop = held.find(_END)
                if stop < 0:
                    break
                need = stop + 2 * len(_END) + int(_headers(bytes(held[:stop]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"the archive ends inside a record, {len(held)} bytes after its start")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _page(urn: str | None) -> int | None:
    name = (urn or "")[len("<urn:page:") : -1]
    return int(name) if name else None


def _put(filesystem: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    filesystem.move(temporary, path)


def normalise(spark: SparkSession, monolithic: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite every archive of a folder with one gzip member per record; returns the offset index
    (``page_id, record_type, archive, offset, length``), which also lies beside each archive as ``.cdxj``."""
    def rewrite(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (monoliths, _), (filesystem, root) = fs.FileSystem.from_uri(_uri(monolithic)), fs.FileSystem.from_uri(_uri(folder))
        filesystem.create_dir(root)
        for part in parts:
            for path in part["path"]:
                name = path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                rows: list[tuple] = []

                def members(path: str = path, rows: list = rows, name: str = name) -> Iterator[bytes]:
                    offset = 0
                    with monoliths.open_input_stream(fs.FileSystem.from_uri(_uri(path))[1], compression=None) as source:
                        for record in split_records(source):
                            head = _headers(record[: record.index(_END)])
                            zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = zipped.compress(record) + zipped.flush()
                            rows.append((_page(head["warc-record-id"]), head["warc-type"], name, offset, len(member)))
                            offset += len(member)
                            yield member

                _put(filesystem, f"{root}/{name}", members())
                lines = (json.dumps(dict(zip(("page_id", "type", "archive", "offset", "length"), r))).encode() + b"\n" for r in rows)
                _put(filesystem, f"{root}/{name}.cdxj", lines)
                yield nullable(rows, _INDEX, "page_id")

    # Only the paths travel: content is read as a stream by the task that rewrites it.
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(monolithic)
    return written(archives.select("path").mapInPandas(rewrite, _INDEX))


def _ranges(wanted: pd.DataFrame, most: int = 1 << 22) -> Iterator[tuple[int, int, list[int]]]:
    """Offset and length of reads that each take in neighbouring members, up to ``most`` bytes or one member, and their lengths."""
    start, size, lengths = 0, 0, []
    for offset, length in sorted(zip(wanted["offset"].tolist(), wanted["length"].tolist())):
        if lengths and (offset != start + size or size + length > most):
            yield start, size, lengths
            size, lengths = 0, []
        if not lengths:
            start = offset
        size += length
        lengths.append(length)
    if lengths:
        yield start, size, lengths


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an index: headers, and payload (a revisit has none; nor has any without ``payloads``, whose
    payloads are verified all the same). ``payload_bytes`` is the length that the HTTP header states, which a revisit keeps
    too; for a response it is verified, as is the digest."""
    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = fs.FileSystem.from_uri(_uri(folder))
        for part in parts:
            for archive, wanted in part.groupby("archive"):
                with filesystem.open_input_file(f"{root}/{archive}") as source:
                    for offset, size, lengths in _ranges(wanted):
                        source.seek(offset)
                        members, at, rows = source.read(size), 0, []
                        for length in lengths:
                            rows.append(_parsed(zlib.decompress(members[at : at + length], 31), payloads))
                            at += length
                        yield nullable(rows, _RECORD, "page_id", "refers_to")

    return index.mapInPandas(fetch, _RECORD)


def _parsed(record: bytes, payloads: bool) -> tuple:
    stop = record.index(_END)
    head = _headers(record[:stop])
    block = record[stop + len(_END) : stop + len(_END) + int(head["content-length"])]
    stop = block.index(_END)
    size, payload = int(_headers(block[:stop])["content-length"]), block[stop + len(_END) :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (
        len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"the payload of {head['warc-record-id']} does not match its headers")
    return (
        _page(head["warc-record-id"]), head["warc-type"], digest, _page(head.get("warc-refers-to")), size,
        head["warc-target-uri"], payload if payloads and head["warc-type"] == "response" else None,
    )


def _uri(path: str) -> str:
    """A path as Arrow's file systems take it: local ones with an empty authority."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def round_trip(pages: DataFrame, least_bytes: int = 0, records_per_archive: int = 2_000) -> DataFrame:
    """Write ``pages``, normalise the archives, and read every record back through the index:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.

    A null payload is an empty one. Rows that repeat an identifier are written
    and returned as often; a null one comes back null and is no group's first page. White space and control characters in an
    address are left out. An empty table gives archives without records and an empty result.
    """
    spark = pages.sparkSession
    root = _uri(fresh_folder(spark, "warc"))
    write_monolithic(pages, f"{root}/monolithic", least_bytes, records_per_archive)
    index = normalise(spark, f"{root}/monolithic", f"{root}/members")
    return read_records(index, f"{root}/members", payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
