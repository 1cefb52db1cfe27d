import base64
import gzip
import hashlib
import io
import json
import zlib
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest

from formbook.llm import warc

SCHEMA = "page_id long, url string, html string, _digest string, _first long"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2 x", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nend"), (6, "u", "é漢" * 30_000),
    (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (8, "u", "é漢" * 30_000), (None, "u", "<p>nameless</p>"), (9, "\r\nX: y", "\x00"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 4) for p in PAGES], SCHEMA).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(pages, least):
    groups = defaultdict(list)
    for page_id, _, html in PAGES:
        if page_id is not None and len((html or "").encode()) >= least:
            groups[html or ""].append(page_id)
    want = []
    for page_id, _, html in PAGES:
        group = groups.get(html or "")
        first = min(group) if group and page_id is not None else page_id
        kind = "response" if first == page_id else "revisit"
        want.append((page_id, len((html or "").encode()), digest(html), kind, first if kind == "revisit" else None))
    found = warc.round_trip(pages, least_bytes=least, records_per_archive=2)
    got = [tuple(r)[:5] for r in found.collect()]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_members_and_index(spark, pages, tmp_path):
    warc.write_monolithic(pages, f"file://{tmp_path}/mono", records_per_archive=4)
    index = warc.normalise(spark, f"file://{tmp_path}/mono", f"file://{tmp_path}/members")
    rows = index.collect()
    assert len(rows) == len(PAGES)
    before, after = [], []
    for path in Path(tmp_path, "mono").glob("*.gz"):
        one = zlib.decompressobj(31)
        one.decompress(path.read_bytes())
        assert one.eof and not one.unused_data  # one stream
        before += list(warc.split_records(path.read_bytes()))
    for path in Path(tmp_path, "members").glob("*.warc.gz"):
        raw = path.read_bytes()
        lines = [json.loads(x) for x in Path(f"{path}.cdxj").read_text().splitlines()]
        own = sorted((r.offset, r.length) for r in rows if r.archive == path.name)
        assert own == sorted((x["offset"], x["length"]) for x in lines)
        assert sum(length for _, length in own) == len(raw)
        for offset, length in own:
            member = zlib.decompressobj(31)
            after.append(member.decompress(raw[offset : offset + length]))
            assert member.eof and not member.unused_data
        assert list(warc.split_records(raw)) == list(warc.split_records(gzip.compress(gzip.decompress(raw))))
    assert sorted(before) == sorted(after)
    assert not list(Path(tmp_path, "members").glob("*.tmp"))


def test_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.split_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))


def test_no_pages(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Records larger than a piece, members of several reads, and a stream no part of which is held whole."""
    rows = [(i, "u", chr(97 + i) * (300_000 + i) + str(i), "x", 4) for i in range(12)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in found.items()} == {r[0]: (len(r[2]), digest(r[2])) for r in rows}
    raw = b"".join(gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 40_000) for _ in range(2))

    class Source(io.BytesIO):
        def read(self, size):
            assert size <= 1 << 18
            return super().read(size)

    assert sum(1 for _ in warc.split_records(Source(raw))) == 80_000
    assert max(map(len, warc._inflated(Source(raw)))) <= 1 << 18


def test_reads_take_in_neighbours(spark):
    wanted = pd.DataFrame([(30, 5), (0, 10), (10, 20), (50, 1), (51, 100), (151, 3)], columns=["offset", "length"])
    assert list(warc._ranges(wanted, 40)) == [(0, 35, [10, 20, 5]), (50, 1, [1]), (51, 100, [100]), (151, 3, [3])]
