"""Removal of repeated substrings by longest previous factors in suffix order.

A byte goes if a string of ``least`` bytes that covers it starts earlier as well: where the longest
previous factor of a position is ``least`` or more, that many bytes from there on are repeats. Only suffixes cut
off at ``least`` bytes matter for this. Suffixes that are equal so far form an interval of the suffix order
(all common prefixes in it are ``least`` long); in an interval suffixes follow in order of position, so
the previous smaller position is the neighbour before, a next smaller one does not exist, and the factor is long enough
exactly for all but the first. The first, the earliest copy, is kept.

No machine holds the corpus' suffix array. Every window of ``least`` bytes elects an anchor,
the gram in it with the smallest hash, so equal windows have equal anchors at equal places. Steps:

1. Documents are put into blocks, written compressed. Blocks send the hashes of their anchors to buckets.
2. A bucket tells each block which of its anchors other blocks have too. All others have no copy elsewhere.
3. A block sends its shared anchors, each with the bytes of the windows that elected it, to the
   anchor's bucket, where suffixes at the anchor and reversed prefixes before it are sorted. Their common prefixes
   cut both orders into intervals for every split of the window, and pairs of intervals are the intervals
   of the window's suffix.
4. What is found repeated goes back to the blocks as runs of positions.

Whatever repeats something earlier is not needed to find other repeats, as the earliest copy still
is there. So blocks first drop repeats among themselves, then groups of ``fan_in`` blocks, and so on; a passage
that a third of all documents share arrives in a bucket once per group at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import nullable, utf8, written_by
from formbook.operators.durable import written

_GRAM = 32
#: A block ends at so many bytes or documents. Bytes of corpus to a bucket of occurrences.
_BLOCK, _DOCUMENTS, _BUCKET = 2 << 20, 60_000, 16 << 20
_INDEX_BITS = 21
_LAST = np.iinfo(np.int64).max
_ROWS = "kind int, key long, part long, data binary"
_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: What a row holds: in the first table texts or hashes, then occurrences or runs of repeats.
_TEXTS, _HASHES, _LIVE, _RUNS = 0, 1, 0, 1


# ---- packing arrays into one binary -------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    at, found = 8 * (1 + len(kinds)), []
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, 1 + len(kinds))[1:]):
        found.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return found


# ---- anchors ------------------------------------------------------------------------------------


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``_GRAM`` bytes from each position on, by doubling."""
    rng = np.random.default_rng(20)
    hashes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[text]
    size = 1
    while size < _GRAM:
        factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        hashes = hashes[:-size] * factor + hashes[size:]
        size *= 2
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def anchors(text: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``(anchor, first window, last window, hash)`` of every run of windows that elect one anchor.

    ``text`` is the documents one after another, ``ends`` where each ends. Of equal hashes the leftmost wins."""
    none = np.empty(0, dtype=np.int64)
    if len(text) < least:
        return none, none, none, np.empty(0, dtype=np.uint64)
    hashes = _gram_hashes(text)
    place = np.arange(len(hashes), dtype=np.uint64)
    best = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    span, size = least - _GRAM + 1, 1
    while 2 * size <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < span:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    owner = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(owner), dtype=bool)  # windows within one document
    for end in ends[:-1]:
        inside[max(0, end - least + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, np.empty(0, dtype=np.uint64)
    owner = owner[starts]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return owner[new], starts[new], starts[last], hashes[owner[new]]


# ---- occurrences of shared anchors --------------------------------------------------------------


@dataclass
class Occurrences:
    """Anchors with the bytes of their windows: ``order`` and ``tie`` place the document, ``start`` is the
    first window there, ``left`` the bytes from it to the anchor, ``count`` the windows."""

    order: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    left: np.ndarray
    count: np.ndarray
    text: np.ndarray
    offset: np.ndarray  # of each one's bytes in ``text``
    bucket: np.ndarray  # where it goes; not sent along

    KINDS = ("int64", "int64", "int64", "uint8", "uint8", "uint8")

    @staticmethod
    def read(parts: list[bytes], least: int) -> Occurrences:
        columns = [np.concatenate(c) for c in zip(*(_unpack(p, *Occurrences.KINDS) for p in parts))]
        sizes = columns[4].astype(np.int64) + least - 1
        return Occurrences(*columns, np.cumsum(sizes) - sizes, np.zeros(len(sizes), dtype=np.int64))

    def take(self, chosen: np.ndarray, least: int) -> Occurrences:
        sizes = self.count[chosen].astype(np.int64) + least - 1
        offset = np.cumsum(sizes) - sizes
        text, shift = np.empty(int(sizes.sum()), dtype=np.uint8), self.offset[chosen] - offset
        for part in range(0, len(chosen), 1 << 12):  # an index takes eight times the bytes it gathers
            own = slice(part, part + (1 << 12))
            begin, end = offset[own][0], offset[own][-1] + sizes[own][-1]
            text[begin:end] = self.text[np.repeat(shift[own], sizes[own]) + np.arange(begin, end)]
        return Occurrences(
            *(c[chosen] for c in (self.order, self.tie, self.start, self.left, self.count)), text, offset,
            self.bucket[chosen],
        )

    def pack(self) -> bytes:
        return _pack(self.order, self.tie, self.start, self.left, self.count, self.text)


def _sorted_common(words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and for each but the first its common prefix with the one before."""
    keys = np.ascontiguousarray(words.view(">u8").astype(np.uint64).T)
    order = np.lexsort(keys[::-1])
    rows = words[order]
    common = np.full(len(order), limit, dtype=np.int64)
    common[0] = 0
    for at in range(1, len(rows), 1 << 16):
        differ = rows[at : at + (1 << 16), :limit] != rows[at - 1 : at - 1 + len(rows[at : at + (1 << 16)]), :limit]
        common[at : at + (1 << 16)] = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
    return order, common


def _contexts(found: Occurrences, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix at each anchor, and the reversed prefix before it, with zeros where its windows end."""
    n, reach = len(found.left), least - _GRAM
    right = np.zeros((n, -(-least // 8) * 8), dtype=np.uint8)
    left = np.zeros((n, -(-reach // 8) * 8), dtype=np.uint8)
    before = found.left.astype(np.int64)
    after = found.count.astype(np.int64) + least - 1 - before
    for at in range(0, n, 1 << 15):
        part = slice(at, at + (1 << 15))
        middle = (found.offset[part] + before[part])[:, None]
        step = np.arange(least)
        right[part, :least] = np.where(step < after[part, None], found.text[np.minimum(middle + step, len(found.text) - 1)], 0)
        step = np.arange(reach)
        left[part, :reach] = np.where(step < before[part, None], found.text[np.maximum(middle - 1 - step, 0)], 0)
    return right, left


def repeated_windows(found: Occurrences, least: int) -> np.ndarray:
    """For each occurrence (in order of position) and each of its windows: does it start earlier as well?
    One row per occurrence, one column per number of bytes from the window's start to the anchor."""
    n, reach = len(found.left), least - _GRAM
    repeated = np.zeros((n, reach + 1), dtype=bool)
    if n < 2:
        return repeated
    right, left = _contexts(found, least)
    (right_order, right_common), (left_order, left_common) = _sorted_common(right, least), _sorted_common(left, reach)
    first = found.left.astype(np.int64) - found.count + 1
    right_interval, left_interval = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    for ahead in range(reach + 1):
        own = np.flatnonzero((first <= ahead) & (ahead <= found.left))
        if len(own) < 2:
            continue
        right_interval[right_order] = np.cumsum(right_common < least - ahead)
        left_interval[left_order] = np.cumsum(left_common < ahead)
        pair = right_interval[own] * np.uint64(n + 1) + left_interval[own]
        if n < 1 << _INDEX_BITS:  # interval and position in one number: sorted, a first is where the interval changes
            both = np.sort((pair << np.uint64(_INDEX_BITS)) | own.astype(np.uint64))
            pair, at = both >> np.uint64(_INDEX_BITS), (both & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
        else:
            by = np.argsort(pair, kind="stable")
            pair, at = pair[by], own[by]
        repeated[at[1:][pair[1:] == pair[:-1]], ahead] = True
    return repeated


def settle(found: Occurrences, least: int) -> tuple[np.ndarray, Occurrences]:
    """Runs of repeated windows as rows (tie, first, last), and the occurrences that have others left."""
    found = found.take(np.lexsort((found.start, found.tie, found.order)), least)
    repeated = repeated_windows(found, least)
    # By position: column 0 is the first window.
    by_window = np.zeros_like(repeated)
    for left in np.unique(found.left):
        rows = np.flatnonzero(found.left == left)
        by_window[rows, : left + 1] = repeated[rows, left::-1]
    own = np.arange(repeated.shape[1]) < found.count[:, None]
    repeated = by_window & own
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    runs = np.stack([found.tie[row], found.start[row] + begin, found.start[row] + end - 1], axis=1)
    fresh = own & ~repeated
    return runs, found.take(np.flatnonzero(fresh.any(axis=1)), least)


# ---- operator -----------------------------------------------------------------------------------


def _blocks(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """Written table: blocks of documents, and for each bucket the hashes of a block's anchors."""

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 16, 0
        names: list[int | None] = []
        texts: list[bytes] = []

        def emit() -> pd.DataFrame:
            ids = np.array([0 if x is None else x for x in names], dtype=np.int64)
            known = np.array([x is not None for x in names])
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            text = np.frombuffer(b"".join(texts), np.uint8)
            bucket, rest = _place(np.unique(anchors(text, np.cumsum(sizes), least)[3]), buckets)
            rows = [(_TEXTS, block, -1, _pack(ids, known, sizes, text))]
            rows += [(_HASHES, b, block, _pack(rest[at])) for b, at in _each(bucket)]
            names.clear()
            texts.clear()
            return pd.DataFrame(rows, columns=["kind", "key", "part", "data"])

        for part in parts:
            for name, known, raw in zip(part["_id"], part["_known"], part["_raw"]):
                names.append(int(name) if known else None)
                texts.append(raw)
                size += len(raw)
                if size >= _BLOCK or len(names) == _DOCUMENTS:
                    yield emit()
                    block, size = block + 1, 0
        if names:
            yield emit()

    # A column with nulls would reach Python as floats.
    known = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNotNull().alias("_known"), utf8().alias("_raw"))
    return written_by(known.mapInPandas(build, _ROWS), "kind")


def _each(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every key with the places where it stands."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(keys[at[0]]), at


def _place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and 32 further bits that stand for it there."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return bucket.astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Which values are in ``rising``, by search: many small lists are held against a long one."""
    if not len(rising):
        return np.zeros(len(values), dtype=bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _shared(hashes: DataFrame) -> DataFrame:
    """``key`` (block), ``part`` (bucket), ``data``: the hashes of a block that another block has too."""

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d, "uint32")[0] for d in rows["data"]]
        # A block has each hash once, but for those that are alike in the bits kept: these may look shared.
        values = np.sort(np.concatenate(parts))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        found = [(b, key[0], p[_among(p, twice)]) for b, p in zip(rows["part"], parts)]
        return pd.DataFrame([(b, k, _pack(p)) for b, k, p in found if len(p)], columns=["key", "part", "data"])

    return hashes.groupBy("key").applyInPandas(meet, "key long, part long, data binary")


def _run_rows(runs: np.ndarray) -> list[tuple]:
    """Runs (tie, first, last) as rows for the blocks they lie in."""
    return [
        (_RUNS, block, -1, _pack(runs[at, 0] & 0xFFFF, runs[at, 1], runs[at, 2])) for block, at in _each(runs[:, 0] >> 16)
    ]


def _first_round(blocks: DataFrame, shared: DataFrame, least: int, hash_buckets: int, buckets: int, fan_in: int) -> DataFrame:
    """Occurrences of shared anchors, after every block has settled what repeats inside it."""
    replies = shared.groupBy("key").agg(F.collect_list(F.struct("part", "data")).alias("replies"))

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, data, found in zip(part["key"], part["data"], part["replies"]):
                ids, known, sizes, text = _unpack(data, "int64", "bool", "int64", "uint8")
                ends = np.cumsum(sizes)
                anchor, first, last, hashes = anchors(text, ends, least)
                _, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
                keep = times[inverse] > 1
                bucket, rest = _place(hashes, hash_buckets)
                replies = {r["part"]: r["data"] for r in found} if found is not None else {}
                for b, at in _each(bucket):
                    if b in replies:
                        keep[at] |= np.isin(rest[at], _unpack(replies[b], "uint32")[0])
                anchor, first, last, hashes = anchor[keep], first[keep], last[keep], hashes[keep]
                doc = np.searchsorted(ends, anchor, side="right")
                everything = Occurrences(
                    np.where(known, ids, _LAST)[doc], (block << 16) + doc, first - (ends - sizes)[doc],
                    (anchor - first).astype(np.uint8), (last - first + 1).astype(np.uint8), text, first,
                    _place(hashes, buckets)[0],
                )
                runs, live = settle(everything, least)
                rows = _run_rows(runs)
                group = (int(block) >> 16) // fan_in
                rows += [(_LIVE, b, group, live.take(at, least).pack()) for b, at in _each(live.bucket)]
                yield pd.DataFrame(rows, columns=["kind", "key", "part", "data"])

    joined = blocks.select("key", "data").join(replies, "key", "left").select("key", "data", "replies")
    return written_by(joined.mapInPandas(find, _ROWS), "kind")


def _round(live: DataFrame, least: int, fan_in: int, final: bool) -> DataFrame:
    """The occurrences of a bucket, of one group of blocks after the other."""

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs, left = settle(Occurrences.read(list(rows["data"]), least), least)
        found = _run_rows(runs)
        if not final and len(left.left):
            found.append((_LIVE, int(key[0]), int(key[1]) // fan_in, left.pack()))
        return pd.DataFrame(found, columns=["kind", "key", "part", "data"])

    return written_by(live.groupBy("key", "part").applyInPandas(meet, _ROWS), "kind")


def _cut(blocks: DataFrame, repeated: DataFrame, least: int) -> DataFrame:
    runs = repeated.groupBy("key").agg(F.collect_list("data").alias("runs"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data, found in zip(part["data"], part["runs"]):
                ids, known, sizes, text = _unpack(data, "int64", "bool", "int64", "uint8")
                begins = np.cumsum(sizes) - sizes
                marks = np.zeros(len(text) + 1, dtype=np.int32)
                for packed in found if found is not None else ():
                    doc, first, last = _unpack(packed, "int64", "int64", "int64")
                    np.add.at(marks, begins[doc] + first, 1)
                    np.add.at(marks, begins[doc] + last + least, -1)
                gone = np.cumsum(marks[:-1]) > 0
                rows = []
                for i, (begin, size) in enumerate(zip(begins, sizes)):
                    here = gone[begin : begin + size]
                    spans = int(here[:1].sum() + (here[1:] & ~here[:-1]).sum())
                    own = text[begin : begin + size]
                    kept = own[~here] if spans else own
                    rows.append((ids[i] if known[i] else None, size, int(here.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                yield nullable(rows, _CUT, "doc_id")

    joined = blocks.select("key", "data").join(runs, "key", "left").select("data", "runs")
    return joined.mapInPandas(cut, _CUT)


def remove_repeats(docs: DataFrame, least: int = 100, fan_in: int = 32) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null is empty; matches lie within a document. Earlier means a smaller
    ``doc_id``, or an earlier start in the same document; null identifiers come last, and rows that repeat an identifier follow in
    the order they were read. Texts under ``least`` bytes stay whole. An empty table gives an empty result.
    """
    if not _GRAM + 8 <= least <= 255:
        raise ValueError(f"least must be from {_GRAM + 8} to 255 bytes")
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // _BUCKET + 1
    # Hashes are small: many more go to one bucket where the corpus is large.
    hash_buckets = max(min(buckets, 512), buckets // 16)
    table = _blocks(docs, least, hash_buckets)
    blocks, hashes = table.filter(f"kind = {_TEXTS}"), table.filter(f"kind = {_HASHES}")
    found = _first_round(blocks, _shared(hashes.select("key", "part", "data")), least, hash_buckets, buckets, fan_in)
    repeated = found.filter(f"kind = {_RUNS}")
    while True:
        live = found.filter(f"kind = {_LIVE}").select("key", "part", "data")
        groups = live.agg(F.max("part")).first()[0]
        if groups is None:
            return _cut(blocks, repeated.select("key", "data"), least)
        found = _round(live, least, fan_in, final=groups == 0)
        repeated = repeated.union(found.filter(f"kind = {_RUNS}"))
