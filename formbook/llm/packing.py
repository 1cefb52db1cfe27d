"""Best-fit packing of token sequences by linear grouping.

Only lengths matter to a packing, and there are at most ``capacity`` different ones, so the
packing is planned on their histogram (one row per length, whatever the corpus) as bin types
with counts. Large lengths are sorted and cut into groups of equal cardinality, every length
rounded up to its group's largest; for these few sizes the fullest configurations are found by
dynamic programming and used as often as sizes last. Then real lengths take the places of
rounded ones, which leaves some room, and small lengths follow in falling order,
each into the bin with the least room that fits.

Documents get their places by rank among those of their length: the plan is a table of
rank ranges per length, at most a few times the number of bin types. Ranks are counted
in salted parts with offsets, so a length that a third of all pieces share is no single task's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import utf8
from formbook.operators.durable import written

_PIECES = "_row long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


# ---- tokens -------------------------------------------------------------------------------------


class Encoder:
    """Token ids of a byte-level BPE file, as its own library gives them without special tokens.

    The same vocabulary as ranks, read by a faster library, gives the same ids for ordinary
    text; texts that spell out a special token go through the file's own library."""

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._own = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self._special = [t.content for t in self._own.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if any(token in text for token in self._special):
            return self._own.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, ranks: str) -> DataFrame:
    """One row per piece. A document is its ids and ``end_id``; one longer than ``capacity`` is cut
    from the end into full pieces, so that the first may be shorter."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, ranks)
        for part in parts:
            rows = []
            for row, name, raw in zip(part["_row"], part["doc_id"], part["_raw"]):
                ids = np.array([*encoder.ids(raw.decode("utf-8", "replace")), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                stops = range(first, len(ids) + 1, capacity)
                for k, stop in enumerate(stops):
                    start = max(0, stop - capacity) if k else 0
                    rows.append((row, name, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            found = pd.DataFrame(rows, columns=["_row", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield found

    # Identifiers go through Python as text: a column of integers with nulls would reach it as floats.
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8().alias("_raw")).withColumn("_row", F.monotonically_increasing_id())
    return rows.mapInPandas(cut, _PIECES.format(id="string")).withColumn("doc_id", F.col("doc_id").cast(kind))


# ---- plan ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """``count`` equal bins: the items (length, copies) put in so far, newest first, as a linked list."""

    items: tuple | None
    count: int

    def add(self, length: int, copies: int, count: int) -> Bins:
        return Bins((length, copies, self.items), count)

    def contents(self) -> Iterator[tuple[int, int]]:
        at = self.items
        while at:
            length, copies, at = at
            yield length, copies


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Falling (length, count) cut into ``groups`` parts of equal cardinality (a length may lie in several)."""
    total = sum(count for _, count in lengths)
    ends = [total * (g + 1) // groups for g in range(groups)]
    parts, at, g = [[]], 0, 0
    for length, count in lengths:
        while count:
            while g < groups - 1 and at == ends[g]:
                g += 1
                parts.append([])
            taken = min(count, ends[g] - at) if g < groups - 1 else count
            parts[-1].append((length, taken))
            at, count = at + taken, count - taken
    return [p for p in parts if p]


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest bin that holds one of the largest left, no more than
    there are (a bounded knapsack). The largest go first, as they are the hardest to place later."""
    largest = next(k for k, have in enumerate(left) if have)
    base = sizes[largest]
    last = np.full(capacity + 1, -1, dtype=np.int64)  # the size that first reached this load
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[base] = True
    for k in range(largest, len(sizes)):
        size, layer = sizes[k], reach
        for _ in range(min(left[k] - (k == largest), (capacity - base) // size)):
            layer = np.concatenate((np.zeros(size, dtype=bool), layer[:-size])) & ~reach
            if not layer.any():
                break
            last[layer] = k
            reach = reach | layer
    counts, load = [0] * len(sizes), int(np.flatnonzero(reach)[-1])
    while load != base:
        counts[last[load]] += 1
        load -= sizes[last[load]]
    counts[largest] += 1
    return counts


def _substitute(configuration: list[int], times: int, stock: list[list[list[int]]], room: dict[int, list[Bins]], capacity: int) -> None:
    """``times`` bins of a configuration, filled with real lengths from each group's stock."""
    done = 0
    slots = [g for g, copies in enumerate(configuration) for _ in range(copies)]
    takes = []
    for g in slots:  # each place of the configuration takes the next ``times`` real lengths
        runs, need = [], times
        while need:
            length, count = stock[g][-1]
            part = min(need, count)
            runs.append([length, part])
            need -= part
            stock[g][-1][1] -= part
            if not stock[g][-1][1]:
                stock[g].pop()
        takes.append(runs)
    at = [0] * len(slots)
    while done < times:
        part = min(takes[s][at[s]][1] for s in range(len(slots)))
        made, load = Bins(None, part), 0
        for s in range(len(slots)):
            length = takes[s][at[s]][0]
            made, load = made.add(length, 1, part), load + length
            takes[s][at[s]][1] -= part
            at[s] += not takes[s][at[s]][1]
        room.setdefault(capacity - load, []).append(made)
        done += part


def best_plan(histogram: dict[int, int], capacity: int, groups: int) -> list[Bins]:
    """Of a few borders between large and small, the one that needs the fewest bins."""
    plans = [plan(histogram, capacity, groups, small) for small in (1 / 2, 1 / 3, 1 / 4, 1 / 8)]
    return min(plans, key=lambda bins: sum(b.count for b in bins))


def plan(histogram: dict[int, int], capacity: int, groups: int = 256, small: float = 1 / 4) -> list[Bins]:
    """Bin types with counts that hold every length as often as the histogram says."""
    falling = sorted(histogram.items(), reverse=True)
    large = [(length, count) for length, count in falling if length > capacity * small]
    parts = _groups(large, groups) if large else []
    sizes = [p[0][0] for p in parts]
    left = [sum(count for _, count in p) for p in parts]
    # Within a group the longest are used first: the stack's end.
    stock = [[[length, count] for length, count in reversed(p)] for p in parts]
    room: dict[int, list[Bins]] = {}
    while any(left):
        configuration = _fullest(sizes, left, capacity)
        times = min(have // need for have, need in zip(left, configuration) if need)
        _substitute(configuration, times, stock, room, capacity)
        left = [have - need * times for have, need in zip(left, configuration)]
    spaces = sorted(room)
    for length, count in falling[len(large) :]:
        while count:
            at = int(np.searchsorted(spaces, length))
            if at == len(spaces):
                each = capacity // length
                full, rest = divmod(count, each)
                for copies, bins in ((each, full), (rest, 1)):
                    if copies and bins:
                        _keep(room, spaces, capacity - copies * length, Bins(None, bins).add(length, copies, bins))
                break
            space = spaces[at]
            bins = room[space].pop()
            if not room[space]:
                del room[space], spaces[at]
            each = space // length
            full, rest = divmod(count, each)
            if full:
                full = min(full, bins.count)
                _keep(room, spaces, space - each * length, bins.add(length, each, full))
                count -= each * full
                if full < bins.count:
                    _keep(room, spaces, space, Bins(bins.items, bins.count - full))
            else:
                _keep(room, spaces, space - rest * length, bins.add(length, rest, 1))
                count = 0
                if bins.count > 1:
                    _keep(room, spaces, space, Bins(bins.items, bins.count - 1))
    return [bins for at in room.values() for bins in at]


def _keep(room: dict[int, list[Bins]], spaces: list[int], space: int, bins: Bins) -> None:
    if space not in room:
        room[space] = []
        spaces.insert(int(np.searchsorted(spaces, space)), space)
    room[space].append(bins)


def places(bins: list[Bins]) -> pd.DataFrame:
    """The plan as rank ranges: pieces of ``length`` with rank from ``first`` on go to sequences from
    ``sequence`` on, each at ``offset``."""
    rows, sequence, used = [], 0, {}
    for kind in bins:
        offset = 0
        for length, copies in kind.contents():
            for _ in range(copies):
                first = used.get(length, 0)
                rows.append((length, first, sequence, offset))
                used[length] = first + kind.count
                offset += length
        sequence += kind.count
    found = pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"])
    return found.sort_values(["length", "first"], ignore_index=True)


# ---- operator -----------------------------------------------------------------------------------


def _ranked(found: DataFrame, rows_per_part: int) -> DataFrame:
    """``found`` with ``_rank`` from 0 within its length. Parts of a length are ranked side by side."""
    parts = max(1, found.count() // rows_per_part)
    salted = found.withColumn("_part", F.pmod(F.xxhash64("_row", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_part").orderBy("_row", "piece")
    return salted.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["length", "_part"]).withColumn(
        "_rank", F.col("_start") + F.col("_at")
    )


def pack(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken", groups: int = 256, rows_per_part: int = 100_000,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is an empty document, which is ``end_id`` alone. Documents are packed row by row,
    also those that repeat or lack an identifier. Pieces of one length are interchangeable and
    go by row number. An empty table gives an empty result.
    """
    found = written(pieces(docs, capacity, end_id, vocabulary, ranks))
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = places(best_plan(histogram, capacity, groups))
    by_length = {length: part.to_numpy() for length, part in table.groupby("length")}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["sequence_id"] = part["offset"] = np.int64(0)
            for length, rows in part.groupby("length"):
                ranges = by_length[length]
                at = np.searchsorted(ranges[:, 1], rows["_rank"].to_numpy(), side="right") - 1
                part.loc[rows.index, "sequence_id"] = ranges[at, 2] + rows["_rank"].to_numpy() - ranges[at, 1]
                part.loc[rows.index, "offset"] = ranges[at, 3]
            yield part[columns]

    kind, schema = docs.schema["doc_id"].dataType, _PIECES.format(id="string").replace("_row long, ", "")
    ranked = _ranked(found, rows_per_part).select(F.col("doc_id").cast("string").alias("doc_id"), *columns[1:5], "_rank")
    placed = ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind))
