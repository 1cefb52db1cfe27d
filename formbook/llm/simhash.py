"""Near duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints that differ in at most ``radius`` of 64 bits, cut into ``radius + 1`` or more
segments, agree on at least ``segments - radius`` of them. Distinct fingerprints are dealt once for every
such choice of segments by the bits there, so each link meets in some cell. How many segments are
used follows from the number of fingerprints and changes the cost only, never the result.

Inside a cell fingerprints are sorted by Gray rank, where neighbours differ in few bits.
Consecutive ones form a leaf, consecutive nodes form an upper node; a node keeps the bits that
all below it share, as a mask and a value. The join descends by pairs of nodes: what two
nodes differ by in bits both share is a lower bound for every pair below them, and a pair of nodes
beyond the radius goes as a whole. The bits in which a node's members are not all equal are an upper bound:
a node within the radius is one group at once, without looking at its pairs.

A cell beyond a size is never gathered: its fingerprints are dealt in the same order into blocks of bounded size,
blocks are the top nodes of its tree, and every pair of blocks that the lower bound leaves is one small join.

A cell returns a forest: at most one link per fingerprint, never all pairs of a
group. Components of all links are found by joins that hand every fingerprint the smallest
identifier in reach, with shortcuts, so a chain of n links takes about log n rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.llm.common import join_small, numbered, utf8, without_rows
from formbook.operators.durable import written

_SEED, _BITS, _LEAF, _FAN = 42, 64, 8, 4


def fingerprint(raw: bytes, width: int) -> int:
    """SimHash over the text's ``width``-word shingles, A-Z lower-cased, repeats included."""
    words = raw.lower().split()  # bytes know ASCII case and the six ASCII white-space characters only
    if not words:
        return 0
    text = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], _SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n)
    ones = np.zeros(_BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # 64 bytes per hash: very long texts go in pieces
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(_BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(width: int):
    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return simhash


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            upper = self.up[self.up]
            if np.array_equal(upper, self.up):
                return self.up
            self.up = upper

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves up: of each node the bits set in all members, and those set in any."""
    alls, anys, size = values, values, _LEAF
    levels = []
    while True:
        cuts = np.arange(0, len(alls), size)
        alls, anys = np.bitwise_and.reduceat(alls, cuts), np.bitwise_or.reduceat(anys, cuts)
        levels.append((alls, anys))
        if len(cuts) == 1:
            return levels
        size = _FAN


def _below(a: np.ndarray, b: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a child of ``a`` with a child of ``b``, once for a node with itself."""
    i = (a[:, None] * fan + np.arange(fan))[:, :, None]
    j = (b[:, None] * fan + np.arange(fan))[:, None, :]
    i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
    real = (i < count) & (j < count) & (i <= j)
    return i[real], j[real]


def cell_links(values: np.ndarray, radius: int, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller-placed value of its group) that connect exactly what ``radius`` connects.

    The descent goes depth first over blocks of at most ``at_once`` node pairs, so its memory
    does not grow with the number of pairs looked at."""
    values = values[np.argsort(gray_rank(values), kind="stable")]
    forest, levels = _Forest(len(values)), _levels(values)
    # A node whose members differ in few enough bits is one group.
    for depth, (alls, anys) in enumerate(levels):
        node = np.arange(len(values)) // (_LEAF * _FAN**depth)
        tight = (np.bitwise_count(alls ^ anys) <= radius)[node]
        where = np.flatnonzero(tight)
        forest.link(where, node[where] * (_LEAF * _FAN**depth))
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > at_once:
            stack.append((depth, a[at_once:], b[at_once:]))
            a, b = a[:at_once], b[:at_once]
        if depth < 0:
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= radius)
            forest.link(a[near], b[near])
            continue
        alls, anys = levels[depth]
        # Bits that both nodes share and have different: in all of one and in none of the other.
        apart = np.bitwise_count((alls[a] & ~anys[b]) | (alls[b] & ~anys[a]))
        near = apart <= radius
        near &= (a != b) | (np.bitwise_count(alls[a] ^ anys[a]) > radius)
        a, b = a[near], b[near]
        if len(a):
            count = len(levels[depth - 1][0]) if depth else len(values)
            stack.append((depth - 1, *_below(a, b, _FAN if depth else _LEAF, count)))
    root = forest.roots()
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def _segments(count: int, radius: int) -> int:
    """Segments so that a cell of evenly spread fingerprints holds a few hundred at most."""
    segments = radius + 1
    while segments < 2 * radius + 4 and count / 2 ** (_BITS * (segments - radius) / segments) > 256:
        segments += 1
    return segments


def near_links(prints: DataFrame, radius: int, most: int = 100_000) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of column ``fp`` that connect what the radius connects. A task holds about
    ``most`` fingerprints of a cell."""
    segments = _segments(prints.count(), radius)
    edges = [round(i * _BITS / segments) for i in range(segments + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(segments), segments - radius)]
    signed = [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]
    cells = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]
    dealt = prints.select("fp", F.inline(F.array(*cells)))
    sizes = dealt.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    large = written(sizes.filter(F.col("n") > most))
    in_large = large.agg(F.sum("n")).first()[0] or 0

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[part["n"] > 1]
            for fps in part["fps"]:
                a, b = cell_links(np.array(fps, dtype=np.int64).view(np.uint64), radius)
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    small = join_small(dealt, large, ["choice", "bits"], "left_anti") if in_large else dealt
    grouped = small.groupBy("choice", "bits").agg(F.collect_list("fp").alias("fps"), F.count("*").alias("n")).filter("n > 1")
    found = grouped.select("n", "fps").mapInPandas(join, "a long, b long")
    if in_large:
        blocks = _block_pairs(join_small(dealt, large.drop("n"), ["choice", "bits"]), radius, -(-2 * in_large // most))
        found = found.union(blocks.mapInPandas(join, "a long, b long"))
    return found.distinct()


def _block_pairs(dealt: DataFrame, radius: int, count: int) -> DataFrame:
    """``n, fps`` of every pair of blocks of a cell, and of every block, that may have a link in it. ``dealt`` is cut into
    ``count`` ranges by cell and Gray rank; where a cell begins or ends inside a range, a block does too."""
    @F.pandas_udf("long")
    def rank(fps: pd.Series) -> pd.Series:
        ranks = gray_rank(fps.to_numpy(dtype=np.int64).view(np.uint64))
        return pd.Series((ranks ^ np.uint64(1 << 63)).view(np.int64))  # in the same order as signed numbers

    cell = ["choice", "bits"]
    ranked = written(dealt.withColumn("_rank", rank("fp")).repartitionByRange(count, *cell, "_rank").withColumn("_block", F.spark_partition_id()))
    blocks = written(
        ranked.groupBy(*cell, "_block").agg(F.collect_list("fp").alias("fps"), F.bit_and("fp").alias("alls"), F.bit_or("fp").alias("anys"))
    )
    bounds = blocks.select(*cell, "_block", "alls", "anys")
    one = bounds.select(*cell, *[F.col(c).alias(f"{c}1") for c in ("_block", "alls", "anys")])
    two = bounds.select(*cell, *[F.col(c).alias(f"{c}2") for c in ("_block", "alls", "anys")])
    apart = (F.col("alls1").bitwiseAND(F.bitwise_not("anys2"))).bitwiseOR(F.col("alls2").bitwiseAND(F.bitwise_not("anys1")))
    pairs = one.join(two, cell).filter((F.col("_block1") <= F.col("_block2")) & (F.bit_count(apart) <= radius)).select(*cell, "_block1", "_block2")
    for side in "12":
        pairs = pairs.join(blocks.select(*cell, F.col("_block").alias(f"_block{side}"), F.col("fps").alias(f"fps{side}")), [*cell, f"_block{side}"])
    both = F.when(F.col("_block1") == F.col("_block2"), F.col("fps1")).otherwise(F.concat("fps1", "fps2"))
    return pairs.select(both.alias("fps")).select(F.size("fps").cast("long").alias("n"), "fps")


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """``fp, component``: the smallest ``name`` of all that the links connect with ``fp``.

    ``names`` has ``fp, name`` for every linked value. In a round every value takes the smallest label
    among its neighbours' and its own (with the neighbours' label of the round before as further
    neighbour: the shortcut). Rounds are written, so a lost executor costs one round at most."""
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = both.select(F.col("a").alias("fp")).distinct()
    state = written(names.join(linked, "fp").select("fp", F.col("name").alias("label")))
    while True:
        offered = both.join(state, both["b"] == state["fp"]).select(F.col("a").alias("fp"), "label")
        nearest = written(state.union(offered).groupBy("fp").agg(F.min("label").alias("label")))
        # Shortcut: whoever holds the label of a name takes over what that name's value holds now.
        owner = nearest.join(names, "fp").select(F.col("name").alias("label"), F.col("label").alias("further"))
        jumped = written(
            nearest.join(owner, "label", "left").select("fp", F.coalesce(F.least("label", "further"), "label").alias("label"))
        )
        changed = jumped.join(state.withColumnRenamed("label", "before"), "fp").filter("label < before").limit(1).count()
        state = jumped
        if not changed:
            return state.select("fp", F.col("label").alias("component"))


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[Column, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id``, ``kept``.

    ``component_id`` is the smallest identifier among rows linked directly or through others,
    where rows link at ``radius`` or fewer differing bits. Texts under ``width`` words are one
    shingle; a null, empty or blank text has fingerprint zero and links like any other. Null
    identifiers never name a component that has others; else its name is null. Exactly one row of a component
    is kept, one that has its name; rows that repeat an identifier share a component only if they link. An empty
    table gives an empty result. ``carry`` adds columns.
    """
    name = F.col(id_col).alias("doc_id")
    rows = numbered(docs.select(name, _fingerprints(width)(utf8(text_col)).alias("fp"), *carry))
    carried = docs.select(*carry).columns
    # Equal fingerprints are one from here on; a group of copies is folded before it is shuffled.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row"))
    prints = written(rows.groupBy("fp").agg(first.alias("first"), F.min("_row").alias("name")))
    found = components(near_links(prints, radius), prints.select("fp", "name"))
    named = written(prints.join(found, "fp", "left").withColumn("component", F.coalesce("component", "name")))
    firsts = named.groupBy("component").agg(F.min("first").alias("of_all"))
    named = named.join(firsts, "component").select("fp", "of_all")
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("of_all.doc_id").alias("component_id"),
        (F.col("_row") == F.col("of_all._row")).alias("kept"),
        *carried,
    )


def without_near_copies(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of every component, all columns."""
    def dropped(rows: DataFrame) -> DataFrame:
        texts = rows.select("_doc.doc_id", "_doc.text", F.col("_row").alias("_number"))
        found = near_duplicates(texts, width, radius, carry=(F.col("_number"),))
        return found.filter("NOT kept").select(F.col("_number").alias("_row"))

    return without_rows(docs, dropped)
