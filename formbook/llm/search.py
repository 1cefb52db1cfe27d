"""Ranked lexical search by dense blocked multiplication.

Items are searched in blocks. A block's distinct terms are its vocabulary, numbered without gaps; every other
word of a document counts for its length only. Documents come in tiles: the impacts of a tile's terms fill a dense matrix, a
few thousand vocabulary columns at a time, and the block's matrix of ones (items by terms) is multiplied with it. Impacts are
whole numbers held in float64. So many columns go into one product that no partial sum can reach 2**53; products are
therefore exact in whatever order they are summed, and further columns are added as 64-bit integers.

A tile's scores meet the best of the task so far. Whatever is not below an item's score at place ``most`` stays, so
documents of equal score are told apart by identifier and not by the tile they came in. The best of all tasks meet in one window.

Each block reads the documents twice: for document frequencies and lengths, then for scores. Nothing of their size is written.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import join_small, numbered, utf8
from formbook.operators.durable import written

#: A term is a run of ASCII letters, digits and everything beyond ASCII; A-Z count as a-z. In UTF-8 that is decided byte by byte.
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_EXACT, _COLUMNS, _TILE = 1 << 53, 2048, 256
_LAST = (1 << 63) - 1


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Some items and their distinct terms: ``item[i]`` has the vocabulary's term ``term[i]``."""

    numbers: np.ndarray
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray

    def counted(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The text's length in terms, and the vocabulary terms in it with their occurrences."""
        words, place = terms(raw), self.vocabulary
        found = Counter(map(place.get, words))
        found.pop(None, None)
        return len(words), np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, terms in all of them, and the weight of each vocabulary term."""

    documents: int
    length: int
    weight: np.ndarray

    def impacts(self, n: int, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 50 + 50 * n * self.documents // self.length
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The ``most`` highest scores of each item so far; equal scores by ascending identifier, a missing one last."""

    def __init__(self, items: int, most: int):
        self._items, self._most = items, most
        self._cut = np.ones(items, dtype=np.int64)  # scores below it are of no use
        self._held, self._size = [np.empty((4, 0), dtype=np.int64)], 0

    def add(self, scores: np.ndarray, doc: np.ndarray, unknown: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self._cut[:, None])
        self._held.append(np.stack((item, scores[item, at], doc[at], unknown[at])))
        self._size += len(item)
        if self._size > 2 * self._items * self._most + (1 << 16):
            self.shrink()

    def shrink(self) -> np.ndarray:
        rows = np.concatenate(self._held, axis=1)
        item, score, doc, unknown = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stay = place < self._most
        last = place == self._most - 1
        self._cut[item[last]] = score[last]
        kept = np.stack((item[stay], score[stay], doc[stay], unknown[stay]))
        self._held, self._size = [kept], kept.shape[1]
        return kept


def tile_scores(block: Block, known: Statistics, found: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of all items (rows) for one tile of documents (columns)."""
    spread = np.repeat(np.arange(len(found)), [len(t) for _, t, _ in found])
    term = np.concatenate([t for _, t, _ in found])
    impact = np.concatenate([known.impacts(*f) for f in found])
    scores = np.zeros((len(block.numbers), len(found)), dtype=np.int64)
    columns = max(1, min(_COLUMNS, (_EXACT - 1) // max(1, int(impact.max(initial=0)))))
    for first in range(0, len(block.vocabulary), columns):
        here, asked = (term >= first) & (term < first + columns), (block.term >= first) & (block.term < first + columns)
        if here.any() and asked.any():
            impacts = np.zeros((columns, len(found)))
            impacts[term[here] - first, spread[here]] = impact[here]
            ones = np.zeros((len(block.numbers), columns))
            ones[block.item[asked], block.term[asked] - first] = 1.0
            scores += (ones @ impacts).astype(np.int64)
    return scores


def _item_terms(items: DataFrame) -> DataFrame:
    """``_row, term``: the distinct terms of every item."""
    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = [sorted(set(terms(raw))) for raw in part["_raw"]]
            yield pd.DataFrame({"_row": np.repeat(part["_row"].to_numpy(), [len(x) for x in own]), "term": [t for x in own for t in x]})

    return items.select("_row", "_raw").mapInPandas(split, "_row long, term binary")


def _block(asked: DataFrame) -> Block:
    rows = asked.toPandas()
    numbers, item = np.unique(rows["_row"].to_numpy(dtype=np.int64), return_inverse=True)
    words = [bytes(t) for t in rows["term"]]
    vocabulary = {t: i for i, t in enumerate(sorted(set(words)))}
    return Block(numbers, vocabulary, item, np.array([vocabulary[t] for t in words], dtype=np.int64))


def _statistics(rows: DataFrame, block: Block) -> Statistics | None:
    """From one pass: a row per task and term, and per task its number and length of documents (as terms -1 and -2)."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, documents, length = np.zeros(len(block.vocabulary), dtype=np.int64), 0, 0
        for part in parts:
            for raw in part["_raw"]:
                n, term, _ = block.counted(raw)
                seen[term] += 1
                documents, length = documents + (n > 0), length + n
        there = np.flatnonzero(seen)
        yield pd.DataFrame({"term": [-1, -2, *there], "n": [documents, length, *seen[there]]}, dtype=np.int64)

    total = {r["term"]: r["n"] for r in rows.select("_raw").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, length = total.get(-1, 0), total.get(-2, 0)
    if not documents:
        return None
    return Statistics(documents, length, np.array([weight(documents, total.get(t, 0)) for t in range(len(block.vocabulary))], dtype=np.int64))


def _scored(rows: DataFrame, block: Block, known: Statistics, most: int) -> DataFrame:
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(block.numbers), most)
        for part in parts:
            doc, unknown = part["_doc"].to_numpy(dtype=np.int64), part["_unknown"].to_numpy(dtype=np.int64)
            for at in range(0, len(part), _TILE):
                tile = slice(at, at + _TILE)
                best.add(tile_scores(block, known, [block.counted(raw) for raw in part["_raw"].iloc[tile]]), doc[tile], unknown[tile])
        item, score, doc, unknown = best.shrink()
        yield pd.DataFrame({"_row": block.numbers[item], "score": score, "_doc": doc, "_unknown": unknown.astype(bool)})

    return rows.mapInPandas(score, "_row long, score long, _doc long, _unknown boolean")


def ranked(
    docs: DataFrame, items: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_items: int = 512, block_terms: int = 32_768,
) -> DataFrame:
    """The ``most`` best documents of every item: ``item_id, rank, doc_id, score``.

    A document's score is the sum of its impacts for the item's distinct terms; only scores above 0 are listed, highest first,
    equal ones by ascending identifier (a missing one last). A null text has no term. Every row of ``items`` is an item and
    every row of ``docs`` a document, also where they repeat an identifier or have none. No item, or no document
    with a term, gives an empty result. Identifiers of documents are integers. A block has about ``block_items`` items or
    ``block_terms`` of their terms; these only reach the driver and the tasks, a block at a time.
    """
    heads = numbered(items.select(F.col(item_col).alias("item_id"), utf8(item_text).alias("_raw")))
    asked = written(_item_terms(heads))
    blocks = max(-(-heads.count() // block_items), -(-asked.count() // block_terms))
    unknown = F.col(id_col).isNull()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_doc"), unknown.alias("_unknown"), utf8(text_col).alias("_raw"))
    found = docs.sparkSession.createDataFrame([], "_row long, score long, _doc long, _unknown boolean")
    for number in range(blocks):
        block = _block(asked.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == number))
        known = _statistics(rows, block) if len(block.numbers) else None
        if known:
            found = found.union(written(_scored(rows, block, known, most)))
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "_doc", "_unknown"))
    top = found.withColumn("rank", place).filter(F.col("rank") <= most)
    return join_small(top, heads.select("_row", "item_id"), ["_row"]).select(
        "item_id", "rank", F.when(~F.col("_unknown"), F.col("_doc")).alias("doc_id"), "score"
    )
