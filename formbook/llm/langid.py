"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A text's likelihood
is the product over its words, and a word's is the sum over all ways to cut it into pieces of the
product of their probabilities. The forward algorithm sums it in one pass over the word's bytes: what
reaches a byte is handed on by every piece that starts there. Single bytes are pieces too, so
every word has a segmentation.

Piece probabilities come from counts over a sample of labelled documents of bounded size; pieces
that no language uses have no probability, and the pieces in use share some smoothing.
Words are scored in batches, position by position, and remembered while a task lasts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import utf8
from formbook.operators.durable import written

_BYTES = 256
_STRETCH = 512  # positions of the forward array that are held at once, besides those a piece can still reach


def _vocabulary(name: str):
    """The model, and each piece as bytes: a word starts with a blank. Control pieces are None."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    texts = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            texts.append(bytes([int(piece[3:5], 16)]))
        else:
            texts.append(None if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return model, texts


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` labelled documents of each language, chosen by hash; all where there are fewer."""
    counts = written(docs.groupBy("lang").count())
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang").filter(place < share)


class Model:
    """Piece probabilities of every language over a byte trie of the pieces in use."""

    def __init__(self, counts: dict[tuple[str, bytes], int], priors: dict[str, int], smoothing: float = 0.5):
        self.languages = sorted(priors)
        used = {bytes([b]) for b in range(_BYTES)} | {piece for _, piece in counts}
        pieces = sorted(used)
        place = {piece: i for i, piece in enumerate(pieces)}
        table = np.full((len(pieces), len(self.languages)), smoothing)
        column = {language: i for i, language in enumerate(self.languages)}
        for (language, piece), n in counts.items():
            table[place[piece], column[language]] += n
        self.probability = table / table.sum(axis=0)
        total = sum(priors.values())
        self.prior = np.log([priors[x] / total for x in self.languages])
        self.depth = max(map(len, pieces))
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece in pieces:
            at = 0
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][byte]
            ends[at] = place[piece]
        self.step = np.zeros((len(nodes), _BYTES), dtype=np.int32)  # 0: no such piece goes on
        for node, out in enumerate(nodes):
            for byte, to in out.items():
                self.step[node, byte] = to
        self.piece = np.array(ends, dtype=np.int32)

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        """One row per word, one column per language: log of the sum over all segmentations."""
        found = np.empty((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            stop, longest = at, 0
            while stop < len(order) and max(longest, len(words[order[stop]])) * (stop - at + 1) <= 1 << 18:
                longest = max(longest, len(words[order[stop]]))
                stop += 1
            stop = max(stop, at + 1)
            chosen = order[at:stop]
            found[chosen] = self._forward([words[i] for i in chosen])
            at = stop
        return found

    def _forward(self, words: list[bytes]) -> np.ndarray:
        """Positions are gone through in stretches; what pieces have reached beyond a stretch is handed on to the next."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max(initial=0))
        text = np.zeros((len(words), width), dtype=np.uint8)
        for row, word in zip(text, words):
            row[: len(word)] = np.frombuffer(word, dtype=np.uint8)
        stretch = min(width, _STRETCH)
        reached = np.zeros((stretch + self.depth + 1, len(words), len(self.languages)))  # [0]: where the stretch begins
        reached[0] = 1.0
        scale, found = np.zeros((2, len(words), len(self.languages)))
        for begin in range(0, width, max(1, stretch)):
            end = min(width, begin + stretch)
            for start in range(begin, end):
                alive = np.flatnonzero(lengths > start)
                if start % 8 == 0 and start:  # keep long words from running out of the smallest double
                    top = reached[start - begin, alive]
                    scale[alive] += np.log(top)
                    reached[start - begin : start - begin + self.depth, alive] /= top
                node = np.zeros(len(alive), dtype=np.int32)
                for stop in range(start + 1, min(width, start + self.depth) + 1):
                    node = self.step[node, text[alive, stop - 1]]
                    on = (node > 0) & (lengths[alive] >= stop)
                    alive, node = alive[on], node[on]
                    if not len(alive):
                        break
                    piece = self.piece[node]
                    ends = piece >= 0
                    at = alive[ends]
                    reached[stop - begin, at] += reached[start - begin, at] * self.probability[piece[ends]]
            done = np.flatnonzero((lengths > begin) & (lengths <= end))
            found[done] = np.log(reached[lengths[done] - begin, done]) + scale[done]
            reached[: self.depth + 1] = reached[stretch : stretch + self.depth + 1].copy()
            reached[self.depth + 1 :] = 0.0
        return found


class Scorer:
    """Scores texts with a model and remembers words, up to a number of them."""

    def __init__(self, model: Model, remember: int = 300_000):
        self._model, self._remember = model, remember
        self._forget()

    def _forget(self) -> None:
        self._place: dict[bytes, int] = {}
        self._scores = np.empty((1024, len(self._model.languages)))

    def _learn(self, words: list[bytes]) -> None:
        have = len(self._place)
        while have + len(words) > len(self._scores):
            self._scores = np.concatenate((self._scores, np.empty_like(self._scores)))
        self._scores[have : have + len(words)] = self._model.log_likelihoods([b" " + word for word in words])
        self._place.update(zip(words, range(have, have + len(words))))

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        if len(self._place) > self._remember:
            self._forget()
        fresh = set().union(*split).difference(self._place) if split else set()
        if fresh:
            self._learn(list(fresh))
        place = self._place
        sums = np.array([self._scores[[place[w] for w in words]].sum(axis=0) for words in split])
        logs = sums + self._model.prior
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", per_language: int = 2_000) -> Model | None:
    """A model of the languages in ``docs`` (doc_id, text, lang); None without labelled texts.

    What reaches the driver is a count per language and piece: at most the vocabulary for each language."""
    labelled = docs.filter(F.col("lang").isNotNull())
    chosen = sample(labelled, per_language).select("lang", utf8().alias("_raw"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, texts = _vocabulary(vocabulary)
        for part in parts:
            rows = []
            for language, raws in part.groupby("lang")["_raw"]:
                words = Counter(w for raw in raws for w in raw.split())
                found: Counter = Counter()
                for ids, n in zip(model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1), words.values()):
                    for i in ids:
                        found[i] += n
                rows += [(language, texts[i], n) for i, n in found.items() if texts[i] is not None]
            yield pd.DataFrame(rows, columns=["lang", "piece", "n"])

    counted = chosen.mapInPandas(count, "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    counts = {(r["lang"], bytes(r["piece"])): r["n"] for r in counted.collect()}
    priors = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    priors = {x: n for x, n in priors.items() if any(x == y for y, _ in counts)} if len(counts) else {}
    return Model(counts, priors) if priors else None


_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model | None, at_once: int = 200) -> DataFrame:
    """``docs`` (``doc_id, held_out, _raw``) with ``lang_pred`` and ``score``, the posterior of the language."""
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model else None
        for part in parts:
            best, sure = np.full(len(part), "und", dtype=object), np.zeros(len(part))
            raws = part["_raw"].tolist()
            known = [i for i, raw in enumerate(raws) if scorer and _has_letter(raw)]
            for at in range(0, len(known), at_once):
                rows = known[at : at + at_once]
                odds = scorer.posteriors([raws[i] for i in rows])
                top = odds.argmax(axis=1)
                best[rows] = np.array(model.languages, dtype=object)[top]
                sure[rows] = odds[np.arange(len(rows)), top]
            yield part[["doc_id", "held_out"]].assign(lang_pred=best, score=sure)

    # Identifiers go through Python as text: a column of integers with nulls would reach it as floats.
    kind = docs.schema["doc_id"].dataType
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = rows.mapInPandas(score, "doc_id string, held_out boolean, lang_pred string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def identify(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", per_language: int = 2_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    A text's likelihood sums over all segmentations of each of its words, however long. Learned from text and ``lang`` where ``crc32(doc_id) mod 3`` is not 1; those with 1 are held out (a null
    identifier counts as an empty text there). ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned. An empty table gives an empty result.
    """
    held_out = _remainder(F.col("doc_id")) == 1
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"), vocabulary, per_language)
    return predict(docs.select("doc_id", held_out.alias("held_out"), utf8().alias("_raw")), model)
