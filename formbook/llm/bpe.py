"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A long text is cut in halves, these again, down to leaves of a bounded size, wherever the middle is: inside a word, a run of one
letter or of blanks. Leaves are rows and encoded in parallel. Neighbours are then joined in rounds. Around a join the last few
tokens of the left side and the first few of the right are encoded again as one window, which grows until both sides agree:
its first token is the left side's token there, and some later one is the right side's own token at the same place. The
tokens of the left side, the window and the right side up to and from there make up the joined text's encoding.

Why this is exact. (1) A sequence of tokens is the encoding of a stretch that is split no further if and only if every two
neighbours are the encoding of what they spell together; so parts of encodings that share a token can be spliced
there. (2) Texts are split by a pattern that looks ahead one character beyond a run of one kind, and three for an apostrophe's
suffixes, and never back. Cuts within three characters of a join, or next to an apostrophe, are not used;
any other one lies on a border of the whole text's split or inside a run that goes on alike on both sides.

Decoding looks up the bytes of every token.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import utf8
from formbook.operators.durable import fresh_folder

_WINDOW, _CLEAR = 8, 12  # tokens of the first window; bytes that hold three characters for sure
_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _continues(token: bytes) -> bool:
    return 0x80 <= token[0] < 0xC0


def join(left: list[int], right: list[int], spelled: list[bytes], encode: Callable[[str], list[int]]) -> list[int]:
    """The encoding of what two encodings spell together, by windows that grow around the join."""
    if not left or not right:
        return left + right
    size = _WINDOW
    while True:
        first = max(0, len(left) - size)
        while first and _continues(spelled[left[first]]):
            first -= 1
        stop = min(len(right), size)
        while stop < len(right) and _continues(spelled[right[stop]]):
            stop += 1
        ahead = b"".join(spelled[t] for t in left[first:])
        window = ahead + b"".join(spelled[t] for t in right[:stop])
        tokens = encode(window.decode("utf-8", "replace"))
        begins = not first or (
            tokens[0] == left[first]
            and len(ahead) >= _CLEAR
            and b"'" not in b"".join(spelled[t] for t in left[max(0, first - 3) : first])[-3:] + window[:1]
        )
        if begins and stop == len(right):
            return left[:first] + tokens
        if begins:
            own = {}
            at = len(ahead)
            for k in range(stop):
                own[at] = k
                at += len(spelled[right[k]])
            at = 0
            for k, token in enumerate(tokens):
                there = own.get(at)
                if there is not None and right[there] == token and len(ahead) + 4 <= at <= len(window) - _CLEAR and b"'" not in window[at - 3 : at + 1]:
                    return left[:first] + tokens[:k] + right[there:]
                at += len(spelled[token])
        size *= 2


class Coder:
    """A byte-level BPE file as its library reads it with default settings: special tokens in a text are
    tokens, and nothing is added, cut or filled up. Ordinary text is encoded by a faster library from the same
    vocabulary, given as ranks; that both files agree is checked."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            described = json.load(file)
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        odd = [t for t in described["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd or described["normalizer"] or described["pre_tokenizer"] != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }:
            raise ValueError(f"{vocabulary} does more than byte-level BPE")
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        shown = _shown_bytes()
        known = {bytes(shown[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added}
        if known != table:
            raise ValueError(f"{vocabulary} and {ranks} are different vocabularies")
        self.special = added
        self.spelled: list[bytes] = [b""] * (max([*table.values(), *added.values()]) + 1)
        for token, i in [*table.items(), *((t.encode(), i) for t, i in added.items())]:
            self.spelled[i] = token
        self._kind = "<u2" if len(self.spelled) <= 1 << 16 else "<u4"
        self.written = [str(i) for i in range(len(self.spelled))]
        self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def segments(self, text: str) -> list[str]:
        """The text cut before and after special tokens; nothing of the split reaches across these."""
        return [s for s in self._split.split(text) if s] if self._split else [text]

    def segment_ids(self, segment: str) -> list[int]:
        return [self.special[segment]] if segment in self.special else self.ordinary(segment)

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Neighbouring parts of one segment, joined pair by pair."""
        while len(parts) > 1:
            parts = [join(parts[i], parts[i + 1], self.spelled, self.ordinary) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self._kind).tobytes()

    def unpacked(self, raw: bytes) -> list[int]:
        return np.frombuffer(raw, dtype=self._kind).tolist()

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        written_ids = ",".join([self.written[i] for i in ids])
        return len(ids), hashlib.sha256(written_ids.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def _shown_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies show for each byte: itself where printable, else one beyond 255."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def coder(vocabulary: str, ranks: str) -> Coder:
    return Coder(vocabulary, ranks)


def leaves(segment: str, most: int) -> list[str]:
    """Halves of halves, until none has more than ``most`` characters."""
    if len(segment) <= most:
        return [segment]
    middle = len(segment) // 2
    return leaves(segment[:middle], most) + leaves(segment[middle:], most)


def _in_small_groups(df: DataFrame) -> DataFrame:
    """``df`` written once, in row groups so small that the leaves of one text are read by many tasks."""
    path = fresh_folder(df.sparkSession)
    df.write.option("parquet.block.size", 4 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", leaf: int = 16_384, fan: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``.

    Texts over ``leaf`` characters are encoded as halves and joined, ``fan`` neighbours in a round, the last ones with what is
    left of their document. A null or empty text has no
    token. Rows that repeat or lack an identifier are encoded one by one. An empty table gives an empty result.
    """
    leaf_columns = "segment int, leaf int, _raw binary"

    def start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = coder(vocabulary, ranks)
        for part in parts:
            rows = []
            for row, name, raw in zip(part["_row"], part["doc_id"], part["_raw"]):
                text = raw.decode("utf-8", "replace")
                if len(text) <= leaf:
                    rows.append((row, name, 0, 0, None, *use.digest(use.encode(text))))
                else:
                    cut = [(s, k, x) for s, segment in enumerate(use.segments(text)) for k, x in enumerate([segment] if segment in use.special else leaves(segment, leaf))]
                    rows += [(row, name, s, k, x.encode(), 0, None, None) for s, k, x in cut]
            yield pd.DataFrame(rows, columns=["_row", "doc_id", "segment", "leaf", "_raw", "n_tokens", "ids_sha256", "decoded_sha256"])

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = coder(vocabulary, ranks)
        for part in parts:
            yield part.assign(_raw=[use.packed(use.segment_ids(raw.decode("utf-8", "replace"))) for raw in part["_raw"]])

    def whole(part: pd.DataFrame) -> list[int]:
        use = coder(vocabulary, ranks)
        return use.joined([use.unpacked(raw) for raw in part.sort_values("leaf")["_raw"]])

    def join_some(part: pd.DataFrame) -> pd.DataFrame:
        return part[:1].assign(leaf=part["leaf"].iloc[:1] // fan, _raw=[coder(vocabulary, ranks).packed(whole(part))])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        ids = [i for _, segment in part.groupby("segment", sort=True) for i in whole(segment)]
        digest = coder(vocabulary, ranks).digest(ids)
        return part[["_row", "doc_id"]][:1].assign(**{c: [v] for c, v in zip(("n_tokens", "ids_sha256", "decoded_sha256"), digest)})

    # Identifiers go through Python as text: a column of integers with nulls would reach it as floats.
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), utf8(text_col).alias("_raw")).withColumn("_row", F.monotonically_increasing_id())
    begun = _in_small_groups(rows.mapInPandas(start, f"_row long, doc_id string, {leaf_columns}, {_DIGEST}"))
    done = begun.filter("_raw IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    nodes = begun.filter("_raw IS NOT NULL").select("_row", "doc_id", "segment", "leaf", "_raw")
    most = nodes.agg(F.max("leaf")).first()[0]
    if most is not None:
        part = f"_row long, doc_id string, {leaf_columns}"
        nodes = nodes.mapInPandas(encode, part)
        while most >= fan:
            nodes = nodes.groupBy("_row", "segment", F.floor(F.col("leaf") / fan).alias("node")).applyInPandas(join_some, part)
            most //= fan
        long = nodes.groupBy("_row").applyInPandas(finish, f"_row long, doc_id string, {_DIGEST}")
        done = done.union(long.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
