"""The registered query of every operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.bpe import round_trip as encode_and_decode
from formbook.llm.common import read
from formbook.llm.exact import exact_groups
from formbook.llm.langid import identify
from formbook.llm.licenses import scan as scan_licenses
from formbook.llm.mixing import mix
from formbook.llm.packing import pack
from formbook.llm.quality import judge
from formbook.llm.repeats import remove_repeats
from formbook.llm.search import ranked
from formbook.llm.secrets import scan as scan_secrets
from formbook.llm.simhash import near_duplicates
from formbook.llm.trie import conversation_trie
from formbook.llm.warc import round_trip


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read(spark, folder, "pages"), least_bytes=0).drop("url")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read(spark, folder, "documents"), keep="largest")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mix(read(spark, folder, "documents"), weights=(5, 2, 1), most=3)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents"), least=100)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), width=4, radius=4).drop("kept")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), capacity=2048)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(read(spark, folder, "documents"), reach=200)


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read(spark, folder, "documents"), vocabulary="piece_bpe_32k.model", per_language=2_000)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "documents"), read(spark, folder, "labels"), stratum_col="lang")


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(read(spark, folder, "documents"), vocabulary="byte_bpe_50k.json")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(read(spark, folder, "conversations"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"), most=50)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
