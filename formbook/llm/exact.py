"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition makes a run: its distinct digests, each with a row count and the best identifier. Runs then
meet in rounds. In a round, ``fan_in`` neighbouring runs are dealt by ranges of digests, so that no task
has a whole run; a task sorts what it got by digest, which puts the entries of one digest from all runs next to each other, and
the first of them, that with the best identifier, takes the sum of their counts. After log(runs) rounds one run is
left, in order within each range. A text that fills a third of the corpus is folded inside each run first, so a
round carries it once per run, and at most ``fan_in`` neighbours are ever equal.

A merge is verified: entries are one only if SHA-256, the byte length and an unrelated
64-bit hash all agree, so no text is merged on the word of a single digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import ascii_lower, numbered, without_rows

_IDENTITY = ["_sha", "_bytes", "_check"]


def _best(key: str, keep: str) -> Column:
    """Aggregate: the row that stays, as (identifier is known, identifier, row)."""
    if keep == "largest":
        return F.max(key).alias("_best")
    if keep == "smallest":
        return F.min(key).alias("_best")
    raise ValueError("keep is 'largest' or 'smallest'")


def _merged(runs: DataFrame, keep: str, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one, range by range, in the order of their digests."""
    dealt = runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")).withColumn("_range", F.substring("_sha", 1, 4))
    best = F.desc("_best") if keep == "largest" else F.asc("_best")
    ordered = dealt.repartition("_run", "_range").sortWithinPartitions("_run", "_range", *_IDENTITY, best)
    equal = Window.partitionBy("_run", "_range", *_IDENTITY).orderBy(best)
    neighbours = ordered.select(
        "_run", *_IDENTITY, "_best", F.row_number().over(equal).alias("_nth"), F.sum("_size").over(equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size")
    )
    return neighbours.filter("_nth = 1").drop("_nth")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8,
    carry: tuple[Column, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; a null text equals an empty one.
    ``keep`` says which identifier of a group stays. A null identifier stays only where a
    group has no other. Rows that repeat an identifier and text count one by one in
    ``group_size``, and exactly one of them is kept. An empty table gives an empty result. ``carry`` adds columns.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    carried = docs.select(*carry).columns
    rows = numbered(
        docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("_text"), *carry).select(
            "doc_id",
            *carried,
            F.sha2("_text", 256).alias("_sha"),
            F.octet_length("_text").alias("_bytes"),
            F.xxhash64("_text").alias("_check"),
            F.spark_partition_id().alias("_run"),
        )
    )
    runs = rows.agg(F.max("_run")).first()[0]
    merged = (
        rows.withColumn("_key", F.struct(known.alias("known"), "doc_id", "_row"))
        .groupBy("_run", *_IDENTITY)
        .agg(_best("_key", keep), F.count("*").alias("_size"))
    )
    while runs:
        runs //= fan_in
        merged = _merged(merged, keep, fan_in)
    return rows.join(merged.drop("_run"), _IDENTITY).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *carried,
    )


def without_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns."""
    def dropped(rows: DataFrame) -> DataFrame:
        texts = rows.select("_doc.doc_id", "_doc.text", F.col("_row").alias("_number"))
        return exact_groups(texts, keep=keep, carry=(F.col("_number"),)).filter("NOT kept").select(F.col("_number").alias("_row"))

    return without_rows(docs, dropped)
