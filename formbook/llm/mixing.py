"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source whose target is r times its size takes each document
floor(r) times, and once more those below a hash threshold. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket in which the budget ends is
found from running sums over buckets, and only its documents are summed again by the next
digits of the hash, until a bucket is one hash value. Then one filter decides all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import WORD, join_small
from formbook.operators.durable import written

#: The hash has 60 bits, read as five digits of 12: a source's running sums are over 4,096 buckets at most.
_DIGIT, _LEVELS = 12, 5


def _hash(identifier: Column, text: Column) -> Column:
    """Of identifier and text, so that documents without an identifier are spread like others."""
    named = F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _prefix(level: int) -> Column:
    return F.shiftright("_hash", _DIGIT * (_LEVELS - level))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_rank``: the source's place by code point from 0, null last. Ranges of
    sources are numbered side by side and shifted by the sizes of the ranges before."""
    placed = written(
        sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").count().orderBy("_part").collect()  # one row per range
    before, starts = 0, []
    for part, count in counts:
        starts.append((part, before))
        before += count
    starts = sizes.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "_part").withColumn("_rank", F.col("_start") + within).drop("_at", "_part", "_start")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``. What a source cannot take, since
    its target stops at ``most`` times its size, goes to the others by weight; that is
    one level that all free sources share per unit of weight, raised until no more source stops."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = written(
        ranked_sources(sizes).withColumn("_weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.col("source_size") * most
    free, weight, stopped = total, None, F.lit(False)
    while True:
        row = ranked.agg(
            F.sum(F.when(stopped, ceiling).otherwise(0)).alias("held"),
            F.sum(F.when(stopped, 0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["weight"] == weight or not row["weight"]:
            break
        free, weight = total - row["held"], row["weight"]
        # As doubles: a literal below 2**31 is an int, and its product with an int weight would overflow.
        share = F.lit(float(free)) * F.col("_weight") / F.lit(float(weight))
        stopped = share > ceiling
    target = ceiling.cast("double") if weight is None else F.when(stopped, ceiling.cast("double")).otherwise(share)
    return ranked.select("_source", "source_size", target.alias("target"))


def _boundary(sums: DataFrame) -> DataFrame:
    """Of every source, the bucket in which its budget ends, and the words below it."""
    order = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("_upto", F.col("_below") + F.sum("_words").over(order))
    return (
        upto.filter(F.col("_upto") >= F.col("_budget"))
        .groupBy("_source", "_budget")
        .agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("below"), F.col("_words").alias("words"))).alias("_end"))
        .select("_source", "_budget", F.col("_end._bucket").alias("_bucket"), F.col("_end.below").alias("_below"), F.col("_end.words").alias("_words"))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(F.col(id_col), F.col(text_col)).alias("_hash"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"),
        *more,
    )


def thresholds(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: target, whole repeats, and the last hash taken once more."""
    sums = written(rows.groupBy("source", "_source", _prefix(1).alias("_bucket")).agg(F.sum("size").alias("_words")))
    plan = targets(sums.groupBy("source", "_source").agg(F.sum("_words").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(
        plan.withColumn("_whole", whole).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    sums = sums.drop("source").join(plan.select("_source", "_budget"), "_source")
    sums = sums.withColumn("_below", F.lit(0).cast("long"))
    for level in range(2, _LEVELS + 1):
        end = written(_boundary(sums)).drop("_words").withColumnRenamed("_bucket", "_upper")
        inside = join_small(rows.drop("source").withColumn("_upper", _prefix(level - 1)), end, ["_source", "_upper"])
        sums = inside.groupBy("_source", "_budget", "_below", _prefix(level).alias("_bucket")).agg(
            F.sum("size").alias("_words")
        )
    nearer = 2 * (F.col("_budget") - F.col("_below")) > F.col("_words")
    ends = _boundary(sums).select("_source", F.col("_bucket").alias("_last"), nearer.alias("_with_last"))
    return plan.join(ends, "_source", "left")


def _with_times(rows: DataFrame, cut: DataFrame) -> DataFrame:
    extra = (F.col("_hash") < F.col("_last")) | ((F.col("_hash") == F.col("_last")) & F.col("_with_last"))
    times = F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return join_small(rows, cut, ["_source"]).withColumn("times", times.cast("long"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, times, taken``.

    ``size`` counts words (null text: 0). Sources take ``weights`` in turn by code point, null
    last, and share 100 % of all words. A document is taken whole, ``times`` times;
    ``taken = times * size``. A source misses its target by at most half of the document at
    its threshold. Documents are chosen by identifier and text alone: rows alike in both
    are chosen together, others without an identifier one by one, and reruns agree. Sources without words have target 0.
    An empty table gives an empty result.
    """
    rows = written(_keyed(docs, id_col, text_col, source_col))
    taken = (F.col("times") * F.col("size")).alias("taken")
    return _with_times(rows, thresholds(rows, weights, most)).select(
        "doc_id", "source", "size", "source_size", "target", "times", taken
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, in the columns of ``docs``."""
    cut = thresholds(written(_keyed(docs, "doc_id", "text", "source")), weights, most)
    rows = _keyed(docs, "doc_id", "text", "source", F.struct("*").alias("_doc"))
    # A document without words weighs nothing and changes no share: it stays, once.
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times")).cast("int")
    repeated = F.explode(F.array_repeat("_doc", times)).alias("_doc")
    return _with_times(rows, cut).filter(times > 0).select(repeated).select("_doc.*")
