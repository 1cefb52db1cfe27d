"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest member conversation and its depth,
for a conversation passes one node at each depth; its parent edge leads to the node one turn shorter.

Sequences are told apart by sums: every turn, together with its place, has a digest, and a prefix is the sum of its turns' digests
in five parts. Sums run in blocks of a range partitioning, each starting from the sum of those before it, so a conversation
that holds a third of all turns is spread over many tasks, and no prefix is ever spelled out.

Totals over subtrees come from a centroid decomposition of the forest of parent edges. In each component
the nodes that have half of it below them form a path from its top down to its centroid. What is at and below the
centroid is summed up and added to every node of that path; then the centroid goes, the part above it and each
part below it become components of their own, and the step repeats. Parts are at most half as large each time, so
a chain of a million turns takes twenty steps. Components that are too large for a task are split by joins;
smaller ones are dealt to tasks, many together, which split them further in the same way.

A node of a single conversation has one leaf at or below it and saves nothing, so only nodes with two or more
members are in the forest; the others count as leaves of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import join_small
from formbook.operators.durable import written

_PARTS = [f"k{i}" for i in range(5)]
_BEFORE = [f"p{i}" for i in range(5)]
_NODE = ["conv_id", "depth"]


# ---- conversations ------------------------------------------------------------------------------


def _running(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``rows`` with sums of ``columns`` up to and including each row of its ``conv_id``, by ``_block`` and ``order``."""
    sums = rows.groupBy("conv_id", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "_block", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in rows.columns if c not in columns]
    return rows.join(starts, ["conv_id", "_block"]).select(*kept, *columns, *[(F.sum(c).over(inside) + F.col(f"_{c}")).alias(f"{c}_run") for c in columns])


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, nth, _block, digest, chars``: the turns of each conversation, numbered from 1 by ``turn`` (null first; turns that
    tie by the digest of role and text). Null role or text is empty; rows without ``conv_id`` belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "_row")
    dealt = written(dealt.select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at"), F.lit(1).cast("long").alias("one")))
    return _running(dealt, ["one"], "_at").select("conv_id", F.col("one_run").alias("nth"), "_block", "digest", "chars")


def rebuilt(own: DataFrame, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, length`` and their turns ``conv_id, depth, _block, digest, chars, length``.

    Conversation c takes the first h turns of ``c - c % family`` and its own after its first h, h being
    ``crc32(c) % (most + 1)``."""
    own = written(own)
    counted = own.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    counted = counted.select("*", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    bases = counted.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = written(
        counted.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))
    )
    heads = own.filter((F.col("nth") <= most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "nth", "digest", "chars")
    borrowed = convs.join(heads, "base").filter(F.col("nth") <= F.col("h")).select("conv_id", F.col("nth").alias("depth"), F.lit(-1).alias("_block"), "digest", "chars", "length")
    rest = own.join(convs, "conv_id").filter(F.col("nth") > F.col("h"))
    rest = rest.select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "_block", "digest", "chars", "length")
    return convs.select("conv_id", "length"), borrowed.union(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the sums that stand for the prefix up to (``k0`` ...) and before (``p0`` ...) each turn."""
    mixed = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    part = lambda i: F.conv(F.substr(F.col("_mixed"), F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
    rows = turns.withColumn("_mixed", mixed).select("conv_id", "depth", "_block", "chars", "length", *[part(i).alias(k) for i, k in enumerate(_PARTS)])
    return _running(rows, _PARTS, "depth").select(
        "conv_id", "depth", "chars", "length",
        *[F.col(f"{k}_run").alias(k) for k in _PARTS], *[(F.col(f"{k}_run") - F.col(k)).alias(p) for k, p in zip(_PARTS, _BEFORE)],
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of rows ``conv_id, depth, member``. Members reach the hash in
    order as a stream, so a node at which a third of all conversations end is read through and not held."""
    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest, done = None, None, []
        for part in parts:
            part = part.reset_index(drop=True)
            for key, rows in part.groupby(_NODE, sort=False).groups.items():
                listed = ",".join(map(str, part["member"].to_numpy()[rows])).encode()
                if key == at:
                    digest.update(b"," + listed)
                else:
                    done += [(*at, digest.hexdigest())] if at else []
                    at, digest = key, hashlib.sha256(listed)
            yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"])
            done = []
        yield pd.DataFrame([(*at, digest.hexdigest())] if at else [], columns=[*_NODE, "ends_sha256"])

    return ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "member").mapInPandas(stream, "conv_id long, depth long, ends_sha256 string")


# ---- forest -------------------------------------------------------------------------------------


def split_here(part: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    """Whole components, decomposed in one task: ``conv_id, depth`` and the totals over what is at and below each node."""
    place = {key: i for i, key in enumerate(zip(part["conv_id"], part["depth"]))}
    comp = list(zip(part["comp_conv"], part["comp_depth"]))
    up = [place.get((c, d - 1), -1) for c, d in zip(part["parent_conv_id"], part["depth"])]
    up = [j if j >= 0 and comp[i] == comp[j] else -1 for i, j in enumerate(up)]
    whole, n = part["size"].to_numpy(dtype=np.int64), len(part)
    # Numbers in preorder: what is below a node has the numbers after its own.
    pre, free, used = np.zeros(n, dtype=np.int64), [0] * n, 0
    sizes = whole.tolist()
    for i in np.argsort(part["depth"].to_numpy(), kind="stable").tolist():
        if up[i] < 0:
            mine, used = used, used + sizes[i]
        else:
            mine = free[up[i]]
            free[up[i]] += sizes[i]
        pre[i], free[i] = mine, mine + 1
    by = np.argsort(pre)
    whole = whole[by]
    parent = np.where(np.array(up)[by] < 0, -1, pre[np.maximum(np.array(up), 0)][by])
    own, totals = part[values].to_numpy(dtype=np.int64)[by], part[[f"{v}_below" for v in values]].to_numpy(dtype=np.int64)[by]
    size, top = whole.copy(), np.arange(n)
    for i in np.flatnonzero(parent >= 0):
        top[i] = top[parent[i]]
    left = np.arange(n)
    while len(left):
        path = 2 * size[left] >= size[top[left]]
        centroid = np.full(n, -1, dtype=np.int64)
        np.maximum.at(centroid, top[left[path]], left[path])  # the last of the path in preorder
        at = centroid[top[left]]
        below = (left >= at) & (left < at + whole[at])
        sums = np.zeros_like(totals)
        np.add.at(sums, at[below], own[left[below]])
        totals[left[path]] += sums[at[path]]
        gone = size.copy()
        size[left[path]] -= gone[at[path]]
        under = below & (left != at)
        heads = left[under & (parent[left] == at)]
        order = np.argsort(top[heads] * n + heads)
        heads = heads[order]
        found = np.searchsorted(top[heads] * n + heads, top[left[under]] * n + left[under], side="right") - 1
        top[left[under]] = heads[found]
        left = left[left != at]
    found = part[_NODE].iloc[by].reset_index(drop=True)
    return found.assign(**{v: totals[:, i] for i, v in enumerate(values)})


def rollup(forest: DataFrame, chains: DataFrame, values: list[str], in_task: int = 50_000) -> DataFrame:
    """``conv_id, depth`` and, for each of ``values``, its total over the node and all below it.

    ``forest`` has ``conv_id, depth, parent_conv_id, size`` (nodes at and below it) and ``values`` of one tree's nodes.
    ``chains`` says which node each naming conversation passes: ``conv_id, depth, owner, up``, the names of that node and of its
    parent. Components up to ``in_task`` nodes are decomposed in a task.
    """
    totals = [f"{v}_below" for v in values]
    root = F.max(F.struct("size", "conv_id", "depth"))
    top = forest.agg(root.alias("top")).first()["top"]
    columns = ["conv_id", "depth", "parent_conv_id", "size", "n", "comp_conv", "comp_depth", *values, *totals]
    state = forest.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(0)).alias("parent_conv_id"), "size", F.lit(top["size"]).cast("long").alias("n"), F.lit(top["conv_id"]).cast("long").alias("comp_conv"),
        F.lit(top["depth"]).cast("long").alias("comp_depth"), *values, *[F.lit(0).cast("long").alias(t) for t in totals],
    )
    small, finished, largest = [], [], top["size"]
    passed = chains.select("conv_id", F.col("depth").alias("_at"), F.col("up").alias("c_conv"), F.col("owner").alias("_child"))
    while largest > in_task:
        comp = ["comp_conv", "comp_depth"]
        path = 2 * F.col("size") >= F.col("n")
        chosen = state.filter(path).groupBy(*comp).agg(F.max(F.struct("depth", "conv_id", "size")).alias("c"))
        chosen = chosen.select(*comp, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
        met = join_small(state, chosen, comp).withColumn("_at", F.col("c_depth") + 1)
        met = written(met.join(passed, ["conv_id", "_at", "c_conv"], "left").withColumn("_child", F.when(F.col("depth") > F.col("c_depth"), F.col("_child"))))
        centre = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))
        sums = met.filter(centre | F.col("_child").isNotNull()).groupBy(*comp).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        met = join_small(met, sums, comp)
        met = met.select(*[c for c in met.columns if c not in totals], *[F.when(path, F.col(t) + F.col(f"_{v}")).otherwise(F.col(t)).alias(t) for v, t in zip(values, totals)])
        finished.append(written(met.filter(centre).select(*_NODE, *[F.col(t).alias(v) for v, t in zip(values, totals)])))
        above = met.filter(~centre & F.col("_child").isNull()).withColumns(
            {"size": F.when(path, F.col("size") - F.col("c_size")).otherwise(F.col("size")), "n": F.col("n") - F.col("c_size")}
        )
        under = met.filter(F.col("_child").isNotNull()).withColumns({"comp_conv": F.col("_child"), "comp_depth": F.col("_at")}).drop("n")
        counts = under.groupBy(*comp).agg(F.count("*").alias("n"))
        state = written(above.select(*columns).union(join_small(under, counts, comp).select(*columns)))
        small.append(state.filter(F.col("n") <= in_task))
        state = state.filter(F.col("n") > in_task)
        largest = state.agg(F.max("n")).first()[0] or 0
    small.append(state)
    for part in small[:-1]:
        small[-1] = small[-1].union(part)
    tasks = -(-top["size"] // in_task)
    dealt = small[-1].withColumn("_task", F.pmod(F.xxhash64("comp_conv", "comp_depth"), F.lit(tasks)))
    schema = "conv_id long, depth long, " + ", ".join(f"{v} long" for v in values)
    found = dealt.groupBy("_task").applyInPandas(lambda part: split_here(part, values), schema)
    for part in finished:
        found = found.union(part)
    return found


# ---- trie ---------------------------------------------------------------------------------------


def trie(convs: DataFrame, turns: DataFrame, in_task: int = 50_000) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` has ``conv_id, length``; ``turns`` has ``conv_id, depth, _block, digest, chars, length``. The root has depth 0, no
    parent and every conversation. No conversation, no node.
    """
    rows = written(prefixes(turns))
    everything = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not everything["n"]:
        return _output(convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256")))
    root, top = everything["conv_id"], F.lit(everything["conv_id"]).cast("long")
    nodes = written(
        rows.groupBy("depth", *_PARTS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *[F.min(p).alias(p) for p in _BEFORE])
    )
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(_PARTS, _BEFORE)])
    first = nodes.filter("depth = 1").withColumn("parent_conv_id", top)
    later = nodes.filter("depth > 1").join(parents, ["depth", *_BEFORE])
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "chars"]
    linked = written(first.select(*own, *_PARTS).union(later.select(*own, *_PARTS)))
    roots = convs.sparkSession.createDataFrame([(root, 0, None, everything["n"], 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, chars long")
    children = linked.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_single")
    )
    every = written(linked.select(*own).union(roots).join(children, _NODE, "left").fillna(0, ["n_children", "_single"]))

    shared = every.filter("n_convs > 1 OR depth = 0")
    chains = _chains(rows, linked)
    sizes = chains.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum(F.col("_last") - F.greatest("_first", "depth") + 1).alias("size"))
    sizes = sizes.union(shared.agg(top, F.lit(0).cast("long"), F.count("*")))
    forest = written(
        shared.join(sizes, _NODE).select(
            *_NODE, "parent_conv_id", "size", (F.col("_single") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
        )
    )
    summed = rollup(forest, chains, ["n_leaves", "saved_tokens"], in_task)

    last = rows.filter("depth = length").select(F.col("conv_id").alias("member"), "depth", *_PARTS).join(linked.select("conv_id", "depth", *_PARTS), ["depth", *_PARTS])
    ends = last.select(*_NODE, "member").union(convs.filter("length = 0").select(top, F.lit(0).cast("long"), "conv_id"))
    found = every.join(summed, _NODE, "left").join(hashed_ends(ends), _NODE, "left")
    alone = lambda c, else_: F.coalesce(c, F.lit(else_)).alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return _output(found.select(*_NODE, "parent_conv_id", "n_convs", "n_children", alone("n_leaves", 1), alone("saved_tokens", 0), alone("ends_sha256", none)))


def _chains(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``conv_id, depth, owner, up, _first, _last``: the shared nodes that each conversation passes that names one of
    them, from the top to the last it names; it names those from ``_first`` to ``_last``."""
    shared = linked.filter("n_convs > 1")
    named = shared.groupBy("conv_id").agg(F.min("depth").alias("_first"), F.max("depth").alias("_last"))
    nodes = shared.select("depth", *_PARTS, F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("up"))
    passed = rows.select("conv_id", "depth", *_PARTS).join(named, "conv_id").filter(F.col("depth") <= F.col("_last"))
    return written(passed.join(nodes, ["depth", *_PARTS]).select("conv_id", "depth", "owner", "up", "_first", "_last"))


def _output(nodes: DataFrame) -> DataFrame:
    whole: list[Column] = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select(*whole, "ends_sha256")


def conversation_trie(conversations: DataFrame, family: int = 100, most: int = 5, in_task: int = 50_000) -> DataFrame:
    """The prefix trie of all rebuilt conversations of a table ``conv_id, turn, role, text``; see ``rebuilt`` and ``trie``.

    Null role or text is empty; a null ``turn`` comes first; turns that tie, repeated rows included, are turns one by one, in order
    of their digests. Rows without ``conv_id`` are no conversation. An empty table gives an empty result.
    """
    convs, turns = rebuilt(ordered(conversations), family, most)
    return trie(convs, turns, in_task)
