import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from formbook.llm.trie import conversation_trie, split_here

SCHEMA = "conv_id long, turn long, role string, text string, depth long, _block int, k0 long, owner string, size long"


def brute(rows, family=100, most=5):
    """Nodes as spelled-out prefixes; (conv_id, turn, role, text) in, result rows out."""
    def key(r):
        text = f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}"
        return r[1] is not None, r[1] or 0, hashlib.sha256(text.encode()).hexdigest()

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (c % family if c >= 0 else -(-c % family))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (c[0], len(p), members[p[:-1]][0] if p else -1, len(c), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, c in members.items()
    )


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "o", 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Shared starts, copies, a long shared chain, nulls, ties, conversations of fewer turns than they borrow, wide identifiers."""
    rng, rows = random.Random(5), []
    for c in [*range(40), *range(200, 330), *range(500, 540), -7, -100, (1 << 60) + 3, (1 << 60) - (1 << 60) % 100]:
        n = rng.randint(1, 9)
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randint(0, 2)) for t in range(n)]
    for c in (700, 701, 702, 777):  # a chain of shared turns
        rows += [(c, t, "user", f"turn {t}") for t in range(120 - c % 2)]
    rows += [(900, None, "user", "x"), (900, None, "user", "x"), (900, 1, None, None), (900, 1, "user", None), (901, None, None, "é漢😀"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", "copy") for c in range(1000, 1040) for t in range(3)]
    return rows


@pytest.mark.parametrize("in_task", [50_000, 25, 1])
def test_equals_brute_force(spark, odd, in_task):
    rows = odd if in_task > 1 else [r for r in odd if r[0] is not None and r[0] < 220]
    assert found(conversation_trie(frame(spark, rows).repartition(5), in_task=in_task)) == brute(rows)


def test_hot_conversation(spark):
    """One conversation with most of all rows is numbered in many blocks."""
    rows = [(5, t * 3 % 1009, "user", str(t * 3 % 1009)) for t in range(1009)] + [(c, t, "user", str(t)) for c in range(6, 40) for t in range(12)]
    assert found(conversation_trie(frame(spark, rows).repartition(7))) == brute(rows)


def test_empty(spark):
    out = conversation_trie(frame(spark, [(1, 1, "a", "b")]).limit(0))
    assert out.collect() == [] and out.columns[:3] == ["conv_id", "depth", "parent_conv_id"]


def test_a_single_conversation(spark):
    rows = [(3, 1, "user", "hello"), (3, 2, "assistant", "hi")]
    assert found(conversation_trie(frame(spark, rows))) == brute(rows)


def test_components_in_one_task():
    """Random forests of several components, among them a chain and a star, against plain sums."""
    rng, rows = random.Random(1), []
    for comp, shape in enumerate(["chain", "star", *["random"] * 6]):
        n, nodes = 200, [(1000 * comp, 0)]
        up = {nodes[0]: (0, -1)}
        for i in range(1, n):
            parent = nodes[-1] if shape == "chain" else nodes[0] if shape == "star" else rng.choice(nodes)
            node = (1000 * comp + i, parent[1] + 1)
            nodes.append(node)
            up[node] = parent
        value = {x: (rng.randint(0, 9), rng.randint(0, 9)) for x in nodes}
        total, size = {x: list(v) for x, v in value.items()}, dict.fromkeys(nodes, 1)
        for x in reversed(nodes[1:]):
            size[up[x]] += size[x]
            total[up[x]] = [a + b for a, b in zip(total[up[x]], total[x])]
        rows += [(*x, up[x][0], size[x], 1000 * comp, 0, *value[x], 0, 0, *total[x]) for x in nodes]
    rng.shuffle(rows)
    columns = ["conv_id", "depth", "parent_conv_id", "size", "comp_conv", "comp_depth", "a", "b", "a_below", "b_below", "want_a", "want_b"]
    part = pd.DataFrame(rows, columns=columns)
    got = split_here(part, ["a", "b"]).merge(part[["conv_id", "depth", "want_a", "want_b"]], on=["conv_id", "depth"])
    assert len(got) == len(part) and (got["a"] == got["want_a"]).all() and (got["b"] == got["want_b"]).all()
