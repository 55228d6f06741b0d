"""Attention intervals of long conversations."""

import random

import pytest

from lexmill.llm.chat_tree import chat_tree


@pytest.mark.parametrize("turns", [17, 300])
def test_all_ancestors_are_attended(spark, turns):
    r = random.Random(4)
    half = turns // 2
    rows = [(c, t, "user", "same" if t < half and c in (0, 1, 2) else r.choice("ab") + "x" * r.randint(0, 3)) for c in (0, 1, 2, None) for t in range(turns)]
    # one that ends where others go on, one that repeats another, and branches at every turn of it
    rows += [(5, t, "user", "same") for t in range(half)] + [(6, t, "user", "same") for t in range(half)]
    rows += [(100 + k, t, "user", "same" if t < k else f"branch {k}") for k in range(half) for t in range(k + 1)]
    _, nodes = chat_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    named = {x.node: x for x in nodes.collect()}
    assert max(x.depth for x in named.values()) == turns - 1
    want: dict[str, set] = {}
    for x in sorted(named.values(), key=lambda x: x.depth):
        up = named.get(x.parent)
        want[x.node] = set() if up is None else want[up.node] | set(range(up.emit_start, up.emit_start + len(up.ids)))
        spans = [(i.start, i.end) for i in x.attends]
        assert {c for a, b in spans for c in range(a, b)} == want[x.node] and x.position_start == len(want[x.node])
        assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert x.tree == (x.node if up is None else up.tree) and (up is None or all(b <= x.emit_start for _, b in spans))
    for tree in {x.tree for x in named.values()}:
        members = sorted((x for x in named.values() if x.tree == tree), key=lambda x: x.emit_start)
        at, stack = 0, []
        for x in members:
            assert x.emit_start == at
            at += len(x.ids)
            while stack and stack[-1] != x.parent:
                stack.pop()
            assert stack or x.node == tree
            stack.append(x.node)


def test_a_path_is_a_few_pieces(spark):
    """Of very many branches along one path a node attends to few intervals, whatever the turns."""
    rows = [(k, t, "user", "same" if t < k else f"branch {k}") for k in range(400) for t in range(min(k, 60) + 1)]
    _, nodes = chat_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert max(len(x.attends) for x in nodes.collect()) <= 30
