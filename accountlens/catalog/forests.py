"""Two small forests by hand, so that SQL can walk the nodes a query scores with."""

from __future__ import annotations

from collections.abc import Sequence

from accountlens.plans.nodes import Node
from accountlens.schema import FEATURE_COLUMNS


def _tree(tree: int, *rows: tuple) -> list[Node]:
    """Rows are (feature, threshold, left, right, gain, counts) of an inner node, or counts of a leaf."""
    found = []
    for number, row in enumerate(rows):
        if len(row) == 6:
            found.append(Node(tree, number, *row[:5], tuple(map(float, row[5]))))
        else:
            found.append(Node(tree, number, None, None, None, None, None, tuple(map(float, row))))
    return found


def _f(name: str) -> int:
    return FEATURE_COLUMNS.index(name)


#: Classes human, bot, cyborg over the account features.
ACCOUNT_FOREST = [
    *_tree(
        0,
        (_f("reputacion"), 0.55, 1, 2, 0.21, (40, 50, 30)),
        (_f("avg_palabras"), 90.5, 3, 4, 0.08, (30, 10, 20)),
        (_f("uso_web"), 0.25, 5, 6, 0.17, (10, 40, 10)),
        (20, 3, 9), (10, 7, 11), (1, 33, 2), (9, 7, 8),
    ),
    *_tree(
        1,
        (_f("entropia"), 2.9, 1, 2, 0.05, (35, 45, 40)),
        (5, 25, 10),
        (_f("n_tweets"), 7000.5, 3, 4, 0.11, (30, 20, 30)),
        (24, 1, 3), (6, 19, 27),
    ),
    *_tree(
        2,
        (_f("Monday"), 0.15, 1, 2, 0.02, (50, 30, 40)),
        (_f("hora_13"), 0.04, 3, 4, 0.01, (20, 20, 30)),
        (30, 10, 10), (4, 16, 10), (16, 4, 20),
    ),
]

#: Classes not spam, spam over the hashed word counts.
TEXT_FOREST = [
    *_tree(
        0,
        (17, 2.5, 1, 2, 0.1, (60, 40)),
        (3, 0.5, 3, 4, 0.2, (45, 15)),
        (99, 4.5, 5, 6, 0.15, (15, 25)),
        (40, 3), (5, 12), (12, 6), (3, 19),
    ),
    *_tree(1, (64, 1.5, 1, 2, 0.3, (50, 50)), (40, 20), (139, 3.5, 3, 4, 0.1, (10, 30)), (8, 9), (2, 21)),
    *_tree(2, (28, 3.5, 1, 2, 0.12, (52, 48)), (22, 30), (30, 18)),
]


def nodes_sql(nodes: Sequence[Node]) -> str:
    """VALUES of a node table with one count column per class."""
    cell = lambda v: "NULL" if v is None else repr(v)
    rows = (
        f"({n.tree}, {n.node}, {cell(n.feature)}, {cell(n.threshold)}, {cell(n.left)}, {cell(n.right)}, {cell(n.gain)}, "
        + ", ".join(map(str, n.counts)) + ")"
        for n in nodes
    )
    counts = ", ".join(f"c{i}" for i in range(len(nodes[0].counts)))
    return f"(VALUES {', '.join(rows)}) nodes(tree, node, feature, threshold, left_, right_, gain, {counts})"
