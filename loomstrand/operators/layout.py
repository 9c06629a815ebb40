"""Edge weights from a force-directed drawing of each component (Fruchterman and Reingold 1991).

Only the drawing's distances are used: an edge that is drawn far longer than its sibling joins parts that do not belong
together. Places start from a hash of component, node and round, so that runs repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomstrand.operators.prune import ROWS, dump, load

ROUNDS = 100
SMALLEST = 6


def force_layout(n: int, pairs: np.ndarray, seed: int, rounds: int = ROUNDS, block: int = 512) -> np.ndarray:
    """n x 2 places. Repulsion is summed over blocks of nodes, so that memory stays at block * n."""
    rng = np.random.default_rng(seed)
    at = rng.random((n, 2))
    k = (1.0 / n) ** 0.5
    heat, cool = 0.1, 0.1 / (rounds + 1)
    for _ in range(rounds):
        push = np.zeros((n, 2))
        for b in range(0, n, block):
            gap = at[b : b + block, None, :] - at[None, :, :]
            push[b : b + block] = (gap * (k * k / np.maximum((gap**2).sum(axis=2), 1e-4))[:, :, None]).sum(axis=1)
        gap = at[pairs[:, 0]] - at[pairs[:, 1]]
        pull = gap * (np.sqrt((gap**2).sum(axis=1)) / k)[:, None]
        np.add.at(push, pairs[:, 0], -pull)
        np.add.at(push, pairs[:, 1], pull)
        size = np.maximum(np.sqrt((push**2).sum(axis=1)), 1e-9)
        at += push * (np.minimum(size, heat) / size)[:, None]
        heat -= cool
    return at


def weighted(rows: DataFrame, round_: int = 0) -> DataFrame:
    """Rows of components with edge weights; components without a junction or of fewer than six nodes keep theirs."""

    def each(key, part: pd.DataFrame) -> pd.DataFrame:
        g = load(part)
        even = sorted({n & ~1 for n in g.nodes})
        where = {n: i for i, n in enumerate(even)}
        pairs = {tuple(sorted((where[e.tail & ~1], where[e.head & ~1]))) for e in g.edges.values()}
        pairs |= {tuple(sorted((where[n.id & ~1], where[t]))) for n in g.nodes.values() for t in n.transitive if t in where}
        pairs = {p for p in pairs if p[0] != p[1]}
        if len(even) >= SMALLEST and pairs and any(g.junction(n) for n in g.nodes):
            at = force_layout(len(even), np.array(sorted(pairs)), (int(key[0]) * 1_000_003 + round_) % (1 << 32))
            for e in g.edges.values():
                e.weight = float(np.hypot(*(at[where[e.tail & ~1]] - at[where[e.head & ~1]])))
        return dump(int(key[0]), g, 0)

    return rows.groupBy("component").applyInPandas(each, ROWS)
