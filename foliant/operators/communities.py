"""Communities of a book's people by modularity (Louvain), the same for every run.

A book's graph fits a task; books are dealt over the cluster.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

LEVELS, PASSES = 12, 20
TINY = 1e-12


def louvain(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """node -> community, 0 for the largest; nodes are visited in order, equal gains go to the smaller community."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    index = {n: i for i, n in enumerate(nodes)}
    graph: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    loops = [0.0] * len(nodes)
    for a, b, w in edges:
        i, j = index[a], index[b]
        if i == j:
            loops[i] += w
        else:
            graph[i][j] += w
            graph[j][i] += w
    member = list(range(len(nodes)))
    total = 2 * sum(w for _, _, w in edges)
    for _ in range(LEVELS if total > 0 else 0):
        degree = [sum(g.values()) + 2 * loop for g, loop in zip(graph, loops, strict=True)]
        of = list(range(len(graph)))
        weight = list(degree)
        moved = False
        for _ in range(PASSES):
            changed = False
            for i, near in enumerate(graph):
                own = of[i]
                weight[own] -= degree[i]
                into: dict[int, float] = defaultdict(float)
                for j, w in near.items():
                    into[of[j]] += w
                best, gain = own, into[own] - weight[own] * degree[i] / total
                for c in sorted(into):
                    g = into[c] - weight[c] * degree[i] / total
                    if g > gain + TINY or abs(g - gain) <= TINY and c < best:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != own:
                    of[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        names = {c: k for k, c in enumerate(sorted(set(of)))}
        member = [names[of[m]] for m in member]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        inner = [0.0] * len(names)
        for i, near in enumerate(graph):
            inner[names[of[i]]] += loops[i]
            for j, w in near.items():
                a, b = names[of[i]], names[of[j]]
                if a == b:
                    inner[a] += w / 2
                else:
                    merged[a][b] += w
        graph, loops = merged, inner
    sizes: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(member):
        sizes[c].append(i)
    order = sorted(sizes.values(), key=lambda m: (-len(m), m[0]))
    return {nodes[i]: k for k, m in enumerate(order) for i in m}


def communities(edges: DataFrame, book: str) -> DataFrame:
    """book, node, community of edges(book, a, b, weight)."""
    kind = dict(edges.dtypes)[book]

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = louvain(sorted(rows[["a", "b", "weight"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(key[0], n, c) for n, c in sorted(found.items())], columns=[book, "node", "community"])

    return edges.select(book, "a", "b", "weight").groupBy(book).applyInPandas(one, f"{book} {kind}, node long, community long")
