"""Benchmark graphs with planted communities (J4-J6): one graph per group, many graphs at once."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.choice import u


@dataclass(frozen=True)
class Parameters:
    n: int = 1000
    mean_degree: float = 20.0
    max_degree: int = 50
    degree_exponent: float = 2.0
    size_exponent: float = 1.0
    mixing: float = 0.3
    min_size: int = 20
    max_size: int = 100


def power_law(low: int, high: int, exponent: float) -> np.ndarray:
    """Cumulative probabilities of k^-exponent on low..high."""
    p = np.arange(low, high + 1, dtype=float) ** -exponent
    return np.cumsum(p / p.sum())


def least_degree(mean: float, high: int, exponent: float) -> int:
    """The least degree whose power law up to ``high`` has the mean nearest to the wanted one."""
    means = [(abs(float((np.arange(k, high + 1) * np.diff(np.append(0, power_law(k, high, exponent)))).sum()) - mean), k) for k in range(1, high + 1)]
    return min(means)[1]


def power_law_draws(spark: SparkSession, n: int, low: int, high: int, exponent: float, seed: int = 1) -> DataFrame:
    """(id, k): draws by the inverse of the cumulative law, as one expression per row."""
    cdf = [float(x) for x in power_law(low, high, exponent)]
    at = F.size(F.filter(F.array(*[F.lit(round(x, 12)) for x in cdf]), lambda c: c < u(seed, 0, "id")))
    return spark.range(n).select("id", F.least(at + low, F.lit(high)).cast("int").alias("k"))


def internal_degrees(degrees: DataFrame, mixing: float, seed: int = 1) -> DataFrame:
    """(1 - mu) k with probabilistic rounding."""
    x = (1 - mixing) * F.col("k")
    return degrees.select("id", "k", (F.floor(x) + (u(seed, 1, "id") < x - F.floor(x)).cast("int")).cast("int").alias("inner"))


def _match(stubs: dict[int, int], rng, barred=lambda a, b: False) -> set[tuple[int, int]]:
    """A simple graph with the given degrees: largest remaining first, then random degree-preserving swaps."""
    left = {v: k for v, k in stubs.items() if k > 0}
    edges: set[tuple[int, int]] = set()
    near: dict[int, set[int]] = defaultdict(set)
    while left:
        v = max(left, key=lambda x: (left[x], -x))
        k = left.pop(v)
        order = sorted((w for w in left if w not in near[v] and not barred(v, w)), key=lambda x: (-left[x], x))[:k]
        for w in order:
            edges.add((min(v, w), max(v, w)))
            near[v].add(w)
            near[w].add(v)
            left[w] -= 1
            if not left[w]:
                del left[w]
    held = sorted(edges)
    for _ in range(2 * len(held)):
        i, j = rng.integers(len(held), size=2)
        (a, b), (c, d) = held[i], held[j]
        if rng.random() < 0.5:
            c, d = d, c
        if len({a, b, c, d}) == 4 and d not in near[a] and b not in near[c] and not barred(a, d) and not barred(c, b):
            for x, y in ((a, b), (c, d)):
                near[x].discard(y)
                near[y].discard(x)
            for x, y in ((a, d), (c, b)):
                near[x].add(y)
                near[y].add(x)
            held[i], held[j] = (min(a, d), max(a, d)), (min(b, c), max(b, c))
    return set(held)


def generate(p: Parameters, seed: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """One graph: edges and memberships, ids from 1."""
    rng = np.random.default_rng(seed)
    low = least_degree(p.mean_degree, p.max_degree, p.degree_exponent)
    k = low + np.searchsorted(power_law(low, p.max_degree, p.degree_exponent), rng.random(p.n))
    k = np.minimum(k, p.max_degree)
    x = (1 - p.mixing) * k
    inner = np.floor(x).astype(int) + (rng.random(p.n) < x - np.floor(x))
    # J4d: sizes until the nodes are used up; the last takes the rest.
    law, sizes = power_law(p.min_size, p.max_size, p.size_exponent), [max(int(inner.max()) + 1, p.min_size)]
    while sum(sizes) < p.n:
        sizes.append(p.min_size + int(np.searchsorted(law, rng.random())))
    if (over := sum(sizes) - p.n) > 0:
        sizes[-1] -= over
        if sizes[-1] < p.min_size and len(sizes) > 1:
            sizes[-2] += sizes.pop()
    # J4e: most demanding nodes first, each into a random community that is large enough and has room.
    room, com = list(sizes), {}
    for v in sorted(range(p.n), key=lambda v: (-inner[v], v)):
        fit = [c for c in range(len(sizes)) if room[c] and sizes[c] > inner[v]] or [max(range(len(sizes)), key=lambda c: room[c])]
        com[v] = int(rng.choice(fit))
        room[com[v]] -= 1
        inner[v] = min(inner[v], sizes[com[v]] - 1)
    edges: set[tuple[int, int]] = set()
    for c in range(len(sizes)):
        mine = [v for v in range(p.n) if com[v] == c]
        if sum(inner[v] for v in mine) % 2:  # J4f
            v = max(mine, key=lambda v: (inner[v], v))
            inner[v] -= 1
        edges |= _match({v: int(inner[v]) for v in mine}, rng)
    outer = {v: int(max(0, k[v] - inner[v])) for v in range(p.n)}
    edges |= _match(outer, rng, lambda a, b: com[a] == com[b])  # J4g: links between communities never fall inside one
    return sorted((a + 1, b + 1) for a, b in edges), {v + 1: c + 1 for v, c in com.items()}


def graphs(spark: SparkSession, count: int, p: Parameters = Parameters(), seed: int = 1) -> DataFrame:  # noqa: B008
    """(graph_id, kind, a, b): edge rows (src, dst) and community rows (node, community) of ``count`` graphs."""
    given = asdict(p)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in pdf["graph_id"]:
            edges, com = generate(Parameters(**given), seed + int(g))
            out += [(g, "edge", a, b) for a, b in edges] + [(g, "community", a, b) for a, b in com.items()]
        return pd.DataFrame(out, columns=["graph_id", "kind", "a", "b"])

    ids = spark.range(count).select(F.col("id").alias("graph_id"))
    return ids.groupBy("graph_id").applyInPandas(body, "graph_id long, kind string, a long, b long")
