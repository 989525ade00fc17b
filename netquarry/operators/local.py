"""Local communities around a start node under a small budget (G40-G42), with precision, recall and F1 against a partition.

One task a community; the graph is broadcast under the bound of ``grouped``. The start of a community is its member of least
hash. Every query costs 1.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.choice import u_py
from netquarry.operators.grouped import Access, Crawl, adjacency_of, mapping_of

#: Cost up to which the overlap method queues, and the budget of a seed of the layered one.
QUEUE_COST, SEED_COST = 5.0, 10.0


def _sharpness(c: Crawl, own: set[str]) -> float:
    """R of a set in the sample: edges inside over all edges at its nodes with outer neighbours."""
    boundary = [v for v in own if c.near[v] - own]
    links = {(min(v, w), max(v, w)) for v in boundary for w in c.near[v]}
    return sum(a in own and b in own for a, b in links) / len(links) if links else 1.0


def _mutual(c: Crawl) -> str:
    return c.top(c.open, lambda n: c.obs(n) / c.deg(n))


def mutual(c: Crawl, start: str, budget: float, help_: dict) -> set[str]:
    """Always the open node with the greatest share of its neighbours in the sample."""
    v: str | None = start
    while v is not None and c.cost < budget:
        c.query(v)
        v = _mutual(c) if c.open else None
    return set(c.closed)


def overlap(c: Crawl, start: str, budget: float, help_: dict) -> set[str]:
    """First found first up to a cost of 5, then the open node with most closed neighbours in the cheap layer."""
    v: str | None = start
    while v is not None and c.cost < budget:
        c.query(v)
        if not c.open:
            break
        near = help_["cheap"]
        v = min(c.open, key=lambda n: (c.open[n], c.u(n), n)) if c.cost < QUEUE_COST else c.top(c.open, lambda n: len(near.get(n, frozenset()) & c.closed.keys()))
    return set(c.closed)


def layers(c: Crawl, start: str, budget: float, help_: dict) -> set[str]:
    """Heads of the cheap communities next to the start's as seeds with equal budgets, then growth while R does not fall."""
    cheap, com, rank = help_["cheap"], help_["com"], help_["rank"]
    members: dict[int, list[str]] = defaultdict(list)
    for n, k in com.items():
        members[k].append(n)
    next_to = {com[w] for n in members.get(com.get(start), ()) for w in cheap.get(n, ()) if w in com}
    heads = [min(members[k], key=lambda n: (-round(rank.get(n, 0.0), 9), n)) for k in sorted(next_to)]
    for seed in [start, *(h for h in heads if h in c.access.adj)]:
        v, end = seed, c.cost + SEED_COST
        while v not in c.closed and c.cost < end:
            c.query(v)
            if not c.open:
                break
            v = _mutual(c)
    own: set[str] = set()
    candidates: set[str] = set()
    v, before, r = start, 0.0, 0.0
    while before <= r:
        own.add(v)
        candidates |= c.near[v] - own
        if not candidates:
            break
        v = c.top(candidates, c.obs)
        candidates.discard(v)
        before, r = r, _sharpness(c, own)
    return own


METHODS = {"mutual": mutual, "overlap": overlap, "layers": layers}


def communities(edges: DataFrame, com: DataFrame, method: str, trials: int, budget: float = 20.0, seed: int = 1, cheap: DataFrame | None = None, cheap_com: DataFrame | None = None, cheap_rank: DataFrame | None = None) -> DataFrame:
    """(com, trial, id, hit, members, cost): the nodes found for every community of com(id, com) in each trial."""
    spark = edges.sparkSession
    adj = adjacency_of(edges)
    help_ = {"cheap": {k: frozenset(v) for k, v in adjacency_of(cheap).items()} if cheap is not None else {}, "com": mapping_of(cheap_com, adj), "rank": mapping_of(cheap_rank, adj)}
    shared = spark.sparkContext.broadcast((adj, help_))
    at_most = com.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_semi")
    runs = at_most.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def body(key, pdf: pd.DataFrame) -> pd.DataFrame:
        graph, more = shared.value
        own, own_seed = set(pdf["id"]), seed + int(key[1])
        c = Crawl(Access(graph), method, int(key[1]), own_seed)
        found = METHODS[method](c, min(own, key=lambda n: (u_py(own_seed, 0, n), n)), budget, more)
        return pd.DataFrame([(int(key[0]), int(key[1]), n, n in own, len(own), c.cost) for n in sorted(found)], columns=["com", "trial", "id", "hit", "members", "cost"])

    return runs.groupBy("com", "trial").applyInPandas(body, "com int, trial int, id string, hit boolean, members long, cost double")


def report(found: DataFrame) -> DataFrame:
    """(com, trial, found, members, cost, precision, recall, f1)."""
    own = found.groupBy("com", "trial").agg(F.count("*").alias("found"), F.sum(F.col("hit").cast("int")).alias("hits"), F.max("members").alias("members"), F.max("cost").alias("cost"))
    own = own.withColumn("precision", F.col("hits") / F.col("found")).withColumn("recall", F.col("hits") / F.col("members"))
    return own.select("com", "trial", "found", "members", "cost", "precision", "recall", F.expr("coalesce(try_divide(2 * precision * recall, precision + recall), 0.0)").alias("f1"))
