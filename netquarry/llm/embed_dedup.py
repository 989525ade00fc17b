"""Embedding near-dedup: NN-descent over a random-projection forest, then exact link counts inside what it links.

1. Equal vectors are one vector with a multiplicity. Vectors that are null, empty, zero or hold null or non-finite
   components link with nothing; vectors of different lengths never link.
2. ``TREES`` random-hyperplane trees cut the vectors into leaves, in blocks of at most ``BLOCK``; the ``K`` best of each
   block start a neighbour graph.
3. NN-descent: around each vector its neighbours and those it is a neighbour of meet (neighbours of neighbours), and every
   vector keeps the K best it has met; rounds end when few lists change. Edges at or above the threshold link.
4. A list whose K entries all reach the threshold is saturated: links to farther vectors have no room in it. The saturated
   vectors go through a forest and descent of their own, where only vectors of other components count as neighbours, until
   a whole pass finds no link between components. (An edge missing at one end from a full list is missing at a saturated
   end on both sides, so other vectors need no second pass.)
5. Inside a linked component saturated lists are enlarged to completion: members whose cosine to the component's centre is at least cos(acos(t) / 2) are linked pairwise for certain
   (angles add up), all others meet every member in blocks. So counts are whole and no pair list is written.

``audit`` measures the recall of the links against brute force for a stated query set. Edge cases: repeated rows and ids
are vectors of their own; ties are kept by id; an empty table gives no rows; extra columns are ignored. Hot leaves are
split by a hash: at most ``HOT`` of a tree's leaves hold more than 1/HOT of all rows each, so their table is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm._graph import components
from netquarry.llm._io import cut, discard
from netquarry.llm._stream import grouped

THRESHOLD, TREES, BLOCK, K = 0.9, 12, 256, 8
HOT, WHOLE, TILE = 1000, 2048, 1024
#: Rounds end when at most this share of the lists' entries changed.
SETTLED = 0.01


def _unit(batches):
    for batch in batches:
        values, good, length = [], [], []
        for v in batch.column(2).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            ok = bool(len(x) and np.isfinite(top) and top > 0)
            if ok:
                x = x / top
                x = x / np.linalg.norm(x)
            good.append(ok)
            length.append(len(x))
            values.append(x.tobytes() if ok else b"")
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(good), pa.array(length, pa.int32()), pa.array(values, pa.binary())], names=["row_key", "vec_id", "ok", "dim", "unit"])


def _stack(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1).astype(kind)


def _best(t: pa.Table, name: str, k: int) -> pa.RecordBatch | None:
    """Each row's k most similar other rows of a block that belong to another part."""
    node, part, x = t.column(name).to_numpy(), t.column("part").to_numpy(), _stack(t.column("unit").combine_chunks(), np.float32)
    n = len(node)
    if n < 2:
        return None
    s = x @ x.T
    s[part[:, None] == part[None, :]] = -2
    k = min(k, n - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sims = np.take_along_axis(s, top, axis=1)
    i, j = np.nonzero(sims > -1.5)
    return pa.record_batch([pa.array(node[i]), pa.array(node[top[i, j]]), pa.array(sims[i, j].astype(np.float32))], names=["node", "other", "sim"])


def _planted(trees: int, bits: int, seed: int):
    """(tree, code, place, node, unit, part): the leaf of each vector in each tree, and its place there by one more projection."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                unit = batch.column(2).take(pa.array(at))
                x = _stack(unit)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), trees * (bits + 1)))
                y = (x @ planes[d]).reshape(len(at), trees, bits + 1)
                code = ((y[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros((len(at), trees), dtype=np.int64)
                for t in range(trees):
                    yield pa.record_batch([pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(code[:, t] * 65536 + int(d)), pa.array(y[:, t, bits]), batch.column(0).take(pa.array(at)), unit, batch.column(3).take(pa.array(at))], names=["tree", "code", "place", "node", "unit", "part"])

    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(node, near): the k best distinct others of each node, an array of (sim, other)."""
    each = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    return each.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "other")), asc=False), 1, k).alias("near"))


def neighbours(vectors: DataFrame, k: int = K, trees: int = TREES, seed: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(node, near) of vectors(node, dim, unit, part) by NN-descent from a random-projection forest; near are of other parts.

    ``known(node, other)`` are pairs whose ends are near each other, of any part: what one of them has met, the other meets.
    """
    n = vectors.count()
    bits = max(0, min(40, math.ceil(math.log2(max(n, 1) / (BLOCK / 2)))))
    planted = vectors.select("node", "dim", "unit", "part").mapInArrow(_planted(trees, bits, seed), "tree int, code long, place double, node long, unit binary, part long")
    leaves = vectors.select("node", "dim", "unit", "part").mapInArrow(_planted(trees, bits, seed), "tree int, code long, place double, node long, unit binary, part long").groupBy("tree", "code").agg(F.count("*").alias("n"))
    hot = leaves.where(F.col("n") > max(BLOCK, n / HOT)).select("tree", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts"))
    dealt = planted.join(F.broadcast(hot), ["tree", "code"], "left").withColumn("salt", F.expr("int(pmod(xxhash64(node, tree), coalesce(salts, 1)))"))
    dealt = dealt.select("tree", "code", "salt", "place", "node", "unit", "part").repartition("tree", "code", "salt").sortWithinPartitions("tree", "code", "salt", "place", "node")

    def leaf(t: pa.Table):
        return _best(t, "node", k)

    edge = "node long, other long, sim float"
    lists = cut(_lists(dealt.mapInArrow(grouped(3, leaf, BLOCK), edge), k))
    own = vectors.select(F.col("node").alias("member"), "unit", "part")
    while True:
        links = lists.select("node", F.explode("near").alias("x")).select("node", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"))
        # Around each centre its neighbours, those it is a neighbour of, and itself.
        pairs = links.select("node", "other").union(known) if known is not None else links
        around = pairs.select(F.col("node").alias("centre"), F.col("other").alias("member")).union(pairs.select(F.col("other").alias("centre"), F.col("node").alias("member")))
        around = around.union(lists.select(F.col("node").alias("centre"), F.col("node").alias("member"))).distinct()
        # A hub's crowd is dealt over parts by a hash that changes with the round's salt.
        crowd = around.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("salts"))
        dealt = around.join(crowd, "centre").withColumn("salt", F.expr("int(pmod(xxhash64(member, centre), salts))")).join(own, "member")
        met = dealt.select("centre", "salt", "member", "unit", "part").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "member")

        def meet(t: pa.Table):
            return _best(t, "member", k)

        fresh = cut(_lists(links.union(met.mapInArrow(grouped(2, meet, BLOCK), edge)), k))
        old = lists.select("node", F.transform("near", lambda x: x.other).alias("was"))
        changed = fresh.join(old, "node", "left").agg(F.sum(F.size(F.array_except(F.transform("near", lambda x: x.other), F.coalesce("was", F.array().cast("array<long>"))))), F.sum(F.size("near"))).first()
        discard(lists)
        lists = fresh
        if not changed[1] or changed[0] <= SETTLED * changed[1]:
            return lists


def _counted(threshold: float):
    """Links of each member of a whole component, weighted by multiplicity."""

    def body(t: pa.Table):
        x, m = _stack(t.column("unit").combine_chunks()), t.column("copies").to_numpy()
        n = np.zeros(len(x), dtype=np.int64)
        for a in range(0, len(x), TILE):
            hit = x[a : a + TILE] @ x.T >= threshold
            hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
            n[a : a + TILE] = hit @ m
        return pa.record_batch([t.column("node").combine_chunks(), pa.array(n)], names=["node", "links"])

    return body


def _crossed(threshold: float):
    """One tile of outer members against a run of members of their component."""

    def body(t: pa.Table):
        outer = t.column("outer").to_numpy(zero_copy_only=False)
        x, m, node = _stack(t.column("unit").combine_chunks()), t.column("copies").to_numpy(), t.column("node").to_numpy()
        core = t.column("core").to_numpy(zero_copy_only=False)
        o, r = np.flatnonzero(outer), np.flatnonzero(~outer)
        if not len(o) or not len(r):
            return None
        hit = x[o] @ x[r].T >= threshold
        hit &= node[o][:, None] != node[r][None, :]
        back = hit.T @ m[o]
        back[~core[r]] = 0  # an outer member counts in its own tile
        return pa.record_batch([pa.array(np.append(node[o], node[r])), pa.array(np.append(hit @ m[r], back).astype(np.int64))], names=["node", "links"])

    return body


def _large_links(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(node, links) of components beyond ``WHOLE``: a certain core, and blocks for the rest."""
    large = members.join(sizes.where(F.col("n") > WHOLE), "component")

    def sums(batches):
        for batch in batches:
            comp, x, m = batch.column(0).to_numpy(), _stack(batch.column(1)), batch.column(2).to_numpy()
            names, at = np.unique(comp, return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, at, x * m[:, None])
            yield pa.record_batch([pa.array(names), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["component", "total"])

    parts = large.select("component", "unit", "copies").mapInArrow(sums, "component long, total array<double>")
    flat = parts.select("component", F.posexplode("total").alias("i", "v")).groupBy("component", "i").agg(F.sum("v").alias("v"))
    centres = flat.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("centre"))
    safe = math.cos(math.acos(threshold) / 2) + 1e-9

    def near(batches):
        for batch in batches:
            x = _stack(batch.column(2))
            c = np.array(batch.column(4).to_pylist(), dtype=np.float64)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array((x * c).sum(1) >= safe)], names=["component", "node", "unit", "copies", "core"])

    marked = cut(large.join(centres, "component").select("component", "node", "unit", "copies", "centre").mapInArrow(near, "component long, node long, unit binary, copies long, core boolean"))
    mass = marked.where("core").groupBy("component").agg(F.sum("copies").alias("mass"))
    inner = marked.where("core").join(mass, "component").select("node", (F.col("mass") - F.col("copies")).alias("links"))
    tiles = marked.where("NOT core").groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    runs = sizes.select("component", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("runs"))
    outer = marked.where("NOT core").join(tiles, "component").join(runs, "component")
    outer = outer.select("component", F.expr("int(pmod(xxhash64(node), tiles))").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(True).alias("outer"), "node", "unit", "copies", "core")
    every = marked.join(tiles, "component").join(runs, "component")
    every = every.select("component", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.expr("int(pmod(xxhash64(node, 1), runs))").alias("run"), F.lit(False).alias("outer"), "node", "unit", "copies", "core")
    met = outer.union(every).repartition("component", "tile", "run").sortWithinPartitions("component", "tile", "run")
    return inner.union(met.mapInArrow(grouped(3, _crossed(threshold), 1 << 30), "node long, links long"))


def link(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, trees: int = TREES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable), kept."""
    raw = vectors.select(F.monotonically_increasing_id().alias("row_key"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = cut(raw.mapInArrow(_unit, "row_key long, vec_id long, ok boolean, dim int, unit binary"))
    same = rows.where("ok").groupBy("unit", "dim").agg(F.min("row_key").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = cut(same)
    lists = neighbours(distinct.select("node", "dim", "unit", F.col("node").alias("part")), k, trees)

    def exact(batches):
        for batch in batches:
            hit = (_stack(batch.column(2)) * _stack(batch.column(3))).sum(1) >= threshold
            yield pa.record_batch([batch.column(0).filter(pa.array(hit)), batch.column(1).filter(pa.array(hit))], names=["a", "b"])

    own = distinct.select("node", "unit")

    def linked(lists: DataFrame) -> DataFrame:
        close = lists.select("node", F.explode("near").alias("x")).where(F.col("x.sim") >= threshold - 1e-5).select(F.col("node").alias("a"), F.col("x.other").alias("b"))
        sides = close.join(own.toDF("a", "ua"), "a").join(own.toDF("b", "ub"), "b").select("a", "b", "ua", "ub")
        return cut(sides.mapInArrow(exact, "a long, b long"))

    links = linked(lists)
    parts = cut(components(links))
    full = cut(lists.where((F.size("near") >= k) & (F.element_at("near", -1).sim >= threshold - 1e-5)).select("node", F.transform("near", lambda x: x.other).alias("near")))
    known = full.select("node", F.explode("near").alias("other"))
    passes = 0
    while parts.join(full, "node").select("component").distinct().limit(2).count() > 1:
        passes += 1
        placed = distinct.join(full.select("node"), "node").join(parts, "node").select("node", "dim", "unit", F.col("component").alias("part"))
        fresh = linked(neighbours(cut(placed), k, trees, 5 + passes, known))
        if fresh.isEmpty():
            break
        links = links.union(fresh)
        parts = cut(components(links))
    members = cut(distinct.join(parts, "node").select("component", "node", "unit", "copies"))
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("n")))
    small = members.join(sizes.where(F.col("n") <= WHOLE), "component").select("component", "node", "unit", "copies")
    counts = small.repartition("component").sortWithinPartitions("component").mapInArrow(grouped(1, _counted(threshold), WHOLE), "node long, links long")
    if not sizes.where(F.col("n") > WHOLE).isEmpty():
        counts = counts.union(_large_links(members, sizes, threshold))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    least = distinct.join(parts, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.join(least, "component").select("node", "component_id")
    per = distinct.join(counts, "node", "left").join(named, "node", "left").select("unit", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.where("ok").join(per, ["unit", "dim"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("NOT ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(vectors: DataFrame, linked: DataFrame, threshold: float = THRESHOLD, every: int = 100) -> float:
    """Recall of the links of vectors whose id is divisible by ``every``, against brute force over all rows in blocks."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row_key"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_unit, "row_key long, vec_id long, ok boolean, dim int, unit binary").where("ok")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "row_key", "dim", "unit").toPandas()
    if asked.empty:
        return 1.0
    units = {d: (g["row_key"].to_numpy(), g["vec_id"].to_numpy(), np.stack([np.frombuffer(u) for u in g["unit"]])) for d, g in asked.groupby("dim")}

    def scan(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d, (keys, ids, q) in units.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    hit = q @ _stack(batch.column(2).take(pa.array(at))).T >= threshold
                    hit &= keys[:, None] != batch.column(0).to_numpy()[at][None, :]
                    yield pa.record_batch([pa.array(ids), pa.array(hit.sum(1).astype(np.int64))], names=["vec_id", "n"])

    true = rows.select("row_key", "dim", "unit").mapInArrow(scan, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(linked.groupBy("vec_id").agg(F.sum("n_links").alias("found")), "vec_id").agg(F.sum(F.least("found", "n")), F.sum("n")).first()
    return float(got[0] / got[1]) if got[1] else 1.0
