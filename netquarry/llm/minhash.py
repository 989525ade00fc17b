"""MinHash near-dedup: BagMinHash signatures of word-shingle bags, banding, and verified multiset overlap.

A document is the bag of its five-word shingles (words: runs without ASCII white space, A-Z lower-cased); a text of
fewer words, but not none, is one shingle. Each shingle carries a hierarchy of Poisson processes over its discretised
weight: strip 0 covers weight [0, 1), strip j covers [2^(j-1), 2^j) at a rate of its width, and a point counts for a
document if its level lies under the shingle's weight there. The least point time of each of 128 components is the
signature; two bags agree in a component with a probability equal to their weighted Jaccard similarity. Points are
generated in time order only up to a horizon that fills all components, doubled for the documents that need it.

32 bands of 4 components make buckets. In a bucket (in parts of at most ``PART`` texts) the greatest spanning forest over
the estimates of longer signatures (``LONG`` components) gives the first candidates, which are verified: a pair links if the sum of least counts over the
sum of greatest counts is 0.8 or more. Then, in every bucket that still holds several components, each text outside the
bucket's main one meets the texts of other components whose estimate lies within four standard errors of the threshold,
best first, in two rounds until none is left; a pair is taken in the first band it shares and in no other. So a bucket's candidates go unverified only where their ends are
linked already, and no pair list of a bucket is written.

Estimates under ``LIKELY``, four standard errors below the threshold, are taken for no candidates; ``likely`` 0 takes all.
Keys that hold many rows (a bucket, a group of copies, a class) are salted in joins.

Edge cases: null, empty and white-space texts have no shingle and stay alone; equal word sequences are one class (their
first row stands for them in the bands); repeated rows and ids share a class; an empty table gives an empty result; extra
columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import _text
from netquarry.llm._graph import components
from netquarry.llm._io import cut, discard
from netquarry.llm._stream import grouped

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
PART, SALTED = 1024, 256
#: A key that holds over 1/HOT of all rows is salted in joins; so the table of such keys is bounded.
HOT = 1000
#: Components of a longer signature, kept in a byte each, for the texts that share a bucket: a standard error of 0.0204 at 0.8.
LONG = 384
#: The least estimate of a candidate, four standard errors under the threshold.
LIKELY = 0.72
#: Candidates of one text in a bucket, by round; the last round takes all.
TAKEN = (8, 1 << 40)
U = np.uint64


def bags(words: _text.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) sorted by row and hash."""
    at, value = words.windows(k)
    row = words.owner[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        whole = np.zeros(len(few), dtype=U)
        for i, r in enumerate(few):
            own = words.hash[words.first[r] : words.first[r + 1]]
            whole[i] = _text.windows(own, np.array([0, len(own)]), len(own))[1][0] ^ U(len(own))
        row, value = np.concatenate([row, few]), np.concatenate([value, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return row[starts], value[starts], np.diff(np.append(starts, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """BagMinHash: the least accepted point time of each of m components, as an (n, m) array; inf for an empty bag."""
    sig = np.full(n * m, np.inf)
    strips = [(row, _text.mix(value), np.ones(len(row)), np.zeros(len(row)), weight)]
    j = 1
    while True:
        low = 1 << (j - 1)
        more = np.flatnonzero(weight > low)
        if not len(more):
            break
        seed = _text.mix(value[more] ^ _text.mix(np.full(len(more), j, dtype=U)))
        strips.append((row[more], seed, np.full(len(more), float(low)), np.full(len(more), float(low)), weight[more]))
        j += 1
    own, seed, rate, floor, heavy = (np.concatenate(x) for x in zip(*strips, strict=True))
    time = np.zeros(len(own))
    step = np.zeros(len(own), dtype=U)
    ahead = np.full(len(own), np.nan)
    mass = np.bincount(row, weights=weight, minlength=n)
    with np.errstate(divide="ignore"):
        horizon = m * (np.log(m) + 2.0) / mass
    open_rows = mass > 0
    component, level = np.zeros(len(own), dtype=np.int64), np.zeros(len(own))

    def draw(who: np.ndarray) -> None:
        """The next point of each process."""
        step[who] += U(1)
        h = _text.mix(seed[who] + step[who] * U(0x9E3779B97F4A7C15))
        u = ((h >> U(24)).astype(np.float64) + 0.5) * 2.0**-40
        ahead[who] = time[who] - np.log(u) / rate[who]
        component[who] = ((h & U(0xFFFFFF)) % U(m)).astype(np.int64)
        wide = who[floor[who] > 0]
        if len(wide):
            g = _text.mix(seed[wide] ^ _text.mix(step[wide]))
            level[wide] = floor[wide] + rate[wide] * ((g >> U(11)).astype(np.float64) * 2.0**-53)

    draw(np.arange(len(own)))
    while open_rows.any():
        live = np.flatnonzero(open_rows[own] & (ahead <= horizon[own]))
        while len(live):
            hit = live[level[live] < heavy[live]]
            np.minimum.at(sig, own[hit] * m + component[hit], ahead[hit])
            time[live] = ahead[live]
            draw(live)
            live = live[ahead[live] <= horizon[own[live]]]
        open_rows &= np.isinf(sig.reshape(n, m)).any(axis=1)
        horizon = np.where(open_rows, horizon * 2, horizon)
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    bits = sig.view(U).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = _text.mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def _signed(batches):
    from pyspark import TaskContext

    key = TaskContext.get().partitionId() << 36
    for batch in batches:
        for low, high in _text.slices(batch.column(1)):
            n, text = high - low, batch.column(1).slice(low, high - low)
            words = _text.Words(text, _text.SPACED)
            row, value, weight = bags(words)
            keys = band_keys(signatures(row, value, weight, n))
            # The whole word sequence in two independent 64-bit hashes.
            total = [np.zeros(len(words.hash) + 1, dtype=U) for _ in range(2)]
            place = (np.arange(len(words.hash)) - words.first[words.owner]).astype(U)
            for t, c in zip(total, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB), strict=True):
                np.cumsum(_text.mix(words.hash ^ _text.mix(place + U(c))), out=t[1:])
            h = [(t[words.first[1:]] - t[words.first[:-1]]).view(np.int64) for t in total]
            rows = np.arange(key, key + n)
            full = words.counts > 0
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * BANDS)).astype(np.int32)), pa.array(keys[full].reshape(-1)))
            yield pa.record_batch(
                [pa.array(rows), batch.column(0).slice(low, n), pa.array(np.where(full, h[0], rows)), pa.array(np.where(full, h[1], -1 - rows)), pa.array(np.bincount(row, weights=weight, minlength=n).astype(np.int64)), bands, text, batch.column(2).slice(low, n)],
                names=["row_key", "doc_id", "h1", "h2", "total", "bands", "text", "rest"],
            )
            key += n


def _lengthened(batches):
    """Adds the longer signature to (row_key, total, text, bands)."""
    for batch in batches:
        for low, high in _text.slices(batch.column(2)):
            row, value, weight = bags(_text.Words(batch.column(2).slice(low, high - low), _text.SPACED))
            sig = (_text.mix(signatures(row, value, weight, high - low, LONG).view(U)) >> U(56)).astype(np.uint8)
            yield pa.record_batch([*(batch.column(i).slice(low, high - low) for i in range(4)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["row_key", "total", "text", "bands", "sig"])


def _verified(similar: float):
    """Streams groups that begin with their hub; yields the members whose bag overlaps it enough."""

    def run(batches):
        hub_key, hub = None, None
        for batch in batches:
            out = []
            group, salt, member, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for low, high in _text.slices(batch.column(4)):
                row, value, weight = bags(_text.Words(batch.column(4).slice(low, high - low), _text.SPACED))
                first = np.searchsorted(row, np.arange(high - low + 1))
                for i in range(high - low):
                    own = (value[first[i] : first[i + 1]], weight[first[i] : first[i + 1]])
                    j = low + i
                    if not member[j]:
                        hub_key, hub = (group[j], salt[j]), (own[0].copy(), own[1].copy())
                    elif hub_key == (group[j], salt[j]) and len(own[0]) and len(hub[0]):
                        at = np.minimum(np.searchsorted(hub[0], own[0]), len(hub[0]) - 1)
                        same = hub[0][at] == own[0]
                        both = np.minimum(hub[1][at[same]], own[1][same]).sum()
                        if both >= similar * (hub[1].sum() + own[1].sum() - both):
                            out.append((group[j], doc[j]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verify(texts: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The (a, b) of ``pairs(hub, doc)`` with enough overlap. Large groups are salted; each part has a copy of the hub."""
    size = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(SALTED)).cast("int").alias("salts"))
    member = pairs.join(size, "hub").select("hub", F.expr("int(pmod(xxhash64(doc), salts))").alias("salt"), F.lit(True).alias("member"), F.col("doc").alias("row_key"))
    hubs = size.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("hub").alias("row_key"))
    rows = member.union(hubs).join(texts, "row_key").select("hub", "salt", "member", "row_key", "text")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(_verified(similar), "a long, b long")


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(t), LONG)
    return t.column("rep").to_numpy(), t.column("total").to_numpy(), sig


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], size: str, total: int, by: str) -> DataFrame:
    """``rows`` joined to ``small``, which has one row for each key and says how many of ``rows`` it has: those of a hot key are
    dealt by ``by`` to several copies of its row."""
    share = max(PART, total // HOT)
    salted = small.withColumn("salts", F.ceil(F.col(size) / F.lit(share)).cast("int"))
    hot = salted.where("salts > 1").select(*keys, "salts")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.expr(f"int(pmod(xxhash64({by}), coalesce(salts, 1)))")).drop("salts")
    copies = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [*keys, "salt"]).drop("salt")


def _estimates(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, similar: float) -> np.ndarray:
    """Estimated similarities; -1 where the bags' sizes rule a link out."""
    out = np.empty((len(a), len(b)), dtype=np.float32)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).mean(axis=2)
    out[np.minimum(ta[:, None], tb[None, :]) < similar * np.maximum(ta[:, None], tb[None, :])] = -1
    return out


def _forest(similar: float, likely: float):
    """The greatest spanning forest of a bucket part over its estimates (Prim)."""

    def body(t: pa.Table):
        rep, total, sig = _read(t)
        if len(rep) < 2:
            return None
        est = _estimates(sig, sig, total, total, similar)
        best, via, out = est[0].copy(), np.zeros(len(rep), dtype=np.int64), np.zeros(len(rep), dtype=bool)
        out[0] = True
        pairs = []
        for _ in range(len(rep) - 1):
            j = int(np.argmax(np.where(out, -2, best)))
            if best[j] >= likely:
                pairs.append(sorted((int(rep[via[j]]), int(rep[j]))))
            out[j] = True
            nearer = est[j] > best
            best[nearer], via[nearer] = est[j][nearer], j
        if not pairs:
            return None
        return pa.record_batch([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["hub", "doc"])

    return body


def _asked(similar: float, taken: int, likely: float):
    """For each asking text of a bucket part, its best candidates in other components."""

    def body(t: pa.Table):
        rep, total, sig = _read(t)
        comp, asks = t.column("part").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a) or not len(b):
            return None
        est = _estimates(sig[a], sig[b], total[a], total[b], similar)
        est[comp[a][:, None] == comp[b][None, :]] = -1
        i, j = np.nonzero(est >= likely)
        bands, key = np.array(t.column("bands").to_pylist(), dtype=np.int64), t.column("key")[0].as_py()
        mine = np.empty(len(i), dtype=bool)
        for c in range(0, len(i), 1 << 16):
            x, y = bands[a[i[c : c + (1 << 16)]]], bands[b[j[c : c + (1 << 16)]]]
            mine[c : c + (1 << 16)] = x[np.arange(len(x)), (x == y).argmax(axis=1)] == key
        i, j = i[mine], j[mine]
        order = np.lexsort((j, -est[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        size = np.bincount(i, minlength=len(a))
        good = rank < taken
        x, y, more = a[i[good]], b[j[good]], size[i[good]] > taken
        return pa.record_batch([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y])), pa.array(more)], names=["hub", "doc", "more"])

    return body


def _parted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Bucket rows dealt by bucket and part."""
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns[:1])


def _crossing(rows: DataFrame, parts: DataFrame, similar: float, taken: int, total: int, likely: float) -> DataFrame:
    """(hub, doc, more): candidates between components that share a bucket. Every tile of asking texts meets every part."""
    own = rows.join(parts, rows.rep == parts.node, "left").select("key", "n", "rep", "total", "sig", "bands", F.coalesce("component", "rep").alias("part"))
    sizes = own.groupBy("key", "part").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "part")).alias("top"), F.count("*").alias("parts"), F.sum("count").alias("all")).where("parts > 1")
    main = main.select("key", "all", F.col("top.part").alias("main"), F.ceil((F.col("all") - F.col("top.count")) / F.lit(PART)).cast("int").alias("tiles"))
    split = cut(_joined(own, main, ["key"], "all", total, "rep").drop("all").withColumn("salts", F.ceil(F.col("n") / F.lit(PART)).cast("int")))
    salt, tile = F.expr("int(pmod(xxhash64(rep, key), salts))"), F.expr("int(pmod(xxhash64(key, rep), tiles))")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = split.select("key", salt.alias("salt"), each("tiles").alias("tile"), "rep", "total", "sig", "bands", "part", F.lit(False).alias("asks"))
    asking = split.where("part <> main").select("key", each("salts").alias("salt"), tile.alias("tile"), "rep", "total", "sig", "bands", "part", F.lit(True).alias("asks"))
    dealt = _parted(every.union(asking), ["key", "salt", "tile"], ["rep", "total", "sig", "bands", "part", "asks"])
    # The hashes keep a group near 2 * PART rows; it is never cut, as rows of two chunks would not meet.
    met = dealt.mapInArrow(grouped(3, _asked(similar, taken, likely), 1 << 40), "hub long, doc long, more boolean")
    out = cut(met.groupBy("hub", "doc").agg(F.max("more").alias("more")))
    discard(split)
    return out


def _classed(docs: DataFrame, rest: Column, similar: float, likely: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their keys and ``rest``; and row_key, doc_id, class_id, class_size, kept of each."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    schema = "row_key long, doc_id long, h1 long, h2 long, total long, bands array<long>, text string, rest " + given.schema["rest"].dataType.simpleString()
    signed = cut(given.mapInArrow(_signed, schema))
    total = signed.count()
    first = signed.groupBy("h1", "h2").agg(F.min("row_key").alias("rep"), F.count("*").alias("copies"))
    member = cut(_joined(signed.select("row_key", "doc_id", "h1", "h2"), first, ["h1", "h2"], "copies", total, "row_key").select("row_key", "doc_id", "rep"))
    alone = member.where("row_key = rep").select("row_key")
    keys = signed.select("row_key", "bands").join(alone, "row_key").select(F.explode("bands").alias("key"), F.col("row_key").alias("rep"))
    shared = cut(_joined(keys, keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), ["key"], "n", total, "rep"))
    mates = shared.select(F.col("rep").alias("row_key")).distinct()
    texts = cut(signed.select("row_key", "total", "text", "bands").join(mates, "row_key").mapInArrow(_lengthened, "row_key long, total long, text string, bands array<long>, sig binary"))
    rows = cut(shared.join(texts.select(F.col("row_key").alias("rep"), "total", "sig", "bands"), "rep"))
    discard(shared)
    salted = rows.withColumn("salt", F.expr(f"int(pmod(xxhash64(rep, key), ceil(n / {PART})))"))
    forest = _parted(salted, ["key", "salt"], ["rep", "total", "sig"]).mapInArrow(grouped(2, _forest(similar, likely), 2 * PART), "hub long, doc long")
    tested = cut(forest.distinct())
    own = [tested]
    body = texts.select("row_key", "text")
    links = cut(_verify(body, tested, similar))
    own.append(links)
    parts = cut(components(links))
    for taken in TAKEN:
        found = _crossing(rows, parts, similar, taken, total, likely)
        fresh = cut(found.select("hub", "doc").join(tested, ["hub", "doc"], "left_anti"))
        last = found.where("more").isEmpty()
        own += [found, fresh]
        if not fresh.isEmpty():
            new = cut(_verify(body, fresh, similar))
            own.append(new)
            tested = tested.union(fresh)
            if not new.isEmpty():
                links = links.union(new)
                before, parts = parts, cut(components(links))
                discard(before)
        if last:
            break
    discard(rows, texts, *own)
    placed = cut(member.join(parts, member.rep == parts.node, "left").select("row_key", "doc_id", F.coalesce("component", "rep").alias("part")))
    discard(member, parts)
    class_of = placed.groupBy("part").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("class_size"))
    return signed, _joined(placed, class_of, ["part"], "class_size", total, "row_key").select("row_key", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row_key") == F.col("first.row_key")).alias("kept"))


def classes(docs: DataFrame, similar: float = SIMILAR, likely: float = LIKELY) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, kept (its first row). With ``likely`` 0
    all texts that share a band are candidates, whatever their longer signatures say."""
    signed, placed = _classed(docs, F.lit(0), similar, likely)
    discard(signed)
    return placed.drop("row_key")


def keep_one(docs: DataFrame, similar: float = SIMILAR, likely: float = LIKELY) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the first row of the least id."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    signed, placed = _classed(docs, F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0), similar, likely)
    kept = signed.select("row_key", "doc_id", "text", "rest").join(placed.where("kept").select("row_key"), "row_key")
    return kept.select(*[F.col("rest").getField(c).alias(c) if c in others else F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
