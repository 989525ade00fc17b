"""Benchmark decontamination: a broadcast hash set of benchmark word n-grams scanned over every document window.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A window is ten consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit. Candidate windows are found by 64-bit hash and verified word by word.

Edge cases: null and empty texts have no words and are never hit; an item without words matches nothing; an empty
benchmark leaves every document clean; repeated rows are scanned each on its own; extra columns pass through.
The broadcast set holds at most ``MAX_WINDOWS`` windows: a larger benchmark is scanned in several bounded passes, and the
driver holds the items of one pass at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import _text
from netquarry.llm._io import cut, discard

WINDOW = 10
MAX_WINDOWS = 1_000_000
_BITS = 20


class Lookup:
    """Windows of one bounded block of items, by length: sorted hashes and the (item, first word) behind each."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        ids = [i for i, _ in items]
        words = _text.Words(pa.array([t or "" for _, t in items], pa.large_string()), _text.ALNUM)
        self.words = [[words.word(j) for j in range(words.first[i], words.first[i + 1])] for i in range(len(items))]
        self.ids = ids
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i in range(len(items)):
            n = len(self.words[i])
            if n:
                k = min(window, n)
                own = words.hash[words.first[i] : words.first[i + 1]]
                at, value = _text.windows(own, np.array([0, n]), k)
                for a, v in zip(at.tolist(), value.tolist(), strict=True):
                    places[k][v].append((i, a))
        self.by = {}
        for k, found in places.items():
            keys = np.array(sorted(found), dtype=np.uint64)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[keys & np.uint64((1 << _BITS) - 1)] = True
            self.by[k] = (keys, seen, [found[int(v)] for v in keys])

    def scan(self, words: _text.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Mask of hit words and, by row, the items with occurring windows."""
        edge = np.zeros(len(words.start) + 1, dtype=np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for k, (keys, seen, places) in self.by.items():
            at, value = words.windows(k)
            may = np.flatnonzero(seen[value & np.uint64((1 << _BITS) - 1)])
            slot = np.minimum(np.searchsorted(keys, value[may]), len(keys) - 1)
            for p, s in zip(at[may[keys[slot] == value[may]]].tolist(), slot[keys[slot] == value[may]].tolist(), strict=True):
                text = [words.word(j) for j in range(p, p + k)]
                own = [self.ids[i] for i, a in places[s] if self.words[i][a : a + k] == text]
                if own:
                    edge[p] += 1
                    edge[p + k] -= 1
                    items[int(np.searchsorted(words.first, p, side="right")) - 1].update(own)
        return np.cumsum(edge[:-1]) > 0, items


def _blocks(benchmark: DataFrame, window: int, max_windows: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of items whose windows fit the broadcast bound, and the blocks, each read when it is asked for."""
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Every window costs at least one byte of text, so bytes bound windows.
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // max_windows))
    block = lambda b: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    return n, ([tuple(r) for r in block(b).collect()] for b in range(n))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, spans (hit byte ranges), items (sorted as text)."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    passes, blocks = _blocks(benchmark, window, max_windows)
    schema = "row_key long, doc_id long, n_words long, hits array<long>, spans array<struct<start:long,end:long>>, items array<string>"

    def one(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Lookup(block, window))

        def run(batches):
            from pyspark import TaskContext

            key = TaskContext.get().partitionId() << 36
            for batch in batches:
                text = batch.column(1)
                for low, high in _text.slices(text):
                    words = _text.Words(text.slice(low, high - low), _text.ALNUM)
                    hit, items = shared.value.scan(words)
                    n = high - low
                    hits, spans = [[]] * n, [[]] * n
                    for i in items:
                        own = np.flatnonzero(hit[words.first[i] : words.first[i + 1]])
                        hits[i] = own.tolist()
                        runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
                        base, first = words.offsets[i], words.first[i]
                        spans[i] = [{"start": int(words.start[first + r[0]] - base), "end": int(words.end[first + r[-1]] - base)} for r in runs]
                    yield pa.record_batch(
                        [
                            pa.array(np.arange(key, key + n)),
                            batch.column(0).slice(low, n),
                            pa.array(words.counts.astype(np.int64)),
                            pa.array(hits, pa.list_(pa.int64())),
                            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            pa.array([sorted({str(x) for x in items[i]}) if i in items else [] for i in range(n)], pa.list_(pa.string())),
                        ],
                        names=["row_key", "doc_id", "n_words", "hits", "spans", "items"],
                    )
                    key += n

        return source.mapInArrow(run, schema)

    if passes == 1:
        return one(next(blocks)).withColumn("n_hit", F.size("hits").cast("long"))
    # A benchmark beyond the bound: hits of each bounded pass meet by row. Each pass is a job of its own, as row keys hold
    # the number of the task.
    parts = [cut(one(b)) for b in blocks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p.where(F.size("hits") > 0))
    out = cut(whole.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).withColumn("n_hit", F.size("hits").cast("long")))
    discard(*parts)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts and the hash of the comma-joined item ids."""
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _without(part: pa.RecordBatch, words: _text.Words, hit: np.ndarray, rows, at: int, counted: int | None, max_share: float) -> pa.RecordBatch:
    """A slice of documents without the hit words of ``rows``, and without those that are hit too much."""
    texts, keep = part.column(at).to_pylist(), np.ones(part.num_rows, dtype=bool)
    chars = part.column(counted).to_pylist() if counted is not None else None
    for i in rows:
        own = hit[words.first[i] : words.first[i + 1]]
        keep[i] = own.mean() < max_share
        raw = words.raw[words.offsets[i] : words.offsets[i + 1]]
        stay = np.ones(len(raw) + 1, dtype=np.int64)
        where = np.flatnonzero(own)
        for r in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
            a = words.start[words.first[i] + r[0]] - words.offsets[i]
            b = words.end[words.first[i] + r[-1]] - words.offsets[i]
            stay[a:b] = 0
        texts[i] = raw[stay[:-1] > 0].tobytes().decode("utf-8")
        if chars is not None:
            chars[i] = len(texts[i])
    part = part.set_column(at, part.schema.field(at).name, pa.array(texts, part.schema.field(at).type))
    if chars is not None:
        part = part.set_column(counted, part.schema.field(counted).name, pa.array(chars, part.schema.field(counted).type))
    return part.filter(pa.array(keep))


def clean(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Documents without their contaminated spans; those with at least ``max_share`` of their words hit go.

    All columns stay. ``n_chars``, where there is one, follows a changed text. The hits of all blocks of a large benchmark
    meet on the whole text before anything is cut or judged.
    """
    spark = docs.sparkSession
    passes, blocks = _blocks(benchmark, window, max_windows)
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    if passes == 1:
        shared = spark.sparkContext.broadcast(Lookup(next(blocks), window))

        def run(batches):
            for batch in batches:
                for low, high in _text.slices(batch.column(at)):
                    part = batch.slice(low, high - low)
                    words = _text.Words(part.column(at), _text.ALNUM)
                    hit, items = shared.value.scan(words)
                    if items:
                        part = _without(part, words, hit, items, at, counted, max_share)
                    if part.num_rows:
                        yield part

        return docs.mapInArrow(run, docs.schema)

    keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))

    def hits(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Lookup(block, window))

        def found(batches):
            for batch in batches:
                for low, high in _text.slices(batch.column(1)):
                    words = _text.Words(batch.column(1).slice(low, high - low), _text.ALNUM)
                    hit, items = shared.value.scan(words)
                    rows = sorted(items)
                    if rows:
                        own = [np.flatnonzero(hit[words.first[i] : words.first[i + 1]]).tolist() for i in rows]
                        yield pa.record_batch([batch.column(0).slice(low, high - low).take(pa.array(rows)), pa.array(own, pa.list_(pa.int64()))], names=["key", "hits"])

        out = cut(keyed.select("key", "row.text").mapInArrow(found, "key long, hits array<long>"))
        shared.destroy()
        return out

    parts = [hits(block) for block in blocks]
    every = reduce(DataFrame.union, parts)
    every = cut(every.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")))
    discard(*parts)

    def rid(batches):
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.column(1).flatten(), names=[f.name for f in batch.schema.field(1).type])
            for low, high in _text.slices(whole.column(at)):
                part, own = whole.slice(low, high - low), batch.column(0).slice(low, high - low).to_pylist()
                rows = [i for i, x in enumerate(own) if x]
                if rows:
                    words = _text.Words(part.column(at), _text.ALNUM)
                    hit = np.zeros(len(words.start), dtype=bool)
                    for i in rows:
                        hit[words.first[i] + np.array(own[i])] = True
                    part = _without(part, words, hit, rows, at, counted, max_share)
                if part.num_rows:
                    yield part

    return keyed.join(every, "key", "left").select("hits", "row").mapInArrow(rid, docs.schema)


def items_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
