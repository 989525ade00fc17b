"""Sequence packing: an order-preserving dynamic programme over cut points at document and sentence ends.

The ids of consecutive documents (each closed by an end id) form a stream. With f(j) the least cost of a packing that
ends at cut point j, f(j) = cut(j) + min over i with p(j) - p(i) <= L of f(i) + L - (p(j) - p(i)). The inner minimum is a
sliding-window minimum of f(i) + p(i), kept in a monotone queue, so each point is pushed and popped once. A cut costs
nothing at a document's end, ``SENTENCE`` at a sentence's end and ``INSIDE`` elsewhere; points elsewhere are offered only
where sentences are longer than ``STRIDE``. Sequences are padded to L, except those whose length is a power of two: the
rest of a block may go out in such parts.

Blocks are runs of rows of one input partition, in their order, of at least ``BLOCK`` ids, so nothing is shuffled and
memory is bounded; the order of rows is kept. Edge cases: a null or empty text is its end id alone; texts of any length
are cut as often as needed; repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netquarry.llm import _text
from netquarry.llm._tokens import Subwords, vocabulary_path

LENGTH, END_ID = 4096, 2
SENTENCE, INSIDE, STRIDE = 4, 24, 32
BLOCK = 1 << 18
#: Bytes of text encoded at once: common words are looked up once each.
SLICE = 1 << 22
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padding long"


def sentence_ends(subwords: Subwords) -> np.ndarray:
    """Which ids close a sentence: runs of full stops, exclamation and question marks."""
    table = np.zeros(1 << 16, dtype=bool)
    for token, i in subwords.tokenizer.get_vocab().items():
        body = token.removesuffix("</w>")
        if body and not body.strip(".!?"):
            table[i] = True
    return table


def cut_points(ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, with their costs. ends: document ends; sentence: sentence ends."""
    points = np.union1d(ends, sentence)
    gaps = np.diff(np.append(0, points))
    wide = np.flatnonzero(gaps > STRIDE)
    if len(wide):
        n = (gaps[wide] - 1) // STRIDE
        inner = np.repeat(points[wide] - gaps[wide], n) + STRIDE * (_text.ragged(np.zeros(len(n), dtype=np.int64), n) + 1)
        points = np.union1d(points, inner)
    cost = np.full(len(points), INSIDE)
    cost[np.isin(points, sentence)] = SENTENCE
    cost[np.isin(points, ends)] = 0
    return points, cost


def powers(length: int) -> list[int]:
    """The binary parts of a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def plan(points: np.ndarray, cost: np.ndarray, limit: int = LENGTH) -> list[int]:
    """Sequence ends of a cheapest packing. The last point is the end of the stream."""
    total = int(points[-1])
    where, pen = [0, *points.tolist()], [0, *cost.tolist()]
    best, back = [0.0] * len(where), [0] * len(where)
    queue: deque[int] = deque([0])
    key = [0.0] * len(where)
    for j in range(1, len(where)):
        p = where[j]
        while where[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        best[j] = pen[j] + limit - p + key[i]
        back[j] = i
        key[j] = best[j] + p
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    # The rest after the last full sequence: padded, or in parts whose lengths are powers of two.
    least, last, parts = np.inf, 0, [total]
    for i in range(len(where) - 2, -1, -1):
        rest = total - where[i]
        if rest > limit:
            break
        split = powers(rest)
        padded = 0 if len(split) == 1 else limit - rest
        binary = INSIDE * (len(split) - 1)
        if best[i] + min(padded, binary) < least:
            least, last = best[i] + min(padded, binary), i
            parts = [total] if padded <= binary else (where[i] + np.cumsum(split)).tolist()
    out = []
    while last:
        out.append(where[last])
        last = back[last]
    return out[::-1] + parts


def pack_block(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, limit: int = LENGTH) -> dict[str, np.ndarray]:
    """The pieces of one block: document index, start, length, crc, sequence index, offset there."""
    inner = np.flatnonzero(is_end[ids]) + 1
    seq = np.array(plan(*cut_points(ends, inner), limit), dtype=np.int64)
    bounds = np.union1d(ends, seq)
    low, high = np.append(0, bounds[:-1]), bounds
    doc = np.searchsorted(ends, low, side="right")
    own = np.searchsorted(seq, low, side="right")
    wide = ids.astype("<u4")
    view = memoryview(wide).cast("B")
    crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)), dtype=np.int64, count=len(low))
    begin, first = np.append(0, ends[:-1]), np.append(0, seq[:-1])
    size = np.diff(np.append(0, seq))
    return {"doc": doc, "start": low - begin[doc], "length": high - low, "crc": crc, "tokens": (ends - begin)[doc], "seq": own, "offset": low - first[own], "size": size[own]}


def pack(docs: DataFrame, limit: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece; sequence ids are unique, pieces of a sequence lie gapless from offset 0."""
    path = path and vocabulary_path(path)

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        subwords = Subwords.shared(path)
        is_end = sentence_ends(subwords)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def flush():
            nonlocal sequence, size
            ids = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            ends = np.concatenate([x[1] + s for x, s in zip(held, shift, strict=True)])
            names = pa.concat_arrays([x[2] for x in held])
            got = pack_block(ids, ends, is_end, limit)
            whole = got["size"]
            square = (whole & (whole - 1)) == 0
            out = pa.record_batch(
                [names.take(pa.array(got["doc"])), *(pa.array(got[k].astype(np.int64)) for k in ("start", "length", "crc", "tokens")), pa.array(got["seq"] + sequence), pa.array(got["offset"]), pa.array(whole), pa.array(np.where(square, 0, limit - whole))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padding"],
            )
            sequence += int(got["seq"][-1]) + 1
            held.clear()
            size = 0
            return out

        for batch in batches:
            for low, high in _text.slices(batch.column(1), SLICE):
                ids, bounds = subwords.encode(batch.column(1).slice(low, high - low))
                n = high - low
                ends = bounds[1:] + np.arange(1, n + 1)
                closed = np.full(len(ids) + n, end_id, dtype=np.uint16)
                text = np.ones(len(closed), dtype=bool)
                text[ends - 1] = False
                closed[text] = ids
                held.append((closed, ends, batch.column(0).slice(low, n)))
                size += len(closed)
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, _SCHEMA)
