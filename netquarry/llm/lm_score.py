"""LM scoring: a causal self-attention model over subword ids, trained in numpy, with corpus-wide word counts.

Every text is encoded once; the ids are a table that all later passes read. The attention model reads a stream of ids in
windows of ``WINDOW`` that overlap by ``CONTEXT``; every id is scored once, in the window where it has that much context,
unless its text begins later. A mask keeps attention causal and inside one text; windows are scored in batches. One
attention layer with a residual, a hidden layer and a softmax over ``CLASSES`` id classes (k-means over the neighbours of
the ids) give p(class); p(id | class) comes from counts.

A text's score is the log10 probability of a mixture, word by word: the corpus count of the word; the attention model's
class of the word's first id times the word's share of that class; the attention model's spelling (the product over the
word's ids, times the chance that an id after a pre-token's end begins a word or not); a pointer to the words before it in
the same text. Word counts come from all training rows. The most common words, ``FREQUENT`` at most, are broadcast; the
occurrences of all others meet their counts in a shuffle join, so no word is dropped. Which words are common is counted over
all rows, those that train nothing included, so no key of that join is hot. Words are identified by a 64-bit hash.

The trained model reads every text once; what it gives each word, with the word's place among the common ones or its hash,
is a table that the mixture and the scores read. It takes the place of the table of ids in parts.

Id counts, word marks, neighbours and p(id | class) come from all training rows. So do the attention weights: every partition
trains them on all windows of all its texts, and the results are averaged by windows. Only where that pass starts from is
fitted on at most ``SAMPLE_DOCS`` training texts of least hash of their id (``SAMPLE_WINDOWS`` windows in all). The mixture's
weights are averaged alike, over expectation maximisation on all training texts of each partition, each word's own
occurrence taken out of its count. Edge cases: a null or empty text is its end token alone;
with no training rows all counts are 0 and the attention model is untrained (near uniform); repeated rows are scored each; a
null id is held in no fold (it trains); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import _text
from netquarry.llm._io import cut, discard, remainder, replaced
from netquarry.llm._tokens import Subwords, discharge, vocabulary_path

WINDOW, CONTEXT, DIM, HIDDEN, CLASSES = 64, 16, 16, 32, 64
FREQUENT, OWN_ROWS = 1 << 19, 4096
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 2000, 12_000, 3
#: Weights of word count, class and word, spelling and pointer without any text to fit them.
WEIGHTS = (0.3, 0.4, 0.25, 0.05)
END_ID, VOCABULARY = 2, 49_408
#: Neighbour columns on either side of an id: the commonest ids have their own, the others share by their number.
OWN_NEAR, NEAR = 32, 48
U = np.uint64
_NONE = -30.0  # log10 of a word without ids
_BLOCK = 1 << 13  # words of a block of expectation maximisation
_PART = 16  # windows of a training batch taken at a time
_BATCH, _MOST = 32, 3.3  # windows scored at a time; bound of a query's and a key's entries by table, so that no exponent overflows


def _joined(arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """One array of all values of ``arrays``, and views of it in their place."""
    flat, out, at = np.concatenate([w.reshape(-1) for w in arrays.values()]), {}, 0
    for k, w in arrays.items():
        out[k] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return flat, out


def _tanh(z: np.ndarray) -> None:
    """In place, by the exponential, which numpy has faster."""
    z *= 2
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide(-2, z, out=z)
    z += 1


class _Room:
    """The arrays of a training step, for batches of ``most`` windows of ``width`` ids at most; made once, as fresh memory costs
    as much as the sums in it."""

    def __init__(self, p: dict[str, np.ndarray], most: int, width: int):
        self.kind = p["e"].dtype.type
        self.flat, self.d = _joined({k: np.zeros_like(w) for k, w in p.items()})
        part = min(_PART, most)
        own = lambda *s: np.ones(s, dtype=self.kind)
        self.h, self.g, self.u, self.du = (own(part, width, k) for k in (DIM, DIM, 3 * DIM + 1, 3 * DIM))
        self.s, self.dg = own(part, width, DIM + 1), own(part, width, DIM + 1)
        self.a, self.da = own(part, width, width), own(part, width, width)
        self.z, self.dz, self.y = own(part * width, HIDDEN), own(part * width, HIDDEN), own(part * width, CLASSES)
        self.dh, self.ones = own(most * width, DIM), own(max(part * width, CLASSES))
        self.causal = np.tri(width, dtype=self.kind)


class Attention:
    """Parameters and numpy passes of the model; sizes are fixed."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.row = np.arange(VOCABULARY) % CLASSES  # id -> embedding row
        self.cls = np.arange(VOCABULARY) % CLASSES  # id -> class
        self.within = np.full(VOCABULARY, -np.log(VOCABULARY / CLASSES), dtype=np.float32)  # log p(id | class)
        self.starts = np.full(VOCABULARY, 0.5)
        self.begins = np.full(CLASSES, 0.5, dtype=np.float32)  # chance that an id of the class begins a word where it may
        f = lambda *s, k=1.0: rng.normal(0, k / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"e": f(OWN_ROWS + CLASSES, DIM, k=np.sqrt(OWN_ROWS + CLASSES) * 0.3), "s": f(WINDOW, DIM, k=np.sqrt(WINDOW) * 0.1), "q": f(DIM, DIM), "k": f(DIM, DIM), "v": f(DIM, DIM), "w1": f(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": f(HIDDEN, CLASSES), "b2": np.zeros(CLASSES, np.float32)}

    def forward(self, x: np.ndarray, text: np.ndarray, keep: bool = False):
        """Log class probabilities after each id of windows x (batch, WINDOW); text: which text each id belongs to."""
        p = self.p
        n = x.shape[1]
        h = p["e"][self.row[x]] + p["s"][:n]
        flat = h.reshape(-1, DIM)  # one product for all windows
        q, k, v = ((flat @ p[m]).reshape(h.shape) for m in "qkv")
        a = np.matmul(q * np.float32(DIM**-0.5), k.transpose(0, 2, 1))
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= np.tri(n, dtype=a.dtype)
        # Causality hides what pads a window's end; other texts in a window are masked.
        mixed = np.flatnonzero(((text[:, 1:] != text[:, :-1]) & (text[:, 1:] >= 0)).any(axis=1))
        a[mixed] *= text[mixed][:, :, None] == text[mixed][:, None, :]
        a[:, np.arange(n), np.arange(n)] += np.float32(1e-20)
        a *= 1 / np.matmul(a, np.ones((n, 1), dtype=a.dtype))
        g = np.matmul(a, v) + h
        z = g.reshape(-1, DIM) @ p["w1"]
        z += p["b1"]
        np.tanh(z, out=z)
        y = z @ p["w2"]
        y += p["b2"]
        y -= y.max(axis=1, keepdims=True)
        chance = np.exp(y)
        total = chance @ np.ones((CLASSES, 1), dtype=y.dtype)
        y -= np.log(total)
        z, y = z.reshape(*x.shape, -1), y.reshape(*x.shape, -1)
        return (y, (h, q, k, v, a, g, z, chance, total)) if keep else y

    def gradients(self, x, text, target, mask, room: _Room | None = None):
        """Mean loss over the masked positions and its gradients, summed over parts that a processor's cache holds."""
        p, n, width = self.p, max(1, mask.sum()), x.shape[1]
        room = room or _Room(p, len(x), width)
        scale, ones, d, loss = room.kind(DIM**-0.5), room.ones, room.d, 0.0
        room.flat[:] = 0
        project = np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1)
        back, projected = np.ascontiguousarray(project.T), np.zeros_like(project)
        large = np.abs(p["w2"]).sum(axis=0).max() + np.abs(p["b2"]).max() > 80
        rows, own = self.row.take(x), (mask / n).astype(room.kind)
        mixed = ((text[:, 1:] != text[:, :-1]) & (text[:, 1:] >= 0)).any(axis=1)
        for low in range(0, len(x), _PART):
            r = rows[low : low + _PART]
            w, size = len(r), r.size
            h, u, a, s, g, du, dg = (m[:w] for m in (room.h, room.u, room.a, room.s, room.g, room.du, room.dg))
            flat = lambda m: m.reshape(size, -1)  # noqa: E731, B023
            z, y, dz = room.z[:size], room.y[:size], room.dz[:size]
            np.take(p["e"], r, axis=0, out=h, mode="clip")
            h += p["s"][:width]
            np.matmul(flat(h), project, out=flat(u)[:, : 3 * DIM])
            q, k, v = u[:, :, :DIM], u[:, :, DIM : 2 * DIM], u[:, :, 2 * DIM :]  # the last column of v sums the weights
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            least = a.min()
            if a.max() > 60:
                np.minimum(a, 60, out=a)
            np.exp(a, out=a)
            a *= room.causal
            for i in np.flatnonzero(mixed[low : low + _PART]):
                a[i] *= text[low + i][:, None] == text[low + i][None, :]
            if least < -20:  # else it is lost in rounding
                np.einsum("bii->bi", a)[:] += room.kind(1e-20)
            np.matmul(a, v, out=s)
            inverse = 1 / s[:, :, DIM:]
            given = s[:, :, :DIM] * inverse
            np.add(given, h, out=g)
            np.matmul(flat(g), p["w1"], out=z)
            z += p["b1"]
            _tanh(z)
            np.matmul(z, p["w2"], out=y)
            y += p["b2"]
            if large:
                y -= y.max(axis=1, keepdims=True)
            at, mine = np.arange(size) * CLASSES + target[low : low + w].reshape(-1), own[low : low + w].reshape(-1)
            chosen = y.reshape(-1).take(at)
            np.exp(y, out=y)
            total = y @ ones[:CLASSES]
            loss -= ((chosen - np.log(total)) * mine).sum()
            y *= (mine / total)[:, None]
            y.reshape(-1)[at] -= mine
            d["w2"] += z.T @ y
            d["b2"] += ones[:size] @ y
            np.matmul(y, p["w2"].T, out=dz)
            z *= z
            np.subtract(1, z, out=z)
            dz *= z
            d["w1"] += flat(g).T @ dz
            d["b1"] += ones[:size] @ dz
            up = (dz @ p["w1"].T).reshape(h.shape)
            # The weights are not divided by their sums, what they are multiplied with is; the last column takes away the
            # weighted mean of a row, the gradient times what attention gave.
            np.multiply(up, inverse, out=dg[:, :, :DIM])
            given *= dg[:, :, :DIM]
            np.negative(flat(given) @ ones[:DIM], out=flat(dg)[:, DIM])
            np.matmul(a.transpose(0, 2, 1), dg[:, :, :DIM], out=du[:, :, 2 * DIM :])
            da = np.matmul(dg, v.transpose(0, 2, 1), out=room.da[:w])
            da *= a
            np.matmul(da, k, out=du[:, :, :DIM])
            np.matmul(da.transpose(0, 2, 1), q, out=du[:, :, DIM : 2 * DIM])
            projected += flat(h).T @ flat(du)
            np.matmul(flat(du), back, out=room.dh[low * width : low * width + size])
            room.dh[low * width : low * width + size] += flat(up)
        for i, m in enumerate("qkv"):
            d[m] += projected[:, i * DIM : (i + 1) * DIM]
        d["q"] *= scale
        dh = room.dh[: x.size]
        d["s"][:width] = dh.reshape(len(x), -1).sum(0).reshape(width, DIM)
        rows = rows.reshape(-1).astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        rows = rows.take(order)
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        d["e"][rows[begin]] = np.add.reduceat(dh.take(order, axis=0), begin, axis=0)
        return loss, d

    def count(self, counts: np.ndarray, free: np.ndarray, first: np.ndarray) -> None:
        """From counts of ids, of ids after a pre-token's end, and of those that begin a word: marks and embedding rows."""
        self.starts = (first + 0.5) / (free + 1.0)
        order = np.argsort(-counts, kind="stable")[:OWN_ROWS]
        self.row = OWN_ROWS + np.arange(VOCABULARY) % CLASSES
        self.row[order] = np.arange(OWN_ROWS)

    def classify(self, counts: np.ndarray, near: np.ndarray, free: np.ndarray, first: np.ndarray, rounds: int = 12) -> None:
        """Classes by k-means over the neighbour counts of the embedding rows' ids, p(id | class) and class marks."""
        order = np.argsort(-counts, kind="stable")[:OWN_ROWS]
        seen = order[counts[order] > 0]
        f = np.sqrt(near[: len(seen)])
        f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)
        if len(seen) >= CLASSES:
            centre = f[:CLASSES].copy()  # the most common ids
            for _ in range(rounds):
                own = np.argmax(f @ centre.T, axis=1)
                total = np.zeros_like(centre)
                np.add.at(total, own, f * np.sqrt(counts[seen])[:, None])
                centre = np.where(np.abs(total).sum(1, keepdims=True) > 0, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), centre)
            self.cls = np.arange(VOCABULARY) % CLASSES
            self.cls[seen] = own
        by = lambda w: np.bincount(self.cls, weights=w, minlength=CLASSES)
        smooth = counts + 0.1
        self.within = (np.log(smooth) - np.log(by(smooth)[self.cls])).astype(np.float32)
        self.begins = ((by(first) + 0.5) / (by(free) + 1.0)).astype(np.float32)

    def fit(self, x: np.ndarray, text: np.ndarray, epochs: int = EPOCHS, batch: int = 64, seed: int = 9, top: float = 0.01) -> None:
        """x, text: windows of WINDOW + 1 ids (text -1: padding)."""
        target, mask = self.cls[x[:, 1:]], (text[:, 1:] == text[:, :-1]) & (text[:, 1:] >= 0)
        rng, t, steps = np.random.default_rng(seed), 0, epochs * max(1, -(-len(x) // batch))
        # All weights are one array, so that a step is few operations.
        flat, self.p = _joined(self.p)
        m, v, root = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        room = _Room(self.p, min(batch, len(x)), WINDOW)
        for _ in range(epochs):
            for b in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
                self.gradients(x[b, :-1], text[b, :-1], target[b], mask[b], room)
                g = room.flat
                t += 1
                rate = top * (1 - 0.9 * t / steps)
                np.subtract(g, m, out=root)
                root *= np.float32(0.1)
                m += root
                g *= g
                g -= v
                g *= np.float32(0.01)
                v += g
                np.sqrt(v, out=root)
                root *= np.float32((1 - 0.99**t) ** -0.5)
                root += np.float32(1e-8)
                np.divide(m, root, out=root)
                root *= np.float32(rate / (1 - 0.9**t))
                flat -= root

    def tokens(self, stream: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every next id of a stream (the last position has none): log p(class), each scored once in overlapping windows,
        and what turns it into log p(class | a word begins)."""
        n, step, p = len(stream) - 1, WINDOW - CONTEXT, self.p
        if n <= 0:
            return np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.float32)
        m = -(-n // step)
        # The stream begins with CONTEXT ids of no text, so that all windows score their last ``step`` positions.
        x, own = np.full(m * step + CONTEXT, END_ID, dtype=np.int64), np.full(m * step + CONTEXT, -1, dtype=np.int64)
        x[CONTEXT : CONTEXT + n], own[CONTEXT : CONTEXT + n] = stream[:-1], text[:-1]
        cls = np.zeros(m * step, dtype=np.int64)
        cls[:n] = self.cls.take(stream[1:])
        place = np.arange(_BATCH * step) * CLASSES
        rows, at = self.row.take(x).reshape(-1), np.arange(m)[:, None] * step + np.arange(WINDOW)
        # Projections are linear: those of embeddings and positions are taken from tables.
        qk = np.concatenate([p["k"], p["q"] * np.float32(DIM**-0.5)], axis=1)
        tables = [np.concatenate([np.clip(t @ qk, -_MOST, _MOST), t @ p["v"], t], axis=1) for t in (p["e"], p["s"][:WINDOW])]
        shift, mask = np.exp(p["b2"]), np.tri(WINDOW, dtype=np.float32)[CONTEXT:]
        sums = np.stack([shift, shift * self.begins], axis=1)
        large = np.abs(p["w2"]).sum(axis=0).max() > 80
        h = np.empty((_BATCH, WINDOW, 4 * DIM), dtype=np.float32)
        keys, queries = np.empty((_BATCH, DIM, WINDOW), dtype=np.float32), np.empty((_BATCH, step, DIM), dtype=np.float32)
        values = np.ones((_BATCH, WINDOW, DIM + 1), dtype=np.float32)  # the last column sums the weights
        weights, seen = np.empty((_BATCH, step, WINDOW), dtype=np.float32), np.empty((_BATCH, step, DIM + 1), dtype=np.float32)
        hidden, y = np.empty((_BATCH * step, HIDDEN), dtype=np.float32), np.empty((_BATCH * step, CLASSES), dtype=np.float32)
        out, turn = np.empty(m * step, dtype=np.float32), np.empty(m * step, dtype=np.float32)
        for low in range(0, m, _BATCH):
            s = at[low : low + _BATCH]
            w = len(s)
            g = np.take(tables[0], rows[s], axis=0, out=h[:w], mode="clip")
            g += tables[1]
            keys[:w] = g[:, :, :DIM].transpose(0, 2, 1)
            queries[:w] = g[:, CONTEXT:, DIM : 2 * DIM]
            values[:w, :, :DIM] = g[:, :, 2 * DIM : 3 * DIM]
            a = np.matmul(queries[:w], keys[:w], out=weights[:w])
            np.exp(a, out=a)
            a *= mask
            label = own[s]
            mixed = np.flatnonzero((label[:, 1:] != label[:, :-1]).any(axis=1))
            if len(mixed):
                a[mixed] *= label[mixed][:, CONTEXT:, None] == label[mixed][:, None, :]
            v = np.matmul(a, values[:w], out=seen[:w])
            z = v[:, :, :DIM] / v[:, :, DIM:]
            z += g[:, CONTEXT:, 3 * DIM :]
            z = np.matmul(z.reshape(-1, DIM), p["w1"], out=hidden[: w * step])
            z += p["b1"]
            np.tanh(z, out=z)
            c = np.matmul(z, p["w2"], out=y[: w * step])
            if large:
                c -= c.max(axis=1, keepdims=True)
            span = slice(low * step, (low + w) * step)
            mine = c.reshape(-1).take(place[: w * step] + cls[span])
            np.exp(c, out=c)
            total = np.log(c @ sums)
            out[span], turn[span] = mine - total[:, 0], total[:, 0] - total[:, 1]
        out += p["b2"][cls]
        turn += np.log(self.begins)[cls]
        return out[:n], turn[:n]


def _word_counts(batches):
    """Counts of word hashes over a partition's texts, of all and of training rows, merged in bounded steps."""
    held, size = [], 0

    def merged():
        names, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return names, *(np.bincount(at, weights=np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2))

    def given(names, every, own):
        return pa.record_batch([pa.array(names.view(np.int64)), pa.array(every), pa.array(own)], names=["word", "every", "n"])

    for batch in batches:
        trains = batch.column(1).to_numpy(zero_copy_only=False)
        for low, high in _text.slices(batch.column(0)):
            words = _text.Words(batch.column(0).slice(low, high - low), _text.SPACED)
            own = np.repeat(trains[low:high], words.counts)
            for mask, weight in ((own, 1), (~own, 0)):
                names, count = np.unique(words.hash[mask], return_counts=True)
                held.append((names, count, count * weight))
                size += len(names)
            if size > 4_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield given(*held[0])
                    held, size = [], 0
    if held:
        yield given(*merged())


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the rows of ``values`` between ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a column made by ``_binary``."""
    raw, bounds = _text.flat(column.cast(pa.large_binary()).view(pa.large_string()))
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype=dtype), bounds // size


def _encoded(path: str | None):
    """(doc_id, trains, text) with the ids of the text and the number of ids of each word."""

    def run(batches):
        subwords = Subwords.shared(path)
        for batch in batches:
            for low, high in _text.slices(batch.column(2), 1 << 22):  # a chunk is looked up once a slice
                part = batch.slice(low, high - low)
                ids, sizes, bounds = subwords.words(part.column(2))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.record_batch([*part.columns, _binary(ids.astype(np.uint16), ends[bounds]), _binary(sizes.astype(np.int32), bounds)], names=["doc_id", "trains", "text", "ids", "sizes"])

    return run


def encode(docs: DataFrame, trains=None, path: str | None = None) -> DataFrame:
    """A table of (doc_id, trains, text, ids, sizes): every text is encoded here, once."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(True) if trains is None else trains).alias("trains"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(given.mapInArrow(_encoded(path), "doc_id long, trains boolean, text string, ids binary, sizes binary"))


def _streams(batches, at: int = 0, limit: int = 1 << 20):
    """Per slice of rows with ids and sizes in columns ``at`` and after: batch, first row, the stream of ids (an end id before
    and after each text), word begins, bounds."""
    for batch in batches:
        for low, high in _text.slices(batch.column(at).cast(pa.large_binary()).view(pa.large_string()), limit):
            ids, cuts = _numbers(batch.column(at).slice(low, high - low), np.uint16)
            sizes, _ = _numbers(batch.column(at + 1).slice(low, high - low), np.int32)
            first = np.zeros(len(ids), dtype=bool)
            ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            first[ends[:-1][sizes > 0]] = True
            heads = cuts + 2 * np.arange(len(cuts))  # two end ids a text
            x, f = np.full(heads[-1], END_ID, dtype=np.int64), np.ones(heads[-1], dtype=bool)
            body = np.ones(len(x), dtype=bool)
            body[heads[:-1]] = body[heads[1:] - 1] = False
            x[body], f[body] = ids, first
            yield batch, low, x, f, heads


def _id_counts(finals: np.ndarray):
    """(id, n, free, first, word): a partition's counts of ids, of those that may begin a word, of these that do, of all that do."""

    def run(batches):
        discharge()
        total = np.zeros((4, VOCABULARY), dtype=np.int64)
        for _, _, x, f, heads in _streams(batches):
            inner = np.ones(len(x), dtype=bool)
            inner[heads[:-1]] = False
            free = np.zeros(len(x), dtype=bool)
            free[1:] = inner[1:] & (finals[x[:-1]] | (x[:-1] == END_ID))
            for i, own in enumerate((inner, free, free & f, inner & f)):
                total[i] += np.bincount(x[own], minlength=VOCABULARY)
        seen = np.flatnonzero(total[0])
        if len(seen):
            yield pa.record_batch([pa.array(seen), *(pa.array(t[seen]) for t in total)], names=["id", "n", "free", "first", "word"])

    return run


def _neighbours(row: np.ndarray):
    """(key, n): a partition's counts of neighbours before and after the ids with an embedding; key: row and column."""

    def run(batches):
        column = np.where(row < OWN_NEAR, row, OWN_NEAR + np.arange(VOCABULARY) % (NEAR - OWN_NEAR))
        total = np.zeros(OWN_ROWS * 2 * NEAR, dtype=np.int64)
        for _, _, x, _, heads in _streams(batches):
            pair = np.ones(len(x), dtype=bool)
            pair[heads[1:] - 1] = False
            a, b = x[:-1][pair[:-1]], x[1:][pair[:-1]]
            for off, own, other in ((0, b, a), (NEAR, a, b)):
                key = row[own] * (2 * NEAR) + off + column[other]
                total += np.bincount(key[row[own] < OWN_ROWS], minlength=len(total))
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["key", "n"])

    return run


def _spread(begin: np.ndarray, n: int) -> np.ndarray:
    return begin[np.unique(np.linspace(0, len(begin) - 1, min(n, len(begin))).astype(int))]


def _sampled(each: int):
    """Windows of WINDOW + 1 ids of sample texts: at most ``each`` from a text, spread over the whole of it."""

    def run(batches):
        for batch, low, x, _, heads in _streams(batches, 1):
            out = []
            for i, (a, b) in enumerate(zip(heads[:-1], heads[1:], strict=True)):
                for s in _spread(np.arange(0, max(b - a - 1, 1), WINDOW), each):
                    out.append((batch.column(0)[low + i].as_py(), int(s), x[a + s : min(a + s + WINDOW + 1, b)].tolist()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "at", "ids"])

    return run


def _windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, text = np.full((len(ids), WINDOW + 1), END_ID, dtype=np.int64), np.full((len(ids), WINDOW + 1), -1, dtype=np.int64)
    for i, a in enumerate(ids):
        x[i, : len(a)], text[i, : len(a)] = a, 0
    return x, text


#: Averages over partitions are sums of whole numbers, so their order does not matter.
_FINE = float(1 << 24)


def _averaged(names: np.ndarray, values: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names), pa.array(np.full(len(names), n)), pa.array(np.rint(values * n * _FINE).astype(np.int64))], names=["key", "n", "v"])


def _average(rows: DataFrame, size: int) -> np.ndarray | None:
    got = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    if not len(got):
        return None
    out = np.zeros(size)
    out[got.column("key").to_numpy()] = got.column("v").to_numpy() / _FINE / got.column("n").to_numpy()
    return out


def _further(shared, held: int = 4096):
    """A partition's weights after its windows, times their number; windows are trained as they come."""

    def run(batches):
        from copy import copy

        discharge()
        model, n, waiting = copy(shared.value), 0, []
        model.p = dict(model.p)

        def learn():
            model.fit(*_windows(waiting), epochs=1, top=0.002)
            waiting.clear()

        for _, _, x, _, heads in _streams(batches):
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                for s in range(0, max(b - a - 1, 1), WINDOW):
                    waiting.append(x[a + s : min(a + s + WINDOW + 1, b)])
                    n += 1
                    if len(waiting) >= held:
                        learn()
        if waiting:
            learn()
        if n:
            flat = np.concatenate([w.reshape(-1) for w in model.p.values()]).astype(np.float64)
            yield _averaged(np.arange(len(flat)), flat, n)

    return run


def train(rows: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> tuple[Attention, np.ndarray]:
    """The attention model of encoded training ``rows`` (statistics and weights of all; the weights start from a sample), and the
    number of words that begin with each id."""
    spark = rows.sparkSession
    texts = rows.select("ids", "sizes")
    model, total = Attention(), np.zeros((4, VOCABULARY), dtype=np.int64)
    names = ("n", "free", "first", "word")
    seen = texts.mapInArrow(_id_counts(Subwords.shared(path).finals()), "id long, n long, free long, first long, word long").groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    if not len(seen):
        return model, total[3]
    for i, c in enumerate(names):
        total[i][seen.column("id").to_numpy()] = seen.column(c).to_numpy()
    counts = total[0].astype(np.float64)
    model.count(counts, total[1], total[2])
    got = texts.mapInArrow(_neighbours(model.row), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    near = np.zeros(OWN_ROWS * 2 * NEAR)
    near[got.column("key").to_numpy()] = got.column("n").to_numpy()
    model.classify(counts, near.reshape(OWN_ROWS, -1), total[1], total[2])
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    each = max(1, 4 * sample_windows // max(sample_docs, 1))
    windows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "ids", "sizes").mapInArrow(_sampled(each), "doc_id long, at long, ids array<long>")
    got = windows.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(sample_windows).select("ids").toArrow()
    if len(got):
        model.fit(*_windows(list(got.column("ids").to_numpy())))
    shared = spark.sparkContext.broadcast(model)
    flat = _average(texts.mapInArrow(_further(shared), "key long, n long, v long"), sum(w.size for w in model.p.values()))
    if flat is not None:
        at = 0
        for k, w in model.p.items():
            model.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
    shared.destroy()
    return model, total[3]


class Scorer:
    """What the executors share: the model, the common words and the mixture."""

    def __init__(self, model: Attention, words: np.ndarray, counts: np.ndarray, total: int, ends: int, begun: np.ndarray, finals: np.ndarray):
        order = np.argsort(words)
        self.model, self.words, self.counts = model, words[order], counts[order].astype(np.float64)
        self.total, self.ends, self.finals, self.weights = max(total, 1), ends, finals, WEIGHTS
        # Words of each class of first ids; the end is one.
        self.classed = np.maximum(np.bincount(model.cls, weights=begun, minlength=CLASSES), 1)

    def predicted(self, ids: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of each text and its end: the factor of a class share and the log10 of the spelling; the texts' bounds."""
        x, cuts = _numbers(ids, np.uint16)
        sizes, bounds = _numbers(sizes, np.int32)
        x, sizes, n = x.astype(np.int64), sizes.astype(np.int64), len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # Inside a pre-token the next id continues it for certain; after its end it may begin a word.
        free = np.append(False, self.finals[x[:-1]]) if len(x) else np.zeros(0, dtype=bool)
        mark = np.where(free, np.log10(1 - self.model.starts)[x], 0.0)
        head = ends[:-1][sizes > 0]
        mark[head] = np.log10(self.model.starts)[x[head]]
        # The stream: an end id before each text, then its ids; the next text's end id closes it.
        heads = cuts + np.arange(n + 1)
        stream = np.full(len(x) + n + 1, END_ID, dtype=np.int64)
        body = np.ones(len(stream), dtype=bool)
        body[heads] = False
        stream[body] = x
        label = np.append(np.repeat(np.arange(n), np.diff(cuts) + 1), n)
        logp, turn = self.model.tokens(stream, label)
        # Position t predicts stream[t + 1]: the ids of a word are predicted from one place before them.
        spell = (logp + self.model.within[stream[1:]]) / np.log(10)
        inner = np.zeros(len(spell))
        inner[np.flatnonzero(body[1:])] = mark
        total = np.concatenate([[0], np.cumsum(spell + inner)])
        place = ends[:-1] + owner
        begin = lambda t: np.exp((logp + turn)[t].astype(np.float64)) / self.classed[self.model.cls[stream[1:][t]]]
        full, last = sizes > 0, heads[1:] - 1
        factor = np.zeros(len(sizes))
        factor[full] = begin(place[full])
        spelled = np.where(full, np.maximum(total[place + sizes] - total[place], -300), _NONE)
        bounds = bounds + np.arange(n + 1)
        closes = np.zeros(bounds[-1], dtype=bool)
        closes[bounds[1:] - 1] = True
        out = np.empty((2, len(closes)), dtype=np.float32)
        out[:, ~closes] = factor, spelled
        out[:, closes] = begin(last), np.maximum(spell[last], -300)
        return out[0], out[1], bounds

    def noted(self, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of the words of each text: the place among the common ones (-1: not common) and how often it occurred earlier in its
        text; the hashes of those that are not common. With these no later pass reads the text."""
        text = _text.Words(column, _text.SPACED)
        names, at = np.unique(text.hash, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.words, names), max(len(self.words) - 1, 0))
        slot = (np.where(self.words[slot] == names, slot, -1) if len(self.words) else np.full(len(names), -1))[at]
        key = text.owner * max(len(names), 1) + at
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        run = np.flatnonzero(new)
        earlier = np.zeros(len(order), dtype=np.int32)
        earlier[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
        rare = np.flatnonzero(slot < 0)
        return _binary(slot.astype(np.int32), text.first), _binary(earlier, text.first), _binary(text.hash[rare], np.searchsorted(rare, text.first))

    def parts(self, slots: pa.Array, earlier: pa.Array, rare: pa.Array, factors: pa.Array, spellings: pa.Array) -> dict[str, np.ndarray]:
        """Per word: count (-1: not common), its class share's factor, spelling, pointer share, words before it; the bounds of the
        texts; the end's factor and spelling of each text; hashes of the words that are not common."""
        factor, ends = _numbers(factors, np.float32)
        factor, spelled = factor.astype(np.float64), 10.0 ** _numbers(spellings, np.float32)[0].astype(np.float64)
        closes = np.zeros(len(factor), dtype=bool)
        closes[ends[1:] - 1] = True
        slot, bounds = _numbers(slots, np.int32)
        assert len(slot) == len(closes) - len(slots)
        count = np.where(slot >= 0, self.counts[slot], -1.0) if len(self.words) else np.full(len(slot), -1.0)
        before = np.arange(len(slot)) - np.repeat(bounds[:-1], np.diff(bounds))
        pointer = _numbers(earlier, np.int32)[0] / np.maximum(before, 1)
        return {"count": count, "factor": factor[~closes], "spelled": spelled[~closes], "pointer": pointer, "before": before, "bounds": bounds, "end_factor": factor[closes], "end_spelled": spelled[closes], "rare": _numbers(rare, U)[0]}

    def mixture(self, columns, rounds: int = 30) -> tuple[np.ndarray, int]:
        """Expectation maximisation of the mixture's weights; the texts are training rows, so each count is less one."""
        x = []
        for c in columns:
            p = self.parts(*c)
            count = np.maximum(p["count"] - 1, 0)
            x.append(np.stack([count / self.total, p["factor"] * count, p["spelled"], p["pointer"]]))
        # In blocks that a processor's cache holds.
        n, x = sum(b.shape[1] for b in x), [np.ascontiguousarray(b[:, low : low + _BLOCK]) for b in x for low in range(0, b.shape[1], _BLOCK)]
        w = np.array(WEIGHTS)
        for _ in range(rounds if n else 0):
            w = w * sum(b @ (1 / np.maximum(w @ b, 1e-300)) for b in x) / n
        w = np.maximum(w / max(w.sum(), 1e-300), 1e-3)
        return w / w.sum(), n

    def rows(self, column: pa.Array, ids: pa.Array, sizes: pa.Array) -> dict:
        factors, spellings, bounds = self.predicted(ids, sizes)
        return self.scored(*self.noted(column), _binary(factors, bounds), _binary(spellings, bounds))

    def scored(self, *columns: pa.Array) -> dict:
        p = self.parts(*columns)
        bounds, count = p["bounds"], p["count"]
        by_count, by_class, by_spelling, by_pointer = self.weights
        weight = np.where(p["before"] > 0, by_pointer, 0.0)  # the first word has nothing to point to
        rest = by_spelling * p["spelled"] + weight * p["pointer"]
        share = (by_count + by_pointer - weight) / self.total + by_class * p["factor"]
        common = count >= 0
        word = np.where(common, np.log10(np.maximum(share * np.maximum(count, 0) + rest, 1e-300)), 0.0)
        base = np.where(common, np.log10(np.maximum(count, 0) + 0.5), 0.0)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])
        end = np.log10(((by_count + by_pointer) / self.total + by_class * p["end_factor"]) * self.ends + by_spelling * p["end_spelled"])
        rare = np.flatnonzero(~common)
        return {"n_tokens": np.diff(bounds) + 1, "n_common": sums(common & (count > 0)).astype(np.int64), "base": sums(base), "score": sums(word) + end, "rare": (np.searchsorted(rare, bounds), p["rare"].view(np.int64), np.log10(np.maximum(rest[rare], 1e-300)), share[rare])}


#: What the mixture and the scores read of each text.
_NOTED = ("slots", "earlier", "rare", "factors", "spellings")


def _predicted(shared):
    """(doc_id, trains) with what is noted of the words and what the attention model gives each word and the end."""

    def run(batches):
        discharge()
        for batch in batches:
            for low, high in _text.slices(batch.column(2), 1 << 19):
                part = batch.slice(low, high - low)
                factors, spellings, bounds = shared.value.predicted(part.column(3), part.column(4))
                yield pa.record_batch([*part.columns[:2], *shared.value.noted(part.column(2)), _binary(factors, bounds), _binary(spellings, bounds)], names=["doc_id", "trains", *_NOTED])

    return run


def _cuts(column: pa.Array):
    """Row ranges of bounded size by a column made by ``_binary``."""
    return _text.slices(column.cast(pa.large_binary()).view(pa.large_string()), 1 << 18)


def _mixed(shared):
    """A partition's mixture weights from its texts."""

    def run(batches):
        discharge()
        held, size = [], 0

        def fitted():
            w, n = shared.value.mixture([h.columns for h in held])
            held.clear()
            return [_averaged(np.arange(len(w)), w, n)] if n else []

        # A batch may be large, so its slices are counted, not batches.
        for batch in batches:
            for low, high in _cuts(batch.column(0)):
                held.append(batch.slice(low, high - low))
                size += int(pa.compute.sum(pa.compute.binary_length(held[-1].column(0))).as_py() or 0)
                if size > 1 << 20:
                    yield from fitted()
                    size = 0
        if held:
            yield from fitted()

    return run


def _common(counts: DataFrame, most: int) -> DataFrame:
    """The words of the greatest counts over all rows, at most ``most``: whole count classes from the top, by a histogram of
    their logs."""
    cls = F.floor(F.log(F.col("every").cast("double")) * 100)
    total, least = 0, None
    for r in sorted(counts.groupBy(cls.alias("c")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.c):
        total += r.k
        if total > most:
            break
        least = r.c
    return counts.where(cls >= least) if least is not None else counts.limit(0)


def score(docs: DataFrame, fold_of: int = 5, held: int = 1, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; rows of the held fold train nothing."""
    spark = docs.sparkSession
    path = path and vocabulary_path(path)
    trains = F.coalesce(remainder(F.col("doc_id"), fold_of) != held, F.lit(True))
    coded = encode(docs, trains, path)
    counts = cut(coded.select("text", "trains").mapInArrow(_word_counts, "word long, every long, n long").groupBy("word").agg(F.sum("every").alias("every"), F.sum("n").alias("n")))
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    own = coded.where("trains")
    ends = own.count()
    total, distinct = int(stats[0]) + ends, int(stats[1]) + bool(ends)
    top = _common(counts, frequent).select("word", "n").toArrow()
    model, begun = train(own, path)
    scorer = Scorer(model, top.column("word").to_numpy().view(U), top.column("n").to_numpy(), total, ends, begun, Subwords.shared(path).finals())
    del top
    first = spark.sparkContext.broadcast(scorer)
    # The model's passes over all texts are one: the mixture and the scores read what it gave. That takes the place of the
    # encoded texts part by part, so that the disk never holds both.
    schema = "doc_id long, trains boolean, " + ", ".join(f"{c} binary" for c in _NOTED)
    tables = replaced(coded, lambda part: part.select("doc_id", "trains", "text", "ids", "sizes").mapInArrow(_predicted(first), schema))
    given = reduce(DataFrame.unionAll, tables)
    weights = _average(given.where("trains").select(*_NOTED).mapInArrow(_mixed(first), "key long, n long, v long"), len(WEIGHTS))
    first.destroy()
    if weights is not None:
        scorer.weights = tuple(float(w) for w in weights)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        from pyspark import TaskContext

        discharge()
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for low, high in _cuts(batch.column(1)):
                n = high - low
                got = shared.value.scored(*(c.slice(low, n) for c in batch.columns[1:]))
                at, word, rest, share = got["rare"]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (word, rest, share)]
                yield pa.record_batch([pa.array(np.arange(key, key + n)), batch.column(0).slice(low, n), pa.array(got["n_tokens"].astype(np.int64)), pa.array(got["n_common"]), pa.array(got["base"]), pa.array(got["score"]), *lists], names=["row_key", "doc_id", "n_tokens", "n_common", "base", "score", "words", "rests", "shares"])
                key += n

    schema = "row_key long, doc_id long, n_tokens long, n_common long, base double, score double, words array<long>, rests array<double>, shares array<double>"
    rows = cut(given.select("doc_id", *_NOTED).mapInArrow(run, schema))
    shared.destroy()
    discard(*tables)
    rare = rows.select("row_key", F.explode(F.arrays_zip("words", "rests", "shares")).alias("x")).select("row_key", F.col("x.words").alias("word"), F.col("x.rests").alias("rest"), F.col("x.shares").alias("share"))
    # A word that occurs often in any rows never gets here, so no key of this join is hot.
    known = rare.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = known.groupBy("row_key").agg(
        F.sum(F.log10(F.col("n") + 0.5)).alias("rare_base"), F.sum((F.col("n") > 0).cast("long")).alias("rare_known"),
        F.sum(F.log10(F.col("share") * F.col("n") + F.pow(F.lit(10.0), "rest"))).alias("rare_score"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # With the logarithms in front: n_tokens may be large.
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    return rows.drop("words", "rests", "shares").join(sums, "row_key", "left").select(
        "doc_id", "n_tokens", (F.col("n_common") + zero("rare_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"),
    )
