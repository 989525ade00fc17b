"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing: every word key has a sparse ternary index vector drawn from its hash. A key is a word's form (letters,
case pattern, outer marks and length class) or the event that a word repeats one of the two before it. A context vector sums
the index vectors of the forms in a window of two on either side over the training sample, so forms used alike lie close.
A document's vector joins the mean index vector of its forms, the mean context vector of its hashed words and the shares of
its repetition events. A network of one hidden tanh layer trained in numpy turns it into a logit; a temperature fitted on
rows kept out of training calibrates the probability.

At most ``MAX_LABELLED`` labelled rows train, those of least hash of their id; tables are of fixed size. Every text is
scored whole. Edge cases: null and empty texts have a vector of zeros and a score of their own; without usable labels the
score is 1 (nothing is rejected); repeated rows are scored each; an empty table gives no rows; extra columns are ignored by
``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import _text
from netquarry.llm.toxicity import labelled

MAX_LABELLED, THRESHOLD = 8_000, 0.7
DIM, FORMS, BUCKETS, HIDDEN = 32, 1 << 12, 1 << 14, 24
U = np.uint64


def index_vectors(n: int, dim: int = DIM, nonzero: int = 6, seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, one for each key, drawn from a hash of the key."""
    key = np.arange(n, dtype=U) * U(64) + U(seed) * U(1 << 40)
    out = np.zeros((n, dim), dtype=np.float32)
    for j in range(nonzero):
        h = _text.mix(key + U(j + 1))
        out[np.arange(n), (h % U(dim)).astype(np.int64)] += np.where((h >> U(32)) & U(1), 1, -1)
    return out / np.float32(np.sqrt(nonzero))


_CLASS = np.full(256, 5, dtype=np.uint8)  # other marks
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 3
_CLASS[[0x2E, 0x2C]] = 4


def forms(words: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form key, hashed word key and repetition flags of each word."""
    raw, s, e = words.raw, words.start, words.end
    if not len(s):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.float32)
    kind = _CLASS[raw]
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    marks = np.concatenate([[0], np.cumsum(kind >= 4)])
    length = np.minimum(np.log2(e - s + 1).astype(np.int64), 5)
    share = lambda c: np.minimum(3 * (c[e] - c[s]) // np.maximum(e - s, 1), 2)
    last, prior = raw[e - 1].astype(np.int64), raw[np.maximum(e - 2, s)].astype(np.int64)
    edge = np.where(kind[e - 1] >= 4, last * 256 + np.where(kind[np.maximum(e - 2, s)] >= 4, prior, 0), 0)
    code = (((kind[s].astype(np.int64) * 8 + length) * 4 + share(upper)) * 4 + share(marks)) * 65536 + edge
    form = (_text.mix(code.astype(U)) % U(FORMS)).astype(np.int64)
    word = (words.hash % U(BUCKETS)).astype(np.int64)
    position = np.arange(len(s)) - words.first[words.owner]
    same = np.zeros((len(s), 2), dtype=np.float32)
    for k in (1, 2):
        same[k:, k - 1] = (words.hash[k:] == words.hash[:-k]) & (position[k:] >= k)
    return form, word, same


class Classifier:
    """Tables and network; plain numpy arrays of fixed size."""

    def __init__(self):
        self.index = index_vectors(FORMS)
        self.context = np.zeros((BUCKETS, DIM), dtype=np.float32)
        self.net: dict[str, np.ndarray] | None = None
        self.temperature = 1.0

    def pooled(self, column: pa.Array) -> np.ndarray:
        """The document vectors of one column slice."""
        words = _text.Words(column, _text.SPACED)
        form, word, same = forms(words)
        n = len(words.counts)
        rows = [self.index[form], self.context[word], same]
        out = np.zeros((n, 2 * DIM + 2), dtype=np.float32)
        full = np.flatnonzero(words.counts)
        if len(full):
            out[full] = np.concatenate([np.add.reduceat(r, words.first[full], axis=0) for r in rows], axis=1) / words.counts[full, None]
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.net
        z = (x - w["mean"]) / w["scale"]
        return (np.tanh(z @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"])[:, 0]

    def probability(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.ones(len(column))
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pooled(column)).astype(np.float64) / self.temperature, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60) -> None:
        """Adam on cross-entropy over four fifths of the rows; the temperature comes from the last fifth."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
        w = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "b2": np.zeros(1)}
        m, v, t = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
        z = (x - mean) / scale
        for _ in range(epochs):
            for b in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                h = np.tanh(z[b] @ w["w1"] + w["b1"])
                p = 1 / (1 + np.exp(-np.clip((h @ w["w2"] + w["b2"])[:, 0], -30, 30)))
                d = ((p - y[b]) / len(b))[:, None]
                dh = d @ w["w2"].T * (1 - h * h)
                g = {"w2": h.T @ d, "b2": d.sum(0), "w1": z[b].T @ dh, "b1": dh.sum(0)}
                t += 1
                for k in w:
                    step = g[k] + 1e-4 * w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * step, 0.999 * v[k] + 0.001 * step**2
                    w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.net = {k: a.astype(np.float32) for k, a in (w | {"mean": mean, "scale": scale}).items()}
        logit, target = self.logit(x[held].astype(np.float32)).astype(np.float64), y[held]
        if len(held):
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, logit / g) - target * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def _contexts(batches):
    """Summed context vectors of hashed words over a partition's texts, in whole numbers (the scale falls out later)."""
    index, total = np.sign(index_vectors(FORMS)), np.zeros((BUCKETS, DIM))
    for batch in batches:
        for low, high in _text.slices(batch.column(2)):
            words = _text.Words(batch.column(2).slice(low, high - low), _text.SPACED)
            form, word, _ = forms(words)
            owner = words.owner
            around = np.zeros((len(form), DIM), dtype=np.float32)
            for k in (1, 2):
                near = (owner[k:] == owner[:-k])[:, None]
                around[k:] += index[form[:-k]] * near
                around[:-k] += index[form[k:]] * near
            np.add.at(total, word, around)
    used = np.flatnonzero(np.abs(total).sum(1))
    yield pa.record_batch([pa.array(used), *(pa.array(total[used, i].astype(np.int64)) for i in range(DIM))], names=["bucket", *(f"v{i}" for i in range(DIM))])


def learn(docs: DataFrame, labels: DataFrame, fold_of: int = 4, held: int = 2, limit: int = MAX_LABELLED) -> Classifier:
    """A classifier from the labelled rows whose remainder modulo ``fold_of`` is not ``held``. The driver gets one row for each
    hashed word (``BUCKETS``) and one vector for each training row."""
    rows = labelled(docs, labels, "quality", fold_of, held, limit).persist()
    model = Classifier()
    try:
        names = [f"v{i}" for i in range(DIM)]
        sums = rows.mapInArrow(_contexts, "bucket long, " + ", ".join(f"{v} long" for v in names)).groupBy("bucket").agg(*[F.sum(v).alias(v) for v in names]).toArrow()
        if len(sums):
            model.context[sums.column("bucket").to_numpy()] = np.stack([sums.column(v).to_numpy() for v in names], axis=1)
        del sums
        model.context /= np.maximum(np.linalg.norm(model.context, axis=1, keepdims=True), 1e-6)

        def run(batches):
            for batch in batches:
                for low, high in _text.slices(batch.column(2)):
                    x = model.pooled(batch.column(2).slice(low, high - low))
                    yield pa.record_batch([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

        seen = rows.mapInArrow(run, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    finally:
        rows.unpersist()
    label = seen.column("label").to_numpy()
    if len(set(label.tolist())) == 2:
        model.train(np.frombuffer(b"".join(seen.column("x").to_pylist()), dtype=np.float32).reshape(len(seen), -1), label.astype(np.float64))
    return model


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for low, high in _text.slices(batch.column(1)):
                p = shared.value.probability(batch.column(1).slice(low, high - low))
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for low, high in _text.slices(batch.column(at)):
                part = batch.slice(low, high - low)
                yield part.filter(pa.array(shared.value.probability(part.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
