"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding: A-Z lower-cased, zero-width characters dropped, Greek, Cyrillic and full-width look-alikes mapped to Latin, and
digits or signs that stand for letters replaced where they touch a letter. The lexicon is learnt from labelled training
rows: words, and stems (word beginnings) of ``STEMS`` letters, whose document frequencies differ between toxic and clean
rows. Near copies among the training rows count once, so one copied document cannot fill the lexicon. A word pair around a
lexicon entry that clean rows hold and toxic ones hardly do is an exception phrase, whose hits do not count. A document's
evidence is its hits' weights, in all and per word; two logistic coefficients fitted on the same rows make the score.

At most ``MAX_LABELLED`` labelled rows are used, those of least hash of their id; the lexicon's entries occur in several of
them, so their number is bounded too. Every text is scored whole.

Edge cases: null and empty texts have no hits and get the score of a clean text; without usable labels the built-in
lexicon and coefficients hold; repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import _text
from netquarry.llm._io import remainder

MAX_LABELLED, SKETCH = 12_000, 8
STEMS = (4, 5, 6)
LEAST_SHARE, LEAST_DOCS, LEAST_WEIGHT, LEAST_G2 = 0.005, 4, 2.5, 18.0

#: Entries that hold before any label is seen.
BUILT_IN = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "imbecile", "bastard")
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "rodeo clown", "sore loser board game")

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_LATIN = dict(zip("абвгеёзикмнопрстухуіјѕԁһαβεηικμνορτυχωɑɡ", "abbreeзukmhoпpctyxyijsdhabenikmvoptuxwag", strict=True)) | {"ο": "o", "а": "a", "ѵ": "v", "ո": "n", "с": "c", "р": "p", "е": "e", "х": "x", "у": "y", "ρ": "p"}
_ODD = re.compile("[­Ͱ-ԯԱ-֏ɐ-ʯ​-‏⁠﻿！-～]")


def _unmask(text: str) -> str:
    out = []
    for c in text:
        c = c.lower() if c > "\x7f" else c
        if c in "­​‌‍‎‏⁠﻿":
            continue
        out.append(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else _LATIN.get(c, c))
    return "".join(out)


_LEET_TABLE = np.arange(256, dtype=np.uint8)
for _k, _v in _LEET.items():
    _LEET_TABLE[ord(_k)] = ord(_v)
_IS_LEET = _LEET_TABLE != np.arange(256)
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def fold(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts and the bounds of each; words are runs of letters."""
    raw, offsets = _text.flat(column)
    # Only these lead bytes can begin a character that the tables below know.
    lead = np.isin(raw, np.array([0xC2, 0xC9, 0xCA, 0xCD, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xE2, 0xEF], dtype=np.uint8))
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(lead), side="right") - 1)
    if len(rows):
        texts = column.to_pylist()
        odd = [r for r in rows.tolist() if _ODD.search(texts[r] or "")]
        if odd:
            for r in odd:
                texts[r] = _unmask(texts[r])
            raw, offsets = _text.flat(pa.array(texts, pa.large_string()))
    low = _text.LOWER[raw]
    # Runs of masking digits and signs are replaced from their letters inwards, up to four in a row.
    open_ = _IS_LEET[low]
    if open_.any():
        for _ in range(4):
            letter = _LETTER[low]
            nxt, prev = np.append(letter[1:], False), np.append(False, letter[:-1])
            prev[offsets[:-1][offsets[:-1] < len(raw)]] = False
            ends = offsets[1:][offsets[1:] > 0] - 1
            nxt[ends] = False
            # A sign may also close a sentence, so it folds only before a letter; a digit folds on either side.
            turn = open_ & ~letter & (nxt | (prev & _IS_DIGIT[low]))
            if not turn.any():
                break
            low = np.where(turn, _LEET_TABLE[low], low)
    return low, offsets


class Lexicon:
    """Entries as bytes with weights; ``*`` at the end of an entry lets it begin a longer word."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, coefficients: tuple[float, float, float] = (-3.0, 1.5, 1.0)):
        self.weights, self.exceptions, self.coefficients = dict(weights), tuple(exceptions), coefficients
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                body = entry.removesuffix("*").encode().decode("latin-1")
                old = a.get(body, (len(body), 0.0, 0.0, False))
                a.add_word(body, (len(body), old[1] if entry.endswith("*") else w, w if entry.endswith("*") else old[2], False))
            for phrase in self.exceptions:
                body = phrase.encode().decode("latin-1")
                if body not in a:
                    a.add_word(body, (len(body), 0.0, 0.0, True))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: summed weight of its hits, number of hits, number of words."""
        low, offsets = fold(column)
        n = len(offsets) - 1
        letter = _LETTER[low]
        before = np.append(False, letter[:-1]) if len(low) else letter
        if len(low):
            before[offsets[:-1][offsets[:-1] < len(low)]] = False
        starts = np.flatnonzero(letter & ~before)
        words = np.diff(np.searchsorted(starts, offsets))
        mass, hits = np.zeros(n), np.zeros(n)
        if not len(self.weights) or not len(low):
            return mass, hits, words
        found = list(self.automaton.iter(low.tobytes().decode("latin-1")))
        if not found:
            return mass, hits, words
        last = np.array([e for e, _ in found]) + 1
        size = np.array([v[0] for _, v in found])
        whole, stem = np.array([v[1] for _, v in found]), np.array([v[2] for _, v in found])
        spared = np.array([v[3] for _, v in found])
        first = last - size
        row = np.searchsorted(offsets, first, side="right") - 1
        bounded = np.append(letter, False)
        left = ~bounded[first - 1] | (first == offsets[row])
        inside = last <= offsets[row + 1]
        right = ~bounded[last] | (last == offsets[row + 1])
        weight = np.where(right, np.maximum(whole, stem), stem)
        real = left & inside & ~spared & (weight > 0)
        shield = np.flatnonzero(left & right & inside & spared)
        if len(shield):
            cover = np.zeros(len(low) + 1, dtype=np.int64)
            np.add.at(cover, first[shield], 1)
            np.add.at(cover, last[shield], -1)
            real &= np.cumsum(cover)[first] == 0
        # Of entries that begin at the same word only the heaviest counts.
        pick = np.flatnonzero(real)
        pick = pick[np.lexsort((-weight[pick], first[pick]))]
        pick = pick[np.append(True, first[pick][1:] != first[pick][:-1])] if len(pick) else pick
        np.add.at(mass, row[pick], weight[pick])
        np.add.at(hits, row[pick], 1)
        return mass, hits, words

    def features(self, column: pa.Array) -> np.ndarray:
        mass, _, words = self.evidence(column)
        return np.stack([np.log1p(mass), np.log1p(100 * mass / np.maximum(words, 1))], axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        a, b, c = self.coefficients
        x = self.features(column)
        return 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 1])))


def _learnable(batches):
    """Training texts to (doc_id, label, sketch): a sketch equal among near copies, of ``SKETCH`` least three-word windows, or
    of the whole of a text with fewer words."""
    for batch in batches:
        for low, high in _text.slices(batch.column(2)):
            n = high - low
            words = _text.Words(batch.column(2).slice(low, n), _text.SPACED)
            at, value = words.windows(3)
            place = (np.arange(len(words.hash)) - words.first[words.owner]).astype(np.uint64)
            whole = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_text.mix(words.hash ^ _text.mix(place + np.uint64(1))))])
            sketch = np.zeros(n, dtype=np.uint64)
            for t in range(SKETCH):
                least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, words.owner[at], _text.mix(value ^ np.uint64(t)))
                sketch = _text.mix(sketch ^ least)
            sketch = np.where(words.counts < 3, _text.mix(whole[words.first[1:]] - whole[words.first[:-1]]), sketch)
            yield pa.record_batch([batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(sketch.view(np.int64)), batch.column(2).slice(low, n)], names=["doc_id", "label", "sketch", "text"])


def _terms(text: str) -> tuple[set[str], set[str]]:
    """Words and stems, and word pairs, of one folded text."""
    words = re.findall(r"[^\x00-`{-\x7f]+", text)
    out = set(words)
    for w in list(out):
        out.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return out, set(zip(words, words[1:]))


def _counted(batches):
    seen: dict[str, list[int]] = {}
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high in _text.slices(batch.column(1)):
            data, offsets = fold(batch.column(1).slice(low, high - low))
            for i in range(high - low):
                own = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")
                for t in _terms(own)[0]:
                    seen.setdefault(t, [0, 0])[labels[low + i]] += 1
    yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["term", "toxic", "clean"])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic coefficients by Newton steps with a small ridge; slopes are kept non-negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array([-2.0, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.05 * np.array([0, *w[1:]])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.05, 0.05])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.01)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold_of: int, held: int, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled training rows, those of least hash of their id."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold_of) != held))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, fold_of: int = 5, held: int = 0, limit: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from the labelled rows whose remainder modulo ``fold_of`` is not ``held``."""
    rows = labelled(docs, labels, "toxic", fold_of, held, limit)
    rows = rows.mapInArrow(_learnable, "doc_id long, label int, sketch long, text string").dropDuplicates(["label", "sketch"]).select("label", "text").persist()
    try:
        sizes = {int(k): n for k, n in rows.groupBy("label").count().collect()}
        p, n = sizes.get(1, 0), sizes.get(0, 0)
        if not p or not n:
            return Lexicon({w: 4.0 for w in BUILT_IN})
        terms = rows.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        weight = F.log((F.col("toxic") + 0.5) / (p + 1.0)) - F.log((F.col("clean") + 0.5) / (n + 1.0))
        # Log-likelihood ratio against an equal share in both classes: chance finds among many terms fall below it.
        both, share = F.col("toxic") + F.col("clean"), p / (p + n)
        ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
        best = terms.where(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * p)).withColumn("weight", weight).where((F.col("weight") >= LEAST_WEIGHT) & (ratio >= LEAST_G2))
        top = best.collect()
        weights = _thinned({r.term: (r.toxic, r.clean, r.weight) for r in top})
        lexicon = Lexicon({w: 4.0 for w in BUILT_IN if w not in weights} | weights)
        found = rows.mapInArrow(_contexts(lexicon), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        spared = found.where("clean >= 3 AND clean >= 10 * (toxic + 0.5)").orderBy("phrase").collect()
        lexicon = Lexicon(lexicon.weights, EXCEPTIONS + tuple(r.phrase for r in spared))
        shared = rows.mapInArrow(_featured(lexicon), "label int, a double, b double").toPandas()
        lexicon.coefficients = _fit(shared[["a", "b"]].to_numpy(), shared["label"].to_numpy().astype(float))
        return lexicon
    finally:
        rows.unpersist()


def _thinned(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Entries that say no more than a stem they begin with are left out."""
    out = {}
    for term in sorted(found, key=lambda t: (len(t.removesuffix("*")), t)):
        body = term.removesuffix("*")
        if not any(f"{body[:k]}*" in out and found[f"{body[:k]}*"][0] >= found[term][0] for k in STEMS if k <= len(body) and f"{body[:k]}*" != term):
            out[term] = float(found[term][2])
    return out


def _contexts(lexicon: Lexicon):
    """Word pairs around lexicon words, by label."""
    stems = {t.removesuffix("*") for t in lexicon.weights if t.endswith("*")}

    def entry(w: str) -> bool:
        return w in lexicon.weights or any(w[:k] in stems for k in STEMS)

    def run(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high in _text.slices(batch.column(1)):
                data, offsets = fold(batch.column(1).slice(low, high - low))
                for i in range(high - low):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")
                    for a, b in _terms(own)[1]:
                        if (entry(a) or entry(b)) and f"{a} {b}" in own:
                            seen.setdefault(f"{a} {b}", Counter())[int(labels[low + i])] += 1
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["phrase", "toxic", "clean"])

    return run


def _featured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            for low, high in _text.slices(batch.column(1)):
                x = lexicon.features(batch.column(1).slice(low, high - low))
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "a", "b"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, hits, words of every row."""

    def run(batches):
        for batch in batches:
            for low, high in _text.slices(batch.column(1)):
                text = batch.column(1).slice(low, high - low)
                _, hits, words = lexicon.evidence(text)
                s = lexicon.score(text)
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(hits.astype(np.int64)), pa.array(words.astype(np.int64))], names=["doc_id", "score", "predicted", "hits", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, hits long, words long")
