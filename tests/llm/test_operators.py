"""Edge cases, brute force, round trips and held-out accuracy of the corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import _text, chat, decontam, embed_dedup, html_extract, lm_score, minhash, packing, pii, quality, toxicity
from netquarry.llm._tokens import Subwords

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "  \n", "one", "word " * 3000, "ünïcödé — ¿qué? 日本語", "a\x0bb\tc"]


def docs(spark, texts, start=0):
    """Documents with an extra column whose names clash with the operators' own."""
    rows = [(start + i, t, f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, row_key int")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.9)) % vocabulary}" for _ in range(n))


# --- text kernels ----------------------------------------------------------------------------------------------------


def test_words_match_their_patterns():
    texts = [t or "" for t in ODD] + ["A-b_c9 Ä1", "x" * 10]
    for rule, pattern in ((_text.SPACED, r"[^\x20\x09-\x0D]+"), (_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = _text.Words(pa.array(texts), rule)
        for i, t in enumerate(texts):
            assert [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])] == re.findall(pattern, t.translate(LOW))
    w = _text.Words(pa.array(["Abc abc", "abc"]), _text.SPACED)
    assert len(set(w.hash.tolist())) == 1 and int(w.hash[0]) == _text.hash_word(b"abc")
    assert len(_text.windows(w.hash, w.first, 2)[0]) == 1


# --- 1: packing ------------------------------------------------------------------------------------------------------


def test_subwords_equal_the_tokenizer():
    s = Subwords.shared()
    texts = [t or "" for t in ODD] + ["don't STOP l's 3rd—day… É İ ẖH̱ <|endoftext|>x", "naïve,café! ﬁ Straße ΣΑΣ", "we'RE 're ''s", "ée É, ́x ŉ ſ Ĳ", "İ_ Yİ' İ, É_ &&& ¡a! a<| (x) ª.", "a\x1cb \x85c a b"]
    want = s.tokenizer.encode_batch(texts, add_special_tokens=False)
    ids, bounds = s.encode(pa.array(texts))
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == want[i].ids for i in range(len(texts)))


def test_a_full_chunk_cache_changes_no_ids(monkeypatch):
    from netquarry.llm import _tokens

    monkeypatch.setattr(_tokens, "CACHED", 60)
    rng = random.Random(2)
    s = Subwords(_tokens.vocabulary_path())
    for _ in range(30):
        texts = [prose(rng, 40, 500) + ", ünï-cödé " + str(rng.randrange(10**9)) for _ in range(4)]
        ids, bounds = s.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in s.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(s.index) < 400


def test_packing_places_every_id_once(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 900)) + "." for _ in range(60)), "same text", "same text"]
    rows = packing.pack(docs(spark, texts).coalesce(1), limit=512).toPandas()
    s = Subwords.shared()
    for d, own in rows.sort_values("start").groupby("doc_id"):
        ids = [*s.tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.append(0, own["length"].cumsum()[:-1]).tolist() and own["length"].sum() <= 512
    one = rows.drop_duplicates("sequence_id")
    assert one["padding"].sum() < 0.03 * rows["length"].sum()
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_is_optimal_on_small_cases():
    rng = np.random.default_rng(2)
    for _ in range(60):
        points = np.unique(rng.integers(1, 60, size=12))
        points = np.append(points[np.diff(np.append(0, points)) > 0], 60)
        if np.diff(np.append(0, points)).max() > 16:
            continue
        cost = rng.integers(0, 8, size=len(points))

        def price(end):
            total, prev = 0, 0
            for e in end:
                total += (16 - (e - prev)) + (cost[np.searchsorted(points, e)] if e != 60 else 0)
                prev = e
            return total

        best = math.inf
        for mask in range(1 << (len(points) - 1)):
            ends = [int(p) for k, p in enumerate(points[:-1]) if mask >> k & 1] + [60]
            if max(np.diff([0, *ends])) <= 16:
                best = min(best, price(ends))
        got = packing.plan(points, cost, 16)
        assert max(np.diff([0, *got])) <= 16 and got[-1] == 60
        if set(got) <= set(points.tolist()):
            last = len(bin(got[-1] - (got[-2] if len(got) > 1 else 0))) and price(got)
            assert last <= best + 16


# --- 2: near-dedup ---------------------------------------------------------------------------------------------------


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(texts):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if all_ and both >= 0.8 * all_:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(texts))}


def near_copies(rng, n):
    base = [prose(rng, 150, 4000).split() for _ in range(3)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("part, likely", [(1024, minhash.LIKELY), (4, 0.0)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, part, likely):
    monkeypatch.setattr(minhash, "PART", part)  # 4: parts, tiles and salts come into play
    rng = random.Random(3)
    texts = [*ODD, "", "one", "word " * 3000, *near_copies(rng, 60), *(prose(rng, 80, 9000) for _ in range(40))] + ["the same words once more " * 4] * (3 * part % 1000)
    got = {r.doc_id: r for r in minhash.classes(docs(spark, texts), likely=likely).collect()}
    want = brute_classes(texts)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    if part == 4:
        return
    kept = minhash.keep_one(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "score", "row_key"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert minhash.classes(docs(spark, [])).count() == 0


def test_every_asking_text_meets_every_member_of_its_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 2)  # 40 texts: 20 parts, far beyond a chunk of 8 * PART rows
    sig, bands = b"s" * minhash.LONG, list(range(minhash.BANDS))
    rows = spark.createDataFrame([(bands[0], 40, r, 100, bytearray(sig), bands) for r in range(40)], "key long, n long, rep long, total long, sig binary, bands array<long>")
    for linked in ([], [(r, 0) for r in range(25)]):
        parts = spark.createDataFrame(linked, "node long, component long")
        of = dict(linked)
        found = minhash._crossing(rows, parts, 0.8, 1 << 40, 40, minhash.LIKELY).collect()
        assert {(r.hub, r.doc) for r in found} == {(a, b) for b in range(40) for a in range(b) if of.get(a, a) != of.get(b, b)}
        assert not any(r.more for r in found)


def test_signatures_estimate_weighted_jaccard():
    a, b = "a b c d e " * 40 + "f g h i j " * 10, "a b c d e " * 30 + "f g h i j " * 20
    w = _text.Words(pa.array([a, b]), _text.SPACED)
    row, value, weight = minhash.bags(w)
    sig = minhash.signatures(row, value, weight, 2, 2048)
    x, y = bag(a), bag(b)
    assert abs((sig[0] == sig[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.05


# --- 3, 6: classifiers -----------------------------------------------------------------------------------------------


def test_toxicity_learns_and_unmasks(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, 60).split()
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorgle", "blemish" + rng.choice("abc"), "kratz"])
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (10**6, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, texts), lab)
    extra = ["you z0rgle", "you zоrgle kratz KRATZ", "the trash can", None, "", "w1 w2 " * 4000]
    out = {r.doc_id: r for r in toxicity.score(docs(spark, texts + extra), model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert [out[600 + k].predicted for k in range(6)] == [1, 1, 0, 0, 0, 0]
    assert toxicity.learn(docs(spark, []), lab.limit(0)).weights and toxicity.score(docs(spark, []), model).count() == 0


def test_short_and_unlike_training_texts_count_each(spark):
    rng = random.Random(21)
    texts = [f"word{i} other{i}" for i in range(200)] + ["one two three " + prose(rng, 60, 10**6) for _ in range(100)]
    near = " ".join(prose(rng, 200, 10**6).split())
    batch = pa.record_batch([pa.array(range(len(texts) + 3)), pa.array([0] * (len(texts) + 3), pa.int32()), pa.array([*texts, near, near, "word1 other1"])], names=["doc_id", "label", "text"])
    sketch = next(iter(toxicity._learnable([batch]))).column(2).to_pylist()
    assert len(set(sketch)) == len(texts) + 1 and sketch[-3] == sketch[-2] and sketch[-1] == sketch[1]


def test_repeated_training_rows_and_ties(spark):
    texts = ["you zorgle " + " ".join(f"a{i}" for i in range(k, k + 20)) for k in range(30)] + [" ".join(f"b{i}" for i in range(k, k + 20)) for k in range(90)]
    lab = spark.createDataFrame([(i, int(i >= 30), int(i < 30)) for i in range(120)] * 2, "doc_id long, quality int, toxic int")
    twice = docs(spark, texts).union(docs(spark, texts)).repartition(5)
    for op, threshold in ((toxicity, 0.5), (quality, 0.7)):
        out = op.score(twice, op.learn(twice, lab)).groupBy("doc_id").agg({"score": "max", "doc_id": "count"}).collect()
        assert all(r["count(doc_id)"] == 2 for r in out) and len(out) == 120
        right = sum((r["max(score)"] >= threshold) == (r.doc_id < 30 if op is toxicity else r.doc_id >= 30) for r in out)
        assert right >= 114


def test_exceptions_shield_hits():
    lex = toxicity.Lexicon({"trash": 4.0, "lowe*": 4.0}, ("trash can",))
    mass, hits, words = lex.evidence(pa.array(["a trash can", "trash talk", "lowest flower", "tr4sh!", "", "x"]))
    assert hits.tolist() == [0, 1, 1, 1, 0, 0] and words.tolist() == [3, 2, 2, 1, 0, 1]


def test_quality_learns(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(500):
        w, bad = prose(rng, 50).split(), rng.random() < 0.3
        texts.append(" ".join([w[0]] * 50 if bad and i % 2 else [x.upper() + "!!" for x in w] if bad else w))
        labels.append((i, int(not bad), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs(spark, texts), lab)
    out = {r.doc_id: r for r in quality.score(docs(spark, texts + [None, ""]), model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held) and 0 <= out[500].score == out[501].score <= 1
    good = quality.keep_good(docs(spark, texts), model)
    assert good.columns == ["doc_id", "text", "score", "row_key"] and good.count() == sum(out[i].predicted for i in range(500))
    untrained = quality.learn(docs(spark, texts), lab.limit(0))
    assert quality.keep_good(docs(spark, texts), untrained).count() == 500


# --- 4: embeddings ---------------------------------------------------------------------------------------------------


def vectors(rng, monkey=True):
    base = rng.normal(size=(400, 16))
    near = np.concatenate([base[k] + 0.08 * rng.normal(size=(n, 16)) for k, n in ((0, 40), (1, 5), (2, 2))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:20], 3 * base[20:30]]))]
    return rows + [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [float("inf")] + [1.0] * 15)]


@pytest.mark.parametrize("whole", [2048, 16])
def test_links_equal_brute_force(spark, whole, monkeypatch):
    monkeypatch.setattr(embed_dedup, "WHOLE", whole)  # 16: the path of large components
    rows = vectors(np.random.default_rng(6))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, dim int")
    linked = embed_dedup.link(df)
    got = {r.vec_id: r for r in linked.collect()}
    ok = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else np.float32(c) for c in v], dtype=np.float64) if v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and np.abs(x).sum():
            ok[i] = x / np.linalg.norm(x)
    near = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9} for i in ok}
    hits = sum(got[i].n_links for i in near)
    assert all(got[i].n_links <= len(near[i]) for i in near) and hits >= 0.99 * sum(map(len, near.values()))
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9008)) and got[9007].component_id == 9006
    assert embed_dedup.audit(df, linked, every=1) >= 0.99
    assert embed_dedup.link(df.limit(0)).count() == 0


def test_dense_groups_with_nearer_neighbours_of_their_own_are_linked(spark):
    rng = np.random.default_rng(13)
    centre, side, far = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    tilt = np.arccos(0.95)
    # Inside a group 0.97 or so, between neighbouring groups 0.92, between the outer two 0.78; the last group is apart.
    middles = [np.cos(k * tilt) * centre + np.sin(k * tilt) * side for k in range(3)] + [far]
    rows = np.concatenate([m + 0.175 / 8 * rng.normal(size=(30, 64)) for m in middles] + [rng.normal(size=(200, 64))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    nearest = np.argsort(-(unit @ unit.T), axis=1)[:90, 1:9] // 30
    assert (nearest == np.arange(90)[:, None] // 30).all() and hit[:30, 30:60].mean() > 0.9 and not hit[:30, 60:90].any()
    got = {r.vec_id: r for r in embed_dedup.link(df).collect()}
    assert [got[i].n_links for i in range(len(rows))] == (hit.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(120)] == [0] * 90 + [90] * 30


# --- 5: LM scoring ---------------------------------------------------------------------------------------------------


def test_attention_gradients():
    model = lm_score.Attention()
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    rng = np.random.default_rng(7)
    x, text = rng.integers(0, 50, (2, 6)), np.array([[0, 0, 0, 1, 1, 1], [0] * 6])
    target, mask = rng.integers(0, lm_score.CLASSES, (2, 6)), rng.random((2, 6)) < 0.7
    _, d = model.gradients(x, text, target, mask)
    for k in ("q", "k", "v", "w1", "w2", "s", "e"):
        at = (int(model.row[x[0, 0]]), 1) if k == "e" else (0, 1)
        old, eps = model.p[k][at], 1e-5
        model.p[k][at] = old + eps
        up = model.gradients(x, text, target, mask)[0]
        model.p[k][at] = old - eps
        down = model.gradients(x, text, target, mask)[0]
        model.p[k][at] = old
        assert abs((up - down) / (2 * eps) - d[k][at]) < 1e-4


def brute_tokens(model, stream, text):
    """Log class chances of every next id and of a word's begin, window by window."""
    step, out = lm_score.WINDOW - lm_score.CONTEXT, []
    for t in range(len(stream) - 1):
        low = t // step * step - lm_score.CONTEXT
        at = [i for i in range(low, t + 1)]
        x = np.array([[stream[i] if i >= 0 else lm_score.END_ID for i in at]])
        y = model.forward(x, np.array([[text[i] if i >= 0 else -1 for i in at]]))[0, -1]
        k = model.cls[stream[t + 1]]
        out.append((y[k], np.log(model.begins[k] / (np.exp(y) * model.begins).sum())))
    return np.array(out).T


def noisy(seed):
    model, rng = lm_score.Attention(), np.random.default_rng(seed)
    model.begins = rng.uniform(0.1, 0.9, lm_score.CLASSES).astype(np.float32)
    model.starts = rng.uniform(0.1, 0.9, lm_score.VOCABULARY)
    model.p["b2"] = rng.normal(0, 0.3, lm_score.CLASSES).astype(np.float32)
    return model, rng


def test_attention_is_causal_and_scores_each_token_once():
    model, rng = noisy(8)
    stream = rng.integers(0, 500, 300)
    text = np.repeat([0, 1, 2], 100)
    whole = model.tokens(stream, text)
    assert [len(w) for w in whole] == [299, 299]
    changed = stream.copy()
    changed[150:] = 7
    assert np.allclose(model.tokens(changed, text)[0][:149], whole[0][:149], atol=1e-5)
    assert np.allclose(whole, brute_tokens(model, stream, text), atol=1e-4)
    y = model.forward(np.stack([stream[:32], stream[90:122]]), np.stack([text[:32], text[90:122]]))
    assert np.allclose(np.exp(y).sum(axis=2), 1, atol=1e-4)


def test_lm_scores_equal_brute_force():
    model, rng = noisy(10)
    random_ = random.Random(3)
    texts = ["", "one", "Two, two two? two", "ünïcödé — x" * 3, *(prose(random_, 70, 60) for _ in range(3))]
    s = Subwords.shared()
    finals = s.finals()
    known = Counter(w for t in texts for w in t.translate(LOW).split())
    names = sorted(known)[::2]  # the others are no common words
    hashes = np.array([_text.hash_word(w.encode()) for w in names], dtype=np.uint64)
    begun = rng.integers(1, 50, lm_score.VOCABULARY)
    scorer = lm_score.Scorer(model, hashes, np.array([known[w] for w in names]), 1000, len(texts), begun, finals)
    coded = list(lm_score._encoded(None)([pa.record_batch([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts)], names=["doc_id", "trains", "text"])]))
    got = scorer.rows(*(pa.concat_arrays([c.column(i) for c in coded]) for i in (2, 3, 4)))
    words = [t.translate(LOW).split() for t in texts]
    ids = [[s.tokenizer.encode(w, add_special_tokens=False).ids for w in ws] for ws in words]
    stream = [lm_score.END_ID]
    label = []
    for i, text in enumerate(ids):
        stream += [x for w in text for x in w] + [lm_score.END_ID]
        label += [i] * (sum(map(len, text)) + 1)
    logp, turn = brute_tokens(model, np.array(stream), np.array([*label, len(ids)]))
    a, b, c, d = scorer.weights
    at = 0
    for i, text in enumerate(ids):
        score = 0.0
        rare = []
        for j, w in enumerate(text):
            n = known[words[i][j]] if words[i][j] in names else 0
            spell = 0.0
            for k, x in enumerate(w):
                mark = np.log(model.starts[x]) if k == 0 else np.log(1 - model.starts[x]) if finals[w[k - 1]] else 0
                spell += logp[at + k] + model.within[x] + mark
            factor = np.exp(logp[at] + turn[at]) / begun[model.cls == model.cls[w[0]]].sum()
            pointer = words[i][:j].count(words[i][j]) / max(j, 1)
            share = (a if j else a + d) / 1000 + b * factor
            rest = c * np.exp(spell) + d * pointer
            if words[i][j] in names:
                score += math.log10(share * n + rest)
            else:
                rare.append((math.log10(rest), share))
            at += len(w)
        k = model.cls[lm_score.END_ID]
        factor = np.exp(logp[at] + turn[at]) / begun[model.cls == k].sum()
        score += math.log10(((a + d) / 1000 + b * factor) * len(texts) + c * np.exp(logp[at] + model.within[lm_score.END_ID]))
        at += 1
        cuts, _, rests, shares = got["rare"]
        assert got["score"][i] == pytest.approx(score, rel=1e-3)
        assert np.allclose(np.stack([rests, shares], axis=1)[cuts[i] : cuts[i + 1]], np.array(rare).reshape(-1, 2), rtol=1e-3)


def test_lm_base_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [*ODD, *(prose(rng, rng.randrange(5, 120), 3000) for _ in range(120))]
    out = {r.doc_id: r for r in lm_score.score(docs(spark, texts), frequent=50).collect()}
    tok = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in enumerate(tok):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        r = out[i]
        assert r.base_score == pytest.approx(base, rel=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(t) + 1, sum(c[w] > 0 for w in t) + 1, n)
        assert math.isfinite(r.score) and r.score < 0
    assert lm_score.score(docs(spark, [])).count() == 0


def test_lm_learns_from_all_training_rows(spark):
    rng = random.Random(14)
    texts = [prose(rng, 40, 300) for _ in range(60)] + ["zebra crossing quixotic ünïcödé " * 30] * 3
    s = Subwords.shared()
    ids = [[*s.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    counts = np.bincount(np.concatenate(ids), minlength=lm_score.VOCABULARY)
    train = lambda d, **k: lm_score.train(lm_score.encode(d), **k)[0]
    model, begun = lm_score.train(lm_score.encode(docs(spark, texts)), sample_docs=3, sample_windows=10)
    total = np.bincount(model.cls, weights=counts + 0.1, minlength=lm_score.CLASSES)
    assert np.allclose(model.within, np.log(counts + 0.1) - np.log(total[model.cls]), atol=1e-5)
    assert begun.sum() == sum(len(t.split()) + 1 for t in texts)
    assert all(model.row[i] < lm_score.OWN_ROWS for i in np.flatnonzero(counts))
    other = train(docs(spark, [t if i % 2 else " ".join(reversed(t.split())) for i, t in enumerate(texts)]).union(docs(spark, texts, 100)), sample_docs=0)
    still = train(docs(spark, texts).union(docs(spark, texts, 100)), sample_docs=0)
    assert any(not np.allclose(other.p[k], still.p[k]) for k in other.p) and all(np.isfinite(v).all() for v in other.p.values())


def test_lm_trains_on_every_window_of_every_text():
    from types import SimpleNamespace

    rng = random.Random(15)
    texts = [prose(rng, 3000, 3100), "", prose(rng, 40, 60)]

    def trained(own):
        coded = list(lm_score._encoded(None)([pa.record_batch([pa.array(range(len(own))), pa.array([True] * len(own)), pa.array(own)], names=["doc_id", "trains", "text"])]))
        ends = [len(x) // 2 + 1 for b in coded for x in b.column(3).to_pylist()]
        (got,) = lm_score._further(SimpleNamespace(value=lm_score.Attention()))(b.select(["ids", "sizes"]) for b in coded)
        return ends, got.column("n")[0].as_py(), got.column("v").to_numpy()

    ends, n, first = trained(texts)
    assert ends[0] > 32 * lm_score.WINDOW and n == sum(max(1, -(-k // lm_score.WINDOW)) for k in ends)
    words = texts[0].split()
    k = len(words) // 3
    assert not np.array_equal(first, trained([" ".join([*words[:k], words[k + 1], words[k], *words[k + 2 :]]), *texts[1:]])[2])


# --- 7: HTML ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<!-- c --><div class="ad">Buy {k}</div><div class="cookie-notice">Cookies {k}</div><{tag}><h1>Title {k}</h1><p><b>First</b> line&nbsp;of {k} &amp; more<br>next<p>Second   <i>par</i>agraph {k}.
<form><input name=q>Search {k}</form></{tag}><aside>Side {k}</aside><div id="comments"><p>Reader {k}</p></div><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_extraction(spark, tag):
    pages = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(k=k, tag=tag)) for k in range(30)]
    pages += [(100, None, None), (101, "http://h0.example/x", ""), (102, "nonsense", "plain &lt; text"), (103, "http://h0.example/y", PAGE.format(k=5, tag=tag)), (104, "http://h9.example/z", PAGE.format(k=1, tag=tag)[:420])]
    rows = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")).collect()}
    for k in (*range(30), 103):
        j = 5 if k == 103 else k
        assert rows[k].text == f"Title {j} First line of {j} & more next Second paragraph {j}." and rows[k].n_chars == len(rows[k].text)
    assert rows[100].text == rows[101].text == "" and rows[102].text == "plain < text" and len(rows) == 35


def test_constant_slots_become_template():
    page = "<html><body><div>Welcome to the site</div><div class=x>{}</div><div>All rights reserved</div></body></html>"
    got = html_extract.extract([page.format(f"story {k}") for k in range(8)])
    assert got == [f"story {k}" for k in range(8)]
    assert html_extract.extract([page.format("same")] * 3) == ["Welcome to the site same All rights reserved"] * 3


def test_slots_decide_without_names(monkeypatch):
    for names in ("_MARKS", "_WEAK", "_DROPPED"):
        monkeypatch.setattr(html_extract, names, frozenset())
    page = "<html><body><div class=t>The Daily</div><ul><li><a href=/>Home</a><li><a href=/x>{1}</a></ul><div><h1>Story {0}</h1><p>Text {0} of <a href=/y>the</a> day.</div><div class=b>Read more every day</div></body></html>"
    assert html_extract.extract([page.format(k, "abc"[k % 3]) for k in range(9)]) == [f"Story {k} Text {k} of the day." for k in range(9)]


def test_content_with_weak_names_stays():
    page = "<article><h1>T {0}</h1><div class=search-results>Found {0}</div><p class=notice>Notice {0}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math>.</p><div class=related-links><a>All</a> <a>more {0}</a></div><p class=share-price>{0} euro</p></article>"
    assert html_extract.extract([page.format(k) for k in range(8)]) == [f"T {k} Found {k} Let x={k}. {k} euro" for k in range(8)]


def test_deep_pages_are_extracted():
    deep = "<div>" * 5000 + "deep {0}" + "</div>" * 5000
    got = html_extract.extract([f"<html><body><main>{deep.format(k)}</main></body></html>" for k in range(6)])
    assert got == [f"deep {k}" for k in range(6)]


def test_matching_is_greatest():
    rng = random.Random(5)

    def tree(depth):
        return (rng.choice("ab"), ""), [], [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    def slot(t):
        s = html_extract.Slot(t[0])
        s.children = [slot(c) for c in t[2]]
        return s

    def brute(a, b):
        if a.label != b[0]:
            return 0

        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), (brute(x[0], y[0]) + best(x[1:], y[1:])) if x[0].label == y[0][0] else 0)

        return 1 + best(a.children, b[2])

    for _ in range(200):
        a, b = slot(tree(3)), tree(3)
        if a.label == b[0]:
            size, pairs = html_extract.match(a, b, {})
            assert size == brute(a, b) == 1 + sum(brute(a.children[i], b[2][j]) for i, j in pairs) and pairs == sorted(pairs)


# --- 8: chat ---------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["hi", None, "", "<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| < |", "line\nline", "é日"]
    rows = [(c, t, r, texts[(c + t) % len(texts)], 0) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, 0, "assistant", "x", 0), (50, 0, None, "y", 0), (51, 0, "ro\\le\n", "z", 0), (51, 0, "ro\\le\n", "z", 0), (None, 1, "user", "q", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    formatted = chat.format_turns(df)
    out = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0], x[1] if x[1] else "", x[2]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert out[c].n_turns == len(own) and out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    assert out[0].valid and not out[50].valid and not out[51].valid
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "")


# --- 9: decontamination ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [decontam.MAX_WINDOWS, 200])
def test_decontamination_equals_brute_force(spark, bound):
    rng = random.Random(10)
    items = [(k, prose(rng, n, 3000).replace(" ", ", ")) for k, n in enumerate([3, 1, 10, 25, 14, 12])] + [(90, None), (91, "--"), (92, "w1")]
    texts = [*ODD]
    for _ in range(60):
        w = prose(rng, 60, 9000).split()
        if rng.random() < 0.5:
            at = rng.randrange(40)
            part = items[rng.choice([0, 2, 3, 4, 5])][1].upper().split()
            w[at:at] = part[: rng.choice([9, 10, 14, 30])]
        texts.append(" ".join(w))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    out = {r.doc_id: r for r in decontam.scan(docs(spark, texts), bench, max_windows=bound).collect()}
    for i, t in enumerate(texts):
        w, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for k, x in items:
            own = word.findall((x or "").translate(LOW))
            n = min(10, len(own))
            for a in range(len(own) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add(k)
        assert (out[i].n_words, out[i].n_hit, out[i]["items"]) == (len(w), len(hit), sorted(map(str, found)))
    clean = {r.doc_id: r.text for r in decontam.clean(docs(spark, texts), bench, max_windows=bound).collect()}
    again = decontam.scan(docs(spark, [clean.get(i) for i in range(len(texts))]), bench.where("item_id <> 92 AND item_id <> 1")).where("n_hit > 10").count()
    assert again == 0 and all(clean[i] == t for i, t in enumerate(texts) if not out[i].n_hit)
    assert decontam.report(docs(spark, []), bench).count() == 0 and decontam.report(docs(spark, ["a"]), bench.limit(0)).first().n_items == 0


def test_cleaning_does_not_depend_on_the_size_of_the_benchmark(spark):
    w = [f"b{k}" for k in range(100)]
    a, b, c = w[:30], w[24:36], w[50:80]
    texts = [None, "plain text", " ".join(["x"] * 40 + w[:36] + ["y"] * 40), " ".join(["x"] * 20 + a + ["y"] * 20 + c), " ".join(["x"] * 80 + c + ["y"] * 80)]
    texts = texts * 2
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((a, b, c))], "item_id long, text string")
    rows = docs(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    size = sum(len(" ".join(x)) for x in (a, b, c))
    bound = next(size // n + 1 for n in range(3, 40) if sum(map(bool, decontam._blocks(bench, 10, size // n + 1)[1])) == 3)
    one, many = (sorted(decontam.clean(rows, bench, max_windows=m).collect(), key=lambda r: r.doc_id) for m in (decontam.MAX_WINDOWS, bound))
    assert one == many and [r.doc_id for r in many] == [0, 1, 2, 4, 5, 6, 7, 9]
    assert many[2].text.split() == ["x"] * 40 + ["y"] * 40 and many[3].text.split() == ["x"] * 80 + ["y"] * 80 and all(r.text is None or r.n_chars == len(r.text) for r in many)


# --- 10: personal data -----------------------------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_brute_force(spark):
    fixed = ["a@b.c_x@d.e é@f.gh a.b@c", "1.2.3.4.5.6.7.8 999.1.1.1 00012.3.4.5", "4111 1111-1111 1111 41111111111111111111111 4111--1111", "+1 (988) 555-2485, +49 30 1 +123456789012345678", "😀 x@y.zz 日本 10.0.0.1", "9" * 5000 + " a@b." + "c" * 3000]
    rng = random.Random(11)
    noise = ["".join(rng.choice("ab@.+-_ 0123456789()") for _ in range(200)) for _ in range(80)]
    texts = [*ODD, *fixed, *noise, *(f"say password={rng.getrandbits(64):016x} now" for _ in range(6)), "no deadbeefcafe1234 here"]
    out = {r.doc_id: r for r in pii.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and out[i].spans.split(",")[: len(want)] == (want or [""])[: len(want)]
        assert out[i].n_email == sum(x.startswith("email") for x in want) and out[i].n_card == sum(x.startswith("card") for x in want)
    assert all("id:" in out[i].spans for i, t in enumerate(texts) if (t or "").startswith("say password"))
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[texts.index(fixed[4])] == "😀 [EMAIL] 日本 [IP]" and all(clean[i] == (t or "") for i, t in enumerate(texts) if not out[i].spans)
    assert pii.report(docs(spark, [])).count() == 0


def test_whole_values_after_seeds_are_found(spark):
    values = ["123-45-6789", "hunter", "X1234567", "550e8400-e29b-41d4-a716-446655440000", "sk_live_4eC39HqLyjWDarjt", "QWxhZGRpbjpvcGVuK3Nlc2FtZQ+/=", "a1"]
    texts = [f"note: {k} {v} then more" for k, v in zip(("ssn:", "my password =", "passport#", "token:", "api_key:", "secret:", "account:"), values, strict=True)]
    texts += ["a plain sentence: nothing here"]
    spans = [r.spans for r in pii.report(docs(spark, texts)).orderBy("doc_id").collect()]
    clean = [r.text for r in pii.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    for t, v, got, c in zip(texts, values, spans, clean, strict=False):
        assert got == f"id:{t.index(v)}:{t.index(v) + len(v)}" and c == t.replace(v, "[ID]")
    assert spans[-1] == "" and clean[-1] == texts[-1]


def test_redaction_keeps_columns_of_clashing_names(spark):
    names = ["row_key", "base", "all", "email", "ip", "card", "phone", "ids", "digits", "hits", "gaps", "candidates", "extra", "named", "rest", "clean"]
    given = spark.createDataFrame([(1, "a@b.co said hi", *range(len(names)), 14), (2, None, *range(len(names)), None), (3, "plain", *range(len(names)), 99)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names) + ", n_chars long")
    out = {r.doc_id: r for r in pii.redact(given).collect()}
    assert all(tuple(out[k][n] for n in names) == tuple(range(len(names))) for k in out)
    assert (out[1].text, out[1].n_chars) == ("[EMAIL] said hi", 15) and (out[2].text, out[2].n_chars, out[3].n_chars) == ("", None, 99)


def test_no_python_in_personal_data(spark):
    plan = pii.found(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for i in range(120):
        w = prose(rng, 60, 3000).split()
        rows.append((i, " ".join([w[0]] * 60) if i % 6 == 0 else " ".join(w)))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " mail me at joe@site.example.org")]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(rows[3][1].split()[10:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        seen[name] = {r[0]: r for r in df.collect()}
        if name != "packing":
            assert df.schema.simpleString() == documents.schema.simpleString()
    quality_, dedup, leaks, private, packed = seen.values()
    assert not any(i % 6 == 0 and i < 120 for i in quality_) and len(quality_) >= 98
    assert 200 not in dedup and 201 not in dedup and len(dedup) == len(quality_) - 2
    assert 3 not in leaks or len(leaks[3].text.split()) == 30
    assert set(packed) == set(private) and corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id")).first()[0] == len(private)


def test_lm_mixture_holds_a_bounded_part_of_a_large_batch():
    from types import SimpleNamespace

    texts = [f"{'some words of text and more ' * 400}{i}" for i in range(900)]
    coded = pa.Table.from_batches(lm_score._encoded(None)([pa.record_batch([pa.array(range(900)), pa.array([True] * 900), pa.array(texts)], names=["doc_id", "trains", "text"])])).combine_chunks().to_batches()
    sizes = []

    def mixture(columns, rounds=30):
        sizes.append(sum(len(t) for c in columns for t in c[0].to_pylist()))
        return np.array([0.25] * 4), 1

    parts = list(lm_score._mixed(SimpleNamespace(value=SimpleNamespace(mixture=mixture)))(b.select(["text", "ids", "sizes"]) for b in coded))
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) < 3 << 20 and len(parts) == len(sizes)


def test_lm_lets_go_of_the_tokenizer_where_nothing_is_encoded():
    from types import SimpleNamespace

    from netquarry.llm._tokens import Subwords

    coded = list(lm_score._encoded(None)([pa.record_batch([pa.array([1]), pa.array([True]), pa.array(["a few words"])], names=["doc_id", "trains", "text"])]))
    assert Subwords._by_path
    list(lm_score._further(SimpleNamespace(value=lm_score.Attention()))(b.select(["ids", "sizes"]) for b in coded))
    assert not Subwords._by_path


def test_lm_gradients_of_parts_and_of_a_used_room_are_those_of_single_windows():
    rng = np.random.default_rng(21)
    model = lm_score.Attention()
    model.p = {k: w.astype(np.float64) for k, w in model.p.items()}
    model.p["q"] = model.p["q"] * 12  # weights of attention that vanish
    n, width = 2 * lm_score._PART + 5, 20
    x, text = rng.integers(0, 300, (n, width)), np.sort(rng.integers(0, 3, (n, width)), axis=1)
    text[:4, 12:] = -1
    target, mask = rng.integers(0, lm_score.CLASSES, (n, width)), rng.random((n, width)) < 0.7
    loss, want = 0.0, {k: np.zeros_like(w) for k, w in model.p.items()}
    for i in range(n):
        one, d = model.gradients(*(m[i : i + 1] for m in (x, text, target, mask)))
        share = max(1, mask[i].sum()) / mask.sum()
        loss += one * share
        for k in want:
            want[k] += d[k] * share
    room = lm_score._Room(model.p, n + 3, width)
    for _ in range(2):
        got, d = model.gradients(x, text, target, mask, room)
        assert got == pytest.approx(loss) and all(np.allclose(d[k], want[k], atol=1e-9) for k in want)
        model.gradients(x[:3], text[:3], target[:3], mask[:3], room)


def test_lm_fit_leaves_shared_weights_alone():
    from copy import copy

    model, rng = noisy(22)
    other, before = copy(model), {k: w.copy() for k, w in model.p.items()}
    other.p = dict(other.p)
    other.fit(rng.integers(0, 300, (70, lm_score.WINDOW + 1)), np.zeros((70, lm_score.WINDOW + 1), dtype=np.int64), epochs=1)
    assert all(np.array_equal(model.p[k], before[k]) and not np.array_equal(other.p[k], before[k]) for k in before)


def test_lm_scores_take_the_place_of_the_ids_part_by_part(spark):
    from pathlib import Path

    from netquarry.cluster import cut, discard, replaced

    table, seen = cut(spark.range(400).repartition(8)), []
    folder = Path(table._nq_path.removeprefix("file://"))

    def step(part):
        seen.append(len(list(folder.glob("part-*"))))
        return part.selectExpr("id + 1 as id")

    out = replaced(table, step)
    assert seen == [8, 6, 4, 2] and not folder.exists()
    assert sorted(r.id for t in out for r in t.collect()) == list(range(1, 401))
    discard(*out)
    none = replaced(cut(spark.range(0)), lambda part: part)
    assert sum(t.count() for t in none) == 0


def test_lm_passes_after_the_model_read_no_text():
    from types import SimpleNamespace

    model, _ = noisy(23)
    texts = ["Rare rare common common common", "", "common " * 50]
    coded = list(lm_score._encoded(None)([pa.record_batch([pa.array(range(3)), pa.array([True] * 3), pa.array(texts)], names=["doc_id", "trains", "text"])]))
    scorer = lm_score.Scorer(model, np.array([_text.hash_word(b"common")], dtype=np.uint64), np.array([53]), 60, 3, np.ones(lm_score.VOCABULARY), Subwords.shared().finals())
    (got,) = lm_score._predicted(SimpleNamespace(value=scorer))(coded)
    assert "text" not in got.schema.names
    p = scorer.parts(*got.columns[2:])
    assert p["count"].tolist() == [-1, -1] + [53] * 53 and p["rare"].tolist() == [_text.hash_word(b"rare")] * 2 and p["bounds"].tolist() == [0, 5, 5, 55]
    assert np.allclose(p["pointer"], [0, 1, 0, 1 / 3, 2 / 4, *(i / max(i, 1) for i in range(50))])
