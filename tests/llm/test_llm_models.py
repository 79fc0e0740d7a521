"""Learned operators: held-out accuracy, proper distributions, awkward rows."""

import collections
import math
import random

import numpy as np

from orrery.llm import langid, toxicity

SYLLABLES = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ou", "é", "eau", "ch", "ai"], "cc": ["ung", "sch", "ß", "ei", "ver"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_force_bits(training, text, order=4, least=2):
    """Bits of every byte by the definition: blended escapes down to equally likely bytes."""
    follow = collections.defaultdict(collections.Counter)
    for raw in training:
        raw = b" " * order + raw
        for i in range(order, len(raw)):
            for k in range(order + 1):
                follow[raw[i - k : i]][raw[i]] += 1

    def p(context, byte):
        shorter = p(context[1:], byte) if context else 1 / 256
        seen = follow.get(context, {})
        n, q = sum(seen.values()), len(seen)
        if context and n < least:
            return shorter
        return (seen.get(byte, 0) + q * shorter) / (n + q)

    raw = b" " * order + text
    return [-math.log2(p(raw[i - order : i], raw[i])) for i in range(order, len(raw))], lambda c: sum(p(c, b) for b in range(256))


def test_ppm_gives_exact_code_lengths():
    rng = random.Random(0)
    training = {lang: [text(lang, 60, rng).encode() + "Ж日 ".encode() * k for k in range(3)] for lang in SYLLABLES}
    counted = {lang: langid.grams(b"".join(t), 4) for lang, t in training.items()}
    model = langid.PPM(sorted(counted), counted)
    texts = [text("aa", 20, rng).encode(), "Zażółć 日本 \x00\xff gęślą".encode(), b"", b"x", text("cc", 30, rng).encode()]
    got = model.lengths(texts)
    for k, lang in enumerate(sorted(training)):
        for i, t in enumerate(texts):
            bits, total = brute_force_bits([b"".join(training[lang])], t)
            assert abs(got[i, k] - sum(bits)) < 1e-3 * (1 + sum(bits))
        assert all(abs(total(c) - 1) < 1e-9 for c in (b"    ", b"Ther", b" the"))


def test_lengths_don_t_depend_on_batches(monkeypatch):
    rng = random.Random(0)
    texts = [text(rng.choice(list(SYLLABLES)), rng.randint(0, 60), rng).encode() for _ in range(40)]
    model = langid.PPM(["x"], {"x": langid.grams(b" ".join(texts))})
    whole = model.lengths(texts)
    monkeypatch.setattr(langid, "_SLICE", 37)
    assert np.allclose(model.lengths(texts), whole, rtol=1e-5)
    one_by_one = np.concatenate([model.lengths([t]) for t in texts])
    assert np.allclose(one_by_one, whole, rtol=1e-5)


def test_trees_don_t_depend_on_other_languages():
    rng = random.Random(4)
    alone = {lang: langid.grams(text(lang, 400, rng).encode()) for lang in SYLLABLES}
    many = alone | {f"l{k}": langid.grams("".join(chr(0x400 + 64 * k + rng.randrange(60)) for _ in range(4000)).encode()) for k in range(12)}
    texts = [text(lang, 9, rng).encode() for lang in SYLLABLES]
    both = langid.PPM(sorted(many), many)
    assert np.array_equal(both.lengths(texts)[:, [sorted(many).index(x) for x in sorted(alone)]], langid.PPM(sorted(alone), alone).lengths(texts))
    assert both.nbytes() < 20e6


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, lang := rng.choice(list(SYLLABLES)), text(lang, rng.randint(5, 40), rng), "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "aa", "th er", "x"), (900, "aa", None, "x")], "doc_id long, lang string, text string, score string")
    model = langid.fit_languages(docs.where("doc_id < 100"), most=20)
    got = langid.identify_languages(docs.where("doc_id BETWEEN 100 AND 199"), model)
    assert got.columns == ["doc_id", "lang", "text", "lang_pred", "score", "bits"]
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got.collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "é" * 300_000)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify_languages(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "bb"]
    clash = odd.selectExpr("*", "7 AS nth", "8 AS share", "9 AS n", "'q' AS c0")
    assert [r["nth"] + r["share"] + r["n"] for r in langid.identify_languages(clash, model).collect()] == [24] * 4
    assert langid.identify_languages(odd.limit(0), model).count() == 0
    twice = langid.identify_languages(odd.union(odd), model).groupBy("doc_id", "lang_pred", "score").count().collect()
    assert [r["count"] for r in twice] == [2] * 4
    few = langid.fit_languages(docs.where("doc_id < 100"), total=6)
    assert few.langs == sorted(SYLLABLES) and few.nbytes() < model.nbytes()
    again = langid.fit_languages(docs.where("doc_id < 100").unionByName(docs.where("doc_id < 100")), most=20)
    assert np.array_equal(again.lengths([b"th er"]), model.lengths([b"th er"]))
    nothing = langid.fit_languages(docs.limit(0))
    assert [r["lang_pred"] for r in langid.identify_languages(odd, nothing, keep=["doc_id"]).collect()] == ["und"] * 4


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["grumblefex", "snarkwort"]
    rows = []
    for i in range(400):
        words = text(rng.choice(list(SYLLABLES)), rng.randint(5, 150), rng).split(" ")
        toxic = int(i % 4 == 0)
        for _ in range(toxic * (1 + len(words) // 30)):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 280] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    wrong = [i for i, _, t in rows if i >= 280 and got[i] != t]
    assert len(wrong) <= 10
    misspelt, repeated = model.scores(["th er grumblefexx on", "th " * 300])
    assert misspelt > repeated and repeated < 0.3
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "12", 3)], "doc_id long, text string, score int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    clash = toxicity.score_toxicity(odd.union(odd).selectExpr("*", "'x' AS __text", "1 AS nth"), model, keep=["doc_id", "score", "__text", "nth"])
    assert clash.columns == ["doc_id", "__text", "nth", "score", "predicted"] and clash.distinct().count() == 3
    assert {r["__text"] for r in clash.collect()} == {"x"}
    again = toxicity.fit_toxicity(docs.unionByName(docs).unionByName(docs.where("doc_id = 4")), labels.unionByName(labels))
    assert np.allclose(again.scores(["th er grumblefex"]), model.scores(["th er grumblefex"]))
    untrained = toxicity.fit_toxicity(docs, labels.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(odd, untrained).collect())


def test_scores_equal_an_explicit_forward_pass():
    rng = random.Random(6)
    texts = [text(rng.choice(list(SYLLABLES)), rng.randint(1, 130), rng) for _ in range(80)]
    model = toxicity.train([t + " zzqx" * (i % 2) for i, t in enumerate(texts)], [i % 2 for i in range(80)], 0.5)

    def forward(t):
        words = toxicity._WORD.findall((t or "").lower())
        first = list(range(0, max(1, len(words) - toxicity.SEGMENT // 3), toxicity.SEGMENT))
        means = []
        for a, b in zip(first, [*first[1:], len(words)]):
            total = 0.0
            for w in set(words[a:b]):
                vectors = [float(model.bucket_score[k]) for k in toxicity.subwords([w])[0]]
                total += sum(vectors) / len(vectors)
            means.append(total / (b - a + toxicity.PRIOR))
        return 1 / (1 + math.exp(-(model.slope * max(means) + model.bias)))

    seen = [*texts[:20], texts[0] + " zzqy", None, "", "12", " ".join(texts)]
    assert np.allclose(model.scores(seen), [forward(t) for t in seen], rtol=1e-4)
    assert model.scores([None, "", "12 ?!"]).tolist() == [1 / (1 + math.exp(-model.bias))] * 3
    sizes = [len(w) + 2 for w in ("zzqx", "a", "grumble")]
    assert [len(toxicity.subwords([w])[0]) for w in ("zzqx", "a", "grumble")] == [1 + sum(max(0, n - g + 1) for g in (3, 4, 5)) for n in sizes]


def test_long_toxic_texts_are_learned_from(spark):
    rng = random.Random(9)
    rows = [(i, text("aa", 1700, rng) + " grumblefex snarkwort" * 3 * (i % 2), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert min(len(r[1]) for r in rows) > 8192
    low, high = model.scores(["th er on an", "th grumblefex er snarkwort on an"])
    assert low < 0.3 <= high


def test_long_texts_and_cache(monkeypatch):
    rng = random.Random(3)
    texts = [text("aa", 60, rng) for _ in range(60)]
    model = toxicity.train([t + " zzqx" * (i % 2) for i, t in enumerate(texts)] * 2, [i % 2 for i in range(60)] * 2, 0.5)
    long = " ".join(texts * 20)
    before = model.scores([long, long + " zzqx"])
    monkeypatch.setattr(toxicity, "CACHE", 10)
    model.known.clear()
    assert np.allclose(model.scores([long, long + " zzqx"]), before) and before[1] > before[0]


def test_joint_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    # 6 segments of 5 words, words of 7 subwords: weights of either bag are arbitrary
    bags_, subs_ = (rng.random(size) * (rng.random(size) < 0.6) for size in ((6, 5), (5, 7)))
    sparse = lambda a: toxicity._Sparse(*np.nonzero(a), a[np.nonzero(a)], a.shape)
    bags, subs = sparse(bags_), sparse(subs_)
    parameters = [rng.normal(size=(7, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)]
    onehot, weight = np.eye(2)[rng.integers(2, size=6)], rng.random((6, 1))

    def loss(vectors, softmax, offset):
        logits = bags_ @ (subs_ @ vectors) @ softmax + offset
        return float((weight * onehot * (np.log(np.exp(logits).sum(1, keepdims=True)) - logits)).sum())

    hidden = bags @ (subs @ parameters[0])
    assert np.allclose(hidden, bags_ @ (subs_ @ parameters[0]))
    found = toxicity.gradients(bags, subs, hidden, hidden @ parameters[1] + parameters[2], parameters[1], onehot, weight)
    for x, gradient in zip(parameters, found, strict=True):
        for at in np.ndindex(x.shape):
            kept, sides = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = kept + step
                sides.append(loss(*parameters))
            x[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - gradient[at]) < 1e-6
