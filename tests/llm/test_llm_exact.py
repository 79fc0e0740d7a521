"""Operators with exactly defined results, against brute force on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import forest, graph, langid, lines, mixing, packing, search, simhash, substrings, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_lines int, size int, __text string"


def documents(spark, texts, sources=("a",)):
    rows = [(i, t, "en", sources[i % len(sources)], 7, 8, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def awkward(seed=0, n=40):
    """Texts with copies, nulls, empties, ties and a long one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "Ünï", "x́", " nb"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", " \t\n", "a", "a b", passage, passage, passage + " tail", "Head " + passage.upper()]
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.4:
            t[len(t) // 2 : len(t) // 2] = passage.split(" ")[: rng.randint(30, 60)]
        out.append(rng.choice((" ", "\n", "  ")).join(t))
    return [*out, " ".join(rng.choice(words) for _ in range(3000)), *out[-3:]]


def substrings_by_brute_force(texts):
    count = collections.Counter()
    words = [WORD.findall(t or "") for t in texts]
    for w in words:
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return want


@pytest.mark.parametrize("bits", [64, 12, 5])
@pytest.mark.parametrize("seed", [0, 7])
def test_substrings(spark, bits, seed):
    texts = awkward(seed)
    want = substrings_by_brute_force(texts)
    docs = documents(spark, texts).repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup_substrings(docs, bits=bits).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500


def test_substrings_overlapping_repeats(spark):
    """Repeats with different partners, within one text, of one word only, and at ends of texts."""
    w = [f"q{i}" for i in range(200)]
    texts = [" ".join(x) for x in (w[:40] + w[100:160], w[:40] + w[60:99], w[20:40] + w[100:140], ["a"] * 90, ["a"] * 34, ["b", "c"] * 40, w[:35], w[:34], w[1:35] + w[:34], w[165:] + w[165:])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup_substrings(documents(spark, texts).repartition(3)).collect()}
    assert got == substrings_by_brute_force(texts)


def test_substrings_compare_words(spark):
    """Complementary Thue-Morse words collide under any polynomial hash modulo a power of two."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rest = " ".join(f"u{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{thue} {rest}"), (2, f"{thue.translate({97: 98, 98: 97})} {rest}")], "doc_id long, text string")
    for bits in (64, 3):
        assert [r["n_removed"] for r in substrings.dedup_substrings(docs, bits=bits).collect()] == [0, 0]


def test_substrings_repeated_rows_and_empty(spark):
    t = " ".join(f"u{i}" for i in range(40))
    twice = spark.createDataFrame([(None, t), (None, t), (3, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], len(r["spans"])) for r in substrings.dedup_substrings(twice).collect())
    assert got == [(0, 40, 1), (0, 40, 1), (3, 0, 0)]
    assert substrings.dedup_substrings(twice.limit(0)).count() == 0
    clash = twice.select("doc_id", "text", *(F.lit(c).alias(c) for c in ("pack", "payload", "spans", "c0", "n_words")))
    got = substrings.dedup_substrings(clash, keep=clash.columns).orderBy("doc_id").collect()[-1]
    assert got.asDict() == {"doc_id": 3, "pack": "pack", "payload": "payload", "c0": "c0", "n_words": 1, "n_removed": 0, "text": "short", "spans": []}


def test_segments_don_t_change_hashes(monkeypatch):
    w = substrings.Words([" ".join(f"v{i % 50}" for i in range(500)).encode(), b"x y", b"", b"a b c d e f"])
    whole = w.hashes(5)
    monkeypatch.setattr(substrings, "_SEGMENT", 7)
    assert (w.hashes(5)[1] == whole[1]).all() and whole[0].tolist() == [*range(496), 502, 503]


def test_lines(spark):
    texts = [None, "", "a\nb\nc", "x\na\nb\nc\nd", "a\nb\nc\na\nb\nc", "a\nb", "p\nq\nr\ns\np\nq\nr\ns"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert got == {
        0: (None, 0, 0), 1: ("", 1, 0), 2: ("a\nb\nc", 3, 0), 3: ("x\nd", 5, 3), 4: ("", 6, 6),
        5: ("a\nb", 2, 0), 6: ("p\nq\nr\ns", 8, 4),
    }
    both = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in lines.dedup_lines(both).collect()) == [(0, 0), (1, 3), (1, 3)]
    assert lines.dedup_lines(both.limit(0)).count() == 0


def test_lines_of_one_id(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nzz"), (1, "a\nb\nc\nzz")]
    got = sorted((r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([("a\nb\nc\nd", 0), ("zz", 3), ("zz", 3)], [("a\nb\nc\nzz", 0), ("a\nb\nc\nzz", 0), ("d", 3)])


def test_names_that_differ_in_case_or_hold_dots(spark):
    odd = "Host string, N_Lines int, Score double, SEQUENCE_ID int, Text int, `a.b` int, `n w` struct<`x y`: int, z: string>"
    docs = spark.createDataFrame([(i, "a\nb\nc one two", "s", "http://x.org/", "h", 1, 0.5, 2, 3, 4, (5, "z")) for i in range(3)], "doc_id long, text string, source string, url string, " + odd)
    whole = lambda df: sorted(map(tuple, df.collect()), key=repr)
    names = docs.columns

    def check(out, dropped, new):
        assert out.columns == [*(c for c in names if c not in dropped), *new]
        assert len(whole(out)) == 3

    check(lines.dedup_lines(docs), ["N_Lines"], ["n_lines", "n_removed"])
    check(urls.filter_urls(docs), ["Host"], ["host", "path", "rule", "verdict"])
    ppm = langid.PPM(["x"], {"x": langid.grams(b"a b c one two")})
    check(langid.identify_languages(docs, ppm), ["Score"], ["lang_pred", "score", "bits"])
    blank = toxicity.SubwordClassifier(np.zeros(toxicity.BUCKETS), 1.0, 0.0)
    check(toxicity.score_toxicity(docs, blank, keep=names), ["Score"], ["score", "predicted"])
    check(substrings.dedup_substrings(docs, 2, keep=names), ["Text", "text"], ["n_words", "n_removed", "text", "spans"])
    assert {r["component_id"] for r in simhash.simhash_components(docs).collect()} == {0}
    assert len(whole(mixing.mix_sources(docs, also=["a.b", "n w"]))) == 3
    pieces = packing.tokenize_pieces(docs)
    assert pieces.count() == 3
    joined = pieces.toDF("doc_id", "piece", "Start", "length", "ids.x").withColumn("Offset", F.lit(1))
    assert packing.pack_pieces(joined).columns == ["doc_id", "piece", "Start", "length", "ids.x", "sequence_id", "offset"]
    n = pieces.first()["length"]
    assert [r["offset"] for r in packing.pack_pieces(joined).orderBy("offset").collect()] == [0, n, 2 * n]


def test_clashing_names(spark):
    names = ["uid1", "UID2", "starts", "Cut", "__uid", "__starts", "__cut", "__url", "url_", "host_", "sequence_id", "offset", "__p_piece", "also0", "rank"]
    rows = [(i, "a\nb\nc", "http://x.org/", *(f"{n}{i}" for n in names)) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "url", *names])
    for out, new in ((lines.dedup_lines(docs), ["n_lines", "n_removed"]), (urls.filter_urls(docs), ["host", "path", "rule", "verdict"])):
        assert out.columns == [*docs.columns, *new]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    pieces = docs.select("doc_id", F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"), *names)
    got = packing.pack_pieces(pieces)
    assert got.columns == ["doc_id", "piece", "length", *(n for n in names if n not in ("sequence_id", "offset")), "sequence_id", "offset"]
    assert sorted(r["offset"] for r in got.collect()) == [0, 5, 10, 15]
    mixed = mixing.mix_sources(docs.withColumn("source", F.lit("s")), also=["rank", "also0", "uid1"]).collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in mixed for n in ("rank", "also0", "uid1"))


def fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(text)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, monkeypatch):
    texts = awkward(1)
    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: (f"{p:016x}", find(i)) for i, p in enumerate(prints)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(documents(spark, texts)).collect()}
    assert got == want
    monkeypatch.setattr(simhash, "_FLUSH", 50)
    assert simhash.fingerprints(texts).tolist() == prints
    assert simhash.simhash_components(documents(spark, texts).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "q"), (None, "q"), (5, "q")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_components(nulls).collect()} == {5}


@pytest.mark.parametrize("spread", [2, 12, 64])
def test_gray_index(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    x = np.full(900, base, np.uint64)
    for _ in range(3):
        x ^= np.uint64(1) << rng.integers(0, spread, len(x)).astype(np.uint64)
    x = np.unique(x)
    g = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(k)
    x = x[np.argsort(g)]
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(x) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if bin(int(x[i] ^ x[j])).count("1") <= 2}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, k) for k in range(901, 960)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark):
    texts = [None, ""] + [" ".join(["w"] * (1 + k * 7 % 90)) for k in range(400)]
    docs = documents(spark, texts, ("a", "b", "b", "b", None, "c"))
    got = mixing.mix_sources(docs, also=["__text"]).collect()
    assert len(got) == len(texts) and all(r["taken"] <= 2 * r["size"] for r in got)
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = ("a", "b", "b", "b", None, "c")[r["doc_id"] % 6]
        size[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or ""))
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) < 100
    open_ = {s: target[s] / w for s, w in (("a", 3), ("b", 1), ("c", 2), (None, 3)) if target[s] < 2 * size[s] - 1e-9}
    assert max(open_.values()) - min(open_.values()) < 1e-6  # one level for all that are not full
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(documents(spark, [None, ""])).collect()] == [0, 0]


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "example.org/es/": ("", "", None, "allow"),
        "HTTP://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://example.org?x=/es/": ("example.org", "", None, "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://evil.net/x.org/": ("evil.net", "/x.org/", None, "allow"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://É.org/" + "y" * 5000: ("É.org", "/" + "y" * 5000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect()}
    assert got == cases
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_glob_automaton_over_words():
    rng = random.Random(5)
    globs = [g for g in ("".join(rng.choice("ab/*") for _ in range(rng.randint(1, 9))).replace("***", "*") for _ in range(60))]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = urls.GlobAutomaton(globs).match([t.encode() for t in texts])

    def pattern(glob):
        return re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", glob)) + r"\Z", re.S)

    for k, g in enumerate(globs):
        assert got[:, k].tolist() == [pattern(g).match(t) is not None for t in texts], g


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    texts = awkward(2) + ["It's DON'T <|endoftext|> 12,3!!'s", "½ ª ² ſ K", "日本語 Σς", "naïve é", "a " * 9000, "a " * 8191]
    want = {}
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    pieces = packing.tokenize_pieces(documents(spark, texts)).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"), F.lit(1).alias("rank"), F.lit(2).alias("bucket2"))
    got = packing.pack_pieces(pieces).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["crc"]) for r in got} == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert -(-total // 4096) <= len(filled) <= -(-total // 4096) + 1
    assert packing.pack_pieces(pieces.limit(0)).count() == 0


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        p = packing.Packer(collections.Counter(items), capacity)
        p.reduce()
        left = [k for k in range(capacity + 1) for _ in range(p.left[k])]
        assert p.plan.reduced + (optimum(left, capacity) if left else 0) == optimum(items, capacity)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(700, 16))
    x[300:420] = x[0] + 0.02 * rng.normal(size=(120, 16))
    x[420:470] = x[1]
    x[470:500] = 3 * x[2] + 0.4 * rng.normal(size=(30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0] * 7]
    return x, rows + [(1000 + i, v) for i, v in enumerate(odd)]


def test_near_duplicates(spark, monkeypatch):
    x, rows = vectors()
    monkeypatch.setattr(forest, "LEAF", 100)
    monkeypatch.setattr(forest, "TILE", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label, 10**9).min(1))
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df, forest=forest.fit_forest(df.where("vec_id < 1000"), leaf=100)).collect()}
    assert len(got) == len(rows)
    found = sum(got[i][0] for i in range(len(x))) / link.sum()
    assert found >= 0.995 and all(got[i][0] <= link[i].sum() for i in range(len(x)))
    assert np.mean([got[i][1] == label[i] for i in range(len(x))]) >= 0.995
    assert all(got[i] == (0, i, True) for i in range(1000, 1007))
    assert forest.near_duplicates(df.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in forest.near_duplicates(tied).collect()) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_near_duplicates_of_a_dense_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3600, 64)) / 8
    x[:1200] = x[0] / np.linalg.norm(x[0]) + 0.3 * x[:1200]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(rng.permutation(x).tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(forest, "TILE", 256)
    fitted = forest.fit_forest(df, leaf=60)
    found = forest.near_duplicates(df, forest=fitted).agg(F.sum("n_links")).first()[0]
    true = (x @ x.T >= 0.9).sum() - len(x)
    assert true > 10**6 and 0.999 * true <= found <= true


def test_one_id_with_several_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS mark1", "2 AS root", "3 AS leaf", "4 AS cell", "5 AS query_id")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in forest.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (8, 1, 8), (9, 1, 8)]
    found = [tuple(r) for r in search.nearest_neighbours(df, df).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 0.01), (3, 1, 1, 1.0), (3, 2, 2, 0.01), (8, 1, 9, 1.0), (9, 1, 8, 1.0)]
    many = spark.createDataFrame([(0, [1.0, 0.0])] + [(1, [1.0, 0.0])] * 50 + [(1, [0.5, k / 10]) for k in range(30)] + [(k, [1 / k, 0.0]) for k in range(2, 40)], kind)
    assert [r["vec_id"] for r in search.nearest_neighbours(many, many.where("vec_id = 0")).orderBy("rank").collect()] == [*range(1, 21)]


def test_an_id_that_a_third_of_all_rows_share(spark, monkeypatch):
    """Of queries and of candidates, with equal and with different vectors, over many blocks."""
    monkeypatch.setattr(search, "BLOCK", 40)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8))
    ids = np.where(np.arange(300) < 100, 20, np.arange(300) + 1000)
    x[:80] = x[0]
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in search.nearest_neighbours(df, asked, nearest=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    scores = x @ x.T
    for q in set(ids[ids % 20 == 0].tolist()):
        best = collections.defaultdict(lambda: -np.inf)
        for i, s in zip(ids.tolist(), scores[ids == q].max(0), strict=True):
            best[i] = max(best[i], s)
        del best[q]
        assert got[q] == [(i, round(s, 9)) for i, s in sorted(best.items(), key=lambda y: (-y[1], y[0]))][:40]


@pytest.mark.parametrize("depth", [8, 11, 14])
def test_forest_finds_links_at_any_depth(depth):
    """Pairs at exactly the similarity in vectors without any groups: the hardest to keep together."""
    rng = np.random.default_rng(depth)
    x = forest._unit(rng.normal(size=(4000, 32)))
    fitted = forest._grown(x, depth, 0.5, recall=0.999)
    a, b = forest._planted(forest._unit(rng.normal(size=(4000, 32))), 0.9, rng)
    met = np.any([fitted.meet(a[:3000], b[:3000], t) for t in range(len(fitted.directions))], 0)
    assert met.mean() >= 0.99


def test_search(spark, monkeypatch):
    x, rows = vectors(4)
    monkeypatch.setattr(search, "BLOCK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in search.nearest_neighbours(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        best = [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:20]
        assert [r[0] for r in got[q]] == list(range(1, 21)) and q not in [r[1] for r in got[q]]
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in got[q])
        assert [(-v, i) for _, i, v in got[q]] == sorted((-v, i) for _, i, v in got[q])
        hits += len(set(best) & {r[1] for r in got[q]})
        total += 20
    assert hits / total >= 0.9 and set(got) == set(range(0, len(x), 20))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in search.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    assert search.nearest_neighbours(few.limit(0), few).count() == 0
    assert search.nearest_neighbours(few.where("vec_id = 0"), few.where("vec_id = 0")).count() == 0


def test_centroids_follow_the_table(spark, monkeypatch):
    assert [search.centroids_for(n) for n in (0, 16_777_216, 16_777_217, 10**12)] == [16, 16, 32, 256]
    monkeypatch.setattr(search, "CELL", 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search.nearest_neighbours(df, df.where("vec_id % 50 = 0"), 10).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    score = x[::50] @ x.T
    score[np.arange(60), np.arange(0, 3000, 50)] = -np.inf
    true = {(50 * q, int(v)) for q, row in enumerate(score) for v in np.argsort(-row)[:10]}
    assert len(got) == 600 and len(true & found) >= 0.9 * len(true)


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    index = search.MultiIndex(rng.normal(size=(500, 8)), centroids=9)
    q = rng.normal(size=8)
    score = (index.left @ q[:4])[:, None] + index.right @ q[4:]
    order = list(index.traverse(q))
    assert sorted(order) == list(range(81))
    values = score.ravel()[order]
    assert (np.diff(values) <= 1e-12).all()
