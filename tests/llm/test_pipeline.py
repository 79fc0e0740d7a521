"""The pipeline's stages, each against brute force on its own input."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from orrery.llm import mixing, packing
from orrery.llm.simhash import fingerprints

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that every stage got and gave, awkward ones added to the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "?! 12", None, "src1", 5), (10**6 + 3, docs.first()["text"], None, None, 1), (10**6 + 3, docs.first()["text"], None, None, 1), (None, "the and of that with", "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.collect())
    return seen


def test_columns(stages):
    assert all(set(r.asDict()) == set(stages[0][0].asDict()) for rows in stages[:5] for r in rows[:1])


def test_language_keeps_all_texts_with_letters(stages):
    want = collections.Counter((r["doc_id"], r["text"]) for r in stages[0] if r["text"] and re.search(r"[^\W\d_]", r["text"]))
    assert collections.Counter((r["doc_id"], r["text"]) for r in stages[1]) == want
    assert all(r["lang"] for r in stages[1])


def test_language_keeps_capitals_and_drops_foreign_texts(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    capitals = base.where("text IS NOT NULL").selectExpr("doc_id + 1000000 AS doc_id", "upper(text) AS text", "lang", "source", "n_chars")
    foreign = spark.createDataFrame([(5 * 10**6, "Это русский текст о погоде", None, "s", 1), (5 * 10**6 + 1, "这是一个中文句子", None, "s", 1)], base.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, base.unionByName(capitals).unionByName(foreign), SF).collect()}
    assert {r["doc_id"] for r in capitals.collect() if re.search(r"[^\W\d_]", r["text"])} <= kept and not {5 * 10**6, 5 * 10**6 + 1} & kept


def test_lines(stages):
    first, want = {}, collections.Counter()
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in stages[1]})
    for d in order:
        ls = d[2].split("\n")
        for k in range(len(ls) - 2):
            first.setdefault(tuple(ls[k : k + 3]), (d[:2], k))
    for r in stages[1]:
        ls, d = r["text"].split("\n"), (r["doc_id"] is not None, r["doc_id"] or 0)
        gone = {k + j for k in range(len(ls) - 2) if first[tuple(ls[k : k + 3])] != (d, k) for j in range(3)}
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        want[r["doc_id"], kept, len(kept)] += 1
    assert collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in stages[2]) == want


def test_near_duplicates(stages):
    rows = stages[2]
    prints = fingerprints([r["text"] for r in rows]).tolist()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r["doc_id"])
    want = collections.Counter(min((d for d in g if d is not None), default=None) for g in groups.values())
    assert collections.Counter(r["doc_id"] for r in stages[3]) == want and len(stages[3]) < len(rows)


def test_near_duplicates_keeps_a_row_a_group(spark):
    texts = [" ".join(f"{name}{k * k}" for k in range(60)) for name in "abcdef"]
    rows = [(1, texts[0]), (2, texts[0]), (1, texts[1]), (None, texts[1]), (5, texts[2]), (2, texts[2])]
    rows += [(None, texts[3]), (None, texts[3]), (None, texts[4]), (None, texts[5]), (9, texts[5]), (9, texts[5])]
    for seen in (rows, rows[::-1], rows[:6], [r for r in rows if r[0]]):
        docs = spark.createDataFrame([(d, t, None, s, len(t)) for s, (d, t) in zip("xyxyxyxyxyxy", seen, strict=False)], "doc_id long, text string, lang string, source string, n_chars long")
        groups = {t: min((e for e, u in seen if u == t and e is not None), default=None) for _, t in seen}
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
        assert collections.Counter(got) == collections.Counter((d, t) for t, d in groups.items())


def test_mixing(spark, stages):
    docs = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix_sources(docs).collect()}
    got = collections.Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in stages[4])
    assert got == collections.Counter({k: n for k, n in copies.items() if n})


def test_mixing_equals_sql(spark, stages):
    import pandas as pd

    documents = pd.DataFrame([r.asDict() for r in stages[3] if r["doc_id"] is not None])  # noqa: F841  read by name
    want = {r[0]: r[1:] for r in duckdb.sql(mixing.OP6_SQL).fetchall()}
    docs = spark.createDataFrame([r for r in stages[3] if r["doc_id"] is not None], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert got == want


def test_packing(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for r in stages[4]:
        n = len(plain.encode(r["text"], add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in stages[5]) == want
    filled = collections.defaultdict(list)
    for r in stages[5]:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(r["length"] for r in stages[5]) // 4096) + 1


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


CLASHES = ("score", "bits", "lang_pred", "n_lines", "n_removed", "__uid", "uid1", "__url", "__cut", "__starts", "starts", "mark1", "__mark1", "copies", "size", "key", "rank", "x0", "component_id", "fp", "sequence_id", "offset", "nth", "a.b")


def test_columns_of_clashing_names_come_through(spark):
    rows = [(i, f"the and of that with w{i % 9} x{i % 9} y{i % 9}\nof the\nthat and\nwith the of", "en" if i % 2 else None, "s", 3, *(f"{c}{i}" for c in CLASHES)) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASHES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES), name
    assert set(corpus_pipeline.packing(spark, docs, SF).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
