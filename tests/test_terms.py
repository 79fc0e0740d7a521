"""Many terms at once and the index, against a search line by line."""

import random
import re
import time

from orrery.operators import rules, terms


def corpus(spark, n=60):
    rng = random.Random(2)
    words = ["Alpha", "beta", "gämma", "ΣΑΣ", "delta", "x", "function go(", "a.b", "", "日本語"]
    rows = [(f"f{i:03}", rng.choice(["\n", "\r\n", " "]).join(rng.choices(words, k=rng.randrange(12)))) for i in range(n)] + [("null", None), ("empty", ""), ("last", "beta\n")]
    return rows, spark.createDataFrame(rows, "path string, text string")


def by_line(rows, wanted, fold):
    out = []
    for path, text in rows:
        for no, line in enumerate((text or "").splitlines(), 1):
            told = sorted({t.lower() if fold else t for t in wanted if t and "\n" not in t and (t.lower() in line.lower() if fold else t in line)})
            if told:
                out.append((path, no, line, told))
    return sorted(out)


def test_many_terms(spark):
    rows, files = corpus(spark)
    wanted = ["alpha", "BETA", "eta", "gä", "a.b", "", "alpha\nbeta", "zzz", "日本", "function go("]
    for fold in (True, False):
        got = sorted((r["path"], r["line_no"], r["line"], r["terms"]) for r in terms.search_terms(files.repartition(3), wanted, fold).collect())
        assert got == by_line(rows, wanted, fold)
    df = spark.createDataFrame([("beta",), ("beta",), (None,), ("x",)], "term string")
    assert sorted(r["path"] for r in terms.search_terms(files, df).collect()) == sorted(p for p, *_ in by_line(rows, ["beta", "x"], True))
    assert terms.search_terms(files, []).count() == 0 and terms.search_terms(files.limit(0), ["x"]).count() == 0
    first = min(p for p, _, line, _ in by_line(rows, ["function go("], False))
    assert [tuple(r) for r in terms.locate_methods(files, ["go", "none"]).collect()] == [("go", first)]


def test_a_thousand_terms_take_about_the_time_of_ten():
    rng = random.Random(0)
    text = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(20_000))
    many = tuple(sorted({"".join(rng.choices("abcdefgh", k=7)) for _ in range(1000)}))

    def seconds(some):
        terms.line_hits("", some, True)
        began = time.time()
        terms.line_hits(text, some, True)
        return time.time() - began

    assert seconds(many) < 5 * seconds(many[:10]) + 1


def test_index(spark, tmp_path):
    rows, files = corpus(spark, 120)
    index = terms.TermIndex(spark, str(tmp_path / "i"), 8)
    index.add(files.where("path < 'f060'"))
    index.add(files.where("path >= 'f060'"))
    told = lambda df: sorted((r["path"], r["line_no"], r["line"], [tuple(c) for c in r["context"]]) for r in df.collect())
    for term in ("beta", "GÄMMA", "日本語", "function go(", "none at all", "x", "alpha"):
        assert told(index.search(term, 1)) == told(rules.search(files, term, 1)), term
    assert told(index.search("Alpha", 0, ignore_case=False)) == told(rules.search(files, "Alpha", 0, ignore_case=False))


def test_postings_are_a_row_for_each_trigram_of_many_files(spark, tmp_path):
    rows, files = corpus(spark, 120)
    index = terms.TermIndex(spark, str(tmp_path / "i"), 4)
    index.add(files.coalesce(1))
    got = [(r["gram"], p) for r in spark.read.parquet(f"{index.folder}/postings").collect() for p in r["paths"]]
    want = {(g, p) for p, text in rows for g in terms._grams(text or "")}
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.read.parquet(f"{index.folder}/postings").count() == len({g for g, _ in want})


def test_postings_of_odd_texts():
    for texts in ([""], ["ab"], ["", "abc", "", "bc", "a", "bcd"], ["x\U0010ffffy\x00z", "\U0010ffffy\x00"], ["aaaa"]):
        got = [(g, p) for g, ps in zip(*(c.to_pylist() for c in terms.posted([str(i) for i in range(len(texts))], texts, 4).columns[1:])) for p in ps]
        want = sorted((g, str(i)) for i, t in enumerate(texts) for g in terms._grams(t))
        assert sorted(got) == want


def test_a_search_reads_little_of_the_index(spark, tmp_path):
    rows = [(f"f{i}", f"common words {'needle in it' if i == 77 else 'and more'}\n" * 50) for i in range(400)]
    index = terms.TermIndex(spark, str(tmp_path / "i"), 16)
    index.add(spark.createDataFrame(rows, "path string, text string"))
    df = index.texts("needle")
    assert [r["path"] for r in df.collect()] == ["f77"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"PartitionFilters: \[[^\]]*{c}#", plan) for c in ("shard", "bucket"))
    read = index.candidates("needle").collect(), index.candidates("common").count(), index.candidates("zzzz").count()
    assert ([r["path"] for r in read[0]], *read[1:]) == (["f77"], 400, 0) and index.candidates("ab") is None
