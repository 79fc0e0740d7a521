"""Source divergence, conversation repair and exact dedup against brute force, DuckDB and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orrery.llm.conversations import OP12_SQL, damage, op12_repair_conversations, repair_conversations
from orrery.llm.divergence import OP11_SQL, op11_audit_sources, source_divergence
from orrery.llm.exact import OP13_SQL, DigestIndex, op13_dedup_exact

DOCS = "doc_id long, text string, lang string, source string"
TURNS = "conv_id long, turn long, role string, text string"


def same_as_sql(spark, tmp_path, name, df, query, sql):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.execute(sql)
    at = [[x[0] for x in found.description].index(c) for c in got.columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


# op11


def divergence_by_brute_force(rows, least, ranks=10):
    docs = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in df[lang].items() if n >= least}
        of = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        price = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        p = {s: price(n) for s, n in of.items()}
        q = price({t: sum(n[t] for n in of.values()) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            pair = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in of if o != s]
            term = [("term", t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, most in ((pair, None), (term, ranks)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k) for k, x in enumerate(part[:most], 1)]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_divergence(spark, monkeypatch, seed):
    monkeypatch.setattr("orrery.llm.divergence.HELD", 20)
    rng = random.Random(seed)
    words = ["Ab", "ab", "cd", "ÉÉ", "éé", "xİ", "日本", "a1b", "_", "", "zz", "q" * 300, "\x7f"]
    rows = [(i, None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randrange(9))), rng.choice(["x", "y", None, ""]), rng.choice(["s", "S", "é", None, "~"])) for i in range(120)]
    rows += [(500, "1 2", "none", "a"), (501, "", "none", "b"), (502, "alone", "single", "a")] + rows[:5]
    got = [tuple(r) for r in source_divergence(spark.createDataFrame(rows, DOCS).repartition(3), 6, 3).collect()]
    assert sorted(got) == sorted(divergence_by_brute_force(rows, 6, 3))
    assert {r[2:] for r in got if r[0] == "none"} == {("pair", "a", 0, 1), ("pair", "b", 0, 1)}


def test_divergence_equals_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("Aé b! c-d É 日 ee".split(), k=rng.randrange(30))) or None, rng.choice(["x", None]), rng.choice(["s", "t", None])) for i in range(80)]
    assert len(same_as_sql(spark, tmp_path, "documents", spark.createDataFrame(rows, DOCS), op11_audit_sources, OP11_SQL)) > 20


def test_divergence_of_awkward_tables(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame([(1, "a b", "x", "s", 0, 0, 0)] * 10, DOCS + ", Text int, `term.n` int, LANG int")
    assert source_divergence(extra).count() == 0  # one source: no pairs, and its terms are the language's
    huge = spark.createDataFrame([(k, "Word " * 50_000, "x", "st"[k % 2]) for k in range(10)], DOCS)
    assert [tuple(r) for r in source_divergence(huge).collect()] == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


# op12


def edits_by_brute_force(rows):
    """Least (cost, initials, repaired) over all edits; rows are (role, text, required, truncated)."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow the last initial
    best = []

    def go(k, last, cost, audit, done, inserted):
        if k == len(rows) and last in ("", "a"):
            best.append((cost, audit, tuple(done)))
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in legal[last]:
                    go(k, role[0], cost + 5, audit + "I", [*done, (role, "")], inserted + 1)
        if k < len(rows):
            role, text, required, truncated = rows[k]
            go(k + 1, last, cost + 2, audit + "D", done, inserted)
            if not required:
                if role[:1] and role[0] in legal[last]:
                    go(k + 1, role[0], cost + 5 * truncated, audit + "K", [*done, (role, text)], inserted)
                for new in ("user", "assistant"):
                    if new[0] in legal[last]:
                        go(k + 1, new[0], cost + 1 + 5 * truncated, audit + "R", [*done, (new, text)], inserted)

    go(0, "", 0, "", [], 0)
    return min(best)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        blank, again = not words, (role, text) in seen
        seen.add((role, text))
        truncated = bool(words) and not again and words[-1][-1] not in ".!?"
        out.append((role, text, blank, again and not blank, truncated))
    return out


def repaired_by_brute_force(table):
    out = {}
    for conv, _, _, _ in table:
        rows = [(t, r or (" " if r is None else ""), x if x is not None else " ") for c, t, r, x in table if c == conv]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        found = faults([x[1:] for x in rows])
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, repaired = edits_by_brute_force([(r, x, b or d, t) for r, x, b, d, t in found])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(sum(f[k] for f in found) for k in (2, 3, 4)), illegal, cost, audit, repaired)
    return out


def conversations(seed, n, most=5):
    rng = random.Random(seed)
    table = []
    for conv in range(n):
        for turn in range(rng.randrange(1, most + 1)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "sales", "tool", None, ""])
            text = rng.choice(["Hi.", "Hi", "Why?\n", "no end", " \t", "", None, "a!", "End. "])
            table.append((conv if conv else None, rng.choice([turn, turn, turn + 1, None]), role, text))
    return table


@pytest.mark.parametrize("seed", range(3))
def test_repair(spark, seed):
    table = conversations(seed, 60)
    got = {r[0]: (*r[1:8], tuple(map(tuple, r["repaired"]))) for r in repair_conversations(spark.createDataFrame(table, TURNS).repartition(3)).collect()}
    assert got == repaired_by_brute_force(table)


def test_least_script_where_one_is_the_beginning_of_another(spark):
    # two truncated rows of one role: of the cheapest edits some insert and some don't
    table = [(1, k, r, x) for k, (r, x) in enumerate([("user", "a"), ("user", "b"), ("user", "c."), ("user", "d"), ("assistant", "e")])]
    want = repaired_by_brute_force(table)
    got = repair_conversations(spark.createDataFrame(table, TURNS)).first()
    assert (got["cost"], got["audit"]) == want[1][5:7]


def test_repair_equals_sql(spark, tmp_path):
    table = conversations(7, 150, 9)
    assert len(same_as_sql(spark, tmp_path, "conversations", spark.createDataFrame(table, TURNS), op12_repair_conversations, OP12_SQL)) == 150


def test_damage(spark):
    table = [(c, t, "assistant", "A. B!") for c in range(30) for t in (0, 1, None)]
    want = []
    for c, t, role, text in table:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, {1: "", 2: "A B"}.get(kind, text), kind == 0)
        want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, damage(spark.createDataFrame(table, TURNS)).collect()))) == sorted(map(repr, want))


def test_repair_of_awkward_tables(spark):
    assert repair_conversations(spark.createDataFrame([], TURNS)).count() == 0
    lost = spark.createDataFrame([(1, 0, "user", "a.", True, 5, "x")], TURNS + ", lost boolean, Role int, `at.x` string")
    row = repair_conversations(lost, "lost").first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", [])
    long = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(2000)] + [(2, 0, "user", "word " * 200_000 + "."), (2, 1, "assistant", "ok.")], TURNS)
    got = {r["conv_id"]: r for r in repair_conversations(long).collect()}
    assert got[1]["audit"] == "K" * 2000 and got[1]["cost"] == 0
    assert got[2]["repaired"] == [Row(role="user", text="word " * 200_000 + "."), Row(role="assistant", text="ok.")]


# op13


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(spark, tmp_path):
    rng = random.Random(5)
    texts = ["a b", "ab", " a\tb\x0b", "ab ", "", None, " \n", "é é", "éé", "c" * 100_000, "𝒳 y", "𝒳y"]
    rows = [(k, rng.choice(texts)) for k in range(200)] + [(None, "ab"), (None, "only"), (3, "twice"), (3, "twice"), (7, "tw ice")]
    got = [tuple(r) for r in DigestIndex(spark, f"{tmp_path}/index", buckets=4).add(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    groups = defaultdict(list)
    for doc, text in rows:
        groups[hashlib.sha256(normal(text).encode()).hexdigest()].append((-len(text or ""), doc is None, doc or 0, doc))
    assert sorted((r[0], r[5]) for r in got if r[0] is not None) == sorted((d, hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows if d is not None)
    for _, keep, size, _, known, digest in got:
        assert (keep, size, known) == (min(groups[digest])[3], len(groups[digest]), False)
    kept = Counter(r[5] for r in got if r[3])
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert all(r[0] == r[1] for r in got if r[3])


def test_batches_meet_the_index(spark, tmp_path):
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a   b"), (5, "d"), (6, "d "), (7, "c")], "doc_id long, text string")
    path = f"{tmp_path}/index"
    index = DigestIndex(spark, path, buckets=4)
    index.add(first)
    told = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in index.add(second).collect()}
    assert told == {4: (1, 1, False, True), 5: (6, 2, False, False), 6: (6, 2, True, False), 7: (3, 1, False, True)}
    index.forget()
    again = DigestIndex(spark, path, buckets=4)  # as a later session opens it
    assert not any(r["kept"] for r in again.add(first.unionByName(second)).collect())
    assert sorted((r["keep_id"], r["points"]) for r in again.rows().collect()) == [(1, 3), (3, 1), (6, 2)]


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    batch = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = batch.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_exact_dedup_of_awkward_tables(spark, tmp_path):
    index = DigestIndex(spark, f"{tmp_path}/index", "string", 2)
    assert index.add(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    extra = spark.createDataFrame([("a", "x", 1, 2, 3)], "doc_id string, text string, Text int, digest int, `a.b` int")
    assert [tuple(r)[:4] for r in index.add(extra).collect()] == [("a", "a", 1, True)]


def test_exact_dedup_equals_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a b", "ab", "", None, "é\x0b", "é", "u v w"]), "x", "y") for k in range(60)]
    same_as_sql(spark, tmp_path, "documents", spark.createDataFrame(rows, DOCS), op13_dedup_exact, OP13_SQL)
