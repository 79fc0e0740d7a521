"""Closures of edges, calls and includes against a plain search."""

import random

from pyspark.sql import functions as F

from orrery.operators import closure, code


def by_search(edges, starts=None, most=None):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in set(after) if starts is None else starts:
        level, frontier = 0, {start}
        while frontier and (most is None or level < most):
            level += 1
            frontier = {b for a in frontier for b in after.get(a, ()) if (start, b) not in out}
            out |= {(start, b): level for b in frontier}
    return out


def reached(df):
    return {(r["start"], r["node"]): r["level"] for r in df.collect()}


def test_reach(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)] + [(50, 50), (60, 61), (61, 60)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 1), (1, None)], "source int, target int")
    assert reached(closure.reach(df)) == by_search(edges)
    assert reached(closure.reach(df, most_levels=2)) == by_search(edges, most=2)
    starts = spark.createDataFrame([(60,), (3,), (99,), (60,)], "start int")
    assert reached(closure.reach(df, starts)) == by_search(edges, [60, 3, 99])
    assert closure.reach(df.limit(0)).count() == 0


def file(name, method, body):
    return f"{name}.php", f"class {name} {{\n  function {method}() {{\n{body}\n  }}\n}}"


def test_calls_and_includes(spark):
    rows = [
        file("A", "a", "$b = new B(); $b->b(); $z = new Z(); $z->z(); include 'B.php';"),
        file("B", "b", "$c = new C(); $c->c(); $c->none(); include 'C.php'; include 'no.php';"),
        file("C", "c", "$a = new A(); $a->a(); require_once('A.php');"),
        file("D", "d", "return 1;"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    names = {"A": "A.php::a", "B": "B.php::b", "C": "C.php::c"}
    edges = [("A", "B"), ("B", "C"), ("C", "A")]
    calls = reached(closure.call_closure(code.methods(files), files))
    assert calls == by_search([(names[a], names[b]) for a, b in edges]) and calls["A.php::a", "A.php::a"] == 3
    assert reached(closure.include_closure(files)) == by_search([(f"{a}.php", f"{b}.php") for a, b in edges])
    parts = files.select("path", F.regexp_extract("text", "class (.)", 1).alias("name"))
    starts = spark.createDataFrame([("A.php",), ("D.php",)], "start string")
    got = {(r["start"], r["name"], r["level"]) for r in closure.included_parts(files, parts, starts).collect()}
    assert got == {("A.php", "A", 0), ("A.php", "B", 1), ("A.php", "C", 2), ("D.php", "D", 0)}
