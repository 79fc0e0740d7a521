from orrery.operators import anomaly, profile

SCHEMA = "id long, v double, c string, ano string, mes string"
ROWS = [(1, 1.0, "x", "1999", "1"), (2, float("nan"), "x", "2001", "12.9"), (None, None, None, "12x", "13"), (4, -3.0, "x", None, "2")]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(profile.null_profile(df)) == [("v", 2, 50.0), ("ano", 1, 25.0), ("c", 1, 25.0), ("id", 1, 25.0), ("mes", 0, 0.0)]
    assert rows(profile.null_profile(df.limit(0))) == []


def test_cardinality_and_duplicates(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(profile.cardinality(df))[1:3] == [("v", 2, 50.0), ("c", 1, 25.0)]
    dup = {r[0]: r[1] for r in rows(profile.column_duplicates(df))}
    assert dup == {"id": 0, "v": 2, "c": 3, "ano": 0, "mes": 0}
    assert rows(profile.cardinality(df.limit(0)))[0] == ("id", 0, 0.0)


def test_dates(spark):
    df = spark.createDataFrame([("1/2/2020",), ("2021-03-04",), ("2019/05/06 10:00",), ("?",), (None,)], "data_ref string")
    assert rows(profile.date_ranges(df)) == [("data_ref", "2019-05-06 10:00:00", "2021-03-04 00:00:00")]
    assert rows(profile.date_ranges(df.withColumnRenamed("data_ref", "other"))) == []


def test_numeric_stats_and_sample(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    stats = {r[0]: r[1:] for r in rows(profile.numeric_stats(df))}
    assert stats["v"][0] == 2 and stats["v"][1] == -1.0 and stats["v"][3:] == (-3.0, 1.0)
    assert rows(profile.sample_rows(df, ["id"], 1)) == [("NULL", "NULL", "NULL", "12x", "13")]
    assert set(profile.profile(df)) == {"shape", "types", "nulls", "cardinality", "duplicates", "dates", "numeric", "sample"}


def test_findings(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = {(r["kind"], r["column"]): r["quantity"] for r in anomaly.detect(df, ["c"]).collect()}
    assert found == {
        ("muitos_nulos", "v"): 2,
        ("coluna_constante", "c"): None,
        ("valores_negativos", "v"): 1,
        ("ano_fora_faixa", "ano"): 1,
        ("mes_fora_faixa", "mes"): 1,
        ("duplicidade_combinacao", "c"): 3,
    }
    assert anomaly.score(anomaly.detect(df, ["c"])).first()["score"] == 4 + 2 + 3 + 5 + 5 + 6


def test_key_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1), (2, 1), (3, 1)], "a int, b int")
    r = anomaly.key_duplicates(df, ["a", "b"]).first()
    assert (r["quantity"], r["detail"]) == (4, "1")
    assert anomaly.suggest_keys(["x", "user_id", "ano", "name"]) == ["user_id", "ano"]


def test_radar_ranks_and_guards(spark):
    bad = ValueError("no table")
    out = rows(anomaly.radar({"b": spark.createDataFrame(ROWS, SCHEMA), "a": spark.range(3), "z": bad}))
    assert [r[:2] for r in out] == [("b", True), ("a", True), ("z", False)] and out[2][4] == "no table"


def test_radar_survives_a_broken_file(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    broken = spark.read.parquet(str(tmp_path / "t"))
    for part in (tmp_path / "t").glob("*.parquet"):
        raw = bytearray(part.read_bytes())
        raw[4:-40] = bytes(len(raw) - 44)
        part.write_bytes(raw)
    out = rows(anomaly.radar({"broken": broken, "a": spark.range(3)}))
    assert [r[:2] for r in out] == [("a", True), ("broken", False)] and out[1][4]


def test_outliers_of_skipped_and_asked_columns(spark):
    df = spark.createDataFrame([(float(i % 100), float(i % 100) if i else 1e6, -1e6 if i == 7 else float(i)) for i in range(3000)], "flat double, high double, low double")
    assert {r["column"]: r["quantity"] for r in anomaly.iqr_outliers(df).collect()} == {"high": 1, "low": 1}
