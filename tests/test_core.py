import pytest

from millrace.functions.parsing import parse_datetime, parse_number
from millrace.operators import cleaning, combine, profiling, ranks, synthetic, transform
from millrace.operators.profiling import profile_dataframe
from millrace.plans import pipeline, recommend
from millrace.sources import catalog, files
from millrace.streaming import apply
from millrace.types import ROW_ID, DataLossError, Notes, PipelineConfig, column_table, limits, shape, step_row, step_table
from pyspark.sql import functions as F

MESSY = [
    (1, "30", "NYC", "2023-01-01", "true"), (2, "25", "LA", "2023-01-15", "false"), (3, None, "NYC", "2023-02-15", "true"), (4, "45", None, None, "true"),
    (5, "1000", "SF", "2023-03-01", "false"), (6, "28", "NYC", "2023-04-01", "true"), (7, "31", "LA", "2023-05-01", "false"), (8, "29", "SF", "2023-06-01", "true"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, "id long, age string, city string, signup_date string, is_active string")


def test_kinds(messy):
    kinds = {p.column_name: p.kind for p in profile_dataframe(messy)}
    assert kinds == {"id": "numeric", "age": "numeric", "city": "categorical", "signup_date": "datetime", "is_active": "boolean"}


def test_unique_strings_become_identifiers_above_twenty(spark):
    for n, kind in ((20, "categorical"), (21, "identifier")):
        assert profile_dataframe(spark.createDataFrame([(f"u{k}",) for k in range(n)], "u string"))[0].kind == kind


def test_numbers(spark):
    cases = {"5": 5.0, " 5 ": 5.0, "1e5": 1e5, "+3": 3.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf"), "0x10": None, "1,000": None, "1_000": None, "1d": None, "1 2": None, "True": None, "": None, "nan": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_number(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in got} == cases


def test_dates(spark):
    cases = {"2023-01-01": "2023-01-01", "01/02/2023": "2023-01-02", "13/02/2023": "2023-02-13", "Jan 5, 2023": "2023-01-05", "5 January 2023": "2023-01-05", "2023/01/05": "2023-01-05", "20230101": "2023-01-01", "2023": "2023-01-01", "2023-01-01T10:00:00Z": "2023-01-01", "2023-01-01 01:00:00+02:00": "2022-12-31", "2023-13-01": None, "Q1 2023": None, "may": None, "5": None, "now": None, "10:30": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", F.date_format(parse_datetime(F.col("s")), "yyyy-MM-dd").alias("v")).collect()
    assert {r.s: r.v for r in got} == cases


def test_coerce_keeps_rows(messy):
    out, _ = cleaning.coerce_types(messy)
    assert out.count() == 8 and dict(out.dtypes)["age"] == "double"


def test_impute(messy):
    coerced, _ = cleaning.coerce_types(messy)
    out, _ = cleaning.impute_missing(coerced, order_by=["id"])
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 8 and rows[3].age == 30.0 and rows[4].city == "NYC" and str(rows[4].signup_date)[:10] == "2023-02-15"


def test_fill_carries_over_ranges(spark):
    df = spark.range(100).select("id", F.when((F.col("id") % 37 == 20), F.col("id")).alias("v"))
    got = {r.id: r.v for r in cleaning.fill_forward_backward(df, ["v"], ["id"]).collect()}
    assert got == {k: 20 if k < 57 else 57 if k < 94 else 94 for k in range(100)}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    _, report = cleaning.handle_duplicates(df)
    assert "NOT removed" in report.warnings[0]
    assert cleaning.handle_duplicates(df, drop=True)[0].count() == 2


def test_outliers(spark):
    df = spark.createDataFrame([(v,) for v in (10, 12, 11, 13, 12, 11, 500, 12, 10, 13)], "value int")
    assert transform.handle_outliers(df)[0].where("value__is_outlier").count() == 1
    assert transform.handle_outliers(df, default_strategy="clip")[0].agg(F.max("value")).first()[0] == 15.375
    assert transform.handle_outliers(df, default_strategy="remove")[0].count() == 9


def test_encoding(spark):
    colours = spark.createDataFrame([(c,) for c in ("red", "blue", "red", "green", "blue")], "color string")
    assert transform.encode_categoricals(colours)[0].columns == ["color_blue", "color_green", "color_red"]
    tags = spark.createDataFrame([(f"cat_{k % 30:02d}",) for k in range(60)] + [(None,)], "tag string")
    codes = {r.tag for r in transform.encode_categoricals(tags)[0].collect()}
    assert codes == {*range(-1, 30)}
    users = spark.createDataFrame([(f"u{k}",) for k in range(25)], "user_id string")
    out, report = transform.encode_categoricals(users)
    assert out.columns == ["user_id"] and "identifier" in report.warnings[0]


def test_scaling(spark):
    df = spark.createDataFrame([(k % 2, 10.0 * (k + 1)) for k in range(5)], "flag int, value double")
    out = transform.scale_features(df)[0].agg(F.avg("value").alias("m"), F.max("flag").alias("f")).first()
    assert abs(out.m) < 1e-9 and out.f == 1
    assert transform.scale_features(df, method="minmax")[0].agg(F.min("value"), F.max("value")).first() == (0.0, 1.0)
    assert transform.scale_features(df, method="none")[0] is df


def test_default_pipeline(messy):
    out, trail = pipeline.run_pipeline(messy, order_by=["id"])
    assert out.columns == ["id", "age", "city_LA", "city_NYC", "city_SF", "signup_date", "is_active", "age__is_outlier", *(f"signup_date__{p}" for p in ("year", "month", "day", "weekday"))]
    assert all(s.rows_after == s.rows_before for s in trail) and trail[-1].nulls_after == 0


def test_pipeline_counts_dropped_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "a int, b string")
    _, trail = pipeline.run_pipeline(df, PipelineConfig(dedupe=True), order_by=["a"])
    assert [s.rows_after - s.rows_before for s in trail if s.step == "handle_duplicates"] == [-1]


def test_concat_and_multi_source(spark):
    a = spark.createDataFrame([(1, "3", "NYC"), (2, "4", "LA"), (3, "5", "SF")], "id int, age string, city string")
    b = spark.createDataFrame([(4, "6"), (5, "7")], "id int, age string")
    both, _ = combine.combine_datasets([("a", a), ("b", b)])
    assert both.count() == 5 and both.columns == ["id", "age", "city", "__source_file"]
    _, trail = pipeline.run_pipeline_multi_source([("a", a), ("b", b)], order_by=["id"])
    assert trail[0].step == "combine_datasets"


def test_merge_rejects_bad_requests(spark):
    a = spark.createDataFrame([(1,)], "id int")
    for kwargs in ({"mode": "merge"}, {"mode": "merge", "on": ["x"]}, {"mode": "zip"}):
        with pytest.raises(ValueError):
            combine.combine_datasets([("a", a), ("b", a)], **kwargs)


def test_lost_rows_raise():
    step = step_row("x", "x", shape(3, {}, {}), shape(2, {}, {}), Notes(), 0.0)
    with pytest.raises(DataLossError):
        pipeline.check_rows(step)


def test_augmentation_keeps_source(spark):
    df = spark.createDataFrame([(k, f"c{k % 3}") for k in range(30)], "id long, c string")
    out, step = pipeline.run_synthetic_augmentation(df, n_rows=10, seed=1)
    assert out.count() == 40 and step.rows_after - step.rows_before == 10 and df.exceptAll(out).count() == 0


def test_recommendations(spark):
    cls = spark.createDataFrame([(20 + k * 3, 1000 + k * 70, ("yes", "no")[k % 2]) for k in range(8)], "age int, income int, label string")
    r = recommend.recommend_algorithms(cls)
    assert (r.target, r.problem) == ("label", "binary_classification")
    assert [a.name for a in r.algorithms] == ["Random Forest", "Logistic Regression", "Support Vector Machine", "K-Nearest Neighbors", "Gradient Boosting", "Naive Bayes"]
    imbalanced = spark.createDataFrame([(k, "a" if k < 2 else "b") for k in range(20)], "feature int, label string")
    assert any("imbalanced" in n for n in recommend.recommend_algorithms(imbalanced).notes)
    with pytest.raises(ValueError):
        recommend.recommend_algorithms(cls, "nope")


def test_ingest(spark, tmp_path):
    from millrace.sources.files import ingest

    path = tmp_path / "a.csv"
    path.write_text('a;b\n1;x\nNA;" "\n3;"y;z"\n')
    result = ingest(spark, str(path))
    assert result.delimiter == ";" and ROW_ID in result.dataframe.columns
    assert [tuple(r) for r in result.dataframe.select("a", "b").collect()] == [("1", "x"), (None, None), ("3", "y;z")]


@pytest.mark.parametrize(("late", "encoding", "value"), [("é€".encode("cp1252"), "cp1252", "é€"), (b"\xe9\x81", "latin1", "é\x81"), ("é€".encode(), "utf-8", "é€")])
def test_encoding_is_found_over_the_whole_file(spark, tmp_path, late, encoding, value):
    path = tmp_path / "late.csv"
    path.write_bytes(b"k,v\n" + b"".join(b"%d,%s\n" % (k, b"x" * 50) for k in range(25_000)) + b"25000," + late + b"\n")
    assert path.stat().st_size > files.HEAD_BYTES
    got = files.ingest(spark, str(path))
    assert got.encoding == encoding
    assert [r.v for r in got.dataframe.where("k = '25000'").collect()] == [value]


def test_ingest_query_reads_every_part_file(spark, tmp_path):
    from millrace import queries

    spark.range(0, 3000, 1, 3).selectExpr("id AS n_nationkey", "'n' AS n_name").write.parquet(str(tmp_path / "nation.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = queries.queries()["ingest_csv"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(int(r.n_nationkey) for r in got) == list(range(3000))


def filled_by_force(values):
    last, out = None, []
    for v in values:
        last = v if v is not None else last
        out.append(last)
    first = next((v for v in values if v is not None), None)
    return [first if v is None else v for v in out]


def test_fill_of_many_rows_with_other_columns(spark):
    n = 100_000
    gap = lambda k, head, every: None if k < head or k % every == 0 or 30_000 < k < 62_000 else k
    df = spark.range(n, numPartitions=7).select("id", (F.col("id") * 7 % 1000).alias("other"), F.concat(F.lit("t"), "id").alias("text"),
        F.when(~((F.col("id") < 27_001) | (F.col("id") % 3 == 0) | F.col("id").between(30_001, 61_999)), F.col("id")).alias("a"),
        F.when(~((F.col("id") < 5) | (F.col("id") % 11 == 0) | F.col("id").between(30_001, 61_999)), F.col("id")).alias("b"), F.lit(None).cast("int").alias("never"))
    got = {r.id: (r.other, r.text, r.a, r.b, r.never) for r in cleaning.fill_forward_backward(df, ["a", "b", "never"], ["id"]).collect()}
    a, b = (filled_by_force([gap(k, head, every) for k in range(n)]) for head, every in ((27_001, 3), (5, 11)))
    assert len(got) == n and all(got[k] == (k * 7 % 1000, f"t{k}", a[k], b[k], None) for k in range(n))


def test_row_numbers_and_quantiles(spark):
    df = spark.range(1000, numPartitions=5).select(((F.col("id") * 37) % 1000).alias("v"), F.when(F.col("id") < 10, F.col("id").cast("double")).alias("w"), F.lit(None).cast("double").alias("none"))
    assert all(r.v == r.n for r in ranks.number_rows(df.select("v"), ["v"], "n").collect())
    assert sorted(r.n for r in ranks.number_rows(df.select("v"), name="n").collect()) == [*range(1000)]
    assert ranks.quantiles(df, {"v": F.col("v"), "w": F.col("w"), "none": F.col("none")}, (0.25, 0.5, 1.0)) == {"v": [249.75, 499.5, 999.0], "w": [2.25, 4.5, 9.0]}


def test_profiles_with_many_values_take_the_sort(spark, monkeypatch):
    df = spark.createDataFrame([(float(v),) for v in (10, 12, 11, 13, 12, 11, 500, 12, 10, 13)], "value double")
    direct = profile_dataframe(df)[0]
    monkeypatch.setattr(profiling, "PERCENTILE_VALUES", 3)
    sorted_ = profile_dataframe(df)[0]
    assert direct.stats == sorted_.stats and [direct.stats[k] for k in ("q1", "median", "q3")] == [11.0, 12.0, 12.75] and limits(direct) == (8.375, 15.375) and sorted_.n_outliers == 1


def test_profile_names_outlying_rows_and_samples(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((10, 12, 11, 13, 12, 11, 500, 12, 10, 13))], f"{ROW_ID} long, value int")
    p = profile_dataframe(df, samples=True)[0]
    assert p.outlier_rows == ["6"] and p.samples == ["10", "12", "11", "13", "500"]


def test_many_labels_are_numbered_without_a_map(spark, monkeypatch):
    monkeypatch.setattr(transform, "LABEL_JOIN_VALUES", 5)
    df = spark.createDataFrame([(k, f"cat_{k % 30:02d}") for k in range(120)] + [(200, None)], "k int, tag string")
    got = {r.k: r.tag for r in transform.encode_categoricals(df)[0].collect()}
    assert got == {k: k % 30 for k in range(120)} | {200: -1}
    assert len(transform.encode_categoricals(df, overrides={"tag": "one_hot"})[0].columns) == 31


def test_outlier_warnings_and_removed_rows(spark):
    df = spark.createDataFrame([(v,) for v in (10, 12, 11, 13, 12, 11, 500, 12, 10, 13)], "value int")
    assert "left as they are" in transform.handle_outliers(df, default_strategy="skip")[1].warnings[0]
    assert "unknown" in transform.handle_outliers(df, default_strategy="burn")[1].warnings[0]
    assert transform.handle_outliers(df, default_strategy="remove")[1].details[-1]["rows_removed"] == 1


def test_merge_accounts_for_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, x string")
    b = spark.createDataFrame([(2, "d"), (3, "e"), (None, "f")], "id int, y string")
    out, report = combine.combine_datasets([("a", a), ("b", b)], mode="merge", on=["id"])
    d = report.details[0]
    assert (out.count(), d["rows_before"], d["rows_produced"], d["unmatched_left"], d["unmatched_right"], d["null_key_rows"]) == (4, 3, 4, 1, 1, 1)
    assert "4" in report.warnings[0]


def test_catalog_keeps_lineage(spark):
    parent = catalog.register(spark.range(3).toDF("x"), "raw")
    child = catalog.register(catalog.get(spark, parent).where("x > 0"), "clean", parent=parent, warnings=["one"])
    noted = {r.view: r for r in catalog.datasets(spark).collect()}
    assert noted[child].parent == parent and catalog.summary(spark, child)["rows"] == 2
    with pytest.raises(KeyError):
        catalog.get(spark, "dataset_none")


def test_many_files_and_json_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    (tmp_path / "b.json").write_text('[{"created_at": "2024-01-02", "date": "soon"}, {"created_at": null, "date": "2024-01-01"}]')
    found = files.ingest_all(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")])
    assert [r.b for r in found[0][1].dataframe.collect()] == ["two\nlines", "x"]
    assert {c: t for c, t in found[1][1].dataframe.dtypes if c != ROW_ID} == {"created_at": "timestamp_ntz", "date": "string"}
    assert catalog.get(spark, found[0][0]).count() == 2
    with pytest.raises(ValueError):
        files.ingest_all(spark, [str(tmp_path / "gone.csv")])
    assert files.cleaned_name("sales.v2.csv", "json") == "sales.v2_cleaned.json"


def test_duplicates_count_nan_as_null_and_are_dropped_as_counted(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.0), (4, -0.0)], "k int, v double")
    for case in (dict(df=df, subset=["v"], order_by=["k"]), dict(df=df.select("v"))):
        out, notes = cleaning.handle_duplicates(case.pop("df"), drop=True, **case)
        assert notes.details[0]["duplicate_count"] == 2 and out.count() == 2
    assert {r.k for r in cleaning.handle_duplicates(df, drop=True, subset=["v"], order_by=["k"])[0].collect()} == {1, 3}
    assert {r.k: r["__duplicate"] for r in cleaning.duplicate_flags(df, ["v"], ["k"]).collect()} == {1: False, 2: True, 3: False, 4: True}
    assert cleaning.handle_duplicates(df.where("false"), drop=True)[0].count() == 0


def test_duplicates_without_an_order_of_their_own(spark, monkeypatch):
    df = spark.range(3000, numPartitions=6).select((F.col("id") % 7).alias("a"), F.lit(1).alias("b"), F.when(F.col("id") % 2 == 0, "x").alias("c"))
    for limit in (cleaning.SMALL_ROWS, 0):
        monkeypatch.setattr(cleaning, "SMALL_ROWS", limit)
        assert cleaning.handle_duplicates(df, drop=True)[0].count() == 14
        assert cleaning.handle_duplicates(df, drop=True, subset=["a"], order_by=["b"])[0].count() == 7  # all are equal in the order
        assert cleaning.duplicate_flags(df, ["a"], ["b"]).where("not __duplicate").count() == 7


def test_quantiles_where_half_of_the_values_are_equal(spark):
    df = spark.range(20_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(2.0).alias("w"))
    values = sorted(5.0 if k % 2 == 0 else float(k) for k in range(20_000))
    at = lambda p: values[int((len(values) - 1) * p)] + (values[min(int((len(values) - 1) * p) + 1, len(values) - 1)] - values[int((len(values) - 1) * p)]) * ((len(values) - 1) * p % 1)
    got = ranks.quantiles(df, {"v": F.col("v"), "w": F.col("w")}, (0.0, 0.3, 0.51, 0.9, 1.0))
    assert got["w"] == [2.0] * 5 and got["v"] == pytest.approx([at(p) for p in (0.0, 0.3, 0.51, 0.9, 1.0)])


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_counts_as_the_join_does(spark, how):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (None, "c"), (9, "z")], "id int, x string")
    b = spark.createDataFrame([(2, "d"), (3, "e"), (None, "f"), (None, "g")], "id int, y string")
    out, notes = combine.combine_datasets([("a", a), ("b", b)], mode="merge", on=["id"], how=how)
    d, n = notes.details[0], out.count()
    assert n == {"inner": 4, "left": 6, "right": 5, "outer": 7}[how] == d["rows_produced"]
    assert (d["unmatched_left"], d["unmatched_right"], d["null_key_rows"]) == (2, 1, 0 if how == "inner" else 2)
    assert sorted(out.columns) == ["id", "x", "y"]


def test_dates_by_fields(spark):
    cases = {"Jan 5, 2024 10:30 PM": "2024-01-05 22:30", "5 January 2023 08:00": "2023-01-05 08:00", "12/31/2023 12:05 am": "2023-12-31 00:05", "31/12/2023 12:05PM": "2023-12-31 12:05", "2023-01-01 13:00 PM": None, "2023-02-29": None, "29 Feb 2024": "2024-02-29 00:00", "Sept 3 2021": "2021-09-03 00:00", "Janu 3 2021": None, "05-Mar-2020 23:59:59.123456789": "2020-03-05 23:59", "2020-01-01 24:00": None, "2020-01-01 00:00:00-0330": "2020-01-01 03:30", "": None, "1/2/20": None, "2020-1-2 3:4": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", F.date_format(parse_datetime(F.col("s")), "yyyy-MM-dd HH:mm").alias("v")).collect()
    assert {r.s: r.v for r in got} == cases


def test_text_datetimes_are_drawn_from_their_span(spark):
    df = spark.createDataFrame([(f"2024-01-{1 + k % 20:02d}",) for k in range(60)], "day string")
    made, _ = synthetic.generate_synthetic(df, n_rows=50, seed=3)
    low, high = made.agg(F.min("day"), F.max("day")).first()
    assert dict(made.dtypes)["day"] == "timestamp_ntz" and str(low) >= "2024-01-01" and str(high) < "2024-01-20 00:00:01" and made.distinct().count() > 20


def test_fitted_steps_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((10.0, 12.0, 11.0, 13.0, 12.0, 11.0, 500.0, 12.0, None, 13.0))], "id int, value double")
    df.write.parquet(str(tmp_path / "in"))
    fills = cleaning.impute_missing(df)[1]
    flags = transform.handle_outliers(df, columns=["value"])[1]
    scaling = transform.scale_features(df, columns=["value"])[1]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = apply.apply_scaling(apply.apply_outlier_flags(apply.apply_fills(stream, fills), flags), scaling)
    query = out.writeStream.format("memory").queryName("fitted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {r.id: r for r in spark.table("fitted").collect()}
    assert len(got) == 10 and [k for k, r in got.items() if r.value__is_outlier] == [6]
    d = scaling.details[0]
    assert abs(got[8].value - (12.0 - d["center"]) / d["scale"]) < 1e-9


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:07")], "k int, at string").selectExpr("k", "cast(at AS timestamp) AS at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    query = apply.drop_repeats(stream, ["k"], "at", "1 minute").writeStream.format("memory").queryName("repeats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert sorted(r.k for r in spark.table("repeats").collect()) == [1, 2]


def test_class_counts_and_trail_table(spark):
    df = spark.createDataFrame([(k, "a" if k < 4 else "b") for k in range(20)], "feature int, label string")
    assert {r["class"]: r.n for r in recommend.class_balance(df, "label")["class_counts"].collect()} == {"b": 16, "a": 4}
    _, trail = pipeline.run_pipeline(df, order_by=["feature"])
    assert [r.step for r in step_table(spark, trail).orderBy("position").collect()] == [s.step for s in trail]
    assert column_table(spark, trail).count() > 0


def test_kinds_are_those_of_profiles_and_count_few_columns(spark, monkeypatch):
    from millrace.operators import profiling

    sql = """SELECT id, id % 3 = 0 AS flag, CAST(id AS STRING) AS digits, concat('name', id) AS name, concat('c', id % 3) AS word, '2024-01-15' AS day,
        CAST(NULL AS STRING) AS nothing, array(id) AS listed, CAST(id AS DOUBLE) AS number, timestamp_ntz '2024-01-15 00:00:00' AS moment FROM range(200)"""
    df, asked, real = spark.sql(sql), [], profiling.distinct_counts
    expected = {p.column_name: p.kind for p in profiling.profile_dataframe(df)}
    monkeypatch.setattr(profiling, "distinct_counts", lambda table, names: asked.extend(names) or real(table, names))
    assert profiling.kinds(df) == expected
    assert {*asked} == {"name", "word"}
    assert profiling.kinds(df.limit(0)) == {p.column_name: p.kind for p in profiling.profile_dataframe(df.limit(0))}
