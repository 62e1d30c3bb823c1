"""A query for each operator over the given tables, and the DuckDB SQL for its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parsing import parse_datetime
from .operators import cleaning, combine, synthetic, transform
from .operators.profiling import kinds, outlier_rows, profile_dataframe, shape_of, visible
from .operators.ranks import quantiles
from .plans import pipeline, recommend
from .sources import catalog, files, single
from .storage import shared_dir
from .types import PipelineConfig, profile_table, step_table

# Tables with gaps and dirt, derived from the given ones; the text is valid in both engines.
VIEWS = {
    "messy_events": """SELECT event_id, ts, user_id,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts_gap,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 2 = 0 END AS flag FROM events""",
    "messy_strings": """SELECT event_id,
        CASE WHEN event_id % 50 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN '   ' ELSE CAST((event_id * 37) % 1000 AS STRING) END AS num_str,
        CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN ' f ' ELSE NULL END AS bool_str,
        CASE event_id % 4 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '15/02/2024' WHEN 2 THEN '03/04/2024' ELSE 'Jan 5, 2024' END AS date_str,
        CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type END AS cat_str FROM events""",
    "nation_nullkey": "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_regionkey END AS rk FROM nation",
    "region_nullkey": "SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS rk, r_name FROM region",
    "messy_labels": "SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality_gap FROM labels",
}
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of VIEWS over given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = VIEWS[name].rsplit(" ", 1)[1]
    return spark.sql(VIEWS[name].rsplit(" ", 1)[0] + " {t}", t=load(spark, sf_dir, base))


def query(name: str, sql: str | None = None):
    """Registers a function of (load, spark) under a name, with its SQL."""
    def register(make: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]):
        _queries[name] = lambda spark, sf_dir: make(partial(load, spark, sf_dir), spark)
        if sql:
            used = {v: f"({t})" for v, t in VIEWS.items() if v in sql}
            _oracles[name] = ("WITH " + ", ".join(f"{v} AS {t}" for v, t in used.items()) + " " + sql) if used else sql
        return make

    return register


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# --- sources and sinks ---

@query("ingest_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(t, spark):
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}.csv"
    files.write(t("nation"), path, "csv")
    parts = sorted(spark.read.option("header", True).csv(path).inputFiles())
    read = [files.ingest(spark, part).dataframe for part in parts]
    return reduce(DataFrame.unionByName, (df.select(*visible(df)) for df in read))


@query("blank_to_null", "SELECT event_id, CASE WHEN regexp_full_match(num_str, '\\s*') THEN NULL ELSE num_str END AS num_str, CASE WHEN regexp_full_match(cat_str, '\\s*') THEN NULL ELSE cat_str END AS cat_str FROM messy_strings")
def _(t, spark):
    return files.normalised(t("messy_strings").select("event_id", "num_str", "cat_str"))


@query("preview_head", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id LIMIT 50")
def _(t, spark):
    return files.preview(t("events").select("event_id", "event_type", "user_id"), 50, ["event_id"])


@query("dataset_summary", "SELECT count(*) AS n_rows, (SELECT count(*)::INT FROM (DESCRIBE customer)) AS n_columns, 'customer' AS name, (SELECT string_agg(column_name, ',') FROM (DESCRIBE customer)) AS columns, NULL AS parent, 0 AS n_warnings FROM customer")
def _(t, spark):
    s = catalog.summary(spark, catalog.register(t("customer"), "customer"))
    return rows(spark, [(s["rows"], len(s["columns"]), s["name"], ",".join(s["columns"]), s["parent"], len(s["warnings"]))], "n_rows long, n_columns int, name string, columns string, parent string, n_warnings int")


def _fresh(spark, extension: str) -> str:
    return f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}.{extension}"


@query("ingest_misfits", "SELECT o_orderkey, (3 + (o_orderkey % 11 = 0)::INT + (o_orderkey % 13 = 0)::INT)::INT AS fields FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def _(t, spark):
    """Records with more fields than the header; a delimiter inside quotes makes no field, an empty last field is one, and short records are no misfits."""
    key, path = F.col("o_orderkey"), _fresh(spark, "csv")
    line = F.concat(key.cast("string"), F.when(key % 7 == 0, F.lit("")).otherwise(F.lit(',"a,b"')), F.when((key % 7 == 0) & (key % 11 != 0) & (key % 13 != 0), F.lit("")).otherwise(F.when(key % 7 == 0, F.lit(",c,d")).otherwise(F.lit(',"say ""x, y"""'))), F.when(key % 11 == 0, F.lit(",more")).otherwise(F.lit("")), F.when(key % 13 == 0, F.lit(",")).otherwise(F.lit("")))
    single.write_lines(t("orders").select(line.alias("value")), path, before="key,one,two\n")
    return files.misfits(spark, path, 3).select(F.split("record", ",")[0].cast("long").alias("o_orderkey"), "fields")


@query("ingest_json_array", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '}{\"[' || c_mktsegment END AS sign FROM customer")
def _(t, spark):
    path = _fresh(spark, "json")
    marked = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('}{"['), "c_mktsegment"))
    files.write(t("customer").select("c_custkey", "c_name", "c_acctbal", marked.alias("sign")), path, "json", ["c_custkey"])
    df = files.ingest(spark, path).dataframe
    return df.select(*visible(df))


@query("ingest_xlsx", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '<&' || s_name END AS sign FROM supplier")
def _(t, spark):
    path = _fresh(spark, "xlsx")
    files.write(t("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("<&"), "s_name")).alias("sign")), path, "xlsx", ["s_suppkey"])
    df = files.ingest(spark, path).dataframe
    return df.select(*visible(df))


@query("download_csv", "SELECT 'orders_cleaned.csv' AS name, 1::BIGINT AS n_files, count(*) AS n_rows, 1 AS first_key FROM orders")
def _(t, spark):
    """One file of many parts, in order, under its own name."""
    folder = f"{shared_dir(spark)}/download-{uuid.uuid4().hex}"
    path = files.download(t("orders").repartition(7).select("o_orderkey", "o_totalprice"), folder, "orders.csv", "csv", ["o_orderkey"])
    back = spark.read.option("header", True).csv(path)
    first = int(back.first().o_orderkey) - t("orders").agg(F.min("o_orderkey")).first()[0] + 1
    return rows(spark, [(path.rsplit("/", 1)[1], len(back.inputFiles()), back.count(), first)], "name string, n_files long, n_rows long, first_key int")


@query("dataset_trail", "SELECT k AS position, step, count(*) AS rows_after, 'nation' AS parent FROM nation, (VALUES (0, 'coerce_types'), (1, 'impute_missing'), (2, 'handle_duplicates'), (3, 'handle_outliers'), (4, 'encode_categoricals'), (5, 'engineer_features'), (6, 'scale_features')) s(k, step) GROUP BY k, step")
def _(t, spark):
    """The steps that made a registered dataset, and what it was derived from, as the log has them."""
    raw = catalog.register(t("nation"), "nation")
    out, trail = pipeline.run_pipeline(catalog.get(spark, raw), order_by=["n_nationkey"])
    view = catalog.register(out, "nation", parent=raw, trail=step_table(spark, trail))
    return catalog.audit_trail(spark, view).select("position", "step", "rows_after", F.lit(catalog.ancestors(spark, view)[0]).alias("parent"))


# --- profiling ---

def _profiles(t, *names: str) -> list:
    return [(n, p) for n in names for p in profile_dataframe(t(n))]


def _counts_sql(name: str, columns: list[str], select: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.format(c=c)} FROM {name}" for c in columns)


EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "ts_gap", "flag"]


@query("profile_counts", _counts_sql("messy_events", EVENTS, "count({c}) AS non_null, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS null_ratio"))
def _(t, spark):
    return rows(spark, [(p.column_name, p.non_null, p.nulls, round(p.null_ratio, 4)) for _, p in _profiles(t, "messy_events")], "column_name string, non_null long, nulls long, null_ratio double")


@query("profile_distinct", _counts_sql("messy_events", EVENTS, "count(DISTINCT {c}) AS n_unique"))
def _(t, spark):
    return rows(spark, [(p.column_name, p.n_unique) for _, p in _profiles(t, "messy_events")], "column_name string, n_unique long")


@query("profile_samples", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS sample FROM (SELECT {c}, min(event_id) AS f FROM messy_events WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY f LIMIT 5))" for c in ("event_type",)))
def _(t, spark):
    p = profile_dataframe(t("messy_events"), ["event_type"], ["event_id"], samples=True)
    return rows(spark, [(x.column_name, v) for x in p for v in x.samples], "column_name string, sample string")


NUMBER_SQL = "regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


@query("profile_numeric_ratio", f"SELECT round(avg(CASE WHEN {NUMBER_SQL.format(c='num_str')} THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM messy_strings WHERE num_str NOT LIKE ' %'")
def _(t, spark):
    p = profile_dataframe(files.normalised(t("messy_strings")), ["num_str"])[0]
    return rows(spark, [(round(p.numeric_ratio, 6),)], "ratio double")


SOME_DATES = "CASE WHEN event_id % 5 = 0 THEN concat('on ', date_str) WHEN event_id % 7 = 0 THEN '2024-13-40' ELSE date_str END"
IS_DATE = "coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%b %-d, %Y')) IS NOT NULL"


@query("profile_datetime_ratio", f"SELECT round(avg(CASE WHEN {IS_DATE.format(c='d')} THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM (SELECT {SOME_DATES} AS d FROM messy_strings)")
def _(t, spark):
    p = profile_dataframe(t("messy_strings").select(F.expr(SOME_DATES).alias("d")))[0]
    return rows(spark, [(round(p.datetime_ratio, 6),)], "ratio double")


@query("profile_is_boolean", "SELECT bool_and(lower(trim(bool_str)) IN ('true','t','yes','y','1','false','f','no','n','0')) AS is_boolean FROM messy_strings")
def _(t, spark):
    return rows(spark, [(profile_dataframe(t("messy_strings"), ["bool_str"])[0].kind == "boolean",)], "is_boolean boolean")


KINDS_SQL = {
    "events": {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": None, "value": "numeric", "props": None},
    "customer": {"c_custkey": "numeric", "c_name": None, "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": None},
    "messy_strings": {"event_id": "numeric", "num_str": "numeric", "bool_str": "boolean", "date_str": "datetime", "cat_str": None},
}


def _kind_sql() -> str:
    out = []
    for name, kinds in KINDS_SQL.items():
        for c, kind in kinds.items():
            case = f"'{kind}'" if kind else f"(SELECT CASE WHEN count(DISTINCT {c}) = count({c}) AND count({c}) > 20 THEN 'identifier' WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) <= 0.5 * count({c}) THEN 'categorical' ELSE 'text' END FROM {name})"
            out.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, {case} AS kind")
    return " UNION ALL ".join(out)


def _kinds(t, spark):
    found = [(n, c, kind) for n in KINDS_SQL for c, kind in kinds(files.normalised(t(n))).items()]
    return rows(spark, found, "table_name string, column_name string, kind string")


query("profile_kind", _kind_sql())(_kinds)
query("kind_histogram", f"SELECT kind, count(*) AS n FROM ({_kind_sql()}) GROUP BY kind")(lambda t, spark: _kinds(t, spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))

STATS_SQL = "min({c}) AS lowest, max({c}) AS highest, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(coalesce(stddev_samp({c}), 0), 4) AS std"


@query("profile_stats", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {STATS_SQL.format(c=f'CAST({c} AS DOUBLE)')} FROM events" for c in ("event_id", "user_id", "value")))
def _(t, spark):
    found = [(p.column_name, *(round(p.stats[k], 4) if k in ("mean", "median", "std") else p.stats[k] for k in ("min", "max", "mean", "median", "std"))) for p in profile_dataframe(t("events")) if p.kind == "numeric"]
    return rows(spark, found, "column_name string, lowest double, highest double, mean double, median double, std double")


BOUNDS = "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"
OUTSIDE = "({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AND q1 <> q3"


def _outlier_sql(select: str, t: str, c: str, where: str) -> str:
    return f"SELECT {select} FROM {t}, {BOUNDS.format(c=c, t=t)} b WHERE {where.format(o=OUTSIDE.format(c=c))}"


@query("profile_outliers", _outlier_sql("'value' AS column_name, count(*) AS n_outliers", "events", "value", "{o}"))
def _(t, spark):
    return rows(spark, [(p.column_name, p.n_outliers) for p in profile_dataframe(t("events"), ["value"])], "column_name string, n_outliers long")


query("outlier_summary", _outlier_sql("'value' AS column_name, count(*) AS n_outliers", "events", "value", "{o}"))(
    lambda t, spark: rows(spark, [*recommend.answer_question("outliers?", t("events"), "events")["data"].items()], "column_name string, n_outliers long")
)


@query("outlier_rows", _outlier_sql("event_id", "events", "value", "{o}") + " ORDER BY event_id LIMIT 100")
def _(t, spark):
    return outlier_rows(t("events"), profile_dataframe(t("events"), ["value"])[0], ["event_id"])


@query("snapshot_nulls", _counts_sql("messy_events", EVENTS, "count(*) AS n_rows, count(*) - count({c}) AS nulls"))
def _(t, spark):
    s = shape_of(t("messy_events"))
    return rows(spark, [(c, s.n_rows, n) for c, n in s.nulls.items()], "column_name string, n_rows long, nulls long")


@query("quality_summary", "SELECT sum(n) AS nulls, count(*) FILTER (WHERE n > 0) AS columns_hit FROM (" + _counts_sql("messy_events", EVENTS, "count(*) - count({c}) AS n") + ")")
def _(t, spark):
    gaps = recommend.answer_question("missing values?", t("messy_events"), "messy_events")["data"]
    return rows(spark, [(sum(gaps.values()), len(gaps))], "nulls long, columns_hit long")


@query("profile_all", _counts_sql("messy_events", EVENTS, "count({c}) AS non_null, count(DISTINCT {c}) AS n_unique"))
def _(t, spark):
    return rows(spark, [(p.column_name, p.non_null, p.n_unique) for p in profile_dataframe(t("messy_events"))], "column_name string, non_null long, n_unique long")


_HALF = "CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE l_extendedprice END"


@query("quantiles_skewed", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round(quantile_cont(v, {p}), 4) AS v FROM (SELECT {_HALF} AS v FROM lineitem)" for p in (0.1, 0.25, 0.5, 0.75, 0.99)))
def _(t, spark):
    """Half of the values are equal; the distributed selection, whatever the number of values."""
    wanted = (0.1, 0.25, 0.5, 0.75, 0.99)
    found = quantiles(t("lineitem"), {"v": F.expr(_HALF)}, wanted)["v"]
    return rows(spark, [(p, round(x, 4)) for p, x in zip(wanted, found)], "p double, v double")


# --- coercion ---

NUM_SQL = f"CASE WHEN {NUMBER_SQL.format(c='num_str')} THEN CAST(trim(num_str) AS DOUBLE) END"
BOOL_SQL = "CASE WHEN lower(trim(bool_str)) IN ('true','t','yes','y','1') THEN true WHEN lower(trim(bool_str)) IN ('false','f','no','n','0') THEN false END"
DATE_SQL = "CASE event_id % 4 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '2024-02-15' WHEN 2 THEN '2024-03-04' ELSE '2024-01-05' END"


def _coerced(t):
    return cleaning.coerce_types(files.normalised(t("messy_strings")))


query("coerce_numeric", f"SELECT event_id, {NUM_SQL} AS num_str FROM messy_strings")(lambda t, spark: _coerced(t)[0].select("event_id", "num_str"))
query("coerce_boolean", f"SELECT event_id, {BOOL_SQL} AS bool_str FROM messy_strings")(lambda t, spark: _coerced(t)[0].select("event_id", "bool_str"))
query("coerce_datetime", f"SELECT event_id, {DATE_SQL} AS day FROM messy_strings")(lambda t, spark: _coerced(t)[0].select("event_id", F.date_format("date_str", "yyyy-MM-dd").alias("day")))
query("coerce_types", f"SELECT 'num_str' AS column_name, count(*) FILTER (WHERE num_str = 'bad') AS failed FROM messy_strings UNION ALL SELECT 'bool_str', count(bool_str) FILTER (WHERE {BOOL_SQL} IS NULL) FROM messy_strings UNION ALL SELECT 'date_str', count(date_str) FILTER (WHERE NOT ({IS_DATE.format(c='date_str')})) FROM messy_strings UNION ALL SELECT 'event_id', count(*) - count(event_id) FROM messy_strings")(
    lambda t, spark: rows(spark, [(d["column"], d["failed_count"]) for d in _coerced(t)[1].details], "column_name string, failed long")
)

# Forms of one moment: the pattern that writes it, and what is left of the moment.
FORMS = (("MMM d, yyyy hh:mm a", "date_trunc('minute', ts)"), ("d MMMM yyyy HH:mm", "date_trunc('minute', ts)"), ("M/d/yyyy hh:mm:ss a", "date_trunc('second', ts)"), ("yyyy-MM-dd'T'HH:mm:ss'+02:30'", "date_trunc('second', ts) - INTERVAL 150 MINUTE"), ("dd-MMM-yyyy", "date_trunc('day', ts)"))


@query("coerce_datetime_forms", f"SELECT event_id, strftime(CASE event_id % {len(FORMS)} {' '.join(f'WHEN {k} THEN {e}' for k, (_, e) in enumerate(FORMS))} END, '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def _(t, spark):
    text = F.lit(None)
    for k, (form, _) in enumerate(FORMS):
        text = F.when(F.col("event_id") % len(FORMS) == k, F.date_format("ts", form)).otherwise(text)
    return t("events").select("event_id", F.date_format(parse_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("moment"))


# --- imputation ---

MEDIAN = "(SELECT quantile_cont(value, 0.5) FROM messy_events)"
MODE = "(SELECT event_type FROM messy_events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)"


def _imputed(column: str, strategy: str):
    def make(t, spark):
        df = t("messy_events").select("event_id", column)
        return cleaning.impute_missing(df, overrides={column: strategy}, order_by=["event_id"])[0]

    return make


query("impute_mean", "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM messy_events)), 6) AS value FROM messy_events")(lambda t, spark: _imputed("value", "mean")(t, spark).withColumn("value", F.round("value", 6)))
query("impute_median", f"SELECT event_id, round(coalesce(value, {MEDIAN}), 6) AS value FROM messy_events")(lambda t, spark: _imputed("value", "median")(t, spark).withColumn("value", F.round("value", 6)))
query("impute_mode", f"SELECT event_id, coalesce(event_type, {MODE}) AS event_type FROM messy_events")(_imputed("event_type", "mode"))
query("impute_constant", "SELECT event_id, coalesce(value, 7.5) AS value FROM messy_events")(_imputed("value", "constant:7.5"))
query("impute_skip", "SELECT event_id, value FROM messy_events")(_imputed("value", "skip"))
query("impute_ffill_bfill", "SELECT event_id, coalesce(event_type, last_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS event_type FROM messy_events")(_imputed("event_type", "ffill_bfill"))

FILLED = "coalesce({c}, last_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
query("impute_ffill_all", f"SELECT event_id, ts, user_id, {FILLED.format(c='event_type')} AS event_type, value, {FILLED.format(c='ts_gap')} AS ts_gap, {FILLED.format(c='flag')} AS flag FROM messy_events")(
    lambda t, spark: cleaning.fill_forward_backward(t("messy_events"), ["event_type", "ts_gap", "flag"], ["event_id"])
)
query("impute_inapplicable", "SELECT event_id, event_type FROM messy_events")(_imputed("event_type", "mean"))


@query("impute_report", "SELECT 'value' AS column_name, 'median' AS strategy, count(*) - count(value) AS filled FROM messy_events UNION ALL SELECT 'event_type', 'mode', count(*) - count(event_type) FROM messy_events UNION ALL SELECT 'flag', 'mode', count(*) - count(flag) FROM messy_events UNION ALL SELECT 'ts_gap', 'ffill_bfill', count(*) - count(ts_gap) FROM messy_events")
def _(t, spark):
    report = cleaning.impute_missing(t("messy_events"), order_by=["event_id"])[1]
    return rows(spark, [(d["column"], d["strategy"], d["filled_count"]) for d in report.details], "column_name string, strategy string, filled long")


# --- duplicates ---

query("dup_count", "SELECT count(*) - count(DISTINCT text) AS n FROM documents")(
    lambda t, spark: rows(spark, [(cleaning.handle_duplicates(t("documents"), subset=["text"], order_by=["doc_id"])[1].details[0]["duplicate_count"],)], "n long")
)
query("dup_indices", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1 ORDER BY doc_id LIMIT 200")(
    lambda t, spark: cleaning.duplicate_flags(t("documents"), ["text"], ["doc_id"]).where("__duplicate").select("doc_id").orderBy("doc_id").limit(200)
)
query("dedupe_all", "SELECT DISTINCT lang, source FROM documents")(lambda t, spark: cleaning.handle_duplicates(t("documents").select("lang", "source"), drop=True)[0])
query("dedupe_subset", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")(lambda t, spark: cleaning.handle_duplicates(t("documents"), drop=True, subset=["text"], order_by=["doc_id"])[0].select("doc_id"))

_NAN = "CASE event_id % 5 WHEN 0 THEN {nan} WHEN 1 THEN NULL WHEN 2 THEN 0.0 WHEN 3 THEN {zero} ELSE event_id % 3 END"


@query("dedupe_nan", f"SELECT min(event_id) AS event_id FROM (SELECT event_id, user_id, {_NAN.format(nan='NULL', zero='0.0')} AS v FROM events) GROUP BY user_id, v")
def _(t, spark):
    """NaN counts as null, and -0.0 as 0.0."""
    value = F.expr(_NAN.format(nan="double('NaN')", zero="-0.0D"))
    return cleaning.handle_duplicates(t("events").select("event_id", "user_id", value.cast("double").alias("v")), drop=True, subset=["user_id", "v"], order_by=["event_id"])[0].select("event_id")


# --- outliers ---


def _outliers(name: str, columns: list[str], strategy: str):
    return lambda t: transform.handle_outliers(t(name), default_strategy=strategy, columns=columns)


query("outlier_flag", _outlier_sql(f"event_id, {OUTSIDE.format(c='value')} AS value__is_outlier", "events", "value", "true"))(lambda t, spark: _outliers("events", ["value"], "flag")(t)[0].select("event_id", "value__is_outlier"))
query("outlier_clip", _outlier_sql("event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS value", "events", "value", "true"))(lambda t, spark: _outliers("events", ["value"], "clip")(t)[0].select("event_id", F.round("value", 6).alias("value")))
query("outlier_remove", _outlier_sql("event_id", "events", "value", "NOT ({o})"))(lambda t, spark: _outliers("events", ["value"], "remove")(t)[0].select("event_id"))
query("outlier_remove_multi", _outlier_sql("doc_id", "documents", "n_chars", "NOT ({o})"))(lambda t, spark: _outliers("documents", ["doc_id", "n_chars"], "remove")(t)[0].select("doc_id"))
_ZERO = " AND ".join(f"NOT ({OUTSIDE.format(c=c).replace('q1', f'{c}_1').replace('q3', f'{c}_3')})" for c in ("quality", "toxic"))
query("outlier_iqr_zero", f"SELECT doc_id, quality, toxic FROM labels, (SELECT quantile_cont(quality, 0.25) AS quality_1, quantile_cont(quality, 0.75) AS quality_3, quantile_cont(toxic, 0.25) AS toxic_1, quantile_cont(toxic, 0.75) AS toxic_3 FROM labels) b WHERE {_ZERO}")(lambda t, spark: _outliers("labels", ["quality", "toxic"], "remove")(t)[0])


@query("outlier_report", _outlier_sql("'value' AS column_name, count(*) AS n_outliers, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound", "events", "value", "{o}"))
def _(t, spark):
    return rows(spark, [(d["column"], d["outlier_count"], round(d["lower"], 4), round(d["upper"], 4)) for d in _outliers("events", ["value"], "flag")(t)[1].details], "column_name string, n_outliers long, lower_bound double, upper_bound double")


# --- encoding ---

query("encode_boolean", "SELECT event_id, CAST(flag AS INT) AS flag FROM messy_events")(lambda t, spark: transform.encode_categoricals(t("messy_events").select("event_id", "flag"))[0])
query("encode_onehot", "SELECT c_custkey, list_transform((SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer), lambda v: CAST(v = c_mktsegment AS INT))::VARCHAR AS bits FROM customer")(
    lambda t, spark: (lambda df: df.select("c_custkey", F.concat(F.lit("["), F.concat_ws(", ", *(F.col(f"`{c}`").cast("string") for c in df.columns if c.startswith("c_mktsegment_"))), F.lit("]")).alias("bits")))(transform.encode_categoricals(t("customer"))[0])
)
query("encode_label", "SELECT p_partkey, (SELECT count(DISTINCT b.p_brand) FROM part b WHERE b.p_brand < a.p_brand)::INT AS p_brand FROM part a")(lambda t, spark: transform.encode_categoricals(t("part").select("p_partkey", "p_brand"))[0])
query("encode_identifier_untouched", "SELECT c_custkey, c_name FROM customer")(lambda t, spark: transform.encode_categoricals(t("customer").select("c_custkey", "c_name"))[0])

# --- features ---

query("fe_date_parts", "SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate__year, month(o_orderdate)::INT AS o_orderdate__month, day(o_orderdate)::INT AS o_orderdate__day FROM orders")(
    lambda t, spark: transform.engineer_features(t("orders").select("o_orderkey", "o_orderdate"))[0].select("o_orderkey", "o_orderdate__year", "o_orderdate__month", "o_orderdate__day")
)
query("fe_weekday", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS o_orderdate__weekday FROM orders")(lambda t, spark: transform.engineer_features(t("orders").select("o_orderkey", "o_orderdate"))[0].select("o_orderkey", "o_orderdate__weekday"))
query("fe_text_length", "SELECT doc_id, length(text)::INT AS text__length FROM documents")(lambda t, spark: transform.engineer_features(t("documents").select("doc_id", "text"))[0].select("doc_id", "text__length"))
query("fe_word_count", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::INT AS text__word_count FROM documents")(lambda t, spark: transform.engineer_features(t("documents").select("doc_id", "text"))[0].select("doc_id", "text__word_count"))

# --- scaling ---


def _scaled(name: str, key: str, column: str, method: str, mask=None):
    return lambda t, spark: transform.scale_features(t(name).select(key, column), method=method, columns=[column], train_mask=mask)[0].withColumn(column, F.round(column, 6))


query("scale_standard", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")(_scaled("orders", "o_orderkey", "o_totalprice", "standard"))
query("scale_minmax", "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")(_scaled("orders", "o_orderkey", "o_totalprice", "minmax"))
query("scale_robust", "SELECT o_orderkey, round((o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders), 6) AS o_totalprice FROM orders")(_scaled("orders", "o_orderkey", "o_totalprice", "robust"))
query("scale_train_mask", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0)) / (SELECT stddev_pop(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0), 6) AS o_totalprice FROM orders")(
    lambda t, spark: _scaled("orders", "o_orderkey", "o_totalprice", "standard", F.col("o_orderkey") % 2 == 0)(t, spark)
)
query("scale_nulls", "SELECT event_id, round((value - (SELECT avg(value) FROM messy_events)) / (SELECT stddev_pop(value) FROM messy_events), 6) AS value FROM messy_events")(_scaled("messy_events", "event_id", "value", "standard"))
_BINARY = ", ".join(f"CASE WHEN (SELECT bool_and({c} IN (0, 1)) FROM labels) THEN {c} ELSE ({c} - (SELECT avg({c}) FROM labels)) / (SELECT stddev_pop({c}) FROM labels) END AS {c}" for c in ("quality", "toxic"))
query("scale_skip_binary", f"SELECT doc_id, {_BINARY} FROM labels")(lambda t, spark: transform.scale_features(t("labels"), columns=["quality", "toxic"])[0])


@query("scale_params", "SELECT 'o_totalprice' AS column_name, round(avg(o_totalprice), 4) AS center, round(stddev_pop(o_totalprice), 4) AS scale, count(*) AS fit_rows FROM orders")
def _(t, spark):
    return rows(spark, [(d["column"], round(d["center"], 4), round(d["scale"], 4), d["fit_rows"]) for d in transform.scale_features(t("orders"), columns=["o_totalprice"])[1].details], "column_name string, center double, scale double, fit_rows long")


query("scale_columns", "SELECT o_orderkey, o_custkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")(
    lambda t, spark: transform.scale_features(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), method="minmax", columns=["o_totalprice", "gone"])[0].withColumn("o_totalprice", F.round("o_totalprice", 6))
)
query("scale_none", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t, spark: transform.scale_features(t("orders").select("o_orderkey", "o_totalprice"), method="none")[0])
query("encode_skip", "SELECT c_custkey, c_mktsegment FROM customer")(lambda t, spark: transform.encode_categoricals(t("customer").select("c_custkey", "c_mktsegment"), overrides={"c_mktsegment": "skip"})[0])
query("fe_none", "SELECT c_custkey, c_acctbal FROM customer")(lambda t, spark: transform.engineer_features(t("customer").select("c_custkey", "c_acctbal"))[0])
query("outlier_skip", "SELECT event_id, value FROM events")(lambda t, spark: _outliers("events", ["value"], "skip")(t)[0].select("event_id", "value"))
query("outlier_remove_report", _outlier_sql("count(*) AS rows_removed", "events", "value", "{o}"))(
    lambda t, spark: rows(spark, [(_outliers("events", ["value"], "remove")(t)[1].details[-1]["rows_removed"],)], "rows_removed long")
)
query("dup_report", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1 ORDER BY doc_id LIMIT 200")(
    lambda t, spark: rows(spark, [(k,) for k in cleaning.handle_duplicates(t("documents"), subset=["text"], order_by=["doc_id"])[1].details[0]["first_duplicates"]], "doc_id long")
)
query("profile_outlier_rows", _outlier_sql("event_id", "events", "value", "{o}") + " ORDER BY event_id LIMIT 100")(
    lambda t, spark: rows(spark, [(int(k),) for k in profile_dataframe(t("events"), ["value"], outlier_keys=["event_id"])[0].outlier_rows], "event_id long")
)
query("profile_table", " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS column_name, count({c}) AS non_null, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS null_ratio, count(DISTINCT {c}) AS n_unique FROM messy_events" for k, c in enumerate(EVENTS)))(
    lambda t, spark: profile_table(spark, profile_dataframe(t("messy_events"))).select("position", "column_name", "non_null", "null_ratio", "n_unique")
)

# --- combination ---


def _merged(how: str):
    return lambda t, spark: combine.combine_datasets([("customer", t("customer").select(F.col("c_custkey").alias("k"), "c_name")), ("orders", t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"))], mode="merge", on=["k"], how=how)[0]


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"merge_{_how}", f"SELECT coalesce(c.c_custkey, o.o_custkey) AS k, c_name, o_orderkey FROM customer c {_join} orders o ON c.c_custkey = o.o_custkey")(_merged(_how))

query("combine_concat", "SELECT c_name, c_acctbal, NULL AS s_name, 'customer' AS __source_file FROM customer UNION ALL SELECT NULL, NULL, s_name, 'supplier' FROM supplier")(
    lambda t, spark: combine.combine_datasets([("customer", t("customer").select("c_name", "c_acctbal")), ("supplier", t("supplier").select("s_name"))])[0]
)
NULL_KEYS = "FROM nation_nullkey n FULL JOIN region_nullkey r ON n.rk IS NOT DISTINCT FROM r.rk"
_null_merge = lambda t: combine.combine_datasets([("nation", t("nation_nullkey")), ("region", t("region_nullkey"))], mode="merge", on=["rk"])[0]
query("merge_null_keys", f"SELECT n_nationkey, n_name, coalesce(n.rk, r.rk) AS rk, r_name {NULL_KEYS}")(lambda t, spark: _null_merge(t))
query("merge_unmatched", f"SELECT count(*) FILTER (WHERE coalesce(n.rk, r.rk) IS NULL) AS n {NULL_KEYS}")(lambda t, spark: rows(spark, [(combine.null_key_rows(_null_merge(t), ["rk"]),)], "n long"))
query("combine_single", "SELECT s_suppkey, s_name FROM supplier")(lambda t, spark: combine.combine_datasets([("supplier", t("supplier").select("s_suppkey", "s_name"))])[0])


@query("merge_report", """SELECT (SELECT count(*) FROM customer) AS rows_before, count(*) AS rows_produced, count(*) FILTER (WHERE o_orderkey IS NULL) AS unmatched_left, count(*) FILTER (WHERE c_name IS NULL) AS unmatched_right
    FROM customer FULL JOIN orders ON c_custkey = o_custkey""")
def _(t, spark):
    parts = [("customer", t("customer").select(F.col("c_custkey").alias("k"), "c_name")), ("orders", t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"))]
    d = combine.combine_datasets(parts, mode="merge", on=["k"])[1].details[0]
    return rows(spark, [(d["rows_before"], d["rows_produced"], d["unmatched_left"], d["unmatched_right"])], "rows_before long, rows_produced long, unmatched_left long, unmatched_right long")


@query("concat_report", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows_expected, count(*) AS rows_produced FROM (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)")
def _(t, spark):
    d = combine.combine_datasets([("customer", t("customer")), ("supplier", t("supplier"))])[1].details[0]
    return rows(spark, [(d["rows_expected"], d["rows_produced"])], "rows_expected long, rows_produced long")


query("merge_suffix", "SELECT d.doc_id, d.lang, e.lang AS lang__other FROM documents d JOIN documents e ON d.doc_id = e.doc_id")(
    lambda t, spark: combine.combine_datasets([("docs", t("documents").select("doc_id", "lang")), ("other", t("documents").select("doc_id", "lang"))], mode="merge", on=["doc_id"], how="inner")[0]
)
query("combine_merge_3way", "SELECT d.doc_id, d.lang, l.quality, l.toxic, m.quality_gap FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN messy_labels m USING (doc_id)")(
    lambda t, spark: combine.combine_datasets([("d", t("documents").select("doc_id", "lang")), ("l", t("labels")), ("m", t("messy_labels").select("doc_id", "quality_gap"))], mode="merge", on=["doc_id"], how="left")[0]
)

# --- recommendations ---

_named = lambda t: f"(SELECT min(column_name) FROM (DESCRIBE {t}) WHERE lower(column_name) IN ('target', 'label', 'class', 'y'))"
query("rec_target", f"SELECT 'embeddings' AS table_name, {_named('embeddings')} AS target UNION ALL SELECT 'labels', {_named('labels')} UNION ALL SELECT 'events', coalesce({_named('events')}, (SELECT CASE WHEN count(DISTINCT event_type) BETWEEN 2 AND 20 THEN 'event_type' END FROM events))")(
    lambda t, spark: rows(spark, [(n, recommend.detect_target(profile_dataframe(t(n)))) for n in ("embeddings", "labels", "events")], "table_name string, target string")
)
query("rec_problem_type", f"""SELECT 'embeddings' AS table_name, CASE WHEN {_named('embeddings')} IS NULL THEN 'clustering' WHEN (SELECT column_type FROM (DESCRIBE embeddings) WHERE column_name = 'label') LIKE '%INT%' THEN 'regression' END AS problem
    UNION ALL SELECT 'labels', CASE WHEN {_named('labels')} IS NULL AND (SELECT bool_and(column_type LIKE '%INT%') FROM (DESCRIBE labels)) THEN 'clustering' END
    UNION ALL SELECT 'events', (SELECT CASE WHEN count(DISTINCT event_type) = 2 THEN 'binary_classification' WHEN count(DISTINCT event_type) <= 20 THEN 'multiclass_classification' END FROM events)""")(
    lambda t, spark: rows(spark, [(n, recommend.recommend_algorithms(t(n)).problem) for n in ("embeddings", "labels", "events")], "table_name string, problem string")
)
query("rec_class_balance", "SELECT count(*) AS classes, round(max(n) / CAST(min(n) AS DOUBLE), 2) AS ratio, max(n) >= 4.0 * min(n) AS is_imbalanced FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")(
    lambda t, spark: rows(spark, [tuple(recommend.class_balance(t("events"), "event_type")[k] for k in ("classes", "ratio", "is_imbalanced"))], "classes long, ratio double, is_imbalanced boolean")
)

query("rec_class_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda t, spark: recommend.class_balance(t("events"), "event_type")["class_counts"].withColumnRenamed("class", "event_type"))


@query("rec_characteristics", "SELECT count(*) AS n_rows, 5 AS n_features, round(5.0 / count(*), 4)::DOUBLE AS ratio, 0.0::DOUBLE AS missing FROM events")
def _(t, spark):
    x = recommend.recommend_algorithms(t("events")).traits
    return rows(spark, [(x.n_rows, x.n_features, x.ratio, x.missing)], "n_rows long, n_features int, ratio double, missing double")


def _scores(problem: str, n_rows_table: str):
    def make(t, spark):
        x = recommend.Traits(t(n_rows_table).count(), 4, 0.0001, True, False, True, 0.0)
        return rows(spark, [(a.name, a.to_dict()["score"]) for a in recommend.score_algorithms(problem, x)], "algorithm string, score double")

    return make


_n = "(SELECT count(*) FROM lineitem)"
_values = lambda pairs: " UNION ALL ".join(f"SELECT '{n}' AS algorithm, round(CAST({s} AS DOUBLE), 3) AS score" for n, s in pairs)
query("rec_scores_classification", _values([("Logistic Regression", "0.6"), ("Random Forest", "0.85"), ("Gradient Boosting", "0.8"), ("Support Vector Machine", f"CASE WHEN {_n} > 20000 THEN 0.2 ELSE 0.5 END"), ("K-Nearest Neighbors", f"CASE WHEN {_n} > 20000 THEN 0.2 ELSE 0.4 END"), ("Naive Bayes", "0.45")]))(_scores("multiclass_classification", "lineitem"))
query("rec_scores_regression", _values([("Linear Regression", "0.55"), ("Ridge / Lasso Regression", "0.55"), ("Random Forest Regressor", "0.85"), ("Gradient Boosting Regressor", "0.8"), ("Support Vector Regression", f"CASE WHEN {_n} > 20000 THEN 0.15 ELSE 0.45 END")]))(_scores("regression", "lineitem"))
query("rec_scores_clustering", _values([("K-Means", "0.65"), ("DBSCAN", "0.7"), ("Hierarchical (Agglomerative) Clustering", f"CASE WHEN {_n} > 5000 THEN 0.25 ELSE 0.45 END")]))(_scores("clustering", "lineitem"))
query("advise_roles", f"SELECT column_name, CASE kind WHEN 'identifier' THEN 'identifier' ELSE 'feature' END AS role, CASE kind WHEN 'identifier' THEN 0.8 WHEN 'text' THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence FROM ({_kind_sql()}) WHERE table_name = 'customer'")(
    lambda t, spark: rows(spark, [(p.column_name, *recommend.RuleAdvisor().suggest_column_role(p)) for p in profile_dataframe(t("customer"))], "column_name string, role string, confidence double")
)
_has = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
query("chat_intent", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in recommend.INTENTS.items()) + " ELSE 'summary' END AS intent FROM conversations")(
    lambda t, spark: t("conversations").select("conv_id", "turn", recommend.intent_expr(F.col("text")).alias("intent"))
)

# A table without a target: the figures that scores depend on come from it; none of its columns has outliers, categories or few rows for its columns.
_LABELS = "(SELECT count(*) FROM labels)"
_CLUSTERING = f"(SELECT algorithm, score::DOUBLE AS score FROM (VALUES ('K-Means', 0.65), ('DBSCAN', 0.55), ('Hierarchical (Agglomerative) Clustering', CASE WHEN {_LABELS} > 5000 THEN 0.25 ELSE 0.45 END)) v(algorithm, score))"
query("recommend_ranked", f"SELECT row_number() OVER (ORDER BY score DESC)::INT AS place, algorithm, score FROM {_CLUSTERING}")(
    lambda t, spark: rows(spark, [(k, a.name, a.to_dict()["score"]) for k, a in enumerate(recommend.recommend_algorithms(t("labels")).algorithms, 1)], "place int, algorithm string, score double")
)
query("recommend_notes", "SELECT 0 AS place, printf('%.1f%% of values are missing: impute them first', 100 * round((count(*) - count(quality_gap)) / count(*)::DOUBLE / 4, 4)) AS note FROM messy_labels UNION ALL SELECT 1, 'no target column was found'")(
    lambda t, spark: rows(spark, [*enumerate(recommend.recommend_algorithms(t("messy_labels")).notes)], "place int, note string")
)
query("chat_recommend", f"SELECT 'For clustering on labels, try ' || string_agg(algorithm, ' or ' ORDER BY score DESC) || '.' AS answer FROM (SELECT * FROM {_CLUSTERING} ORDER BY score DESC LIMIT 2)")(
    lambda t, spark: rows(spark, [(recommend.answer_question("which model fits?", t("labels"), "labels")["answer"],)], "answer string")
)

# --- pipeline ---


@query("pipeline_flagship", f"""
    SELECT event_id AS key, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 5) AS value, e AS signup, strftime(g, '%Y-%m-%d %H:%M:%S') AS ts_gap,
        round(coalesce((day(g) - avg(day(g)) OVER ()) / nullif(stddev_pop(day(g)) OVER (), 0), 0), 5) AS gap_day
    FROM (SELECT event_id, coalesce(value, {MEDIAN}) AS v, CAST(coalesce(event_type, {MODE}) = 'signup' AS INT) AS e, {FILLED.format(c='ts_gap')} AS g FROM messy_events)""")
def _(t, spark):
    out, _ = pipeline.run_pipeline(t("messy_events").withColumn("key", F.concat(F.lit("k"), F.col("event_id").cast("string"))), order_by=["event_id"])
    return out.select(F.substring("key", 2, 20).cast("long").alias("key"), F.round("value", 5).alias("value"), F.col("event_type_signup").alias("signup"), F.date_format("ts_gap", "yyyy-MM-dd HH:mm:ss").alias("ts_gap"), F.round("ts_gap__day", 5).alias("gap_day"))


@query("pipeline_multi_source", "SELECT 'combine_datasets' AS step, 0 AS position, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows_after")
def _(t, spark):
    _, trail = pipeline.run_pipeline_multi_source([("customer", t("customer").select("c_name", "c_acctbal")), ("supplier", t("supplier").select("s_name"))], PipelineConfig(coerce_types=False, encode=False, engineer_features=False, scale_method="none", datetime_impute_strategy="skip", categorical_impute_strategy="skip"), order_by=["c_name", "s_name"])
    return rows(spark, [(trail[0].step, 0, trail[0].rows_after)], "step string, position int, rows_after long")


_STEPS = ("coerce_types", "impute_missing", "handle_duplicates", "handle_outliers", "encode_categoricals", "engineer_features", "scale_features")


_PAIRS = f"(SELECT count(*) FROM (SELECT DISTINCT user_id, coalesce(event_type, {MODE}) FROM messy_events))"


@query("audit_steps", " UNION ALL ".join(
    f"SELECT {k} AS position, '{n}' AS step, {'count(*)' if k <= 2 else f'any_value({_PAIRS})'} AS rows_before, {'count(*)' if k < 2 else f'any_value({_PAIRS})'} AS rows_after, "
    f"{'sum(' + ' + '.join(f'({c} IS NULL)::INT' for c in EVENTS) + ')' if k <= 1 else '0'}::BIGINT AS nulls_before, {'sum(' + ' + '.join(f'({c} IS NULL)::INT' for c in EVENTS) + ')' if k < 1 else '0'}::BIGINT AS nulls_after FROM messy_events"
    for k, n in enumerate(_STEPS)
))
def _(t, spark):
    _, trail = pipeline.run_pipeline(t("messy_events"), PipelineConfig(dedupe=True, dedupe_subset=["user_id", "event_type"]), order_by=["event_id"])
    return step_table(spark, trail).select("position", "step", "rows_before", "rows_after", "nulls_before", "nulls_after")


@query("run_step", "SELECT 'handle_duplicates' AS step, count(*) AS rows_before, count(DISTINCT text) AS rows_after FROM documents")
def _(t, spark):
    _, step = pipeline.run_step(t("documents").select("text"), "handle_duplicates", lambda df: cleaning.handle_duplicates(df, drop=True))
    return rows(spark, [(step.step, step.rows_before, step.rows_after)], "step string, rows_before long, rows_after long")


@query("explain_step", """SELECT printf('Find repeated rows: rows %+d, columns +0, missing values +0, 0 warning(s).', (count(DISTINCT text) - count(*))::INT) AS answer FROM documents""")
def _(t, spark):
    _, step = pipeline.run_step(t("documents").select("text"), "handle_duplicates", lambda df: cleaning.handle_duplicates(df, drop=True))
    return rows(spark, [(recommend.RuleAdvisor().explain_step(step),)], "answer string")


# --- synthetic rows ---

query("synthetic_rows")(lambda t, spark: synthetic.generate_synthetic(t("events").select("event_id", "ts", "event_type", "value"), n_rows=500, seed=7)[0])
query("synthetic_augment")(lambda t, spark: synthetic.augment_with_synthetic(t("customer"), n_rows=200, seed=7)[0])

@query("synthetic_invariants", "SELECT 500 AS n_rows, 0 AS nulls, count(DISTINCT event_type)::INT AS n_types, 0 AS foreign_types, 0 AS outside_span FROM events")
def _(t, spark):
    """Many draws have every frequent category, none that the source lacks, and no moment outside of its span."""
    events = t("events").select("event_id", "ts", "event_type", "value")
    made = synthetic.generate_synthetic(events, n_rows=500, seed=7)[0]
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    known = events.select("event_type").distinct().withColumn("known", F.lit(True))
    marked = made.join(F.broadcast(known), "event_type", "left").join(F.broadcast(span))  # few types, one span
    nulls = F.count_if(F.col("ts").isNull() | F.col("event_type").isNull() | F.col("value").isNull() | F.col("event_id").isNull())
    return marked.agg(F.count(F.lit(1)).cast("int").alias("n_rows"), nulls.cast("int").alias("nulls"), F.count_distinct("event_type").cast("int").alias("n_types"), F.count_if(F.col("known").isNull()).cast("int").alias("foreign_types"), F.count_if((F.col("ts") < F.col("lo")) | (F.col("ts") > F.col("hi"))).cast("int").alias("outside_span"))


@query("synthetic_kinds", "SELECT 400 AS n_rows, 0 AS foreign_flags, 0 AS foreign_texts, 0 AS broken_numbers, 0 AS far_numbers, 2::INT AS n_flags FROM (SELECT count(*) FROM labels)")
def _(t, spark):
    """0/1 columns and text are drawn from the source as they are; whole numbers stay whole and within six deviations of the jitter of their span."""
    flags = synthetic.generate_synthetic(t("labels").select("quality"), n_rows=400, seed=5)[0]
    source = t("documents").select("text", "n_chars")
    made = synthetic.generate_synthetic(source, n_rows=400, seed=5)[0]
    known = source.select(F.xxhash64("text").alias("h")).distinct()
    foreign = made.select(F.xxhash64("text").alias("h")).join(known, "h", "left_anti").count()
    span = source.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), (6 * 0.03 * F.stddev("n_chars")).alias("reach")).first()
    found = made.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") != F.rint("n_chars")).alias("broken"), F.count_if((F.col("n_chars") < span.lo - span.reach) | (F.col("n_chars") > span.hi + span.reach)).alias("far")).first()
    drawn = flags.agg(F.count_if(~F.col("quality").isin(0, 1)).alias("foreign"), F.count_distinct("quality").alias("kinds")).first()
    return rows(spark, [(found.n, drawn.foreign, foreign, found.broken, found.far, drawn.kinds)], "n_rows int, foreign_flags int, foreign_texts int, broken_numbers int, far_numbers int, n_flags int")


@query("augment_keeps_source", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t, spark):
    """The source's rows among the augmented ones: placeholders name the others."""
    out, _ = pipeline.run_synthetic_augmentation(t("customer"), n_rows=200, seed=7)
    return out.where(~F.startswith("c_name", F.lit("synthetic_")))


query("synthetic_identifier", "SELECT 'synthetic_c_name_' || i AS c_name FROM range(100) r(i)")(lambda t, spark: synthetic.generate_synthetic(t("customer").select("c_name"), n_rows=100, seed=1)[0])


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
