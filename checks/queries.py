"""Registered queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.business import compact_number
from holdfast.operators import categories, cleaning, constraints, drift, features, importance, keyed, metrics, quality, splits
from holdfast.operators.features import LABEL
from holdfast.operators.fingerprint import fingerprint
from holdfast.operators.selection import quantiles
from holdfast.operators.warehouse import (
    append_predictions,
    denormalise,
    load_predictions,
    load_subscribers,
    lookup_keys,
    prediction_rows,
    seed_dimensions,
)
from holdfast.plans import documents, full_run, kpis, models, named_queries, reports
from holdfast.schemas import FACT_MODEL_RUNS
from holdfast.session import scratch_dir
from holdfast.sources import files, versions
from holdfast.sources.accounts import MARKET_SEGMENTS
from holdfast.workspace import HEURISTIC, PREDICTED_AT, SIMPLE, Workspace, open_workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def register(name: str):
    def add(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = fn
        return fn

    return add


def portable(df: DataFrame) -> DataFrame:
    """Plain result types: bigint, double and text."""

    def cast(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind.startswith("decimal") or kind == "float":
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(name)

    return df.select(*[cast(n, k) for n, k in df.dtypes])


def fresh_path(w: Workspace, name: str) -> str:
    return f"{scratch_dir(w.spark)}/{uuid.uuid4().hex}/{name}"


# Named queries and KPI views.
for _name, _query in named_queries.NAMED.items():
    QUERIES[_name] = lambda w, q=_name: named_queries.run_named_query(q, w.warehouse)

for _name, _view in {
    "v01_headline": kpis.headline,
    "v02_by_plan": kpis.by_plan,
    "v03_by_region": kpis.by_region,
    "v04_by_channel": kpis.by_channel,
    "v05_cohort_retention": kpis.cohort_retention,
    "v06_watchlist": kpis.watchlist,
    "v07_engagement_segments": kpis.engagement_segments,
    "j05_flagged_star_join": kpis.flagged_accounts,
    "j08_cohort_aggregates_joined": kpis.cohort_retention_joined,
}.items():
    QUERIES[_name] = lambda w, v=_view: v(w.warehouse)


@register("v01b_headline_documents")
def _(w):
    return documents.headline(w.documents)


@register("v02b_by_plan_documents")
def _(w):
    return documents.by_plan(w.documents, w.dims)


@register("v03b_by_region_documents")
def _(w):
    return documents.by_region(w.documents)


@register("v04b_by_channel_documents")
def _(w):
    return documents.by_channel(w.documents, w.dims)


@register("v05b_bucket_survival")
def _(w):
    return documents.bucket_survival(w.documents)


@register("v06b_watchlist_single_model")
def _(w):
    return documents.watchlist_single_model(w.documents, w.predictions, model_name=SIMPLE)


@register("v07b_engagement_bands")
def _(w):
    return documents.engagement_bands(w.documents)


@register("q05b_arr_trend_documents")
def _(w):
    return named_queries.running_by_month(
        named_queries.monthly_arr_events(w.documents), "net_change"
    )


@register("u1_arr_union_of_aggregates")
def _(w):
    return named_queries.running_by_month(named_queries.monthly_arr_union(w.fact))


@register("q03_arr_at_risk_after_append")
def _(w):
    twice = append_predictions(w.predictions, w.predictions)
    return named_queries.arr_at_risk(w.warehouse.with_predictions(twice))


# Sources, sinks and loading.
@register("s01_raw_csv_roundtrip")
def _(w):
    path = fresh_path(w, "raw_csv")
    files.write_raw(w.raw, path)
    return files.read_raw(w.spark, path)


@register("s01b_raw_csv_by_name")
def _(w):
    """Files whose columns stand in another order, with one more."""
    path = fresh_path(w, "raw_csv")
    files.write_raw(w.raw.select(F.lit("x").alias("note"), *reversed(w.raw.columns)), path)
    return files.read_raw(w.spark, path)


@register("s02_clean_roundtrip")
def _(w):
    path = fresh_path(w, "clean")
    files.write_clean(w.clean, cleaning.audit_log(w.raw, w.deduped, w.fit), path, path + "_log")
    return files.read_clean(w.spark, path)


@register("s03_test_split_read")
def _(w):
    path = fresh_path(w, "splits")
    files.write_splits(
        w.features.withColumn("split", splits.split_of(F.col("subscriber_id"))), path
    )
    return files.read_split(w.spark, path, "test").select(
        "subscriber_id", "plan_tier", "engagement_decile", "churned", "split"
    )


@register("s04_predictions_by_model")
def _(w):
    path = fresh_path(w, "predictions")
    files.write_predictions(w.scored, path)
    stored = files.read_predictions(w.spark, path, HEURISTIC)
    absent = files.read_predictions(w.spark, path, "never_trained")
    return stored.unionByName(absent)


@register("s05_parameterised_sql")
def _(w):
    kpis.register_views(w.warehouse)
    return named_queries.query_sql(
        w.spark,
        "SELECT p.plan_tier, count(*) AS n, sum(f.churned) AS n_churned "
        "FROM fact_subscribers f JOIN dim_plan p ON f.plan_id = p.plan_id "
        "WHERE p.tier_rank >= ? AND f.billing_cycle = ? GROUP BY p.plan_tier",
        (2, "annual"),
    )


@register("s06_document_chain")
def _(w):
    return (
        w.documents.filter(F.col("region_code").isin("NAM", "EMEA") & F.col("churn_date").isNotNull())
        .groupBy("channel_type")
        .agg(F.count("*").alias("n"), F.sum("seat_count").alias("seats"))
    )


@register("s08_audit_log_text")
def _(w):
    path = fresh_path(w, "clean")
    files.write_clean(w.clean, cleaning.audit_log(w.raw, w.deduped, w.fit), path, path + "_log")
    return w.spark.read.text(path + "_log")


@register("s09_features_roundtrip")
def _(w):
    path = fresh_path(w, "features")
    files.write_features(features.with_comments(w.features), path)
    return _rounded_logs(files.read_features(w.spark, path))


@register("s12_comparison_csv")
def _(w):
    path = fresh_path(w, "comparison")
    files.write_comparison(metrics.compare_models(with_baseline(w)), path)
    return files.read_comparison(w.spark, path)


@register("s13_quality_report_json")
def _(w):
    path = fresh_path(w, "quality")
    report = quality.report(w.raw)
    files.write_quality_report(report, path, path + "_text")
    stored = w.spark.read.schema(report.schema).json(path)
    return stored.select("n_rows", "n_cols", "n_duplicates", "pct_duplicates")


@register("s13b_quality_report_rows")
def _(w):
    """Columns and issues of the stored report, a row each."""
    path = fresh_path(w, "quality")
    report = quality.report(w.raw)
    files.write_quality_report(report, path, path + "_text")
    stored = w.spark.read.schema(report.schema).json(path)
    one = stored.select(F.explode("columns").alias("c"))
    return one.select("c.column_name", "c.n_total", "c.n_null", "c.pct_null", "c.n_unique", F.size("c.issues").alias("n_issues"))


@register("s14_run_records")
def _(w):
    path = fresh_path(w, "runs")
    sizes = splits.split_shares(
        w.clean.withColumn("split", splits.split_of(F.col("subscriber_id"))), LABEL
    ).collect()
    n = {r["split"]: r["n"] for r in sizes}
    records = models.run_record(
        metrics.compare_models(with_baseline(w)),
        F.lit(PREDICTED_AT).cast("timestamp"),
        fingerprint(w.clean).first()["data_hash"],
        n["train"], n["test"], path,
    )
    files.append_run(records, path)
    stored = files.read_or_empty(w.spark, path, FACT_MODEL_RUNS, "parquet")
    return stored.drop("data_hash", "artifact_path")


@register("s15_watchlist_export")
def _(w):
    path = fresh_path(w, "watchlist")
    files.export_watchlist(
        reports.filter_watchlist(kpis.flagged_accounts(w.warehouse), plans=["growth", "starter"]), path
    )
    numbers = {"tenure_months": "int", "engagement_score": "double", "arr_usd": "double",
               "churn_probability": "double"}
    texts = ("subscriber_id", "plan_tier", "region_code", "industry_name", "risk_tier", "model_name")
    exported = w.spark.read.csv(path, header=True)
    return exported.select(*texts, *[F.col(c).try_cast(t).alias(c) for c, t in numbers.items()])


@register("s16_dim_seed")
def _(w):
    """Seeded rows with the number of accounts that point at them."""
    parts = []
    codes = {
        "plan_id": "plan_tier",
        "region_id": "region_code",
        "channel_id": "channel_code",
        "industry_id": "industry_name",
    }
    for key, dim in w.dims.by_key().items():
        used = w.fact.groupBy(key).agg(F.count("*").alias("n"))
        parts.append(
            dim.join(used, key, "left").select(
                F.lit(key).alias("dimension"),
                F.col(key).alias("id"),
                F.col(codes[key]).alias("code"),
                F.coalesce("n", F.lit(0)).alias("n_accounts"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@register("s16b_seed_over_present_ids")
def _(w):
    """The usual industries seeded over the loaded ones, with the documents of each."""
    dims = seed_dimensions(w.spark, w.dims)
    used = denormalise(w.fact, dims).groupBy("industry_vertical").agg(F.count("*").alias("n"))
    joined = dims.industries.join(used, F.col("industry_name") == F.col("industry_vertical"), "left")
    return joined.select("industry_id", "industry_name", F.coalesce("n", F.lit(0)).alias("n_documents"))


@register("s17_upsert_subscribers")
def _(w):
    """All arrivals, repeats included, loaded over the first ones."""
    existing = w.deduped.drop("ingest_seq")
    return keyed.upsert(existing, w.raw, ["subscriber_id"], "ingest_seq")


@register("s18_upsert_predictions")
def _(w):
    at = F.lit("2024-12-30 00:00:00")
    first = prediction_rows(
        w.deduped.select("subscriber_id", F.col("churn_probability_true").alias("churn_probability")),
        HEURISTIC, "earlier", at,
    )
    return load_predictions(w.predictions, first)


@register("s19_denormalised")
def _(w):
    return w.documents


@register("s21_view_by_sql")
def _(w):
    kpis.register_views(w.warehouse)
    return named_queries.query_sql(w.spark, "SELECT * FROM vw_kpi_by_region")


@register("s23_overview_frames")
def _(w):
    """Row counts of all overview frames."""
    frames = kpis.load_all(w.warehouse)
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("frame"), "n_rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@register("s24_full_run")
def _(w):
    result = full_run.run(
        w.raw, fresh_path(w, "full_run"), industries=MARKET_SEGMENTS,
        trainers={"logistic_regression": models.train_logistic}, cross_validation=False,
    )
    return result.comparison


@register("s24b_second_run")
def _(w):
    """Two runs on one output: three quarters of the accounts, then all of them."""
    root = fresh_path(w, "runs")
    settings = {
        "industries": MARKET_SEGMENTS, "cross_validation": False,
        "trainers": {"logistic_regression": models.train_logistic},
    }
    some = w.raw.filter(F.crc32("subscriber_id") % 4 != 0)
    for raw in (some, w.raw):
        full_run.run_again(raw, root, **settings)
    last = full_run.open_version(w.spark, root, MARKET_SEGMENTS)
    runs = w.spark.read.parquet(f"{versions.current(w.spark, root)}/warehouse/fact_model_runs")
    broken = constraints.all_violations(
        {"fact_subscribers": last.fact, "fact_model_predictions": last.predictions, "fact_model_runs": runs}
    )
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return reduce(
        DataFrame.unionByName,
        [
            count(last.fact, "accounts"), count(last.predictions, "predictions"), count(runs, "run records"),
            count(versions.published(w.spark, root), "versions"),
            broken.agg(F.sum("n_violations").alias("n")).select(F.lit("violations").alias("what"), "n"),
        ],
    )


@register("s17b_load_over_existing")
def _(w):
    """Half of the accounts loaded first, then all rows of the raw table, the last of an account winning."""
    first = load_subscribers(w.clean.filter(F.crc32("subscriber_id") % 2 == 0), w.dims)
    batch = w.clean.withColumn("load_seq", F.lit(1)).unionByName(
        w.clean.select(*[c for c in w.clean.columns if c != "seat_count"], (F.col("seat_count") + 1).alias("seat_count"))
        .withColumn("load_seq", F.lit(2))
    )
    return load_subscribers(batch, w.dims, first, "load_seq").select("subscriber_id", "plan_id", "region_id", "seat_count")


# Cleaning.
@register("k1_dedup")
def _(w):
    return cleaning.remove_duplicates(w.raw)


@register("k2_dates")
def _(w):
    return cleaning.fix_impossible_dates(w.deduped).select(
        "subscriber_id", "churn_date", "churned", "churn_reason"
    )


@register("k3_fees")
def _(w):
    return cleaning.fix_fees(w.deduped, w.fit).select(
        "subscriber_id", "plan_tier", "monthly_fee_per_seat"
    )


@register("k4_engagement")
def _(w):
    return cleaning.impute_engagement(w.deduped, w.fit).select("subscriber_id", "engagement_score")


@register("k5_logins")
def _(w):
    return cleaning.impute_logins(w.deduped, w.fit).select(
        "subscriber_id", "monthly_logins_per_user"
    )


@register("k6_caps")
def _(w):
    filled = cleaning.impute_logins(w.deduped, w.fit)
    return cleaning.cap_outliers(filled, w.fit).select("subscriber_id", *cleaning.CAPPED)


@register("k7_types")
def _(w):
    as_text = w.deduped.select(*[F.col(c).cast("string").alias(c) for c in w.deduped.columns])
    return cleaning.normalize_types(as_text)


@register("k8_clean_all")
def _(w):
    return cleaning.clean(w.raw)[0]


@register("k8_audit_log")
def _(w):
    return cleaning.audit_log(w.raw, w.deduped, w.fit)


@register("a08_tier_medians")
def _(w):
    return cleaning.fit(w.deduped).tier_medians


@register("a09_quartiles")
def _(w):
    names = ("seat_count", "tenure_months", "total_contract_value")
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("measure"), F.col(n).cast("decimal(20,4)").alias("value"))
            for n in names
        ]
    )
    q = quantiles(w.clean.select(F.inline(cells)), ["measure"], "value", ["0.25", "0.5", "0.75"])
    return q.select(
        "measure",
        *[F.col("quantiles")[p].alias(n) for p, n in
          (("0.25", "q1"), ("0.5", "median"), ("0.75", "q3"))],
    )


@register("w7_repeated_ids")
def _(w):
    return w.raw.agg(
        keyed.n_repeats(F.col("subscriber_id")).alias("n_repeats"),
        keyed.n_repeats(F.col("churn_reason")).alias("n_repeats_with_nulls"),
    )


# Validation.
@register("l1_header")
def _(w):
    return quality.header(w.raw).drop("n_bad_dates")


@register("l2_date_order")
def _(w):
    return quality.header(w.raw).select("n_rows", "n_bad_dates")


@register("l3_profile")
def _(w):
    return quality.profile(w.raw).select(
        "column_name", "n_total", "n_null", "pct_null", "n_unique"
    )


@register("l4_7_rule_violations")
def _(w):
    return quality.violations(w.raw)


@register("l9_constraints")
def _(w):
    return constraints.constraint_violations(w.fact, w.predictions)


@register("l9b_all_tables")
def _(w):
    dims = w.dims
    return constraints.all_violations(
        {
            "dim_plan": dims.plans, "dim_region": dims.regions, "dim_channel": dims.channels,
            "dim_industry": dims.industries, "fact_subscribers": w.fact, "fact_model_predictions": w.predictions,
        }
    )


@register("l9c_keys_of_raw_rows")
def _(w):
    """Keys and checks on rows that break them."""
    rules = constraints.TableRules(
        ("subscriber_id", "churn_reason"),
        {"seat_count": F.col("seat_count") < 5},
        {
            "primary_key:subscriber_id": ("subscriber_id",),
            "unique:plan_tier,region,industry_vertical": ("plan_tier", "region", "industry_vertical"),
            "unique:churn_reason": ("churn_reason",),
        },
    )
    return constraints.rule_violations(w.raw, "subscribers_raw", rules)


@register("l8_missing_columns")
def _(w):
    """A raw file without two columns: its report names them, and profiles the others."""
    path = fresh_path(w, "raw")
    files.write_raw(w.raw.drop("region", "seat_count"), path)
    report = quality.report(files.read_raw(w.spark, path))
    issue = F.explode(F.filter("global_issues", lambda i: i.contains("missing"))).alias("issue")
    return report.select("n_rows", F.size("columns").alias("n_profiled"), issue)


@register("l9_orphans")
def _(w):
    return constraints.all_orphans(w.fact, w.predictions, w.dims.by_key())


@register("l10_report_lines")
def _(w):
    return quality.report_lines(quality.report(w.raw))


@register("l11_reconcile")
def _(w):
    return constraints.reconcile(w.fact, w.clean, kpis.by_plan(w.warehouse))


@register("j12_key_lookup_default")
def _(w):
    """Industry codes in another case match nothing and fall to id 1."""
    other_case = w.clean.withColumn("industry_vertical", F.initcap("industry_vertical"))
    return lookup_keys(other_case, w.dims).select(
        "subscriber_id", "plan_id", "region_id", "channel_id", "industry_id"
    )


@register("j12_lookup_misses")
def _(w):
    other_case = w.clean.withColumn("industry_vertical", F.initcap("industry_vertical"))
    return constraints.lookup_misses(other_case, w.dims)


# Scalar functions and predicates over whole tables.
@register("h13_safe_parse")
def _(w):
    text = w.raw.select(
        F.when(F.col("churned") == 1, F.lit("unknown"))
        .otherwise(F.col("subscription_start_date").cast("string"))
        .alias("day"),
        F.when(F.col("plan_tier") == "starter", F.lit("n/a"))
        .otherwise(F.col("seat_count").cast("string"))
        .alias("seats"),
    )
    parsed = text.select(
        F.try_to_date("day").alias("day"), F.col("seats").try_cast("double").alias("seats")
    )
    return parsed.agg(
        F.count("*").alias("n"),
        F.count("day").alias("n_days"),
        F.min("day").alias("first_day"),
        F.count("seats").alias("n_seats"),
        F.sum("seats").alias("seats"),
    )


@register("h20_compact_revenue")
def _(w):
    return w.fact.select(
        "subscriber_id", compact_number(F.col("monthly_arr_usd"), "$").alias("arr_text")
    )


@register("p08_predicates")
def _(w):
    c = F.col
    return w.fact.agg(
        F.count_if(~c("churned").isin(0, 1)).alias("not_binary"),
        F.count_if(c("churn_date").isNotNull()).alias("dated"),
        F.count_if(c("engagement_score").between(40, 60)).alias("mid_engagement"),
        F.count_if(c("contract_months").isin(12)).alias("annual"),
    )


@register("p13_picker_values")
def _(w):
    plans = reports.picker_values(w.documents, "plan_tier").select(
        F.lit("plan_tier").alias("picker"), F.col("plan_tier").alias("value")
    )
    return plans.unionByName(
        reports.picker_values(w.documents, "region_code").select(
            F.lit("region_code").alias("picker"), F.col("region_code").alias("value")
        )
    )


# Features.
def _rounded_logs(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, 9) for c in ("fee_per_seat_log", "seat_count_log", "tenure_log")}
    )


@register("m2_11_features")
def _(w):
    return _rounded_logs(features.build_features(w.clean, w.edges))


@register("m6_engagement_decile")
def _(w):
    edges = features.fit_decile_edges(w.clean)
    return (
        w.clean.groupBy(
            features.apply_decile(F.col("engagement_score"), edges).alias("engagement_decile")
        )
        .agg(
            F.count("*").alias("n"),
            F.min("engagement_score").alias("lowest"),
            F.max("engagement_score").alias("highest"),
        )
    )


@register("a10_decile_edges")
def _(w):
    q = quantiles(w.clean, [], "engagement_score", [str(i / 10) for i in range(11)])
    return q.select(F.explode("quantiles").alias("prob", "edge"))


# The three below read what the stages of the trainers make.
@register("m14_scaled")
def _(w):
    scaled = models.scaling_stage(w.preparation).transform(w.features)
    return scaled.select("subscriber_id", *[F.round(n, 6).alias(n) for n in w.preparation.scaled_names()])


@register("m15_onehot")
def _(w):
    prep = w.preparation
    encoder = models.code_stage(prep)
    cols = [
        (F.col(f"{c}_code") == place).cast("int").alias(name)
        for c in encoder.sizes
        for place, name in enumerate(features.one_hot_names(c, prep.categories[c]))
    ]
    return encoder.transform(w.features).select("subscriber_id", *cols)


@register("m16_label_index")
def _(w):
    names = list(w.preparation.sizes)
    rows = categories.with_positions(w.features, w.preparation.index, names)
    return rows.select(
        "subscriber_id", *[categories.strict_index(c, f"{c}_position").alias(f"{c}_index") for c in names]
    )


@register("m16b_index_of_open_vocabulary")
def _(w):
    """Positions of a column with a value per customer, joined back to the rows."""
    index = categories.category_index(w.clean, ["subscriber_id", "industry_vertical"])
    rows = categories.with_positions(w.clean, index, ["subscriber_id", "industry_vertical"])
    return rows.select("subscriber_id", "subscriber_id_position", "industry_vertical_position")


@register("a17_fingerprint")
def _(w):
    return fingerprint(w.clean, [c for c, t in w.clean.dtypes if t != "double"])


@register("a17b_fingerprint_of_all_columns")
def _(w):
    """Doubles enter as text of six decimals, so that a changed score changes the fingerprint."""
    texts = w.clean.withColumns({c: F.col(c).cast("decimal(20,6)") for c, t in w.clean.dtypes if t == "double"})
    return fingerprint(texts)


@register("m13_catalog")
def _(w):
    """Descriptions read back from the stored features, with the rows that they describe."""
    path = fresh_path(w, "features")
    files.write_features(features.with_comments(w.features), path)
    stored = files.read_features(w.spark, path)
    n = stored.agg(F.count("*").alias("n_rows"))
    rows = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.metadata["comment"]).alias("comment"))
            for f in stored.schema
            if "comment" in f.metadata
        ]
    )
    return n.select(F.inline(rows), "n_rows")


# Splits, scores and metrics.
@register("n1_split_shares")
def _(w):
    parts = w.clean.withColumn("split", splits.split_of(F.col("subscriber_id")))
    return splits.split_shares(parts, LABEL)


@register("n1_exact_split")
def _(w):
    return splits.exact_split(w.clean, "subscriber_id", LABEL).select("subscriber_id", "split")


@register("n2_folds")
def _(w):
    return (
        w.clean.groupBy(splits.fold_of(F.col("subscriber_id")).alias("fold"))
        .agg(F.count("*").alias("n"), F.sum(LABEL).alias("n_churned"))
    )


@register("n2b_stratified_folds")
def _(w):
    return splits.stratified_folds(w.clean, "subscriber_id", LABEL).select("subscriber_id", "fold")


@register("n5_baseline")
def _(w):
    train = w.clean.filter(splits.split_of(F.col("subscriber_id")) == "train")
    return splits.baseline_probability(w.clean, train, "subscriber_id", LABEL).select(
        "subscriber_id", "churn_probability"
    )


def with_baseline(w: Workspace) -> DataFrame:
    baseline = QUERIES["n5_baseline"](w).join(
        w.clean.select("subscriber_id", F.col(LABEL).alias("churned_actual")), "subscriber_id"
    )
    columns = ["model_name", "churn_probability", "churned_actual"]
    return (
        baseline.withColumn("model_name", F.lit("baseline"))
        .select(*columns)
        .unionByName(w.scored.select(*columns))
    )


@register("n9_roc_auc")
def _(w):
    return metrics.ranking_metrics(with_baseline(w)).select("model_name", "roc_auc")


@register("n10_average_precision")
def _(w):
    return metrics.ranking_metrics(with_baseline(w)).select("model_name", "pr_auc")


@register("n11_threshold_metrics")
def _(w):
    return metrics.threshold_metrics(with_baseline(w))


@register("n12_comparison")
def _(w):
    return metrics.compare_models(with_baseline(w))


@register("n16_scores")
def _(w):
    return w.predictions


@register("a16_class_weights")
def _(w):
    return metrics.class_weights(w.clean, LABEL)


# Reports.
@register("d01_heatmap")
def _(w):
    retention = kpis.cohort_retention(w.warehouse)
    return reports.cohort_heatmap(retention, reports.periods_without_gaps(retention))


@register("d02_watchlist_summary")
def _(w):
    return reports.watchlist_summary(kpis.flagged_accounts(w.warehouse))


def _searched(w: Workspace) -> DataFrame:
    return reports.filter_watchlist(
        kpis.flagged_accounts(w.warehouse),
        tiers=["high", "medium"],
        plans=["starter", "growth"],
        search="[13579]$",
    )


@register("d03_watchlist_page")
def _(w):
    return reports.page(_searched(w), 2)


@register("d03_page_count")
def _(w):
    return reports.page_count(_searched(w))


@register("d04_histogram")
def _(w):
    return reports.score_histogram(w.scored.filter(F.col("model_name") == HEURISTIC))


@register("d05_best_model")
def _(w):
    return reports.best_and_worst(metrics.compare_models(with_baseline(w)))


@register("d06_narrative")
def _(w):
    return reports.narrative(kpis.headline(w.warehouse))


@register("d07_savings")
def _(w):
    return reports.savings_estimate(kpis.headline(w.warehouse))


@register("d08_segment_filter")
def _(w):
    return reports.apply_filters(kpis.by_region(w.warehouse), plan="growth", region="EMEA")


def _train_and_test(w: Workspace, df: DataFrame) -> list[DataFrame]:
    split = splits.split_of(F.col("subscriber_id"))
    return [df.filter(split == part) for part in ("train", "test")]


@register("x1_score_distance")
def _(w):
    one, two = (drift.score_histogram(df) for df in _train_and_test(w, w.predictions))
    return drift.score_distance(one, two).withColumn("ks", F.round("ks", 9))


@register("x2_stability_index")
def _(w):
    one, two = _train_and_test(w, w.clean)
    texts, edges = ["plan_tier", "region", "industry_vertical"], drift.rank_edges(one, ["tenure_months", "seat_count"])
    index = drift.stability_index(drift.histogram(one, texts, edges), drift.histogram(two, texts, edges))
    return index.withColumn("psi", F.round("psi", 7))


@register("x3_rate_gap")
def _(w):
    rounded = [F.round(c, 7).alias(c) for c in ("mean_score", "observed_rate", "gap")]
    return drift.rate_gap(w.scored).select("model_name", "risk_tier", "n", *rounded)


@register("x4_permuted_columns")
def _(w):
    """Every account once per column, with that column's values dealt anew."""
    copies = importance.permuted(w.clean, ["tenure_months", "seat_count"], "subscriber_id")
    return copies.select("subscriber_id", "permuted_column", "tenure_months", "seat_count")


@register("h22_page_of_percentages")
def _(w):
    """A watch-list whose probabilities are percentages, shown as shares."""
    flagged = kpis.flagged_accounts(w.warehouse)
    percent = flagged.withColumn("churn_probability", F.col("churn_probability") * 100)
    return reports.page(percent, 1)


@register("t5_preview")
def _(w):
    return reports.preview(w.documents.select("subscriber_id", "plan_tier", "region_code").orderBy("subscriber_id"))


# Models: no SQL equivalent.
def _parts(w: Workspace) -> tuple[DataFrame, DataFrame]:
    split = splits.split_of(F.col("subscriber_id"))
    return w.features.filter(split == "train"), w.features.filter(split == "test")


def _fit_and_score(w: Workspace, trainer) -> DataFrame:
    train, test = _parts(w)
    return models.score(trainer(train), test)


@register("n3_cross_validation")
def _(w):
    return models.cross_validate(_parts(w)[0], models.train_logistic)


@register("n6_logistic")
def _(w):
    return models.evaluate({"logistic_regression": _fit_and_score(w, models.train_logistic)})


@register("n7_forest")
def _(w):
    return models.evaluate({"random_forest": _fit_and_score(w, models.train_forest)})


@register("n8_gbt")
def _(w):
    return models.evaluate({"gradient_boost": _fit_and_score(w, models.train_boosting)})


@register("n13_scoring")
def _(w):
    train, _test = _parts(w)
    return models.score(models.train_logistic(train), w.features)


@register("n14_model_roundtrip")
def _(w):
    train, test = _parts(w)
    model = models.train_logistic(train)
    path = fresh_path(w, "model")
    models.save_model(model, path)
    again = models.score(models.load_model(path), test).withColumnRenamed(
        "churn_probability", "reloaded_probability"
    )
    both = models.score(model, test).join(again.drop("churned_actual"), "subscriber_id")
    return both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("churn_probability") != F.col("reloaded_probability")).alias("n_different"),
    )


@register("n15_mlp")
def _(w):
    return models.evaluate({"perceptron": _fit_and_score(w, models.train_perceptron)})


# What holds of a model whatever it learned: rows scored, bounds, a fit better than chance.
def _facts_of(w: Workspace, trainer) -> DataFrame:
    train, _ = _parts(w)
    model = trainer(train)
    path = fresh_path(w, "model")
    models.save_model(model, path)
    again = models.score(models.load_model(path), w.features).select(
        "subscriber_id", F.col("churn_probability").alias("reloaded")
    )
    fit = metrics.ranking_metrics(models.stack({"m": models.score(model, train)})).first()
    p = F.col("churn_probability")
    return (
        models.score(model, w.features)
        .join(again, "subscriber_id")
        .agg(
            F.count("*").alias("n_scored"),
            F.countDistinct("subscriber_id").alias("n_accounts"),
            F.sum("churned_actual").alias("n_churned"),
            F.count_if(p.isNull() | ~p.between(0, 1)).alias("n_out_of_bounds"),
            F.count_if(F.abs(p - F.col("reloaded")) > 1e-12).alias("n_different_after_reload"),
        )
        .withColumn("fits_better_than_chance", F.lit(fit["roc_auc"] > 0.5))
    )


for _name, _trainer in {
    "n6b_facts_of_logistic": models.train_logistic,
    "n7b_facts_of_forest": models.train_forest,
    "n8b_facts_of_boosting": models.train_boosting,
    "n15b_facts_of_neural": models.train_perceptron,
}.items():
    QUERIES[_name] = lambda w, t=_trainer: _facts_of(w, t)


@register("n3b_facts_of_cross_validation")
def _(w):
    row = models.cross_validate(_parts(w)[0], models.train_logistic)
    n = w.clean.filter(splits.split_of(F.col("subscriber_id")) == "train").agg(F.count("*").alias("n_train"))
    inside = [F.col(c).between(0, 1).alias(f"{c}_in_bounds") for c in row.columns]
    facts = row.select(F.struct(*inside).alias("facts"))
    return n.withColumn("facts", facts.scalar()).select("n_train", "facts.*")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, sf_dir, q=query: portable(q(open_workspace(spark, sf_dir))))
        for name, query in QUERIES.items()
    }
