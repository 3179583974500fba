"""Raw subscriber accounts derived from customers, their orders and order lines.

One account per customer that has ordered. All arithmetic is on integers, so the
result does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import CHANNELS
from holdfast.functions.business import account_id, heuristic_churn_score, tenure_months
from holdfast.functions.exact import int_div
from holdfast.schemas import RAW, column_names

MARKET_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Fixed values per plan: hash limit, fee floor and spread in cents, seat floor and spread.
PLAN_PROFILE = (
    ("starter", 38, 999, 2000, 1, 5),
    ("growth", 68, 2999, 5000, 5, 21),
    ("professional", 90, 7999, 12000, 20, 81),
    ("enterprise", 100, 19999, 30000, 80, 421),
)


def _per_plan(position: int) -> Column:
    expr = F.lit(PLAN_PROFILE[-1][position])
    for row in reversed(PLAN_PROFILE[:-1]):
        expr = F.when(F.col("plan_tier") == row[0], F.lit(row[position])).otherwise(expr)
    return expr


def _plan_of(h: Column) -> Column:
    expr = F.lit(PLAN_PROFILE[-1][0])
    for name, limit, *_ in reversed(PLAN_PROFILE[:-1]):
        expr = F.when(h < limit, F.lit(name)).otherwise(expr)
    return expr


def _order_facts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.min("o_day").alias("first_dt"),
        F.max("o_day").alias("last_dt"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(
            (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
        ).alias("n_lowp"),
    )


def _line_facts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # The distinct supplier count makes Spark group by (customer, supplier) first,
    # so one customer with a large share of the lines is spread over many tasks.
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("line_custkey"))
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
            F.countDistinct("l_suppkey").alias("n_supp"),
        )
    )


def derive_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders").withColumn("o_day", F.to_date("o_orderdate"))
    places = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    base = (
        table("customer")
        .join(_order_facts(orders), F.col("c_custkey") == F.col("o_custkey"))
        .join(
            _line_facts(orders, table("lineitem")),
            F.col("c_custkey") == F.col("line_custkey"),
            "left",
        )
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("observed", orders.agg(F.max("o_day")).scalar())
    )

    k = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    base = base.select(
        "*",
        cents.alias("cents"),
        account_id(k).alias("subscriber_id"),
        _plan_of((k * 7919) % 100).alias("plan_tier"),
        F.when((k * 104729) % 100 < 55, "monthly").otherwise("annual").alias("billing_cycle"),
        F.when((F.col("r_name") == "AMERICA") & (F.col("c_nationkey") >= 16), "LATAM")
        .when(F.col("r_name") == "AMERICA", "NAM")
        .when(F.col("r_name") == "ASIA", "APAC")
        .otherwise("EMEA")
        .alias("region"),
        F.element_at(
            F.array(*map(F.lit, CHANNELS)), ((k * 31 + 7) % 6 + 1).cast("int")
        ).alias("acquisition_channel"),
        F.col("c_mktsegment").alias("industry_vertical"),
        F.col("first_dt").alias("subscription_start_date"),
        F.when(F.col("last_dt") < F.date_sub("observed", 365), 1).otherwise(0).alias("churned"),
    )

    annual = F.col("billing_cycle") == "annual"
    list_price = _per_plan(2) + int_div(F.col("cents") * _per_plan(3), 1_000_000)
    fee_cents = (
        F.when(F.col("cents") < 0, int_div(F.col("cents"), 200))
        .when(annual, int_div(list_price * 85, 100))
        .otherwise(list_price)
    )
    n_lines = F.coalesce("n_lines", F.lit(0))
    churned = F.col("churned") == 1
    accounts = (
        base.withColumns(
            {
                "contract_months": F.when(annual, 12).otherwise(1),
                "fee_cents": fee_cents,
                "seat_count": (_per_plan(4) + n_lines % _per_plan(5)).cast("int"),
                "payment_failures_12m": F.least(F.lit(4), "n_lowp").cast("int"),
                "engagement_score": F.when(
                    k % 33 != 0, (k * 37 + F.col("n_orders") * 13) % 1001 / F.lit(10)
                ).cast("decimal(6,2)"),
                "feature_adoption_rate": (
                    int_div(F.col("n_f") * 1000, F.col("n_lines")) / F.lit(1000)
                ).cast("decimal(4,3)"),
            }
        )
        .withColumns(
            {
                "monthly_fee_per_seat": (F.col("fee_cents").cast("decimal(18,0)") / 100).cast(
                    "decimal(13,3)"
                ),
                "total_contract_value": (
                    (F.col("fee_cents") * F.col("seat_count") * F.col("contract_months")).cast(
                        "decimal(18,0)"
                    )
                    / 100
                ).cast("decimal(20,4)"),
                "tenure_months": tenure_months(F.col("first_dt"), F.col("observed")),
                "support_tickets_90d": F.col("n_urgent").cast("int"),
                "n_integrations": (F.coalesce("n_supp", F.lit(0)) % 12).cast("int"),
                "monthly_logins_per_user": F.when(
                    k % 67 != 0, F.col("qty").cast("decimal(18,0)") / 10
                ).cast("decimal(18,4)"),
                "churn_date": F.when(
                    churned,
                    F.when(k % 7 == 0, F.date_sub("first_dt", 10)).otherwise(
                        F.date_add("last_dt", 30)
                    ),
                ),
                "churn_reason": F.when(
                    churned,
                    F.when(F.col("payment_failures_12m") >= 2, "Price sensitivity")
                    .when(F.col("engagement_score") < 40, "Low engagement")
                    .otherwise("Feature gaps"),
                ),
            }
        )
        .withColumn("churn_probability_true", heuristic_churn_score())
    )

    # Every hundredth account arrives a second time, later and with one ticket more.
    copies = F.when(k % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        accounts.withColumn("copy", F.explode(copies))
        .withColumn("ingest_seq", k + F.col("copy") * 1_000_000_000)
        .withColumn("support_tickets_90d", F.col("support_tickets_90d") + F.col("copy"))
        .select(*column_names(RAW))
    )
