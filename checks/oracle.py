"""The same answers in SQL for DuckDB, over the test tables.

Money, fees, scores and rates are kept as integers - fees in thousandths, revenue in
cents, contract value and logins in ten-thousandths, engagement in hundredths, adoption
in thousandths - and become decimals in the last step only.
"""

from __future__ import annotations

RAW = """
ord AS (
    SELECT o_custkey, count(*) AS n_orders,
           min(CAST(o_orderdate AS DATE)) AS first_dt, max(CAST(o_orderdate AS DATE)) AS last_dt,
           count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
           count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS n_lowp
    FROM orders GROUP BY o_custkey),
lin AS (
    SELECT o_custkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
           count(*) FILTER (WHERE l_linestatus = 'F') AS n_f,
           count(DISTINCT l_suppkey) AS n_supp
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
obs AS (SELECT max(CAST(o_orderdate AS DATE)) AS obs FROM orders),
cust AS (
    SELECT c_custkey AS k, c_nationkey, r_name, c_mktsegment,
           CAST(round(c_acctbal * 100) AS BIGINT) AS cents, (c_custkey * 7919) % 100 AS h,
           n_orders, first_dt, last_dt, n_urgent, n_lowp,
           coalesce(n_lines, 0) AS n_lines, qty, n_f, coalesce(n_supp, 0) AS n_supp, obs
    FROM customer JOIN ord ON c_custkey = ord.o_custkey
    LEFT JOIN lin ON c_custkey = lin.o_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    CROSS JOIN obs),
planned AS (
    SELECT *,
        CASE WHEN h < 38 THEN 'starter' WHEN h < 68 THEN 'growth'
             WHEN h < 90 THEN 'professional' ELSE 'enterprise' END AS plan_tier,
        CASE WHEN (k * 104729) % 100 < 55 THEN 'monthly' ELSE 'annual' END AS billing_cycle,
        CASE WHEN h < 38 THEN 999 WHEN h < 68 THEN 2999 WHEN h < 90 THEN 7999 ELSE 19999 END AS lo,
        CASE WHEN h < 38 THEN 2000 WHEN h < 68 THEN 5000 WHEN h < 90 THEN 12000 ELSE 30000 END AS sp,
        CASE WHEN h < 38 THEN 1 WHEN h < 68 THEN 5 WHEN h < 90 THEN 20 ELSE 80 END AS slo,
        CASE WHEN h < 38 THEN 5 WHEN h < 68 THEN 21 WHEN h < 90 THEN 81 ELSE 421 END AS ssp,
        CAST(last_dt < obs - 365 AS INTEGER) AS churned0
    FROM cust),
priced AS (
    SELECT *, slo + n_lines % ssp AS seat_count,
        CASE WHEN billing_cycle = 'annual' THEN 12 ELSE 1 END AS contract_months,
        CASE WHEN cents < 0 THEN cents // 200
             WHEN billing_cycle = 'annual' THEN ((lo + (cents * sp) // 1000000) * 85) // 100
             ELSE lo + (cents * sp) // 1000000 END AS fee_c,
        CASE WHEN k % 33 <> 0 THEN (k * 37 + n_orders * 13) % 1001 END AS eng_t,
        least(4, n_lowp) AS fails
    FROM planned),
acc AS (
    SELECT 'SUB-' || CASE WHEN length(CAST(k AS VARCHAR)) >= 6 THEN CAST(k AS VARCHAR)
                          ELSE lpad(CAST(k AS VARCHAR), 6, '0') END AS subscriber_id,
        k, first_dt AS start_dt, plan_tier, billing_cycle,
        CASE WHEN r_name = 'AMERICA' AND c_nationkey >= 16 THEN 'LATAM'
             WHEN r_name = 'AMERICA' THEN 'NAM' WHEN r_name = 'ASIA' THEN 'APAC'
             ELSE 'EMEA' END AS region,
        CASE (k * 31 + 7) % 6 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid_search' WHEN 2 THEN 'referral'
             WHEN 3 THEN 'partner' WHEN 4 THEN 'direct_sales' ELSE 'trial_convert'
             END AS acquisition_channel,
        c_mktsegment AS industry_vertical, fee_c * 10 AS fee_m, seat_count,
        fee_c * seat_count * contract_months * 100 AS tcv_u, contract_months,
        CAST(greatest(1, round(CAST(obs - first_dt AS DOUBLE) / 30.44)) AS BIGINT) AS tenure_months,
        eng_t * 10 AS eng_h, n_urgent AS support_tickets_90d, fails AS payment_failures_12m,
        n_supp % 12 AS n_integrations,
        CASE WHEN k % 67 <> 0 THEN qty * 1000 END AS log_u,
        CASE WHEN n_lines > 0 THEN (n_f * 1000) // n_lines END AS ado_m, churned0 AS churned,
        CASE WHEN churned0 = 1 THEN CASE WHEN k % 7 = 0 THEN first_dt - 10 ELSE last_dt + 30 END
             END AS churn_date,
        CASE WHEN churned0 = 1 THEN CASE WHEN fails >= 2 THEN 'Price sensitivity'
             WHEN eng_t < 400 THEN 'Low engagement' ELSE 'Feature gaps' END END AS churn_reason
    FROM priced)"""


def score(prefix: str = "") -> str:
    """The heuristic churn score in the units above."""
    p = prefix
    logit = (
        f"(0.88::DOUBLE - 1.20::DOUBLE * (ln(1.0::DOUBLE + {p}tenure_months) / ln(37.0::DOUBLE))"
        f" - 1.50::DOUBLE * ((coalesce({p}eng_h, 0) / 100.0::DOUBLE) / 100.0::DOUBLE)"
        f" - 0.80::DOUBLE * ({p}n_integrations / 11.0::DOUBLE)"
        f" - 0.60::DOUBLE * (CASE {p}plan_tier WHEN 'starter' THEN 0.0::DOUBLE"
        f" WHEN 'growth' THEN 1.0::DOUBLE WHEN 'professional' THEN 2.0::DOUBLE"
        f" ELSE 3.0::DOUBLE END / 3.0::DOUBLE)"
        f" - 0.70::DOUBLE * CASE WHEN {p}billing_cycle = 'annual' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        f" - 0.40::DOUBLE * ((coalesce({p}log_u, 0) / 10000.0::DOUBLE) / 120.0::DOUBLE)"
        f" - 0.50::DOUBLE * (coalesce({p}ado_m, 0) / 1000.0::DOUBLE)"
        f" + 0.90::DOUBLE * ({p}support_tickets_90d / 5.0::DOUBLE)"
        f" + 1.20::DOUBLE * ({p}payment_failures_12m / 4.0::DOUBLE) - 0.10::DOUBLE)"
    )
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-{logit})), 4)"


RAW_ALL = RAW + f""",
scored_acc AS (SELECT *, {score()} AS churn_probability_true FROM acc),
raw AS (
    SELECT * EXCLUDE (k), k AS ingest_seq FROM scored_acc
    UNION ALL
    SELECT * EXCLUDE (k) REPLACE (support_tickets_90d + 1 AS support_tickets_90d),
           1000000000 + k AS ingest_seq
    FROM scored_acc WHERE k % 100 = 0)"""

DEDUP = RAW_ALL + """,
k1 AS (SELECT * FROM raw
       QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY ingest_seq) = 1)"""

STEPS = DEDUP + """,
k2 AS (SELECT * REPLACE (CASE WHEN churn_date < start_dt THEN NULL ELSE churn_date END AS churn_date,
                         CASE WHEN churn_date < start_dt THEN 0 ELSE churned END AS churned)
       FROM k1),
fee_med AS (SELECT plan_tier, CAST(median(fee_m) AS BIGINT) AS fee_med
            FROM k1 WHERE fee_m >= 9990 GROUP BY plan_tier),
eng_med AS (SELECT plan_tier, CAST(median(eng_h) AS BIGINT) AS eng_med FROM k1 GROUP BY plan_tier),
log_med AS (SELECT CAST(median(log_u) AS BIGINT) AS log_med FROM k1),
k5 AS (SELECT k2.* REPLACE (CASE WHEN fee_m < 9990 THEN fee_med ELSE fee_m END AS fee_m,
                            coalesce(eng_h, eng_med) AS eng_h, coalesce(log_u, log_med) AS log_u)
       FROM k2 LEFT JOIN fee_med USING (plan_tier) LEFT JOIN eng_med USING (plan_tier)
       CROSS JOIN log_med),
quart AS (SELECT
    CAST(quantile_cont(support_tickets_90d * 10000, 0.25) AS BIGINT) AS t1,
    CAST(quantile_cont(support_tickets_90d * 10000, 0.75) AS BIGINT) AS t3,
    CAST(quantile_cont(log_u, 0.25) AS BIGINT) AS l1, CAST(quantile_cont(log_u, 0.75) AS BIGINT) AS l3,
    CAST(quantile_cont(tcv_u, 0.25) AS BIGINT) AS c1, CAST(quantile_cont(tcv_u, 0.75) AS BIGINT) AS c3
    FROM k5),
fence AS (SELECT t1 - 3 * (t3 - t1) AS t_lo, t3 + 3 * (t3 - t1) AS t_hi,
                 l1 - 3 * (l3 - l1) AS l_lo, l3 + 3 * (l3 - l1) AS l_hi,
                 c1 - 3 * (c3 - c1) AS c_lo, c3 + 3 * (c3 - c1) AS c_hi FROM quart),
clean AS (SELECT k5.* REPLACE (
        least(greatest(support_tickets_90d * 10000, t_lo), t_hi) // 10000 AS support_tickets_90d,
        least(greatest(log_u, l_lo), l_hi) AS log_u, least(greatest(tcv_u, c_lo), c_hi) AS tcv_u)
    FROM k5 CROSS JOIN fence)"""

FACT = STEPS + """,
dim_plan AS (SELECT * FROM (VALUES (1, 'starter', 1), (2, 'growth', 2), (3, 'professional', 3),
    (4, 'enterprise', 4)) t(plan_id, plan_tier, tier_rank)),
dim_region AS (SELECT * FROM (VALUES (1, 'NAM', 'North America'),
    (2, 'EMEA', 'Europe, Middle East & Africa'), (3, 'APAC', 'Asia-Pacific'),
    (4, 'LATAM', 'Latin America')) t(region_id, region_code, region_name)),
dim_channel AS (SELECT * FROM (VALUES (1, 'organic', 'inbound'), (2, 'paid_search', 'outbound'),
    (3, 'referral', 'viral'), (4, 'partner', 'partnership'), (5, 'direct_sales', 'outbound'),
    (6, 'trial_convert', 'inbound')) t(channel_id, channel_code, channel_type)),
dim_industry AS (SELECT * FROM (VALUES (1, 'AUTOMOBILE'), (2, 'BUILDING'), (3, 'FURNITURE'),
    (4, 'HOUSEHOLD'), (5, 'MACHINERY')) t(industry_id, industry_name)),
fact AS (SELECT c.*, coalesce(plan_id, 1) AS plan_id, coalesce(region_id, 1) AS region_id,
        coalesce(channel_id, 1) AS channel_id, coalesce(industry_id, 1) AS industry_id,
        tier_rank, region_code, region_name, channel_code, channel_type, industry_name,
        fee_m * seat_count * 12 // 10 AS arr_c
    FROM clean c LEFT JOIN dim_plan p ON lower(c.plan_tier) = p.plan_tier
    LEFT JOIN dim_region ON upper(region) = region_code
    LEFT JOIN dim_channel ON lower(acquisition_channel) = channel_code
    LEFT JOIN dim_industry ON industry_vertical = industry_name)"""

# 0.4 (1 - engagement) + 0.3 failures / 4 + 0.3 tickets / 5, in hundred-thousandths.
RISK = """(40000 - 4 * least(greatest(eng_h, 0), 10000)
    + 7500 * least(greatest(payment_failures_12m, 0), 4)
    + 6000 * least(greatest(support_tickets_90d, 0), 5))"""


def half_even(value: str, unit: int) -> str:
    """``value`` in whole ``unit`` steps, ties to the even step."""
    return (
        f"(({value}) // {unit} + CASE WHEN ({value}) % {unit} * 2 > {unit} THEN 1"
        f" WHEN ({value}) % {unit} * 2 = {unit} THEN (({value}) // {unit}) % 2 ELSE 0 END)"
    )


PRED = FACT + f""",
pred AS (
    SELECT subscriber_id, 'heuristic' AS model_name, {score()} AS p FROM clean
    UNION ALL
    SELECT subscriber_id, 'simple_risk' AS model_name, {half_even(RISK, 10)} / 10000.0 AS p FROM clean),
predictions AS (
    SELECT subscriber_id, model_name, 'fixture' AS run_id, p AS churn_probability,
        CAST(p >= 0.40 AS BIGINT) AS predicted_churned,
        CASE WHEN p >= 0.70 THEN 'high' WHEN p >= 0.40 THEN 'medium' ELSE 'low' END AS risk_tier,
        '2024-12-31 00:00:00' AS predicted_at
    FROM pred)"""


def rounded(num: str, den: str, places: int) -> str:
    """num / den rounded half up, for num >= 0, on integers."""
    f = 10**places
    return (
        f"CAST((2 * {f} * CAST({num} AS HUGEINT) + {den}) // (2 * nullif({den}, 0)) AS DOUBLE) / {f}"
    )


def avg(col: str, unit: int, places: int) -> str:
    return rounded(f"sum({col})", f"(count({col}) * {unit})", places)


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


RATE = rounded("100 * sum(churned)", "count(*)", 2)
COUNTS = f"count(*) AS n_subscribers, {big('sum(churned)')} AS n_churned, {RATE} AS churn_rate_pct"


def whole_usd(cents: str) -> str:
    return rounded(cents, "100", 0)


ACCOUNT = f"""subscriber_id, {day('start_dt')} AS subscription_start_date, plan_tier, billing_cycle,
    region, acquisition_channel, industry_vertical, fee_m / 1000.0::DOUBLE AS monthly_fee_per_seat,
    {big('seat_count')} AS seat_count, tcv_u / 10000.0::DOUBLE AS total_contract_value,
    {big('contract_months')} AS contract_months, tenure_months,
    eng_h / 100.0::DOUBLE AS engagement_score, {big('support_tickets_90d')} AS support_tickets_90d,
    {big('payment_failures_12m')} AS payment_failures_12m, {big('n_integrations')} AS n_integrations,
    log_u / 10000.0::DOUBLE AS monthly_logins_per_user, ado_m / 1000.0::DOUBLE AS feature_adoption_rate,
    {big('churned')} AS churned, {day('churn_date')} AS churn_date, churn_reason,
    churn_probability_true"""

QUARTER = "CAST(quarter(start_dt) AS BIGINT)"
YEAR = "CAST(year(start_dt) AS BIGINT)"
TENURE_BAND = """CASE WHEN tenure_months < 3 THEN '0-3 months' WHEN tenure_months < 6 THEN '3-6 months'
    WHEN tenure_months < 12 THEN '6-12 months' WHEN tenure_months < 24 THEN '12-24 months'
    ELSE '24+ months' END"""
SEGMENT = """CASE WHEN eng_h >= 8000 THEN 'Champion (80-100)' WHEN eng_h >= 6000 THEN 'Engaged (60-79)'
    WHEN eng_h >= 4000 THEN 'At Risk (40-59)' WHEN eng_h >= 2000 THEN 'Disengaged (20-39)'
    ELSE 'Critical (<20)' END"""
BAND = """CASE WHEN eng_h >= 7500 THEN 'Healthy (75-100)' WHEN eng_h >= 5000 THEN 'Moderate (50-74)'
    WHEN eng_h >= 2500 THEN 'At-Risk (25-49)' ELSE 'Critical (0-24)' END"""

FLAGGED = f"""SELECT subscriber_id, plan_tier, region_code, industry_name, tenure_months,
    eng_h / 100.0::DOUBLE AS engagement_score, {big('payment_failures_12m')} AS payment_failures_12m,
    {big('support_tickets_90d')} AS support_tickets_90d, {whole_usd('arr_c')} AS arr_usd,
    churn_probability, risk_tier, model_name, predicted_at
    FROM predictions JOIN fact USING (subscriber_id)
    WHERE risk_tier IN ('high', 'medium') AND churned = 0"""
WATCHLIST = PRED + f""", flagged AS ({FLAGGED}),
watchlist AS (SELECT * FROM flagged
              ORDER BY churn_probability DESC, subscriber_id, model_name LIMIT 500)"""

HEADLINE = f"""SELECT count(*) AS total_subscribers,
    {big('sum(CASE WHEN churned = 0 THEN 1 ELSE 0 END)')} AS active_subscribers,
    {big('sum(churned)')} AS churned_subscribers, {RATE} AS churn_rate_pct,
    {whole_usd('sum(arr_c)')} AS total_arr_usd,
    {whole_usd('sum(CASE WHEN churned = 0 THEN arr_c ELSE 0 END)')} AS active_arr_usd,
    {whole_usd('sum(CASE WHEN churned = 1 THEN arr_c ELSE 0 END)')} AS lost_arr_usd,
    {avg('tenure_months', 1, 1)} AS avg_tenure_months, {avg('eng_h', 100, 1)} AS avg_engagement_score
    FROM fact"""

MONTHS = """,
ev AS (SELECT strftime(start_dt, '%Y-%m') AS event_month, sum(arr_c) AS added, 0 AS lost
       FROM fact GROUP BY 1
       UNION ALL
       SELECT strftime(churn_date, '%Y-%m'), 0, sum(arr_c) FROM fact
       WHERE churned = 1 AND churn_date IS NOT NULL GROUP BY 1),
monthly AS (SELECT event_month, CAST(sum(added) AS BIGINT) AS added, CAST(sum(lost) AS BIGINT) AS lost
            FROM ev GROUP BY 1)"""


def months(net: str) -> str:
    return f"""WITH {FACT}{MONTHS}
    SELECT event_month, added / 100.0::DOUBLE AS arr_added, lost / 100.0::DOUBLE AS arr_lost,
        (added - lost) / 100.0::DOUBLE AS {net},
        CAST(sum(added - lost) OVER (ORDER BY event_month ROWS UNBOUNDED PRECEDING) AS BIGINT)
            / 100.0::DOUBLE AS running_arr
    FROM monthly"""


COHORTS = f""",
co AS (SELECT {YEAR} AS cohort_year, 'Q' || {QUARTER} AS cohort_quarter,
              tenure_months // 3 AS period_bucket, churned FROM fact),
cohort_base AS (SELECT cohort_year, cohort_quarter, count(*) AS cohort_size FROM co GROUP BY 1, 2),
activity AS (SELECT cohort_year, cohort_quarter, period_bucket, count(*) AS n_active
             FROM co WHERE churned = 0 GROUP BY 1, 2, 3),
retention AS (SELECT cohort_year, cohort_quarter, period_bucket, cohort_size, n_active,
                     {rounded('100 * n_active', 'cohort_size', 1)} AS retention_pct
              FROM activity JOIN cohort_base USING (cohort_year, cohort_quarter))"""


def at_risk(predictions: str) -> str:
    return f"""WITH {PRED}, source AS ({predictions}),
    total AS (SELECT sum(arr_c) AS all_active FROM fact WHERE churned = 0)
    SELECT risk_tier, count(DISTINCT subscriber_id) AS n_accounts,
        {whole_usd('sum(arr_c)')} AS arr_at_risk_usd,
        {rounded('100 * sum(arr_c)', 'max(all_active)', 2)} AS pct_of_total_arr
    FROM source JOIN fact USING (subscriber_id) CROSS JOIN total
    WHERE churned = 0 AND risk_tier IN ('high', 'medium') GROUP BY risk_tier"""


def share(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0) * 100.0::DOUBLE, 0.0)"


def plain_avg(col: str, unit: int) -> str:
    return f"(CAST(sum({col}) AS DOUBLE) / {unit}::DOUBLE) / CAST(count({col}) AS DOUBLE)"


DOC_COUNTS = f"""count(*) AS n_subscribers, {big('sum(churned)')} AS n_churned,
    {big('sum(arr_c)')} / 100.0::DOUBLE AS total_arr_usd, {share('sum(churned)', 'count(*)')} AS churn_rate_pct"""

PROFILED = (
    ("subscriber_id", "subscriber_id", "{c} IS NULL", None, None, None, True),
    ("plan_tier", "plan_tier", "{c} IS NULL", "('starter','growth','professional','enterprise')", None, None, False),
    ("billing_cycle", "billing_cycle", "{c} IS NULL", "('monthly','annual')", None, None, False),
    ("region", "lower(region)", "{c} IS NULL", "('apac','emea','latam','nam')", None, None, False),
    ("acquisition_channel", "acquisition_channel", "{c} IS NULL",
     "('organic','paid_search','referral','partner','direct_sales','trial_convert')", None, None, False),
    ("monthly_fee_per_seat", "fee_m", "{c} IS NULL", None, 9990, 999990, False),
    ("seat_count", "seat_count", "{c} IS NULL", None, 1, 500, False),
    ("contract_months", "contract_months", "{c} IS NULL", None, 1, 36, False),
    ("tenure_months", "tenure_months", "{c} IS NULL", None, 0, None, False),
    ("engagement_score", "eng_h", None, None, 0, 10000, False),
    ("support_tickets_90d", "support_tickets_90d", "{c} IS NULL", None, 0, None, False),
    ("payment_failures_12m", "payment_failures_12m", "{c} IS NULL", None, 0, 12, False),
    ("n_integrations", "n_integrations", "{c} IS NULL", None, 0, None, False),
    ("feature_adoption_rate", "ado_m", None, None, 0, 1000, False),
    ("churned", "churned", "{c} IS NULL", "(0, 1)", None, None, False),
)


def _profile_rows() -> str:
    parts = [
        f"""SELECT '{name}' AS column_name, count(*) AS n_total, count(*) - count({c}) AS n_null,
        {rounded(f'100 * (count(*) - count({c}))', 'count(*)', 2)} AS pct_null,
        count(DISTINCT {c}) AS n_unique FROM raw"""
        for name, c, *_ in PROFILED
    ]
    return " UNION ALL ".join(parts)


# Rule name -> (order in the report, text).
RULE_TEXT = {
    "nulls_found": (1, "nulls"),
    "not_allowed": (2, "values not allowed"),
    "below_minimum": (3, "values below minimum"),
    "above_maximum": (4, "values above maximum"),
    "duplicates": (5, "duplicate values"),
}


def _violation_rows() -> str:
    parts = []

    def add(name: str, rule: str, n: str) -> None:
        parts.append(
            f"SELECT '{name}' AS column_name, '{rule}' AS rule, CAST({n} AS BIGINT) AS n_violations FROM raw"
        )

    for name, c, not_null, allowed, low, high, unique in PROFILED:
        if not_null:
            add(name, "nulls_found", f"count(*) FILTER (WHERE {not_null.format(c=c)})")
        if allowed:
            add(name, "not_allowed", f"count(*) FILTER (WHERE {c} NOT IN {allowed})")
        if low is not None:
            add(name, "below_minimum", f"count(*) FILTER (WHERE {c} < {low})")
        if high is not None:
            add(name, "above_maximum", f"count(*) FILTER (WHERE {c} > {high})")
        if unique:
            add(name, "duplicates", f"count({c}) - count(DISTINCT {c})")
    return (
        "v AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_violations > 0)"
    )


def _report_lines() -> str:
    order = " ".join(f"WHEN '{r}' THEN {i}" for r, (i, _) in RULE_TEXT.items())
    text = " ".join(f"WHEN '{r}' THEN '{t}'" for r, (_, t) in RULE_TEXT.items())
    return f"""WITH {RAW_ALL}, {_violation_rows()},
    h AS (SELECT count(*) AS n_rows, count(*) - count(DISTINCT subscriber_id) AS n_dup,
        {rounded('100 * (count(*) - count(DISTINCT subscriber_id))', 'count(*)', 2)} AS pct,
        count(*) FILTER (WHERE churn_date < start_dt) AS n_bad FROM raw),
    profile AS ({_profile_rows()}),
    lines AS (
        SELECT 0 AS part, '' AS col, 0 AS pos, 'Rows: ' || n_rows || ' | Duplicates: ' || n_dup || ' ('
            || CAST(pct AS VARCHAR) || '%) | Total issues: '
            || ((SELECT count(*) FROM v) + CAST(n_dup > 0 AS INTEGER) + CAST(n_bad > 0 AS INTEGER)) AS value FROM h
        UNION ALL SELECT 1, '', 0, '--- Global issues ---'
        UNION ALL SELECT 2, '', 0, '  - ' || n_dup || ' duplicate subscriber_id values' FROM h WHERE n_dup > 0
        UNION ALL SELECT 3, '', 0, '  - ' || n_bad || ' rows where churn_date precedes subscription_start_date'
        FROM h WHERE n_bad > 0
        UNION ALL SELECT 4, '', 0, '--- Column issues ---'
        UNION ALL SELECT DISTINCT 5, column_name, 0,
            '  ' || column_name || ' (null: ' || CAST(pct_null AS VARCHAR) || '%):' FROM v JOIN profile USING (column_name)
        UNION ALL SELECT 5, column_name, CASE rule {order} END,
            '      - ' || n_violations || ' ' || CASE rule {text} END FROM v)
    SELECT row_number() OVER (ORDER BY part, col, pos) - 1 AS line_no, value FROM lines"""


def _constraints() -> str:
    fact_required = {
        "subscriber_id": "subscriber_id", "plan_id": "plan_id", "region_id": "region_id",
        "channel_id": "channel_id", "industry_id": "industry_id",
        "subscription_start_date": "start_dt", "billing_cycle": "billing_cycle",
        "contract_months": "contract_months", "tenure_months": "tenure_months",
        "monthly_fee_per_seat": "fee_m", "seat_count": "seat_count",
        "total_contract_value": "tcv_u", "monthly_arr_usd": "arr_c",
        "support_tickets_90d": "support_tickets_90d", "payment_failures_12m": "payment_failures_12m",
        "n_integrations": "n_integrations", "churned": "churned",
    }
    fact_checks = {
        "billing_cycle": "billing_cycle IN ('monthly', 'annual')",
        "contract_months": "contract_months IN (1, 12)", "tenure_months": "tenure_months >= 0",
        "monthly_fee_per_seat": "fee_m > 0", "seat_count": "seat_count > 0",
        "engagement_score": "eng_h BETWEEN 0 AND 10000",
        "payment_failures_12m": "payment_failures_12m >= 0",
        "feature_adoption_rate": "ado_m BETWEEN 0 AND 1000", "churned": "churned IN (0, 1)",
    }
    pred_required = (
        "subscriber_id", "model_name", "run_id", "churn_probability", "predicted_churned",
        "risk_tier", "predicted_at",
    )
    pred_checks = {
        "churn_probability": "churn_probability BETWEEN 0 AND 1",
        "predicted_churned": "predicted_churned IN (0, 1)",
        "risk_tier": "risk_tier IN ('high', 'medium', 'low')",
    }

    def row(table: str, source: str, name: str, bad: str) -> str:
        return (
            f"SELECT '{table}' AS table_name, '{name}' AS constraint_name,"
            f" count(*) FILTER (WHERE {bad}) AS n_violations FROM {source}"
        )

    parts = [row("fact_subscribers", "fact", f"not_null:{n}", f"{c} IS NULL") for n, c in fact_required.items()]
    parts += [row("fact_subscribers", "fact", f"check:{n}", f"NOT ({c})") for n, c in fact_checks.items()]
    parts += [row("fact_model_predictions", "predictions", f"not_null:{c}", f"{c} IS NULL") for c in pred_required]
    parts += [row("fact_model_predictions", "predictions", f"check:{n}", f"NOT ({c})") for n, c in pred_checks.items()]
    return f"WITH {PRED} " + " UNION ALL ".join(parts)


def _orphans() -> str:
    parts = [
        f"""SELECT 'fact_subscribers.{key}' AS reference, count(*) AS n_orphans
        FROM fact f LEFT JOIN {dim} d ON f.{key} = d.{key} WHERE d.{key} IS NULL"""
        for key, dim in (("plan_id", "dim_plan"), ("region_id", "dim_region"),
                         ("channel_id", "dim_channel"), ("industry_id", "dim_industry"))
    ]
    parts.append(
        """SELECT 'fact_model_predictions.subscriber_id', count(*)
        FROM predictions p LEFT JOIN fact f ON p.subscriber_id = f.subscriber_id
        WHERE f.subscriber_id IS NULL"""
    )
    return f"WITH {PRED} " + " UNION ALL ".join(parts)


def fixed(value: str, decimals: int) -> str:
    """Non-negative or negative integer ``value`` in units of 10^-decimals as text."""
    f = 10**decimals
    return (
        f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || CAST(abs({value}) // {f} AS VARCHAR) || '.'"
        f" || lpad(CAST(abs({value}) % {f} AS VARCHAR), {decimals}, '0'))"
    )


def cents_text(value: str) -> str:
    """Ten-thousandths as text with two decimals, half away from zero."""
    return fixed(
        f"(CASE WHEN {value} < 0 THEN -((-({value}) + 50) // 100) ELSE (({value}) + 50) // 100 END)", 2
    )


def _audit() -> str:
    caps = {
        "support_tickets_90d": ("support_tickets_90d * 10000", "t_lo", "t_hi"),
        "monthly_logins_per_user": ("log_u", "l_lo", "l_hi"),
        "total_contract_value": ("tcv_u", "c_lo", "c_hi"),
    }
    cap_counts = ", ".join(
        f"(SELECT count(*) FROM k5 CROSS JOIN fence WHERE {v} < {lo} OR {v} > {hi}) AS cap{i}"
        for i, (v, lo, hi) in enumerate(caps.values())
    )
    rows = [
        "SELECT 1 AS step_no, 'dedup' AS step, dropped AS n_affected, 'Deduplication: removed ' || dropped ||"
        " ' duplicate rows (kept first per subscriber_id)' AS message FROM n",
        "SELECT 2, 'dates', dates, 'Date fix: ' || dates ||"
        " ' rows with churn_date before subscription_start_date' FROM n",
        "SELECT 3, 'fees', fees, 'Fee fix: ' || fees ||"
        " ' fees below the minimum set to the plan-tier median' FROM n",
        "SELECT 4, 'engagement', scores, 'Imputation: ' || scores ||"
        " ' null engagement_score set to the plan-tier median' FROM n",
        "SELECT 5, 'logins', logins, 'Imputation: ' || logins ||"
        f" ' null monthly_logins_per_user set to the median (' || {cents_text('log_med')} || ')' FROM n CROSS JOIN log_med",
    ]
    for i, (c, (_, lo, hi)) in enumerate(caps.items()):
        rows.append(
            f"SELECT {6 + i}, 'cap_{c}', cap{i}, 'Outlier cap ({c}): ' || cap{i} || ' values capped to [' ||"
            f" {cents_text(lo)} || ', ' || {cents_text(hi)} || ']' FROM n CROSS JOIN fence"
        )
    rows.append("SELECT 9, 'types', 0, 'Type normalization' FROM n")
    return f"""WITH {STEPS}, n AS (SELECT
        (SELECT count(*) FROM raw) - (SELECT count(*) FROM k1) AS dropped,
        (SELECT count(*) FROM k1 WHERE churn_date < start_dt) AS dates,
        (SELECT count(*) FROM k1 WHERE fee_m < 9990) AS fees,
        (SELECT count(*) FROM k1 WHERE eng_h IS NULL) AS scores,
        (SELECT count(*) FROM k1 WHERE log_u IS NULL) AS logins, {cap_counts}),
    steps AS ({" UNION ALL ".join(rows)})
    SELECT CAST(step_no AS BIGINT) AS step_no, step, n_affected, message FROM steps
    WHERE step IN ('dedup', 'types') OR n_affected > 0"""


# Exact ten-quantile edges in thousandths: position (n-1) k / 10 between two sorted scores.
EDGES = """,
sorted_eng AS (SELECT eng_h, row_number() OVER (ORDER BY eng_h) - 1 AS i, count(*) OVER () AS n
               FROM clean WHERE eng_h IS NOT NULL),
edges AS (SELECT d.k, max(CASE WHEN i = ((n - 1) * d.k) // 10 THEN eng_h END) * (10 - max(((n - 1) * d.k) % 10))
               + max(CASE WHEN i = ((n - 1) * d.k + 9) // 10 THEN eng_h END) * max(((n - 1) * d.k) % 10) AS edge_t
          FROM sorted_eng CROSS JOIN (SELECT unnest(range(0, 11)) AS k) d GROUP BY d.k),
inner_edges AS (SELECT DISTINCT edge_t FROM edges
                WHERE edge_t > (SELECT min(edge_t) FROM edges) AND edge_t < (SELECT max(edge_t) FROM edges)),
deciled AS (SELECT subscriber_id AS sid, 1 + (SELECT count(*) FROM inner_edges e WHERE c.eng_h * 10 > e.edge_t) AS engagement_decile
            FROM clean c)"""

FEATURES = FACT + EDGES + f""",
feat AS (SELECT f.*,
        CASE plan_tier WHEN 'starter' THEN 0 WHEN 'growth' THEN 1 WHEN 'professional' THEN 2 ELSE 3 END AS plan_tier_enc,
        CAST(billing_cycle = 'annual' AS BIGINT) AS billing_annual_flag,
        ln(1.0::DOUBLE + fee_m / 1000.0::DOUBLE) AS fee_log,
        ln(1.0::DOUBLE + seat_count) AS seat_log, ln(1.0::DOUBLE + tenure_months) AS ten_log,
        engagement_decile, {half_even(RISK, 10)} / 10000.0::DOUBLE AS risk_score_simple,
        CAST(support_tickets_90d > 3 AS BIGINT) AS is_high_ticket_user,
        CAST(payment_failures_12m >= 2 AS BIGINT) AS is_payment_delinquent,
        CAST(coalesce(ado_m < 250, FALSE) AS BIGINT) AS is_low_adoption,
        seat_count * eng_h / 100.0::DOUBLE AS seats_x_engagement,
        round_even(ln(1.0::DOUBLE + arr_c / 100.0::DOUBLE) * ln(1.0::DOUBLE + tenure_months), 4) AS log_arr_x_tenure,
        CAST(acquisition_channel = 'organic' AS BIGINT) AS channel_is_organic,
        CAST(acquisition_channel = 'referral' AS BIGINT) AS channel_is_referral
    FROM fact f JOIN deciled ON subscriber_id = sid)"""

NUMERIC = {
    "monthly_fee_per_seat": "fee_m / 1000.0::DOUBLE", "seat_count": "seat_count",
    "contract_months": "contract_months", "tenure_months": "tenure_months",
    "engagement_score": "eng_h / 100.0::DOUBLE", "support_tickets_90d": "support_tickets_90d",
    "payment_failures_12m": "payment_failures_12m", "n_integrations": "n_integrations",
    "monthly_logins_per_user": "log_u / 10000.0::DOUBLE",
    "feature_adoption_rate": "ado_m / 1000.0::DOUBLE", "plan_tier_enc": "plan_tier_enc",
    "monthly_arr_usd": "arr_c / 100.0::DOUBLE", "fee_per_seat_log": "fee_log",
    "seat_count_log": "seat_log", "tenure_log": "ten_log",
    "engagement_decile": "engagement_decile", "risk_score_simple": "risk_score_simple",
    "seats_x_engagement": "seats_x_engagement", "log_arr_x_tenure": "log_arr_x_tenure",
}


def _scaled() -> str:
    cells = ", ".join(f"coalesce(CAST({e} AS DOUBLE), 0.0::DOUBLE) AS {n}" for n, e in NUMERIC.items())
    stats = ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s" for n in NUMERIC)
    out = ", ".join(
        f"round(({n} - {n}_m) / CASE WHEN {n}_s = 0 THEN 1.0 ELSE {n}_s END, 6) AS {n}_scaled"
        for n in NUMERIC
    )
    return f"""WITH {FEATURES}, nums AS (SELECT subscriber_id, {cells} FROM feat),
    stats AS (SELECT {stats} FROM nums)
    SELECT subscriber_id, {out} FROM nums CROSS JOIN stats"""


CATEGORIES = {
    "plan_tier": ("enterprise", "growth", "professional", "starter"),
    "region": ("apac", "emea", "latam", "nam"),
    "acquisition_channel": (
        "direct_sales", "organic", "paid_search", "partner", "referral", "trial_convert",
    ),
    "industry_vertical": ("automobile", "building", "furniture", "household", "machinery"),
}


def _one_hot() -> str:
    cells = [
        f"CAST(lower({c}) = '{v}' AS BIGINT) AS {c}_{v}" for c, vs in CATEGORIES.items() for v in vs[1:]
    ]
    return f"WITH {STEPS} SELECT subscriber_id, {', '.join(cells)} FROM clean"


def _label_index() -> str:
    cells = [
        f"CAST(list_position({list(vs)}, lower({c})) - 1 AS BIGINT) AS {c}_index"
        for c, vs in CATEGORIES.items()
    ]
    return f"WITH {STEPS} SELECT subscriber_id, {', '.join(cells)} FROM clean"


def hashed(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def salted(purpose: str) -> str:
    return hashed(f"subscriber_id || '|{purpose}|42'")


SPLIT = f"""CASE WHEN {salted('split')} % 10000 < 2000 THEN 'test'
    WHEN {salted('split')} % 10000 < 3500 THEN 'val' ELSE 'train' END"""

SCORED = PRED + f""",
prior AS (SELECT CAST(sum(churned) AS BIGINT) AS pos, count(*) AS n FROM clean WHERE {SPLIT} = 'train'),
baseline AS (SELECT subscriber_id, churned,
        CASE WHEN ({salted('baseline')} % 10000) * n < pos * 10000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p
    FROM clean CROSS JOIN prior),
scored AS (SELECT 'baseline' AS model_name, p, churned AS y FROM baseline
           UNION ALL
           SELECT model_name, churn_probability, churned FROM predictions JOIN fact USING (subscriber_id)),
by_score AS (SELECT model_name, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1, 2),
walked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
                  sum(pos) OVER (PARTITION BY model_name) AS all_pos,
                  sum(neg) OVER (PARTITION BY model_name) AS all_neg
           FROM by_score WINDOW w AS (PARTITION BY model_name ORDER BY p DESC)),
ranking AS (SELECT model_name,
        round(CAST(sum(neg * (2 * (tp - pos) + pos)) AS DOUBLE)
              / (2.0::DOUBLE * CAST(max(all_pos) AS DOUBLE) * CAST(max(all_neg) AS DOUBLE)), 4) AS roc_auc,
        round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))
              / CAST(max(all_pos) AS DOUBLE), 4) AS pr_auc
    FROM walked GROUP BY model_name),
confusion AS (SELECT model_name,
        count(*) FILTER (WHERE p >= 0.4 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.4 AND y = 0) AS fp,
        count(*) FILTER (WHERE p < 0.4 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.4 AND y = 0) AS tn
    FROM scored GROUP BY model_name),
threshold AS (SELECT *,
        coalesce({rounded('2 * tp', '(2 * tp + fp + fn)', 4)}, 0.0) AS f1,
        coalesce({rounded('tp', '(tp + fp)', 4)}, 0.0) AS "precision",
        coalesce({rounded('tp', '(tp + fn)', 4)}, 0.0) AS recall
    FROM confusion),
comparison AS (SELECT model_name AS model, roc_auc, pr_auc, f1, "precision", recall,
                      0.4::DOUBLE AS threshold FROM ranking JOIN threshold USING (model_name))"""


def compact(cents: str) -> str:
    """Dollar text of an amount in cents."""
    m, k = f"(({cents} + 5000000) // 10000000)", f"(({cents} + 5000) // 10000)"
    return f"""CASE WHEN {cents} >= 100000000 THEN '$' || ({m} // 10) || '.' || ({m} % 10) || 'M'
        WHEN {cents} >= 100000 THEN '$' || ({k} // 10) || '.' || ({k} % 10) || 'K'
        ELSE '$' || (({cents} + 50) // 100) END"""


def _date_text(col: str) -> str:
    return f"coalesce({day(col)}, '~')"


def _decimal_text(col: str, scale: int) -> str:
    return f"coalesce({fixed(col, scale)}, '~')"


FINGERPRINT_ROW = " || '|' || ".join(
    f"CASE WHEN CAST({x} AS VARCHAR) = '~' THEN '~' "
    f"ELSE length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    for x in [
        "subscriber_id", _date_text("start_dt"), "plan_tier", "billing_cycle", "region",
        "acquisition_channel", "industry_vertical", _decimal_text("fee_m", 3), "seat_count",
        _decimal_text("tcv_u", 4), "contract_months", "tenure_months", _decimal_text("eng_h", 2),
        "support_tickets_90d", "payment_failures_12m", "n_integrations",
        _decimal_text("log_u", 4), _decimal_text("ado_m", 3), "churned", _date_text("churn_date"),
        "coalesce(churn_reason, '~')",
    ]
)

PAGE_FILTER = """risk_tier IN ('high', 'medium') AND plan_tier IN ('starter', 'growth')
    AND regexp_matches(subscriber_id, '[13579]$')"""

# The oldest account of the test tables is in its 27th tenure period at every scale.
HEATMAP_CELLS = ", ".join(
    f"round(avg(CASE WHEN period_bucket = {p} THEN retention_pct END), 6) AS period_{p}" for p in range(27)
)

ORACLE: dict[str, str] = {
    "q01_attrition_trend": f"""WITH {FACT}, q AS (SELECT {YEAR} AS cohort_year, {QUARTER} AS cohort_q,
            count(*) AS n, {big('sum(churned)')} AS n_churned,
            CAST((2 * 10000 * sum(churned) + count(*)) // (2 * count(*)) AS BIGINT) AS r FROM fact GROUP BY 1, 2),
        l AS (SELECT *, lag(r) OVER (ORDER BY cohort_year, cohort_q) AS pr FROM q)
        SELECT cohort_year, cohort_q, n, n_churned, r / 100.0::DOUBLE AS churn_rate_pct,
            pr / 100.0::DOUBLE AS prev_period_rate, (r - pr) / 100.0::DOUBLE AS period_change_pct FROM l""",
    "q02_plan_retention_ranked": f"""WITH {FACT} SELECT plan_tier, {big('tier_rank')} AS tier_rank, {COUNTS},
            rank() OVER (ORDER BY sum(churned) * 1.0 / count(*) DESC) AS churn_rank,
            {avg('tenure_months', 1, 1)} AS avg_tenure_months
        FROM fact GROUP BY plan_tier, tier_rank""",
    "q03_arr_at_risk": at_risk("SELECT * FROM predictions"),
    "q03_arr_at_risk_after_append": at_risk(
        "SELECT * FROM predictions UNION ALL SELECT * FROM predictions"
    ),
    "q04_channel_retention_curve": f"""WITH {FACT} SELECT channel_code, {TENURE_BAND} AS tenure_bucket,
            count(*) AS n, {big('sum(churned)')} AS n_churned, {RATE} AS churn_rate_pct
        FROM fact GROUP BY 1, 2""",
    "q05_arr_running_total": months("net_arr_change"),
    "q05b_arr_trend_documents": months("net_change"),
    "u1_arr_union_of_aggregates": months("net_arr_change"),
    "q06_industry_churn_arr": f"""WITH {FACT} SELECT industry_name, {COUNTS},
            {whole_usd('sum(CASE WHEN churned = 1 THEN arr_c ELSE 0 END)')} AS arr_lost_usd,
            rank() OVER (ORDER BY sum(churned) * 1.0 / count(*) DESC) AS churn_rank,
            rank() OVER (ORDER BY sum(CASE WHEN churned = 1 THEN arr_c ELSE 0 END) DESC) AS arr_loss_rank
        FROM fact GROUP BY industry_name""",
    "q07_engagement_quartiles": f"""WITH {FACT}, r AS (SELECT plan_tier, eng_h,
            ntile(4) OVER (PARTITION BY plan_tier ORDER BY eng_h, subscriber_id) AS quartile
            FROM fact WHERE eng_h IS NOT NULL)
        SELECT plan_tier, quartile, count(*) AS n, {rounded('min(eng_h)', '100', 1)} AS min_score,
            {rounded('max(eng_h)', '100', 1)} AS max_score, {avg('eng_h', 100, 1)} AS avg_score
        FROM r GROUP BY 1, 2""",
    "q08_cohort_six_month": f"""WITH {FACT}, b AS (SELECT {YEAR} AS start_year,
            CAST(month(start_dt) AS BIGINT) AS start_month, count(*) AS cohort_size,
            count(*) FILTER (WHERE tenure_months >= 6 AND churned = 0) AS still_active_6m FROM fact GROUP BY 1, 2)
        SELECT *, {rounded('100 * still_active_6m', 'cohort_size', 1)} AS six_month_retention_pct FROM b""",
    "v01_headline": f"WITH {FACT} {HEADLINE}",
    "v02_by_plan": f"""WITH {FACT} SELECT plan_tier, {big('tier_rank')} AS tier_rank, {COUNTS},
            {avg('fee_m', 1000, 2)} AS avg_monthly_fee, {avg('seat_count', 1, 1)} AS avg_seats,
            {whole_usd('sum(arr_c)')} AS total_arr_usd, {avg('tenure_months', 1, 1)} AS avg_tenure_months,
            {avg('eng_h', 100, 1)} AS avg_engagement FROM fact GROUP BY plan_tier, tier_rank""",
    "v03_by_region": f"""WITH {FACT} SELECT region_code, region_name, {COUNTS},
            {whole_usd('sum(arr_c)')} AS total_arr_usd, {avg('eng_h', 100, 1)} AS avg_engagement
        FROM fact GROUP BY region_code, region_name""",
    "v04_by_channel": f"""WITH {FACT} SELECT channel_code, channel_type, {COUNTS},
            {avg('tenure_months', 1, 1)} AS avg_tenure_months, {avg('arr_c', 100, 0)} AS avg_arr_usd,
            {avg('eng_h', 100, 1)} AS avg_engagement FROM fact GROUP BY channel_code, channel_type""",
    "v05_cohort_retention": f"WITH {FACT}{COHORTS} SELECT * FROM retention",
    "j08_cohort_aggregates_joined": f"WITH {FACT}{COHORTS} SELECT * FROM retention",
    "v06_watchlist": f"WITH {WATCHLIST} SELECT * FROM watchlist",
    "j05_flagged_star_join": f"WITH {PRED} {FLAGGED}",
    "v07_engagement_segments": f"""WITH {FACT} SELECT {SEGMENT} AS engagement_segment, {COUNTS},
            {avg('arr_c', 100, 0)} AS avg_arr_usd, {avg('tenure_months', 1, 1)} AS avg_tenure FROM fact GROUP BY 1""",
    "v01b_headline_documents": f"""WITH {FACT} SELECT count(*) AS total_subscribers,
            count(*) FILTER (WHERE churned = 0) AS active_subscribers,
            count(*) FILTER (WHERE churned = 1) AS churned_subscribers,
            {big('sum(arr_c)')} / 100.0::DOUBLE AS total_arr_usd,
            {big('sum(CASE WHEN churned = 0 THEN arr_c ELSE 0 END)')} / 100.0::DOUBLE AS active_arr_usd,
            {big('sum(CASE WHEN churned = 1 THEN arr_c ELSE 0 END)')} / 100.0::DOUBLE AS lost_arr_usd,
            {plain_avg('tenure_months', 1)} AS avg_tenure_months, {plain_avg('eng_h', 100)} AS avg_engagement_score,
            {share('sum(churned)', 'count(*)')} AS churn_rate_pct FROM fact""",
    "v02b_by_plan_documents": f"""WITH {FACT} SELECT plan_tier, {big('tier_rank')} AS tier_rank, {DOC_COUNTS},
            {plain_avg('eng_h', 100)} AS avg_engagement FROM fact GROUP BY plan_tier, tier_rank""",
    "v03b_by_region_documents": f"""WITH {FACT} SELECT region_code, {DOC_COUNTS},
            {plain_avg('eng_h', 100)} AS avg_engagement FROM fact GROUP BY region_code""",
    "v04b_by_channel_documents": f"""WITH {FACT} SELECT channel_code, channel_type, {DOC_COUNTS}
        FROM fact GROUP BY channel_code, channel_type""",
    "v05b_bucket_survival": f"""WITH {FACT}{COHORTS} SELECT cohort_year, cohort_quarter, period_bucket,
            count(*) AS n_total, count(*) FILTER (WHERE churned = 0) AS n_active,
            {share('count(*) FILTER (WHERE churned = 0)', 'count(*)')} AS retention_pct FROM co GROUP BY 1, 2, 3""",
    "v06b_watchlist_single_model": f"""WITH {PRED} SELECT subscriber_id, churn_probability, risk_tier, plan_tier,
            region_code, arr_c / 100.0::DOUBLE AS arr_usd, tenure_months,
            eng_h / 100.0::DOUBLE AS engagement_score, predicted_at
        FROM predictions JOIN fact USING (subscriber_id)
        WHERE risk_tier IN ('high', 'medium') AND model_name = 'simple_risk' AND churned = 0
        ORDER BY churn_probability DESC, subscriber_id LIMIT 500""",
    "v07b_engagement_bands": f"""WITH {FACT} SELECT {BAND} AS engagement_segment, count(*) AS n_subscribers,
            {big('sum(churned)')} AS n_churned, {plain_avg('arr_c', 100)} AS avg_arr_usd,
            {share('sum(churned)', 'count(*)')} AS churn_rate_pct FROM fact GROUP BY 1""",
    "s01_raw_csv_roundtrip": f"WITH {RAW_ALL} SELECT {ACCOUNT}, ingest_seq FROM raw",
    "s02_clean_roundtrip": f"WITH {STEPS} SELECT {ACCOUNT} FROM clean",
    "s03_test_split_read": f"""WITH {STEPS}{EDGES} SELECT subscriber_id, plan_tier, engagement_decile,
            {big('churned')} AS churned, 'test' AS split FROM clean JOIN deciled ON subscriber_id = sid
        WHERE {SPLIT} = 'test'""",
    "s04_predictions_by_model": f"""WITH {PRED} SELECT subscriber_id, churn_probability,
            {big('churned')} AS churned_actual FROM predictions JOIN fact USING (subscriber_id)
        WHERE model_name = 'heuristic'""",
    "s05_parameterised_sql": f"""WITH {FACT} SELECT plan_tier, count(*) AS n, {big('sum(churned)')} AS n_churned
        FROM fact WHERE tier_rank >= 2 AND billing_cycle = 'annual' GROUP BY plan_tier""",
    "s06_document_chain": f"""WITH {FACT} SELECT channel_type, count(*) AS n, {big('sum(seat_count)')} AS seats
        FROM fact WHERE region_code IN ('NAM', 'EMEA') AND churn_date IS NOT NULL GROUP BY channel_type""",
    "s15_watchlist_export": f"""WITH {WATCHLIST} SELECT subscriber_id, plan_tier, region_code, industry_name,
            tenure_months, engagement_score, arr_usd, churn_probability, risk_tier, model_name
        FROM flagged WHERE plan_tier IN ('growth', 'starter')""",
    "s16_dim_seed": f"""WITH {FACT}
        SELECT 'plan_id' AS dimension, {big('d.plan_id')} AS id, d.plan_tier AS code, count(f.plan_id) AS n_accounts
        FROM dim_plan d LEFT JOIN fact f ON d.plan_id = f.plan_id GROUP BY ALL
        UNION ALL SELECT 'region_id', d.region_id, d.region_code, count(f.region_id)
        FROM dim_region d LEFT JOIN fact f ON d.region_id = f.region_id GROUP BY ALL
        UNION ALL SELECT 'channel_id', d.channel_id, d.channel_code, count(f.channel_id)
        FROM dim_channel d LEFT JOIN fact f ON d.channel_id = f.channel_id GROUP BY ALL
        UNION ALL SELECT 'industry_id', d.industry_id, d.industry_name, count(f.industry_id)
        FROM dim_industry d LEFT JOIN fact f ON d.industry_id = f.industry_id GROUP BY ALL""",
    "s17_upsert_subscribers": f"""WITH {RAW_ALL} SELECT {ACCOUNT} FROM raw
        QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY ingest_seq DESC) = 1""",
    "s18_upsert_predictions": f"WITH {PRED} SELECT * FROM predictions",
    "n16_scores": f"WITH {PRED} SELECT * FROM predictions",
    "s19_denormalised": f"""WITH {FACT} SELECT subscriber_id, plan_tier, region_code, channel_code, channel_type,
            industry_vertical, {day('start_dt')} AS subscription_start_date, billing_cycle,
            {big('contract_months')} AS contract_months, tenure_months,
            fee_m / 1000.0::DOUBLE AS monthly_fee_per_seat, {big('seat_count')} AS seat_count,
            tcv_u / 10000.0::DOUBLE AS total_contract_value, arr_c / 100.0::DOUBLE AS monthly_arr_usd,
            eng_h / 100.0::DOUBLE AS engagement_score, {big('support_tickets_90d')} AS support_tickets_90d,
            {big('payment_failures_12m')} AS payment_failures_12m, {big('n_integrations')} AS n_integrations,
            log_u / 10000.0::DOUBLE AS monthly_logins_per_user, ado_m / 1000.0::DOUBLE AS feature_adoption_rate,
            {big('churned')} AS churned, {day('churn_date')} AS churn_date, churn_reason FROM fact""",
    "s23_overview_frames": f"""WITH {WATCHLIST}{COHORTS}
        SELECT 'headline' AS frame, 1 AS n_rows UNION ALL SELECT 'by_plan', count(DISTINCT plan_id) FROM fact
        UNION ALL SELECT 'by_region', count(DISTINCT region_id) FROM fact
        UNION ALL SELECT 'by_channel', count(DISTINCT channel_id) FROM fact
        UNION ALL SELECT 'risk_watchlist', count(*) FROM flagged
        UNION ALL SELECT 'engagement_segments', count(DISTINCT {SEGMENT}) FROM fact
        UNION ALL SELECT 'cohort', count(*) FROM retention""",
    "k1_dedup": f"WITH {DEDUP} SELECT {ACCOUNT}, ingest_seq FROM k1",
    "k2_dates": f"""WITH {STEPS} SELECT subscriber_id, {day('churn_date')} AS churn_date,
        {big('churned')} AS churned, churn_reason FROM k2""",
    "k3_fees": f"WITH {STEPS} SELECT subscriber_id, plan_tier, fee_m / 1000.0::DOUBLE AS monthly_fee_per_seat FROM k5",
    "k4_engagement": f"WITH {STEPS} SELECT subscriber_id, eng_h / 100.0::DOUBLE AS engagement_score FROM k5",
    "k5_logins": f"WITH {STEPS} SELECT subscriber_id, log_u / 10000.0::DOUBLE AS monthly_logins_per_user FROM k5",
    "k6_caps": f"""WITH {STEPS} SELECT subscriber_id, {big('support_tickets_90d')} AS support_tickets_90d,
        log_u / 10000.0::DOUBLE AS monthly_logins_per_user, tcv_u / 10000.0::DOUBLE AS total_contract_value FROM clean""",
    "k7_types": f"WITH {DEDUP} SELECT {ACCOUNT} FROM k1",
    "k8_clean_all": f"WITH {STEPS} SELECT {ACCOUNT} FROM clean",
    "k8_audit_log": _audit(),
    "a08_tier_medians": f"""WITH {STEPS} SELECT plan_tier AS tier, fee_med / 1000.0::DOUBLE AS fee_median,
        eng_med / 100.0::DOUBLE AS engagement_median FROM fee_med FULL JOIN eng_med USING (plan_tier)""",
    "a09_quartiles": f"WITH {STEPS} " + " UNION ALL ".join(
        f"""SELECT '{name}' AS measure, quantile_cont({c}, 0.25) / {unit}::DOUBLE AS q1,
        median({c}) / {unit}::DOUBLE AS median, quantile_cont({c}, 0.75) / {unit}::DOUBLE AS q3 FROM clean"""
        for name, c, unit in (("seat_count", "seat_count", 1), ("tenure_months", "tenure_months", 1),
                              ("total_contract_value", "tcv_u", 10000))
    ),
    "w7_repeated_ids": f"""WITH {RAW_ALL} SELECT count(*) - count(DISTINCT subscriber_id) AS n_repeats,
        count(*) - count(DISTINCT coalesce(churn_reason, '~')) AS n_repeats_with_nulls FROM raw""",
    "l1_header": f"""WITH {RAW_ALL} SELECT count(*) AS n_rows, CAST(23 AS BIGINT) AS n_cols,
        count(*) - count(DISTINCT subscriber_id) AS n_duplicates,
        {rounded('100 * (count(*) - count(DISTINCT subscriber_id))', 'count(*)', 2)} AS pct_duplicates FROM raw""",
    "l2_date_order": f"""WITH {RAW_ALL} SELECT count(*) AS n_rows,
        count(*) FILTER (WHERE churn_date < start_dt) AS n_bad_dates FROM raw""",
    "l3_profile": f"WITH {RAW_ALL} {_profile_rows()}",
    "l4_7_rule_violations": f"WITH {RAW_ALL}, {_violation_rows()} SELECT * FROM v",
    "l10_report_lines": _report_lines(),
    "l9_constraints": _constraints(),
    "l9_orphans": _orphans(),
    "l11_reconcile": f"""WITH {FACT} SELECT 'fact' AS layer, count(*) AS n, {big('sum(churned)')} AS n_churned,
            {RATE} AS churn_rate_pct FROM fact
        UNION ALL SELECT 'cleaned', count(*), {big('sum(churned)')}, {RATE} FROM clean
        UNION ALL SELECT 'plan_totals', {big('sum(n)')}, {big('sum(c)')}, {rounded('100 * sum(c)', 'sum(n)', 2)}
        FROM (SELECT plan_id, count(*) AS n, sum(churned) AS c FROM fact GROUP BY plan_id)""",
    "j12_key_lookup_default": f"""WITH {FACT} SELECT subscriber_id, {big('plan_id')} AS plan_id,
        {big('region_id')} AS region_id, {big('channel_id')} AS channel_id, CAST(1 AS BIGINT) AS industry_id FROM fact""",
    "j12_lookup_misses": f"""WITH {STEPS} SELECT 'plan' AS dimension, 0 AS n_defaulted UNION ALL SELECT 'region', 0
        UNION ALL SELECT 'channel', 0 UNION ALL SELECT 'industry', count(*) FROM clean""",
    "h13_safe_parse": f"""WITH {RAW_ALL}, t AS (SELECT
            CASE WHEN churned = 1 THEN 'unknown' ELSE {day('start_dt')} END AS d,
            CASE WHEN plan_tier = 'starter' THEN 'n/a' ELSE CAST(seat_count AS VARCHAR) END AS s FROM raw)
        SELECT count(*) AS n, count(try_cast(d AS DATE)) AS n_days,
            strftime(min(try_cast(d AS DATE)), '%Y-%m-%d') AS first_day,
            count(try_cast(s AS DOUBLE)) AS n_seats, sum(try_cast(s AS DOUBLE)) AS seats FROM t""",
    "h20_compact_revenue": f"WITH {FACT} SELECT subscriber_id, {compact('arr_c')} AS arr_text FROM fact",
    "p08_predicates": f"""WITH {FACT} SELECT count(*) FILTER (WHERE churned NOT IN (0, 1)) AS not_binary,
        count(*) FILTER (WHERE churn_date IS NOT NULL) AS dated,
        count(*) FILTER (WHERE eng_h BETWEEN 4000 AND 6000) AS mid_engagement,
        count(*) FILTER (WHERE contract_months IN (12)) AS annual FROM fact""",
    "p13_picker_values": f"""WITH {FACT} SELECT DISTINCT 'plan_tier' AS picker, plan_tier AS value FROM fact
        UNION ALL SELECT DISTINCT 'region_code', region_code FROM fact""",
    "m2_11_features": f"""WITH {FEATURES} SELECT subscriber_id, lower(plan_tier) AS plan_tier,
            lower(billing_cycle) AS billing_cycle, lower(region) AS region,
            lower(acquisition_channel) AS acquisition_channel, lower(industry_vertical) AS industry_vertical,
            fee_m / 1000.0::DOUBLE AS monthly_fee_per_seat, {big('seat_count')} AS seat_count,
            tcv_u / 10000.0::DOUBLE AS total_contract_value, {big('contract_months')} AS contract_months,
            tenure_months, eng_h / 100.0::DOUBLE AS engagement_score,
            {big('support_tickets_90d')} AS support_tickets_90d,
            {big('payment_failures_12m')} AS payment_failures_12m, {big('n_integrations')} AS n_integrations,
            log_u / 10000.0::DOUBLE AS monthly_logins_per_user, ado_m / 1000.0::DOUBLE AS feature_adoption_rate,
            {big('churned')} AS churned, {big('plan_tier_enc')} AS plan_tier_enc, billing_annual_flag,
            arr_c / 100.0::DOUBLE AS monthly_arr_usd, round(fee_log, 9) AS fee_per_seat_log,
            round(seat_log, 9) AS seat_count_log, round(ten_log, 9) AS tenure_log, engagement_decile,
            risk_score_simple, is_high_ticket_user, is_payment_delinquent, is_low_adoption,
            seats_x_engagement, log_arr_x_tenure, channel_is_organic, channel_is_referral FROM feat""",
    "m6_engagement_decile": f"""WITH {STEPS}{EDGES} SELECT engagement_decile, count(*) AS n,
        min(eng_h) / 100.0::DOUBLE AS lowest, max(eng_h) / 100.0::DOUBLE AS highest
        FROM clean JOIN deciled ON subscriber_id = sid GROUP BY 1""",
    "a10_decile_edges": f"""WITH {STEPS}{EDGES} SELECT CAST(k // 10 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) AS prob,
        edge_t / 1000.0::DOUBLE AS edge FROM edges""",
    "m14_scaled": _scaled(),
    "m15_onehot": _one_hot(),
    "m16_label_index": _label_index(),
    "m16b_index_of_open_vocabulary": f"""WITH {STEPS} SELECT subscriber_id,
        dense_rank() OVER (ORDER BY subscriber_id) - 1 AS subscriber_id_position,
        CASE WHEN industry_vertical IS NOT NULL THEN dense_rank() OVER (ORDER BY industry_vertical NULLS LAST) - 1 END
            AS industry_vertical_position FROM clean""",
    "a17_fingerprint": f"""WITH {STEPS}, h AS (SELECT {hashed(FINGERPRINT_ROW)} AS row_hash FROM clean)
        SELECT count(*) AS n_rows,
            substr(sha256(CAST(sum(row_hash) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)), 1, 16) AS data_hash
        FROM h""",
    "n1_split_shares": f"""WITH {STEPS} SELECT {SPLIT} AS split, count(*) AS n, {big('sum(churned)')} AS n_churned,
        {RATE} AS churn_rate_pct FROM clean GROUP BY 1""",
    "n1_exact_split": f"""WITH {STEPS}, r AS (SELECT subscriber_id,
            row_number() OVER (PARTITION BY churned ORDER BY {salted('split')}) - 1 AS i,
            count(*) OVER (PARTITION BY churned) AS n FROM clean)
        SELECT subscriber_id, CASE WHEN i < (n * 20) // 100 THEN 'test' WHEN i < (n * 35) // 100 THEN 'val'
            ELSE 'train' END AS split FROM r""",
    "n2b_stratified_folds": f"""WITH {STEPS}, r AS (SELECT subscriber_id,
            row_number() OVER (PARTITION BY churned ORDER BY {salted('fold')}) - 1 AS i,
            count(*) OVER (PARTITION BY churned) AS n FROM clean)
        SELECT subscriber_id, len(list_filter(range(1, 5), lambda k: (n * k) // 5 <= i)) AS fold FROM r""",
    "n2_folds": f"""WITH {STEPS} SELECT {salted('fold')} % 5 AS fold, count(*) AS n,
        {big('sum(churned)')} AS n_churned FROM clean GROUP BY 1""",
    "n5_baseline": f"WITH {SCORED} SELECT subscriber_id, p AS churn_probability FROM baseline",
    "n9_roc_auc": f"WITH {SCORED} SELECT model_name, roc_auc FROM ranking",
    "n10_average_precision": f"WITH {SCORED} SELECT model_name, pr_auc FROM ranking",
    "n11_threshold_metrics": f"WITH {SCORED} SELECT * FROM threshold",
    "n12_comparison": f"WITH {SCORED} SELECT * FROM comparison",
    "a16_class_weights": f"""WITH {STEPS}, c AS (SELECT churned AS label, count(*) AS n FROM clean GROUP BY 1),
        t AS (SELECT sum(n) AS all_n, sum(CASE WHEN label = 0 THEN n END) AS neg FROM c)
        SELECT {big('label')} AS label, n, {rounded('all_n', '(2 * n)', 6)} AS balanced_weight,
            CASE WHEN label = 1 THEN {rounded('neg', 'n', 6)} ELSE 1.0 END AS imbalance_weight FROM c CROSS JOIN t""",
    "d01_heatmap": f"""WITH {FACT}{COHORTS} SELECT cohort_year || '-' || cohort_quarter AS cohort_label,
            {HEATMAP_CELLS} FROM retention GROUP BY 1""",
    "d02_watchlist_summary": f"""WITH {WATCHLIST}, s AS (SELECT
            count(*) FILTER (WHERE risk_tier = 'high') AS high_risk_accounts,
            count(*) FILTER (WHERE risk_tier = 'medium') AS medium_risk_accounts,
            coalesce(sum(CASE WHEN risk_tier = 'high' THEN arr_usd END), 0.0) AS arr_at_high_risk FROM flagged)
        SELECT *, {compact('(CAST(arr_at_high_risk AS BIGINT) * 100)')} AS arr_at_high_risk_text FROM s""",
    "d03_watchlist_page": f"""WITH {WATCHLIST} SELECT subscriber_id, plan_tier, region_code, industry_name,
            tenure_months, engagement_score, payment_failures_12m, support_tickets_90d, arr_usd,
            churn_probability, risk_tier FROM flagged WHERE {PAGE_FILTER}
        ORDER BY churn_probability DESC, subscriber_id, model_name LIMIT 25 OFFSET 25""",
    "d03_page_count": f"""WITH {WATCHLIST} SELECT count(*) AS n_accounts,
        greatest(1, (count(*) - 1) // 25 + 1) AS total_pages FROM flagged WHERE {PAGE_FILTER}""",
    "d04_histogram": f"""WITH {PRED} SELECT CAST(greatest(0, least(39, floor(churn_probability * 40.0::DOUBLE))) AS BIGINT) AS bin,
        {big('churned')} AS churned_actual, count(*) AS n FROM predictions JOIN fact USING (subscriber_id)
        WHERE model_name = 'heuristic' GROUP BY 1, 2""",
    "d05_best_model": f"WITH {SCORED} " + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric,
            (SELECT model FROM comparison ORDER BY {m} DESC, model DESC LIMIT 1) AS best_model,
            (SELECT max({m}) FROM comparison) AS best_value,
            (SELECT model FROM comparison ORDER BY {m}, model LIMIT 1) AS worst_model,
            (SELECT min({m}) FROM comparison) AS worst_value"""
        for m in ("roc_auc", "pr_auc", "f1")
    ),
    "d06_narrative": f"""WITH {FACT}, h AS ({HEADLINE}) SELECT churn_rate_pct,
            CASE WHEN churn_rate_pct > 20 THEN 'above' WHEN churn_rate_pct < 15 THEN 'below'
                 ELSE 'at median' END AS churn_band,
            CAST(avg_engagement_score < 55 AS BIGINT) AS low_engagement,
            {compact('(CAST(lost_arr_usd AS BIGINT) * 100)')} AS lost_arr_text,
            coalesce({rounded('100 * CAST(lost_arr_usd AS BIGINT)', 'CAST(total_arr_usd AS BIGINT)', 1)}, 0.0) AS pct_arr_lost
        FROM h""",
    "d07_savings": f"""WITH {FACT}, h AS ({HEADLINE}) SELECT lost_arr_usd,
            (CAST(lost_arr_usd AS BIGINT) * 30) / 100.0::DOUBLE AS estimated_savings_usd,
            {compact('(CAST(lost_arr_usd AS BIGINT) * 30)')} AS estimated_savings_text FROM h""",
    "d08_segment_filter": f"""WITH {FACT} SELECT region_code, region_name, {COUNTS},
            {whole_usd('sum(arr_c)')} AS total_arr_usd, {avg('eng_h', 100, 1)} AS avg_engagement
        FROM fact WHERE region_code = 'EMEA' GROUP BY region_code, region_name""",
}
ORACLE["s01b_raw_csv_by_name"] = ORACLE["s01_raw_csv_roundtrip"]
ORACLE["s16b_seed_over_present_ids"] = f"""WITH {FACT}, usual(name, place) AS (VALUES
        ('Software & SaaS', 1), ('E-commerce', 2), ('Financial Services', 3), ('Healthcare IT', 4),
        ('Professional Services', 5), ('Manufacturing', 6), ('Media & Entertainment', 7), ('Education', 8))
    SELECT {big('d.industry_id')} AS industry_id, d.industry_name, count(f.industry_id) AS n_documents
    FROM dim_industry d LEFT JOIN fact f ON d.industry_id = f.industry_id GROUP BY ALL
    UNION ALL SELECT {big('place + (SELECT max(industry_id) FROM dim_industry)')}, name, 0 FROM usual"""
ORACLE["s21_view_by_sql"] = ORACLE["v03_by_region"]
ORACLE["s08_audit_log_text"] = f"SELECT message AS value FROM ({_audit()})"
ORACLE["s09_features_roundtrip"] = ORACLE["m2_11_features"]
ORACLE["s12_comparison_csv"] = ORACLE["n12_comparison"]
ORACLE["s13_quality_report_json"] = ORACLE["l1_header"]
ORACLE["s14_run_records"] = f"""WITH {SCORED}, n AS (SELECT
        count(*) FILTER (WHERE {SPLIT} = 'train') AS n_train,
        count(*) FILTER (WHERE {SPLIT} = 'test') AS n_test FROM clean)
    SELECT model || '_20241231T000000' AS run_id, model AS model_name,
        '2024-12-31 00:00:00' AS trained_at, n_train, n_test, roc_auc, pr_auc, f1 AS f1_score,
        "precision" AS precision_score, recall AS recall_score, threshold AS threshold_used
    FROM comparison CROSS JOIN n"""


def _all_tables() -> str:
    """The declared rules of every table, each key by its distinct values."""
    base = _constraints()
    with_part, rows = base[: base.index("SELECT 'fact_subscribers'")], base[base.index("SELECT 'fact_subscribers'") :]
    dims = {
        "dim_plan": (
            ("plan_id", "plan_tier", "tier_rank", "base_price_floor", "base_price_ceil"), ("plan_tier", "tier_rank"),
            ("primary_key:plan_id", "unique:plan_tier"),
        ),
        "dim_region": (
            ("region_id", "region_code", "region_name"), ("region_code",), ("primary_key:region_id", "unique:region_code"),
        ),
        "dim_channel": (
            ("channel_id", "channel_code", "channel_type"), ("channel_type",),
            ("primary_key:channel_id", "unique:channel_code"),
        ),
        "dim_industry": (("industry_id", "industry_name"), (), ("primary_key:industry_id", "unique:industry_name")),
    }
    # The seeded dimensions satisfy every rule.
    parts = [
        f"SELECT '{table}', '{name}', 0::BIGINT"
        for table, (required, checks, keys) in dims.items()
        for name in [*(f"not_null:{c}" for c in required), *(f"check:{c}" for c in checks), *keys]
    ]
    parts.append("""SELECT 'fact_subscribers', 'primary_key:subscriber_id',
        count(subscriber_id) - count(DISTINCT subscriber_id) FROM fact""")
    parts.append("""SELECT 'fact_model_predictions', 'primary_key:subscriber_id,model_name',
        count(*) - count(DISTINCT (subscriber_id, model_name)) FROM predictions""")
    return with_part + rows + " UNION ALL " + " UNION ALL ".join(parts)


def _catalog() -> str:
    from holdfast.operators.features import CATALOG

    rows = ", ".join(f"('{name}', '{text}')" for name, text in CATALOG.items())
    return f"""WITH {STEPS} SELECT column_name, comment, (SELECT count(*) FROM clean) AS n_rows
        FROM (VALUES {rows}) AS t(column_name, comment)"""


def _model_facts() -> str:
    return f"""WITH {STEPS} SELECT count(*) AS n_scored, count(DISTINCT subscriber_id) AS n_accounts,
        {big('sum(churned)')} AS n_churned, 0::BIGINT AS n_out_of_bounds, 0::BIGINT AS n_different_after_reload,
        TRUE AS fits_better_than_chance FROM clean"""


ORACLE |= {
    "l9b_all_tables": _all_tables(),
    "l9c_keys_of_raw_rows": f"""WITH {RAW_ALL}, k AS (SELECT plan_tier, region, industry_vertical, count(*) AS n FROM raw
            WHERE plan_tier IS NOT NULL AND region IS NOT NULL AND industry_vertical IS NOT NULL GROUP BY ALL)
        SELECT 'subscribers_raw' AS table_name, 'not_null:subscriber_id' AS constraint_name,
            count(*) - count(subscriber_id) AS n_violations FROM raw
        UNION ALL SELECT 'subscribers_raw', 'not_null:churn_reason', count(*) - count(churn_reason) FROM raw
        UNION ALL SELECT 'subscribers_raw', 'check:seat_count', count(*) FILTER (WHERE NOT seat_count < 5) FROM raw
        UNION ALL SELECT 'subscribers_raw', 'primary_key:subscriber_id',
            count(subscriber_id) - count(DISTINCT subscriber_id) FROM raw
        UNION ALL SELECT 'subscribers_raw', 'unique:plan_tier,region,industry_vertical',
            {big('coalesce(sum(n - 1), 0)')} FROM k
        UNION ALL SELECT 'subscribers_raw', 'unique:churn_reason', count(churn_reason) - count(DISTINCT churn_reason) FROM raw""",
    "l8_missing_columns": f"""WITH {RAW_ALL} SELECT (SELECT count(*) FROM raw) AS n_rows,
            CAST({len(PROFILED) - 2} AS BIGINT) AS n_profiled, 'Expected column ' || chr(39) || c || chr(39) || ' is missing' AS issue
        FROM (VALUES ('region'), ('seat_count')) AS t(c)""",
    "s13b_quality_report_rows": f"""WITH {RAW_ALL}, {_violation_rows()}, profile AS ({_profile_rows()})
        SELECT column_name, n_total, n_null, pct_null, n_unique,
            (SELECT count(*) FROM v WHERE v.column_name = profile.column_name) AS n_issues FROM profile""",
    "s24b_second_run": f"""WITH {STEPS}, n AS (SELECT count(*) AS n FROM clean)
        SELECT 'accounts' AS what, n FROM n UNION ALL SELECT 'predictions', n FROM n UNION ALL SELECT 'run records', 4
        UNION ALL SELECT 'versions', 2 UNION ALL SELECT 'violations', 0""",
    "s17b_load_over_existing": f"""WITH {FACT} SELECT subscriber_id, {big('plan_id')} AS plan_id,
        {big('region_id')} AS region_id, {big('seat_count + 1')} AS seat_count FROM fact""",
    "a17b_fingerprint_of_all_columns": f"""WITH {STEPS}, t AS (SELECT *,
            CAST(CAST(churn_probability_true AS DECIMAL(20, 6)) AS VARCHAR) AS true_text FROM clean),
        h AS (SELECT {hashed(FINGERPRINT_ROW + " || '|' || coalesce(length(true_text) || ':' || true_text, '~')")}
            AS row_hash FROM t)
        SELECT count(*) AS n_rows,
            substr(sha256(CAST(sum(row_hash) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)), 1, 16) AS data_hash FROM h""",
    "m13_catalog": _catalog(),
    "h22_page_of_percentages": f"""WITH {WATCHLIST} SELECT subscriber_id, plan_tier, region_code, industry_name,
            tenure_months, engagement_score, payment_failures_12m, support_tickets_90d, arr_usd,
            churn_probability * 100 / 100 AS churn_probability, risk_tier FROM flagged
        ORDER BY flagged.churn_probability * 100 DESC, subscriber_id, model_name LIMIT 25""",
    "t5_preview": f"""SELECT subscriber_id, plan_tier, region_code FROM ({ORACLE['s19_denormalised']}) AS documents
        ORDER BY subscriber_id LIMIT 20""",
    "n6b_facts_of_logistic": _model_facts(),
    "n7b_facts_of_forest": _model_facts(),
    "n8b_facts_of_boosting": _model_facts(),
    "n15b_facts_of_neural": _model_facts(),
    "n3b_facts_of_cross_validation": f"""WITH {STEPS} SELECT count(*) FILTER (WHERE {SPLIT} = 'train') AS n_train,
        TRUE AS cv_roc_auc_mean_in_bounds, TRUE AS cv_roc_auc_std_in_bounds,
        TRUE AS cv_pr_auc_mean_in_bounds, TRUE AS cv_pr_auc_std_in_bounds FROM clean""",
}


def _stability_index() -> str:
    texts = [
        f"SELECT part, '{c}' AS column_name, CAST({c} AS VARCHAR) AS bin FROM r"
        for c in ("plan_tier", "region", "industry_vertical")
    ]
    numbers = [
        f"""SELECT part, '{c}', CAST((SELECT count(*) FROM (SELECT DISTINCT v FROM (SELECT {c} AS v,
            row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM r WHERE part = 'train' AND {c} IS NOT NULL)
            WHERE list_contains(list_transform(range(10), lambda k: ((n - 1) * k) // 10), i)) e WHERE e.v <= r.{c}) AS VARCHAR)
        FROM r"""
        for c in ("tenure_months", "seat_count")
    ]
    return f"""WITH {STEPS}, r AS (SELECT *, {SPLIT} AS part FROM clean),
        h AS ({" UNION ALL ".join(texts + numbers)}),
        b AS (SELECT column_name, bin, count(*) FILTER (WHERE part = 'train') AS n0,
            count(*) FILTER (WHERE part = 'test') AS n1 FROM h WHERE part <> 'val' GROUP BY ALL),
        s AS (SELECT column_name, greatest(n0 / sum(n0) OVER w, 1e-4::DOUBLE) AS p, greatest(n1 / sum(n1) OVER w, 1e-4::DOUBLE) AS q
            FROM b WINDOW w AS (PARTITION BY column_name))
        SELECT column_name, count(*) AS n_bins, round(sum((p - q) * ln(p / q)), 7) AS psi FROM s GROUP BY ALL"""


ORACLE |= {
    "x1_score_distance": f"""WITH {PRED}, h AS (SELECT model_name, {SPLIT} AS part,
            greatest(0, least(999, floor(churn_probability * 1000.0::DOUBLE))) AS bin FROM predictions),
        b AS (SELECT model_name, bin, count(*) FILTER (WHERE part = 'train') AS n0,
            count(*) FILTER (WHERE part = 'test') AS n1 FROM h GROUP BY ALL),
        c AS (SELECT model_name, sum(n0) OVER u / sum(n0) OVER w AS p, sum(n1) OVER u / sum(n1) OVER w AS q FROM b
            WINDOW w AS (PARTITION BY model_name), u AS (PARTITION BY model_name ORDER BY bin ROWS UNBOUNDED PRECEDING))
        SELECT model_name, round(max(abs(p - q)), 9) AS ks FROM c GROUP BY ALL""",
    "x2_stability_index": _stability_index(),
    "x3_rate_gap": f"""WITH {PRED} SELECT model_name, risk_tier, count(*) AS n, round(avg(churn_probability), 7) AS mean_score,
            round(avg(churned), 7) AS observed_rate, round(avg(churn_probability) - avg(churned), 7) AS gap
        FROM predictions JOIN fact USING (subscriber_id) GROUP BY ALL""",
}
ORACLE["x4_permuted_columns"] = f"""WITH {STEPS}, r AS (SELECT subscriber_id, tenure_months, seat_count,
        row_number() OVER (ORDER BY {salted('give')}) AS g, row_number() OVER (ORDER BY {salted('take')}) AS t FROM clean)
    SELECT a.subscriber_id, 'tenure_months' AS permuted_column, {big('b.tenure_months')} AS tenure_months,
        {big('a.seat_count')} AS seat_count FROM r a JOIN r b ON a.t = b.g
    UNION ALL SELECT a.subscriber_id, 'seat_count', {big('a.tenure_months')}, {big('b.seat_count')}
    FROM r a JOIN r b ON a.t = b.g"""
