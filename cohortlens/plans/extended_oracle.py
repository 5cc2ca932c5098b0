"""DuckDB SQL for the queries of ``extended``: mostly those of the jobs whose
results they give by another way."""

from __future__ import annotations

from cohortlens.plans.extended import PLANTED
from cohortlens.plans.oracle import MAPPING, ORACLE_SQL, pct


def _text(column: str, shown: str) -> str:
    modulus, remainder, text = PLANTED[column]
    return f"CASE WHEN subscription_id % {modulus} = {remainder} THEN NULL ELSE {shown} END AS {column}"


# in the order of the table's columns
_REASONS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN subscription_id % {m} = {r} THEN '{c}={text}' END" for c, (m, r, text) in PLANTED.items()
) + "], lambda x: x IS NOT NULL), ';')"

EXTENDED_ORACLE: dict[str, str] = {
    "feature_metrics_bucketed": ORACLE_SQL["feature_metrics"],
    "monthly_active_users_bucketed": ORACLE_SQL["monthly_active_users"],
    "retention_activity_bucketed": ORACLE_SQL["retention_activity"],
    "usage_segments_bucketed": ORACLE_SQL["usage_segments"],
    "accounts_summary_incremental": ORACLE_SQL["accounts_summary"],
    "monthly_active_users_keyed": ORACLE_SQL["monthly_active_users"],
    "monthly_active_users_sketch": f"SELECT active_month, mau, true AS within_bound FROM ({ORACLE_SQL['monthly_active_users']})",
    "key_census_sketch": f"SELECT *, true AS within_bound FROM ({ORACLE_SQL['key_census']})",
    "activation_median_histogram": ORACLE_SQL["activation_median"],
    "customer_growth_filled": f"""
WITH {MAPPING},
firsts AS (SELECT account_id, CAST(date_trunc('month', min(start_date)) AS DATE) AS month FROM subscriptions GROUP BY account_id),
span AS (SELECT min(month) AS a, max(month) AS b FROM firsts),
spine AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
filled AS (SELECT s.month, count(f.account_id) AS n FROM spine s LEFT JOIN firsts f ON f.month = s.month GROUP BY s.month)
SELECT x.month, x.n AS new_customers,
       CAST((SELECT sum(y.n) FROM filled y WHERE y.month <= x.month) AS BIGINT) AS running_total_new_customers,
       {pct("x.n - p.n", "p.n")} AS mom_growth_percentage
FROM filled x LEFT JOIN filled p ON p.month = x.month - INTERVAL 1 MONTH""",
    "customer_growth_csv": f"""
SELECT *, (SELECT count(*) FROM ({ORACLE_SQL['customer_growth']})) AS rows_committed, CAST(0 AS BIGINT) AS malformed_lines
FROM ({ORACLE_SQL['customer_growth']})""",
    "churn_segments_preview": f"""
SELECT *, (SELECT count(*) FROM ({ORACLE_SQL['churn_by_segment']})) AS rows_committed, CAST(0 AS BIGINT) AS malformed_lines
FROM ({ORACLE_SQL['churn_by_segment']}) ORDER BY segment, subsegment LIMIT 5""",
    "subscriptions_from_text": f"""
WITH {MAPPING}
SELECT subscription_id, account_id, {_text('mrr_amount', 'mrr_amount')}, {_text('start_date', 'start_date')},
       {_text('end_date', 'end_date')}, plan_tier, {_text('upgrade_flag', 'upgrade_flag')}, downgrade_flag,
       {_REASONS} AS reasons
FROM subscriptions""",
    "churn_rate_views": f"""
SELECT r.*, (WITH {MAPPING} SELECT count(DISTINCT account_id) FROM churn_events) AS accounts_with_events
FROM ({ORACLE_SQL['churn_rate']}) r""",
}
