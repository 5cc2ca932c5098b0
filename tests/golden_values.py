"""Published result tables of the source analysis (500 accounts,
24 months), used for golden replay of the notebook-side jobs and for the
published figures.  Stated as published, in their published order."""

# month, new_customers, running_total_new_customers, mom_growth_percentage
MOM_GROWTH = [
    ("2023-01-01", 2, 2, None), ("2023-02-01", 8, 10, 300.00), ("2023-03-01", 11, 21, 37.50),
    ("2023-04-01", 15, 36, 36.36), ("2023-05-01", 14, 50, -6.67), ("2023-06-01", 21, 71, 50.00),
    ("2023-07-01", 18, 89, -14.29), ("2023-08-01", 27, 116, 50.00), ("2023-09-01", 15, 131, -44.44),
    ("2023-10-01", 18, 149, 20.00), ("2023-11-01", 22, 171, 22.22), ("2023-12-01", 20, 191, -9.09),
    ("2024-01-01", 26, 217, 30.00), ("2024-02-01", 18, 235, -30.77), ("2024-03-01", 25, 260, 38.89),
    ("2024-04-01", 22, 282, -12.00), ("2024-05-01", 28, 310, 27.27), ("2024-06-01", 27, 337, -3.57),
    ("2024-07-01", 28, 365, 3.70), ("2024-08-01", 20, 385, -28.57), ("2024-09-01", 31, 416, 55.00),
    ("2024-10-01", 23, 439, -25.81), ("2024-11-01", 36, 475, 56.52), ("2024-12-01", 25, 500, -30.56),
]

# segment, subsegment, total_accounts, churned_accounts, churned_share_percentage
CHURN_SEGMENTS = [
    ("country", "UK", 58, 45, 77.59), ("country", "FR", 22, 16, 72.73),
    ("country", "US", 291, 206, 70.79), ("country", "CA", 23, 16, 69.57),
    ("country", "AU", 32, 22, 68.75), ("country", "IN", 49, 33, 67.35),
    ("country", "DE", 25, 14, 56.00),
    ("industry", "DevTools", 113, 83, 73.45), ("industry", "EdTech", 79, 57, 72.15),
    ("industry", "Cybersecurity", 100, 72, 72.00), ("industry", "FinTech", 112, 76, 67.86),
    ("industry", "HealthTech", 96, 64, 66.67),
    ("initial_plan_tier", "Pro", 178, 129, 72.47), ("initial_plan_tier", "Enterprise", 154, 108, 70.13),
    ("initial_plan_tier", "Basic", 168, 115, 68.45),
    ("referral_source", "partner", 89, 67, 75.28), ("referral_source", "organic", 114, 85, 74.56),
    ("referral_source", "other", 103, 73, 70.87), ("referral_source", "event", 96, 68, 70.83),
    ("referral_source", "ads", 98, 59, 60.20),
]

# usage_segment, accounts, segment_share_percentage, churned_accounts,
# churn_rate_percentage, avg_lifetime_months
USAGE_SEGMENTS = [
    ("low usage", 272, 54.40, 191, 70.22, 8.36),
    ("medium usage", 219, 43.80, 154, 70.32, 2.96),
    ("high usage", 9, 1.80, 7, 77.78, 2.22),
]

# active_month, mau
MONTHLY_ACTIVE_USERS = [
    ("2023-01-01", 8), ("2023-02-01", 23), ("2023-03-01", 42), ("2023-04-01", 59),
    ("2023-05-01", 74), ("2023-06-01", 79), ("2023-07-01", 96), ("2023-08-01", 108),
    ("2023-09-01", 120), ("2023-10-01", 141), ("2023-11-01", 156), ("2023-12-01", 168),
    ("2024-01-01", 183), ("2024-02-01", 188), ("2024-03-01", 198), ("2024-04-01", 211),
    ("2024-05-01", 227), ("2024-06-01", 220), ("2024-07-01", 238), ("2024-08-01", 222),
    ("2024-09-01", 217), ("2024-10-01", 211), ("2024-11-01", 208), ("2024-12-01", 177),
]

MEDIAN_ACTIVATION_DAYS = (16.0, 5.0)  # to first subscription, to first use
USAGE_DATA_AGG = (500, 10, 490)  # total_count, valid_usage_data, invalid_usage_data

# Published figures (text): worst subsegment per segment, mean MAU, peak month.
WORST = {"country": "UK", "industry": "DevTools", "initial_plan_tier": "Pro", "referral_source": "partner"}
MEAN_MAU = 148.92
PEAK = ("2024-07-01", 238)

# Retention rates (%) at month 0 of the cohorts 2023-01 ... 2024-12 and at month
# 12 of those that have it, and the published means over cohorts.
RETENTION_RATES = {
    "activity": {
        0: [
            94.12, 94.44, 85.00, 86.67, 92.31, 92.31, 100.00, 81.25, 82.61, 90.00, 84.00, 90.00,
            93.75, 69.23, 85.19, 86.36, 86.36, 76.19, 73.08, 76.19, 84.00, 83.87, 90.63, 76.47,
        ],
        12: [
            23.53, 22.22, 15.00, 26.67, 23.08, 23.08, 28.57, 18.75, 30.43, 35.00, 28.00, 5.00,
        ],
    },
    "payment_first_churn": {
        0: [
            100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00,
            100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00,
        ],
        12: [
            41.18, 55.56, 20.00, 80.00, 65.38, 69.23, 57.14, 43.75, 30.43, 25.00, 28.00, 20.00,
        ],
    },
    "payment_last_churn": {
        0: [
            100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00,
            100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00, 100.00,
        ],
        12: [
            64.71, 83.33, 55.00, 93.33, 84.62, 92.31, 71.43, 62.50, 56.52, 45.00, 40.00, 45.00,
        ],
    },
}
RETENTION_MEANS = {"activity": (85.58, 23.28), "payment_first_churn": (100.0, 44.64), "payment_last_churn": (100.0, 66.15)}
