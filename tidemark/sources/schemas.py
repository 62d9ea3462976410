"""Explicit schemas: no inference pass over the files."""

from __future__ import annotations

# Column names and types of the files.
CUSTOMERS = "customer_id string, customer_name string, signup_date date, country string, segment string, age_group string"
TRANSACTIONS = (
    "transaction_id string, customer_id string, transaction_date date, category string, channel string, amount_sgd double"
)
IMPORTANCE = "feature string, importance double"
METRICS = "accuracy double, roc_auc double, n_train long, n_test long, churn_rate_in_data double"
RETRIEVAL_QUESTIONS = (
    "id int, question string, expected_source string, expected_keywords array<string>, in_scope boolean, note string"
)
ROUTING_QUESTIONS = (
    "id int, category string, question string, expected_tools array<string>, must_contain array<string>, "
    "must_not_contain array<string>, note string"
)
NOTES = "id string, ticker string, date string, headline string, text string"
CHART = (
    "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<long>, "
    "indicators: struct<adjclose: array<struct<adjclose: array<double>>>>>>>"
)
