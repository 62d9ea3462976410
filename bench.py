"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query runs in full into a sink that discards the rows; nothing is reused between queries.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import build_session

HEADLINE = [
    "j1_customer_left_join", "a1_purchase_summary", "a2_country_summary", "a3_kpi_row", "f7_customer_lookup", "w1_quartile_scores",
    "w2_value_quartiles", "w11_average_and_first_rank", "j2_aligned_prices", "w8_factor_panel", "w9_volatility_panel",
    "w10_rolling_var_historical", "a17_covariance", "a18_portfolio_stats", "a21_efficient_frontier", "a26_historical_cvar", "a28_kupiec_test",
    "a32_information_coefficient", "a33_long_short_sharpe", "a14_control_variate", "a15_mergeable_moments",
    "n2_option_price", "n3_option_greeks", "n4_implied_volatility", "n5_jump_diffusion_price", "n9_bond_risk_metrics", "n10_shock_grid",
    "n11_bootstrap_zero_curves", "n12_discount_factor",
    "r2_sections", "r3_chunks", "r4_tfidf_vectors", "j5_vector_top_k", "r7_batch_ask", "r7_batch_ask_text", "r8_keyword_router", "a11_routing_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["a5_segment_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the session
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
