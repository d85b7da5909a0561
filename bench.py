"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barsight.catalog import QUERIES
from barsight.session import build_session

HEADLINE = {
    "slice_momentum_sharpe": "j06_momentum_signal",
    "bars_scan": "a06_full_trajectory",
    "baseline_features": "e01_baseline_features",
    "path_features": "e03_path_features",
    "rich_features": "bench_rich",
    "emission_table": "f11_emission_table",
    "sentiment_features": "e05_sentiment_features",
    "news_aggregates": "e17_news_aggregates",
    "hashed_text": "i02_hashed_fingerprint",
    "forward_returns": "d07_forward_returns",
    "event_validation": "l05_event_validation",
    "prior_history": "d09_prior_history",
    "fold_gram_mean": "j03_cross_validated_mean",
    "sharpe_linear": "j04_sharpe_linear",
    "sizing_grid": "k04_sizing_grid",
    "regime_states": "j15_pooled_states",
    "augmented_bars": "m05_augmented_bars",
}


def rich(spark, path):
    from barsight.operators.rich import rich_features
    from barsight.sources.market import Market

    return rich_features(Market(spark, path).seen())


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(os.path.join(path, "lineitem.parquet")).groupBy("l_suppkey").count().collect()
    spent = {}
    for name, key in HEADLINE.items():
        run = rich if key == "bench_rich" else QUERIES[key]
        start = time.time()
        run(spark, path).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    rows = spark.read.parquet(os.path.join(path, "lineitem.parquet")).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
                "lineitem_rows": rows,
                "rows_per_sec": {k: round(rows / v) for k, v in spent.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
