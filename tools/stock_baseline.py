"""

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python tools/stock_baseline.py

What a user of plain Spark ML would write for the same work as
``correct_<technique>``: read the view, cache it, index (trees), fit on the
hash-train rows, score every row, RMSE of the holdout.  Medians of three runs
after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TECHNIQUES = ("decision_tree", "rf", "gb_tree", "glr", "linear")


def stock_once(spark, name: str, folder: str) -> float:
    """Seconds of one technique with plain Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
    from pyspark.sql import functions as F

    from residuum.operators.split import train_flag
    from residuum.sources.tables import CALIBRATION_FEATURES, calibration_orders

    learners = {
        "decision_tree": lambda c: DecisionTreeRegressor(featuresCol=c, labelCol="delta_e", maxDepth=5, seed=42),
        "rf": lambda c: RandomForestRegressor(featuresCol=c, labelCol="delta_e", numTrees=20, maxDepth=5, seed=42),
        "gb_tree": lambda c: GBTRegressor(featuresCol=c, labelCol="delta_e", maxIter=10, seed=42),
        "glr": lambda c: GeneralizedLinearRegression(featuresCol=c, labelCol="delta_e", maxIter=10, regParam=0.3),
        "linear": lambda c: LinearRegression(featuresCol=c, labelCol="delta_e", maxIter=10, regParam=0.3, elasticNetParam=0.8),
    }
    begun = time.perf_counter()
    cal = calibration_orders(spark, folder).withColumn("delta_e", F.col("observed") - F.col("predicted"))
    vec = VectorAssembler(inputCols=list(CALIBRATION_FEATURES), outputCol="features").transform(cal).withColumn("is_train", train_flag("row_id")).cache()
    if name in ("decision_tree", "rf", "gb_tree"):
        index = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=4).fit(vec)
        model = Pipeline(stages=[index, learners[name]("indexed")]).fit(vec.where("is_train"))
    else:
        model = Pipeline(stages=[learners[name]("features")]).fit(vec if name == "glr" else vec.where("is_train"))
    scored = model.transform(vec)
    RegressionEvaluator(labelCol="delta_e", metricName="rmse").evaluate(scored.where("not is_train"))
    scored.agg(F.avg(F.pow(F.col("prediction") - F.col("delta_e"), 2))).first()
    vec.unpersist()
    return time.perf_counter() - begun


def main() -> None:
    from residuum.session import build_session

    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", int(os.environ.get("BENCH_CPUS", "8")))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    for name in TECHNIQUES:
        stock_once(spark, name, "/root/testdata/sf0.001")
    print(json.dumps({name: round(statistics.median(stock_once(spark, name, sf) for _ in range(3)), 3) for name in TECHNIQUES}))
    spark.stop()


if __name__ == "__main__":
    main()
