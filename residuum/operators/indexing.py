"""Automatic categorical feature detection (``VectorIndexer``).

A feature with at most ``max_categories`` distinct values (zero counts as a
value) is treated as categorical by the tree learners.  As in the reference
the indexer is fitted on *all* labelled rows before the split, so the holdout
can hold no unseen category.  Fitting is one distributed pass whose per-task
state is capped at ``max_categories + 1`` values per feature.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorIndexer, VectorIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_CATEGORIES = 4


def fit_indexer(df: DataFrame, input_col: str = "features",
                output_col: str = "indexed_features",
                max_categories: int = MAX_CATEGORIES) -> VectorIndexerModel:
    indexer = VectorIndexer(inputCol=input_col, outputCol=output_col,
                            maxCategories=max_categories)
    return indexer.fit(df)


def categorical_decision(spark: SparkSession, model: VectorIndexerModel,
                         feature_names: list[str] | tuple[str, ...]) -> DataFrame:
    """``feature, position, is_categorical, n_categories`` (one row per
    feature; the fitted model's metadata, bounded by the feature count)."""
    maps = model.categoryMaps
    rows = [(name, i, i in maps, len(maps[i]) if i in maps else None)
            for i, name in enumerate(feature_names)]
    schema = T.StructType([
        T.StructField("feature", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("is_categorical", T.BooleanType(), False),
        T.StructField("n_categories", T.IntegerType(), True),
    ])
    return spark.createDataFrame(rows, schema)
