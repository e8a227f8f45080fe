"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic.  The cells' token
masses are raked: scaled in turn so that the source, language and topic sums
meet their target shares, again and again.  A cell's calibrated weight is its
raked mass over its own mass; a document is kept with a probability in
proportion to that weight, decided by a hash of its id, so any rerun or retry
keeps the same documents.  All of it is DataFrame operations.

The sampling rate does not hang on a rare cell: the cells of the largest
weights that together hold at most ``RARE_SHARE`` of the raked mass are kept
whole, and the largest weight of the others is the one kept with probability 1.
So at most that share of the mixture can be missing from its targets.

Target shares are given per dimension, or derived from the corpus by tempering:
a value's share is proportional to its token share to the power ``alpha``
(below 1 raises small values and lowers the large ones).

Defined cases: a NULL source, language or topic is the value ``(none)``; a NULL
or empty text has no tokens, a zero weight moves nothing, and its document gets
its cell's probability; a cell without tokens keeps weight 1; a NULL id is
hashed as the text ``null``; repeated rows share their fate; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace

ITERATIONS = 12
ALPHA = 0.9
SEED = "mix-1"
#: Up to so many cells one task rakes them; beyond, each step is an exchange.
ONE_TASK_CELLS = 200_000
#: The share of the raked mass, in the cells of the largest weights, that does not set the sampling rate.
RARE_SHARE = 1e-4
DIMENSIONS = ("_source", "_lang", "_topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by plain marks of the text: links, contacts, questions,
    or prose without them."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains("://"), F.lit("links")).when(text.contains("@"), F.lit("contacts"))
            .when(text.contains("?"), F.lit("questions")).otherwise(F.lit("prose")))


def word_count(text: Column) -> Column:
    """Tokens as the mixture counts them: runs of non-blank characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a document's id, the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, work: Workspace, iterations: int = ITERATIONS) -> DataFrame:
    """Add ``raked`` to cells with ``mass`` and per dimension a target share
    ``<dimension>_share``: iterative proportional fitting.

    Each step divides a cell by its dimension's sum, a window.  Up to
    ``ONE_TASK_CELLS`` cells (a few numbers each) all windows run in one task
    without an exchange; beyond, Spark deals each window out by its key.
    """
    n, total = cells.agg(F.count("*"), F.sum("mass")).first()
    together = (lambda df: df.coalesce(1)) if n <= ONE_TASK_CELLS else (lambda df: df)
    frame = together(cells.withColumn("raked", F.col("mass").cast("double")))
    for step in range(1, iterations + 1):
        for d in DIMENSIONS:
            own = F.sum("raked").over(Window.partitionBy(d))
            wanted = F.col(f"{d}_share") * F.lit(float(total or 0))
            frame = frame.withColumn("raked", F.when(own > 0, F.col("raked") * (wanted / own)).otherwise(0.0))
        if step % 4 == 0 and step < iterations:
            frame = together(work.table(frame, f"rake-{step}"))
    return frame


def _rate_weight(weights: DataFrame, work: Workspace) -> float:
    """The largest weight that is not rare: the first, from the largest down, at
    which the raked mass of the cells so far exceeds ``RARE_SHARE`` of all.  Up to
    ``ONE_TASK_CELLS`` cells one task sums them up; beyond, they are ranged by
    weight and only the range in which the mass is exceeded is summed cell by cell.
    """
    n, total = weights.agg(F.count("*"), F.sum("raked")).first()
    limit, before, cells = RARE_SHARE * (total or 0.0), 0.0, weights
    if n > ONE_TASK_CELLS:
        ranged = work.table(weights.repartitionByRange(F.desc("weight")).withColumn("_range", F.spark_partition_id()), "ranges")
        upto = F.sum("_mass").over(Window.orderBy("_range"))      # one row a range
        sums = ranged.groupBy("_range").agg(F.sum("raked").alias("_mass")).withColumn("_upto", upto)
        met = sums.filter(F.col("_upto") > limit).orderBy("_range").first()
        if met is None:
            return 1.0
        before, cells = met["_upto"] - met["_mass"], ranged.filter(F.col("_range") == met["_range"])
    heavier = cells.withColumn("_upto", F.sum("raked").over(Window.orderBy(F.desc("weight"))) + F.lit(before))
    return heavier.filter(F.col("_upto") > limit).agg(F.max("weight")).first()[0] or 1.0


def _name(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("(none)"))


def _dimensions(text_col: str, source_col: str, lang_col: str, topic: Column | None) -> list[Column]:
    own = topic if topic is not None else topic_of(F.col(f"`{text_col}`").cast("string"))
    return [_name(F.col(f"`{source_col}`")).alias("_source"), _name(F.col(f"`{lang_col}`")).alias("_lang"), _name(own).alias("_topic")]


def calibrate(rows: DataFrame, work: Workspace, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA,
              iterations: int = ITERATIONS) -> DataFrame:
    """``_source, _lang, _topic, weight, probability`` of every cell of ``rows``
    (the dimensions and ``_tokens``).  ``targets`` may give a frame of ``value,
    share`` for ``source``, ``lang`` or ``topic``; a dimension without one is
    tempered by ``alpha``.  The cell of the largest calibrated weight that is
    not rare (``RARE_SHARE``) is kept whole, and so are the rare ones above it;
    the expected token shares of all others are in the proportions of the raked.
    """
    cells = work.table(rows.groupBy(*DIMENSIONS).agg(F.sum("_tokens").alias("mass")), "cells")
    shares = cells
    for d, key in zip(DIMENSIONS, ("source", "lang", "topic")):
        given = (targets or {}).get(key)
        if given is None:
            sums = cells.groupBy(d).agg(F.sum("mass").cast("double").alias("_sum"))
            power = sums.select(d, F.when(F.col("_sum") > 0, F.pow("_sum", F.lit(alpha))).otherwise(0.0).alias("_power"))
        else:
            wanted = given.select(_name(F.col("value")).alias(d), F.col("share").cast("double").alias("_power"))
            power = cells.select(d).distinct().join(wanted, d, "left").fillna(0.0, ["_power"])
        norm = power.agg(F.sum("_power")).first()[0] or 1.0
        shares = shares.join(power.select(d, (F.col("_power") / F.lit(norm)).alias(f"{d}_share")), d)
    raked = rake(work.table(shares, "shares"), work, iterations)
    weight = F.when(F.col("mass") > 0, F.col("raked") / F.col("mass")).otherwise(1.0)
    weights = work.table(raked.select(*DIMENSIONS, "raked", weight.alias("weight")), "weights")
    largest = _rate_weight(weights, work)
    return weights.drop("raked").withColumn("probability", F.least(F.lit(1.0), F.col("weight") / F.lit(largest)))


def mix(docs: DataFrame, work: Workspace, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA,
        iterations: int = ITERATIONS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """``id, source, lang, topic, n_tokens, weight, probability, selected`` of
    every document."""
    rows = work.table(docs.select(F.col(f"`{id_col}`").alias("_id"), *_dimensions(text_col, source_col, lang_col, topic),
                                  word_count(F.col(f"`{text_col}`").cast("string")).alias("_tokens")), "rows")
    weighted = rows.join(calibrate(rows, work, targets, alpha, iterations), list(DIMENSIONS))
    return weighted.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), "weight", "probability", (uniform(F.col("_id"), seed) < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, work: Workspace, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA,
           iterations: int = ITERATIONS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """The selected rows of ``docs``, as they are."""
    own = _dimensions(text_col, source_col, lang_col, topic)
    rows = docs.select(*own, word_count(F.col(f"`{text_col}`").cast("string")).alias("_tokens"))
    weights = calibrate(rows, work, targets, alpha, iterations)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *own, uniform(F.col(f"`{id_col}`"), seed).alias("_u"))
    return whole.join(weights, list(DIMENSIONS)).filter(F.col("_u") < F.col("probability")).select("_row.*")


def oracle_sql(iterations: int = ITERATIONS, alpha: float = ALPHA, seed: str = SEED, docs: str = "documents") -> str:
    """The same mixture as DuckDB SQL, every raking step a query of its own."""
    ctes = [f"""rows AS (
  SELECT doc_id, coalesce(source, '(none)') AS _source, coalesce(lang, '(none)') AS _lang,
         CASE WHEN contains(coalesce(text, ''), '://') THEN 'links' WHEN contains(coalesce(text, ''), '@') THEN 'contacts'
              WHEN contains(coalesce(text, ''), '?') THEN 'questions' ELSE 'prose' END AS _topic,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS bigint) AS _tokens
  FROM {docs})""",
            "cells AS (SELECT _source, _lang, _topic, cast(sum(_tokens) AS double) AS mass FROM rows GROUP BY ALL)"]
    for d in DIMENSIONS:
        ctes.append(f"p{d} AS (SELECT {d}, CASE WHEN sum(mass) > 0 THEN pow(sum(mass), {alpha}) ELSE 0 END AS p FROM cells GROUP BY {d})")
        ctes.append(f"s{d} AS (SELECT {d}, p / coalesce(nullif(sum(p) OVER (), 0), 1) AS {d}_share FROM p{d})")
    joins = " ".join(f"JOIN s{d} USING ({d})" for d in DIMENSIONS)
    ctes.append(f"r0 AS (SELECT *, mass AS raked, sum(mass) OVER () AS total FROM cells {joins})")
    k = 0
    for _ in range(iterations):
        for d in DIMENSIONS:
            k += 1
            ctes.append(f"""r{k} AS MATERIALIZED (SELECT * EXCLUDE (own) REPLACE (CASE WHEN own > 0 THEN raked * ({d}_share * total / own) ELSE 0 END AS raked)
  FROM (SELECT *, sum(raked) OVER (PARTITION BY {d}) AS own FROM r{k - 1}))""")
    ctes.append(f"w AS (SELECT _source, _lang, _topic, raked, CASE WHEN mass > 0 THEN raked / mass ELSE 1 END AS weight FROM r{k})")
    ctes.append("h AS (SELECT weight, sum(raked) OVER (ORDER BY weight DESC) AS upto, sum(raked) OVER () AS total FROM w)")
    ctes.append(f"g AS (SELECT coalesce(nullif(max(weight) FILTER (upto > {RARE_SHARE} * total), 0), 1) AS largest FROM h)")
    ctes.append("m AS (SELECT *, least(1.0, weight / (SELECT largest FROM g)) AS probability FROM w)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, _source AS source, _lang AS lang, _topic AS topic, _tokens AS n_tokens,
       round(weight, 9) AS weight, round(probability, 9) AS probability,
       cast(concat('0x', substr(md5(concat('{seed}:', coalesce(cast(doc_id AS varchar), 'null'))), 1, 13)) AS bigint)
         / 4503599627370496.0 < probability AS selected
FROM rows JOIN m USING (_source, _lang, _topic)
"""
