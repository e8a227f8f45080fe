"""Readers for calibration inputs.

* ``read_calibration``  - a header CSV (or parquet) whose columns carry their
  roles by position: observed, predicted, features...
* ``read_libsvm``       - sparse labelled vectors (``label i:v ...``)
* ``read_labelled_csv`` - headerless CSV, field 0 the label, the rest features
* ``explode_series``    - parallel array columns to one row per position
* ``read_prediction_list`` - stored comma-joined lists, one a row, to keyed rows
* ``read_prediction_file`` - a stored list that is a file, however long its line

Readers never infer schemas by a second scan when the caller can give one,
and nothing here pulls data to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize, owns
from ..spec import CalibrationSpec


#: Fields that mean "no value", after trimming (any case of the words).
MISSING = ("", "na", "nan", "null", "none")
_CORRUPT = "_corrupt_record"
_SPARK_ERRORS = (PySparkException, Py4JJavaError)
#: Different headers that the files of one folder may have.
MOST_LAYOUTS = 1000


def _number(c: Column) -> Column:
    """A text field as a double: NULL for a missing token, and NULL too for
    anything else that is no number (``_is_bad`` tells the two apart)."""
    text = F.trim(c)
    return F.when(F.lower(text).isin(*MISSING), F.lit(None)).otherwise(text.try_cast("double"))


def _is_bad(c: Column) -> Column:
    text = F.trim(c)
    return c.isNotNull() & ~F.lower(text).isin(*MISSING) & text.try_cast("double").isNull()


def read_calibration(spark: SparkSession, path: str, fmt: str = "csv",
                     schema: T.StructType | str | None = None,
                     key: str | None = "row_id", check: bool = True,
                     observed: str | None = None, predicted: str | None = None) -> tuple[DataFrame, CalibrationSpec]:
    """Read a calibration table and resolve its roles by position.

    CSV with a header row.  Every field is read as text and the roles are
    turned into doubles: empty fields and ``NA``, ``NaN``, ``null``, ``none``
    are missing.  A row with another number of fields than the header, or with
    a role that is neither missing nor a number, is malformed: ``check`` counts
    such rows in one pass and raises ``ValueError`` with their number, so none
    is trained on half-read.  Without ``check`` such fields are NULL.

    The files of a folder may order their columns differently: every file's own
    header says which column is which.  The pass that checks the rows compares
    the headers; if they differ, one more pass reads each file's first line and
    the files of each order are read by their own names.  Which columns are the
    observation and the prediction must then be said by ``observed`` and
    ``predicted``, unless all files begin with the same two; files with other
    columns are an error.  Without ``check`` different headers are an error when
    the frame is read.

    ``schema`` gives the types of columns without a numeric role (the key).  If
    ``key`` is absent from the file a row id is added that is unique but follows
    the file splits; the holdout split then goes by the row's content
    (``split_key``), which is the same however the file is read.
    """
    split_key = None
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns   # repeated names get their position
        given = {f.name: f.dataType for f in _schema(schema)} if schema is not None else {}
        parts = {tuple(names): _text_rows(spark, path, names, same_header=True)}
        try:
            n_bad = _malformed(parts, key) if check else 0
        except _SPARK_ERRORS as exc:
            if "CSV header" not in str(exc):
                raise
            layouts = _layouts(spark, path)
            names = list(min(layouts))
            _same_columns(layouts, path, key, observed, predicted)
            parts = {n: _text_rows(spark, files, list(n), same_header=False) for n, files in layouts.items()}
            n_bad = _malformed(parts, key)
        if n_bad:
            raise ValueError(f"{n_bad} malformed rows in {path}: wrong number of fields, or a field that is no number")
        raw = reduce(DataFrame.unionAll, [p.select(*[_field(n) for n in names]) for p in parts.values()])
        cols = [_number(_field(n)).alias(n) for n in names if n != key]
        if key in names:
            cols = [_field(key).cast(given.get(key, T.StringType())).alias(key), *cols]
            df = raw.select(*cols)
            if key not in given and not df.filter(_field(key).try_cast("long").isNull() & _field(key).isNotNull()).limit(1).count():
                df = df.withColumn(key, _field(key).cast("long"))
        else:
            split_key = "_split_content"
            df = raw.select(*cols, F.md5(F.to_json(F.array(*[_field(n) for n in names]), {"ignoreNullFields": "false"})).alias(split_key))
    else:
        df = spark.read.format(fmt).load(path)
    if key and key not in df.columns:
        df = df.withColumn(key, F.monotonically_increasing_id())
        if split_key is None:
            split_key = "_split_content"
            content = [_field(c).cast("string") for c in df.columns if c != key]
            df = df.withColumn(split_key, F.md5(F.to_json(F.array(*content), {"ignoreNullFields": "false"})))
    spec = CalibrationSpec.from_positions(df, key=key, split_key=split_key)
    if observed or predicted:
        first, second = observed or spec.observed, predicted or spec.predicted
        rest = [c for c in (spec.observed, spec.predicted, *spec.features) if c not in (first, second)]
        spec = CalibrationSpec(first, second, tuple(rest), spec.key, split_key)
    return df, spec


def _text_rows(spark: SparkSession, path: str | list[str], names: list[str], same_header: bool) -> DataFrame:
    """All fields as text; ``same_header``: reading a file with another header
    is an error."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    return (spark.read.schema(text).option("header", True).option("enforceSchema", not same_header)
            .option("columnNameOfCorruptRecord", _CORRUPT).csv(path))


def _malformed(parts: dict[tuple[str, ...], DataFrame], key: str | None) -> int:
    total = 0
    for names, raw in parts.items():
        bad = reduce(lambda x, y: x | y, [_is_bad(_field(n)) for n in names if n != key], F.col(_CORRUPT).isNotNull())
        total += raw.select(bad.alias("bad")).agg(F.count_if("bad")).first()[0]
    return total


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line that is not blank of every file of a task."""
    done = None
    for batch in batches:
        for line, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()):
            if file != done and line.strip():
                done = file
                yield pa.RecordBatch.from_pydict({"file": [file], "line": [line]})


def _layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Column names and files of every header in a folder.  The driver gets one
    name a file, as it does from any listing of the folder."""
    begins = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = begins.filter("start = 0").select("value", "file").mapInArrow(_first_lines, "file string, line string")
    found = lines.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).limit(MOST_LAYOUTS + 1).collect()
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers in {path}")
    out: dict[tuple[str, ...], list[str]] = {}
    for r in found:
        files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in r.files]   # a path, not a pattern
        names = tuple(spark.read.option("header", True).csv(files[0]).columns)
        out[names] = sorted(out.get(names, []) + files)
    return out


def _same_columns(layouts: dict[tuple[str, ...], list[str]], path: str, key: str | None, observed: str | None, predicted: str | None) -> None:
    first = min(layouts)
    for names, files in layouts.items():
        if sorted(names) != sorted(first):
            raise ValueError(f"{files[0]} of {path} has columns {list(names)}, another file {list(first)}")
    begins = {tuple(n for n in names if n != key)[:2] for names in layouts}
    if len(begins) > 1 and not (observed and predicted):
        raise ValueError(f"files of {path} begin with different columns {sorted(begins)}: name observed and predicted")


def _field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label double, features vector``.  Pass ``num_features`` to keep the
    full width (otherwise Spark infers it from the largest index present, and
    a trailing all-zero feature disappears) and to skip the inference pass."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", int(num_features))
    return reader.load(path)


def read_labelled_csv(spark: SparkSession, path: str, num_features: int,
                      features_col: str = "features") -> DataFrame:
    """Headerless ``label, f1..fn`` CSV to ``label, f1..fn, features``.

    A blank field is an error, as in the reference's point parser.
    """
    from ..operators.encode import assemble
    names = ["label"] + [f"f{i + 1}" for i in range(num_features)]
    schema = T.StructType([T.StructField(n, T.DoubleType(), True) for n in names])
    df = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    return assemble(df, names[1:], out=features_col, handle_invalid="error")


def explode_series(df: DataFrame, arrays: dict[str, str | Column],
                   keep: list[str] | tuple[str, ...] = (), pos: str = "pos",
                   slice_length: int | None = None) -> DataFrame:
    """Parallel arrays (e.g. ``time``, ``predicted``, ``observed`` of one
    simulation run per row) to one row per position: ``keep..., pos, name...``.

    Arrays are zipped by position; a shorter or missing (NULL) array yields
    NULLs, so a run is never dropped because one of its arrays is absent.

    Without ``slice_length`` the work is per input row, without a shuffle: right
    for many series.  With it every series is first cut into slices of so many
    positions, the slices are dealt out over the cluster and exploded there, so
    that one very long series in one row is spread over as many tasks as it has
    slices.
    """
    names = list(arrays)
    if slice_length is not None and slice_length < 1:
        raise ValueError("slice_length must be positive")
    cols = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()).alias(n)
            for n, c in arrays.items()]
    if slice_length is None:
        zipped = df.select(*keep, F.posexplode(F.arrays_zip(*cols)).alias(pos, "_z"))
        return zipped.select(*keep, pos, *[F.col(f"_z.{n}").alias(n) for n in names])
    # own names for what is carried: a kept column may be called like an array
    carried = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    held = df.select(*carried, *[c.alias(f"_a{i}") for i, c in enumerate(cols)])
    lengths = [F.size(f"_a{i}") for i in range(len(names))]
    longest = F.greatest(*lengths) if len(lengths) > 1 else lengths[0]
    starts = F.when(longest > 0, F.sequence(F.lit(0), longest - 1, F.lit(slice_length))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), *[F.slice(f"_a{i}", s + 1, F.lit(slice_length)).alias(f"a{i}") for i in range(len(names))]))
    dealt = held.select(*[f"_k{i}" for i in range(len(keep))], F.explode(cut).alias("_s")).repartition(
        # a number of its own: small slices make many rows, and adaptive execution would join them again by their bytes
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*[f"_k{i}" for i in range(len(keep))], "_s.start"))
    zipped = dealt.select("*", F.posexplode(F.arrays_zip(*[F.col(f"_s.a{i}").alias(f"a{i}") for i in range(len(names))])).alias("_p", "_z"))
    return zipped.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], (F.col("_s.start") + F.col("_p")).alias(pos),
                         *[F.col(f"_z.a{i}").alias(n) for i, n in enumerate(names)])


def read_prediction_list(df: DataFrame, line: str, keep: list[str] | tuple[str, ...] = (),
                         pos: str = "pos", value: str = "value") -> DataFrame:
    """A comma-joined list of numbers (``1.5,-2,3e4``) to rows ``keep..., pos,
    value`` with 0-based positions; blanks around items are ignored, an empty
    line is an empty list.  For lists of bounded size, one per row; a list that
    is a file of its own is read by ``read_prediction_file``."""
    text = F.trim(F.col(line))
    parts = F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))
    exploded = df.select(*keep, F.posexplode(parts).alias(pos, "_t"))
    return exploded.select(*keep, pos, F.trim(F.col("_t")).cast("double").alias(value))


def read_prediction_file(spark: SparkSession, path: str, header_lines: int = 1, pin: str = "auto") -> DataFrame:
    """A stored list, one line however long, to rows ``pos, value``.

    ``path`` is a file whose last line is the comma-joined list, after
    ``header_lines`` lines of text, or a folder of such files (without header
    lines: ``sinks.write_prediction_list``) that follow one another in the order
    of their part numbers, then names.  Items are separated while the file is
    read, so its splits, not its lines, are what tasks read.  An item's position
    is its place in the split plus the items of the splits before: one number a
    split.  The items are stored first, as another scan could cut other splits.

    An empty line gives no rows; blanks and line ends around items are ignored;
    an item that is no number is an error.
    """
    items = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"))
    stored = materialize(items, pin)
    clean = lambda c: F.trim(c, F.lit(" \t\r\n"))
    # the text before the list is part of a file's first item
    body = F.regexp_replace("value", "^(?:[^\n]*(?:\n|$)){%d}" % header_lines, "") if header_lines else F.col("value")
    splits = stored.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.count_if(clean(body) == "").alias("_blank"))
    in_file = Window.partitionBy("_file")
    # a file whose only item is blank holds an empty list
    empty = (F.sum("_n").over(in_file) == 1) & (F.sum("_blank").over(in_file) == 1)
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1)
    number = F.when(part != "", part.cast("long"))
    earlier = Window.orderBy(number.asc_nulls_first(), "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    based = splits.withColumn("_n", F.when(empty, 0).otherwise(F.col("_n"))).select(
        "_file", "_start", "_n", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), "_first",
        (F.min("_start").over(in_file) == F.col("_start")).alias("_leads"))
    begins = F.col("_leads") & (F.col("_at") == F.col("_first"))
    text = clean(F.when(begins, body).otherwise(F.col("value")))
    rows = stored.join(based.filter("_n > 0"), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("pos"), text.cast("double").alias("value"))
    return owns(rows, stored)
