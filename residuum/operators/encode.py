"""Feature vectors and the sparse labelled-vector (LIBSVM) text encoding.

``libsvm_line`` is a pure column expression (``concat_ws`` skips NULL items),
so encoding runs inside generated code with no Python per row.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: list[str] | tuple[str, ...],
             out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """Dense feature vector of the named columns, full width kept (a trailing
    all-zero feature still occupies its slot).  Clean first (``prepare.clean``)
    so that missing features are 0.0; ``handle_invalid='error'`` then guards
    against anything that slipped through."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=out,
                                handleInvalid=handle_invalid)
    return assembler.transform(df)


def _number_text(c: Column) -> Column:
    return c.cast("string")


def label_text(label: Column) -> Column:
    """Any zero label (0, 0.0, -0.0) is written as ``0``."""
    return F.when(label == 0, F.lit("0")).otherwise(_number_text(label))


def _item(index: int, value: Column) -> Column:
    """``index:value``, or NULL (item omitted) when the value is missing or 0."""
    return F.when(value.isNull() | (value == 0), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit(f"{index}:"), _number_text(value)))


def libsvm_line(label: Column | str, features: list[Column | str]) -> Column:
    """``label i:v i:v ...`` with 1-based positions; missing and zero items are
    left out but keep the positions of the others."""
    lab = F.col(label) if isinstance(label, str) else label
    items = [_item(i + 1, F.col(f) if isinstance(f, str) else f)
             for i, f in enumerate(features)]
    return F.concat_ws(" ", label_text(lab), *items)


def libsvm_line_from_vector(label: Column | str, vector: Column | str) -> Column:
    """The same encoding for an ML vector column of any width."""
    lab = F.col(label) if isinstance(label, str) else label
    vec = F.col(vector) if isinstance(vector, str) else vector
    arr = vector_to_array(vec)
    items = F.transform(arr, lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"),
                                                                   F.lit(":"),
                                                                   _number_text(x))))
    kept = F.filter(items, lambda s: s.isNotNull())
    joined = F.when(F.size(kept) > 0, F.array_join(kept, " "))
    return F.concat_ws(" ", label_text(lab), joined)


def to_libsvm(df: DataFrame, label: str | None, features: list[str] | tuple[str, ...],
              out: str = "value") -> DataFrame:
    """One text line per row.  ``label=None`` writes the constant label 1."""
    lab = F.lit(1) if label is None else F.col(label)
    return df.select(libsvm_line(lab, list(features)).alias(out))
