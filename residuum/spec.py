"""Column roles of a calibration table (observed, predicted, features, key)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CalibrationSpec:
    """Which columns play which role.

    The uploaded tables the reference reads carry roles by position: column 0
    is the observation, column 1 the model's prediction and every later column
    a feature.  ``from_positions`` reproduces that default; ``key`` names the
    column that identifies a row so that results are joined, never zipped.
    ``split_key`` names what the hash split goes by when the key does not come
    from the data (a row number says nothing about the row).
    """

    observed: str
    predicted: str
    features: tuple[str, ...] = field(default_factory=tuple)
    key: str = "row_id"
    split_key: str | None = None    # what the holdout split hashes, if not the key

    @classmethod
    def from_positions(cls, df: DataFrame, key: str | None = "row_id",
                       split_key: str | None = None) -> "CalibrationSpec":
        cols = [c for c in df.columns if c not in (key, split_key)]
        if len(cols) < 2:
            raise ValueError("a calibration table needs an observed and a predicted column")
        return cls(observed=cols[0], predicted=cols[1], features=tuple(cols[2:]),
                   key=key or "row_id", split_key=split_key)

    def with_features(self, *features: str) -> "CalibrationSpec":
        return CalibrationSpec(self.observed, self.predicted, tuple(features), self.key, self.split_key)
