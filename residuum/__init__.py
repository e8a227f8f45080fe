"""residuum - learn a simulation model's error on Spark, correct its
predictions and measure how much the correction helped.

The names below are imported when they are first used, so that a Python worker
that needs one part of the library loads that part only.
"""

from __future__ import annotations

from importlib import import_module

_HOME = {
    "CalibrationSpec": "spec",
    "CorrectionResult": "plans.correct", "compare_techniques": "plans.correct", "correct": "plans.correct",
    "prepare_frame": "plans.correct", "three_way_report": "plans.correct",
    "materialize": "operators.materialize", "release": "operators.materialize", "stored": "operators.materialize",
    "cd": "functions.metrics", "goodness_of_fit": "functions.metrics", "mse": "functions.metrics", "nse": "functions.metrics",
    "pbias": "functions.metrics", "rmse": "functions.metrics", "series_report": "functions.metrics",
}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return [*globals(), *__all__]
