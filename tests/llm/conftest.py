import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from residuum.llm.shared import Workspace  # noqa: E402


@pytest.fixture()
def work(spark):
    w = Workspace(spark, "test")
    yield w
    for own in list(Workspace.live):
        own.release()


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows: list[tuple]):
    """Documents of (id, text), dealt over a few partitions."""
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def clashing(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("_id", "_text", "node", "block", "n", "key", "score", "spans", "weight", "_row", "part", "start", "label", "id")})
