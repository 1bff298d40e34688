import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd(docs_of):
    """Documents that try an operator: nulls in every column, empty, blank, very long and repeated texts, clashing columns."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    long = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(4000))
    pairs = [(1, None), (None, "no id here"), (None, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one two three"), (6, "one two three"), (7, "one two three"), (8, "naïve Ünïcödé 漢字かな 🙂"), (9, "x")]
    frame = docs_of(pairs)
    frame = frame.withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang")))
    for clash in ("id", "sig", "node", "key", "mark", "n", "k1", "k2", "score", "is_good", "dup_digest", "dup_id", "near_key", "quality_score", "h", "html", "tokens", "keep_id"):
        frame = frame.withColumn(clash, F.lit("clash"))
    return frame


@pytest.fixture
def empty(docs_of):
    return docs_of([])
