"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

The statistics come from the flat bytes of an Arrow batch, the flattened trees are walked with numpy, so a document
costs no Python call. Only the fit sees a bounded sample of labelled rows (``max_labelled``, a documented
parameter: the rows of the smallest hash of their id); statistics and scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import _flat, _gbt
from lodestone.llm._common import col, fresh, ship, trimmed

_CLASSES = ("upper", "lower", "digit", "blank", "newline", "stop", "comma", "pipe", "mark", "symbol", "other", "wide")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _bytes in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t\r", "newline": b"\n", "stop": b".?:;", "comma": b",'\"-()", "pipe": b"|", "mark": b"!", "symbol": b"#$%&*+<=>@[\\]^_`{}~/", "wide": range(128, 256)}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

FEATURES = [*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "short_words", "distinct_words", "top_repeat", "distinct_pairs", "log_lines", "line_mean", "line_max_share", "repeated_lines", "upper_words", "words_a_stop"]


def _repeats(row: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, most frequent hash's count) of each row."""
    n = len(bounds) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    bits = max(1, int(n).bit_length())
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(64 - bits)).astype(np.int64)
    cut = _flat.segments(owner, n)
    return np.diff(cut).astype(float), _flat.reduce_rows(np.maximum, size, cut, 0).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """n x len(FEATURES); null counts as empty, whose statistics are 0."""
    data, offsets = _flat.flat(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    counts = np.zeros((n, len(_CLASSES)))
    kind = _CLASS[data]
    full = np.flatnonzero(size)
    for k in range(len(_CLASSES)):
        if len(full):
            counts[full, k] = np.add.reduceat(kind == k, offsets[full], dtype=np.int64)
    upper = (data >= 65) & (data <= 90)
    data = _flat.fold(data)
    starts, ends, row = _flat.words(data, offsets)
    h = _flat.hashes(data, starts, ends)
    bounds = _flat.segments(row, n)
    words = np.diff(bounds).astype(float)
    many = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    total = _flat.reduce_rows(np.add, length, bounds, 0)
    square = _flat.reduce_rows(np.add, length**2, bounds, 0)
    mean = total / many
    short = _flat.reduce_rows(np.add, (length <= 3).astype(float), bounds, 0)
    shout = np.zeros(0)
    if len(starts):
        ups = np.concatenate([[0], np.cumsum(upper)])
        shout = ((ups[ends] - ups[starts]) * 2 > ends - starts).astype(float)
    different, top = _repeats(row, h, bounds)
    pair_row = row[:-1][row[:-1] == row[1:]] if len(row) else row
    pair = _flat.mix64(h[:-1] * np.uint64(3) + h[1:])[row[:-1] == row[1:]] if len(row) else h
    pairs, _ = _repeats(pair_row, pair, _flat.segments(pair_row, n))
    ls, le = _flat.spans(data != 10, offsets)
    lrow = np.searchsorted(offsets, ls, "right") - 1
    lcut = _flat.segments(lrow, n)
    lines = np.diff(lcut).astype(float)
    some_lines = np.maximum(lines, 1)
    llen = (le - ls).astype(float)
    distinct_lines, _ = _repeats(lrow, _flat.hashes(data, ls, le), lcut)
    stops = counts[:, _CLASSES.index("stop")]
    columns = [
        *(counts / some[:, None]).T, np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square / many - mean**2, 0)), _flat.reduce_rows(np.maximum, length, bounds, 0), short / many, different / many, top / many, pairs / np.maximum(words - 1, 1),
        np.log1p(lines), _flat.reduce_rows(np.add, llen, lcut, 0) / some_lines, _flat.reduce_rows(np.maximum, llen, lcut, 0) / some, 1 - distinct_lines / some_lines, _flat.reduce_rows(np.add, shout, bounds, 0) / many, words / (stops + 1),
    ]
    return np.stack(columns, 1)


class Model:
    """A forest and the score from which a document counts as good."""

    def __init__(self, forest: _gbt.Forest, threshold: float, report: dict[str, float]) -> None:
        self.forest, self.threshold, self.report = forest, threshold, report


def train(x: np.ndarray, y: np.ndarray, keep: float = 0.998, seed: int = 3) -> Model:
    """A fifth of the rows is held out. The threshold is the largest, up to one half, that keeps the share ``keep`` of the
    held-out good rows; the report has the held-out accuracy. Without rows of both classes every document is good."""
    if not len(y) or y.min() == y.max():
        return Model(_gbt.fit(x[:0], y[:0]), 0.0, {"rows": len(y), "accuracy": float("nan")})
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    forest = _gbt.fit(x[~held], y[~held])
    s, t = forest.score(x[held]), y[held]
    good = np.sort(s[t == 1])
    threshold = min(0.5, float(good[int((1 - keep) * len(good))])) if len(good) else 0.5
    report = {"rows": len(y), "accuracy": float(((s >= threshold) == t).mean()) if len(t) else float("nan"), "good_kept": float((s[t == 1] >= threshold).mean()) if (t == 1).any() else float("nan"), "bad_kept": float((s[t == 0] >= threshold).mean()) if (t == 0).any() else float("nan")}
    return Model(forest, threshold, report)


def _measure(text_name: str, label_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _flat.slices(whole, text_name):
                x = features(part.column(text_name))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([flat, part.column(label_name)], ["x", "y"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Model:
    """Train on at most ``max_labelled`` labelled documents. Rows with a null id, text or label are left out; an id with
    several labels counts by the largest, one
    with several texts by the least. The sample's size is fixed, so it may be broadcast and collected."""
    ship(docs.sparkSession)
    target = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = target.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    one = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    got = one.mapInArrow(_measure("text", "y"), "x array<double>, y int").toArrow()
    y = got.column("y").to_numpy().astype(int) if got.num_rows else np.zeros(0, int)
    x = np.stack([np.asarray(v) for v in got.column("x").to_numpy()]) if got.num_rows else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # the order in which tasks end doesn't matter
    return train(x[order], (y[order] > 0).astype(int))


def _score(model: Model, text_name: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _flat.slices(whole, text_name):
                s = model.forest.score(features(part.column(text_name)))
                columns = [part.column(c) for c in part.schema.names if c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array(s >= model.threshold)], names)

    return run


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, is_good) for every row; a null text is scored as the empty text, a null id is passed on, repeated rows
    are scored alike. The statistics are those of the whole text, of any length. An empty table gives no rows. Other
    columns are ignored, whatever their names. Ids are cast to long, what can't be is an error."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_score(model, "text", ["doc_id", "score", "is_good"])), "doc_id long, score double, is_good boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model takes for good, with all their columns, whatever these are called. A null text is
    judged as the empty text, repeated rows alike, a text of any length whole; an empty table stays empty."""
    ship(docs.sparkSession)
    score, good = fresh(docs, "quality_score", "quality_good")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(good, T.BooleanType())])
    return docs.mapInArrow(trimmed(_score(model, text_col, schema.names)), schema).where(F.col(good)).drop(score, good)
