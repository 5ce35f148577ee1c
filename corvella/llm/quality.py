"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad.
A text is cut into pieces that cover it whole; every piece is compressed with both. The
difference of the two sizes, over their sum, says which dictionary explains the text better.
A logistic calibration, fitted on labelled rows that neither dictionary has seen, turns the
difference, the compressed share of the text and its length into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, slices, utf8


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple
    prior: float
    piece: int
    level: int

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out


def sizes(text: bytes, good, bad, piece: int) -> tuple[int, int]:
    a = b = 0
    for i in range(0, len(text), piece):
        part = text[i : i + piece]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return a, b


def features(good: np.ndarray, bad: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The normalised difference, the compressed share, the length, and their products."""
    d = 10 * (good - bad) / np.maximum(1, good + bad)
    r = np.minimum(good, bad) / np.maximum(1, length)
    n = np.log1p(length) / 10
    return np.stack([np.ones_like(d), d, r, n, d * d, r * r, n * n, d * r, d * n, r * n], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression; x's first column is all ones and goes free.

    Columns are standardised, and a Newton step is halved until the loss falls, so that the fit
    comes to rest at its one optimum on separable classes, too.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale = 0, np.where(scale > 1e-12, scale, 1)
    scale[0] = 1
    z, penalty = (x - mean) / scale, np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w):
        m = z @ w
        return np.logaddexp(0, m).sum() - y @ m + (penalty * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-9 and not loss(w - size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10 * max(1.0, now):
            break
    w = w / scale
    w[0] -= mean @ w - mean[0] * w[0]
    return w


MEASURED = pa.schema([(k, pa.int64()) for k in ("y", "half", "h", "good", "bad", "length")])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 4000, pieces: int = 24000, dict_bytes: int = 65536, piece: int = 512, level: int = 3) -> QualityModel | None:
    """Train on at most `per_class` labelled rows of each class: those of smallest hash of doc_id.

    `labels` has doc_id and quality (0 or 1); ids with contradicting labels and rows without
    text are left out; of an id with several texts one serves, by hash. Half of the ids, by hash,
    give the dictionaries, at most `pieces` pieces of `piece` bytes of each class; the other half
    the calibration; a class that has none in a half uses all it has. Whole texts, however long,
    stay on the executors: what reaches the driver is bounded by these parameters. None if either
    class has no text.
    """
    spark = docs.sparkSession
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi")
        .select(F.col("doc_id").alias("_id"), F.col("lo").alias("_y"), F.xxhash64(F.lit(17), "doc_id").alias("_h"))
    )
    picked = one.where("_y = 0").orderBy("_h", "_id").limit(per_class).unionByName(one.where("_y = 1").orderBy("_h", "_id").limit(per_class)).collect()
    picked = spark.createDataFrame(picked, one.schema)  # 2 * per_class rows at most
    # one text of each id, so that no id's copies crowd out others
    texts = (
        docs.select("doc_id", utf8().alias("_t"))
        .join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
        .where("length(_t) > 0")
        .groupBy("_id", "_y", "_h")
        .agg(F.min(F.struct(F.xxhash64("_t").alias("h"), "_t"))["_t"].alias("_t"))
        .withColumn("_half", F.col("_h").bitwiseAND(1))
    )
    begins = F.sequence(F.lit(1), F.length("_t"), F.lit(piece))
    parts = texts.select("_y", "_half", F.explode(F.transform(begins, lambda i: F.substring("_t", i, F.lit(piece)))).alias("_p"))
    trained = {}
    for y in (0, 1):
        got = parts.where(F.col("_y") == y).orderBy("_half", F.xxhash64("_p"), "_p").limit(pieces).collect()
        first = [bytes(r["_p"]) for r in got if r["_half"] == 0]
        if not got:
            return None
        trained[y] = dictionary(first or [bytes(r["_p"]) for r in got], dict_bytes)
    model = QualityModel(trained[1], trained[0], (), 0.5, piece, level)

    def measure(batches):
        good, bad = model.compressors()
        for b in slices(batches):
            if made := [(y, half, h, *sizes(t, good, bad, piece), len(t)) for y, half, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]:
                yield batch(MEASURED, *zip(*made, strict=True))

    rows = sorted(tuple(r) for r in texts.select("_y", "_half", "_h", "_t").mapInArrow(measure, "y long, half long, h long, good long, bad long, length long").collect())
    second = {r[0] for r in rows if r[1]}
    rows = [r for r in rows if r[1] or r[0] not in second]
    s = np.array([r[3:] for r in rows], dtype=float)
    y = np.array([r[0] for r in rows], dtype=float)
    w = logistic(features(s[:, 0], s[:, 1], s[:, 2]), y)
    return QualityModel(trained[1], trained[0], tuple(w), float(y.mean()), piece, level)


def dictionary(pieces: list[bytes], dict_bytes: int) -> bytes:
    """A trained dictionary; too little text to train on is the dictionary itself, its last bytes if it is longer."""
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(256, sum(map(len, pieces)) // 4)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces).rjust(64)[-dict_bytes:]


def score(docs: DataFrame, model: QualityModel | None, *, column: str = "quality_score") -> DataFrame:
    """Append `column` (double, 0 to 1: how likely the text is good) to `docs`; no shuffle.

    Null and empty texts get the share of good rows in calibration; without a model every row
    gets 0.5. A text of any length is compressed whole, piece by piece. Repeated rows score alike.
    An existing column of that name is replaced.
    """
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.5))

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        good, bad = model.compressors()
        s = np.array([(*sizes(t, good, bad, model.piece), len(t)) if t else (0, 0, 0) for t in texts], dtype=float).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(features(s[:, 0], s[:, 1], s[:, 2]) @ np.array(model.weights), -30, 30)))
        return pd.Series(np.where(s[:, 2] > 0, p, model.prior))

    return docs.withColumn(column, rate(utf8()))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def scores(docs: DataFrame, model: QualityModel | None, held_out) -> DataFrame:
    """doc_id, held_out and score of every row: `score` without carrying the text back."""
    if model is None:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit(0.5).alias("score"))

    def run(batches):
        good, bad = model.compressors()
        w = np.array(model.weights)
        for b in slices(batches, 4096):
            s = np.array([(*sizes(t, good, bad, model.piece), len(t)) if t else (0, 0, 0) for t in b.column(2).to_pylist()], dtype=float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(features(s[:, 0], s[:, 1], s[:, 2]) @ w, -30, 30)))
            yield batch(SCHEMA, b.column(0), b.column(1), np.where(s[:, 2] > 0, p, model.prior))

    return docs.select("doc_id", held_out.alias("held_out"), utf8().alias("t")).mapInArrow(run, "doc_id long, held_out boolean, score double")
