"""Language identification by a mixture of languages per document.

Every language has a hashed character-trigram model. A word's likelihood under a language is
the product over its trigrams; expectation-maximisation over a document's words estimates the
share of each language. Languages join the document's set one by one, in order of share, while
the log-likelihood gained exceeds a penalty that grows with the logarithm of the word count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import batch

#: Trigrams are hashed to so many bits.
BITS = 16
UNKNOWN = "und"

_alpha: np.ndarray | None = None


def alphabetic(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
    out = _alpha[codes & 0xFFFF]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = chr(codes[i]).isalpha()
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashes of the trigrams centred on every letter, and where each word's begin; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = alphabetic(codes)
    if not letter.any():
        return None
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    np.multiply(codes, letter, out=padded[1:-1])
    at = np.flatnonzero(letter)
    h = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32), np.flatnonzero(padded[at] == 0)


def fit(docs: DataFrame, *, per_lang: int = 1000, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (trigram x language).

    For each value of lang at most `per_lang` distinct texts train: those of smallest hash. Only
    hashes are ranked; the largest one taken of each language, a row a language, is broadcast and
    selects the texts before anything is shuffled: what moves is the sample alone. Counts are made
    on the executors, in sixteen parts a language, and reach the driver compressed. The model holds
    a vector for each language, so their number is taken to be small. Rows without text or lang
    don't train.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    hashes = rows.select("lang", "_h").distinct()
    ranked = hashes.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= per_lang)
    last = ranked.groupBy("lang").agg(F.max("_h").alias("_last"))
    picked = rows.join(F.broadcast(last), "lang").where(F.col("_h") <= F.col("_last")).groupBy("lang", "_h").agg(F.min("text").alias("text"))

    def count(key, pdf):
        import pandas as pd

        c = np.zeros(1 << BITS, dtype=np.int64)
        for t in pdf["text"]:
            if (g := trigrams(t)) is not None:
                c += np.bincount(g[0], minlength=1 << BITS)
        return pd.DataFrame({"lang": [key[0]], "counts": [zlib.compress(c.tobytes(), 1)]})

    counts: dict[str, np.ndarray] = {}
    for r in picked.groupBy("lang", F.pmod("_h", F.lit(16)).alias("_part")).applyInPandas(count, "lang string, counts binary").toLocalIterator():
        c = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
        counts[r["lang"]] = counts[r["lang"]] + c if r["lang"] in counts else c
    counts = {k: c for k, c in sorted(counts.items()) if c.sum() > 0}
    if not counts:
        return [], np.zeros((1 << BITS, 0), dtype=np.float32)
    p = np.stack([np.log((c + smooth) / (c.sum() + smooth * (1 << BITS))) for c in counts.values()], axis=1)
    return list(counts), np.ascontiguousarray(p, dtype=np.float32)


def mixture(like: np.ndarray, steps: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Shares of the languages by expectation-maximisation; like: word x language, each row's largest is 1."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(steps):
        joint = like * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return share


def identify(text: str | None, logp: np.ndarray, penalty: float = 1.0) -> tuple[dict[int, float], int] | None:
    """The document's language set with shares (by column of logp) and its word count; None without a letter."""
    g = trigrams(text) if text else None
    if g is None or not logp.shape[1]:
        return None
    by_word = np.add.reduceat(logp[g[0]], g[1], axis=0).astype(np.float64)
    top = by_word.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(by_word - top, -60))
    n = len(by_word)
    order = np.argsort(-mixture(like), kind="stable")
    best, gained = {int(order[0]): 1.0}, float(np.log(like[:, order[0]]).sum())
    for k in range(2, len(order) + 1):
        part = like[:, order[:k]]
        share = mixture(part)
        now = float(np.log(np.maximum(part @ share, 1e-300)).sum())
        if now - gained <= penalty * np.log(n + 1) + 2:
            break
        best, gained = {int(c): float(s) for c, s in zip(order[:k], share, strict=True)}, now
    return best, n


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out, *, penalty: float = 1.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of that language) and languages (the set, as
    lang=share by falling share) of every row; no shuffle.

    Texts that are null or without a letter, and all texts if nothing was learned: `und`, score 0.
    Equal shares go to the language that sorts first.
    """
    langs, logp = model

    def run(batches):
        for b in batches:
            found = [identify(t, logp, penalty) for t in b.column(2).to_pylist()]
            ranked = [sorted(f[0].items(), key=lambda x: (-x[1], x[0])) if f else [] for f in found]
            yield batch(
                SCHEMA,
                b.column(0),
                b.column(1),
                [langs[r[0][0]] if r else UNKNOWN for r in ranked],
                [min(1.0, r[0][1]) if r else 0.0 for r in ranked],
                [",".join(f"{langs[c]}={s:.4f}" for c, s in r) for r in ranked],
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")
