"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

A text's features are its distinct words, adjacent pairs, and pairs with one or two words between,
hashed into one table. Each weight has its own learning rate and an L1 threshold that keeps all
but a few thousand of them at zero: what goes to the executors are the non-zero weights. Fitting
uses a bounded sample of labelled rows, even over the classes where both are plenty, and a score is
the probability under that sample's odds; scoring reads every word of every text.

Defined cases. Null and empty texts have no features: their score is the intercept's. Null or
repeated ids are scored like others. Without labels of both kinds the score is the share of label
1 (0.5 without labels). Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.common import crc_mod
from dipscan.llm.sampling import labelled


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20  # of the feature table
    gaps: tuple[int, ...] = (1, 2, 3)  # between the words of a pair; 1 is adjacent
    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    per_class: int = 2000  # labelled rows of each kind to fit on
    most_bytes: int = 20_000  # of a row to fit on, which bounds the sample; longer ones are scored all the same
    passes: int = 8
    threshold: float = 0.3


def features(buf: np.ndarray, offs: np.ndarray, cfg: Ftrl) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) arrays, one pair per kind of feature; repeats included."""
    starts, ends, woffs = X.words(buf, offs)
    h = X.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    shift, salt = np.uint64(64 - cfg.bits), X.stream(31, 1 + max(cfg.gaps)) | np.uint64(1)
    out = [(doc, ((h * salt[0]) >> shift).astype(np.int64))]
    for gap in cfg.gaps:
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        pair = X.mix(h[:-gap][same] * salt[gap] + h[gap:][same]) if len(same) else np.zeros(0, np.uint64)
        out.append((doc[gap:][same] if len(same) else doc[:0], (pair >> shift).astype(np.int64)))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, cfg: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero features, their weights, and the intercept; ``rows`` hold distinct features."""
    z, n = np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits)
    b_z = b_n = 0.0
    rng = np.random.default_rng(5)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2))

    for _ in range(cfg.passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w, b = weights(zi, ni, cfg.l1), float(weights(np.float64(b_z), np.float64(b_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / cfg.alpha * w
            n[at] = ni + g * g
            b_z += g - (np.sqrt(b_n + g * g) - np.sqrt(b_n)) / cfg.alpha * b
            b_n += g * g
    w = weights(z, n, cfg.l1)
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32), float(weights(np.float64(b_z), np.float64(b_n), 0.0))


def probabilities(buf: np.ndarray, offs: np.ndarray, dense: np.ndarray, intercept: float, cfg: Ftrl) -> np.ndarray:
    out = np.empty(len(offs) - 1)
    for i, j in X.blocks(offs):
        keys = []
        for doc, at in features(buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i], cfg):
            hit = dense[at] != 0
            keys.append((doc[hit] << cfg.bits) | at[hit])
        keys = np.unique(np.concatenate(keys))
        total = np.bincount(keys >> cfg.bits, dense[keys & ((1 << cfg.bits) - 1)], j - i)
        out[i:j] = 1 / (1 + np.exp(-np.clip(total + intercept, -700, 700)))
    return out


def _distinct(cfg: Ftrl):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            rows = []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                parts = features(buf[a:b], np.array([0, b - a]), cfg)
                rows.append(np.unique(np.concatenate([at for _, at in parts])).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, cfg: Ftrl = Ftrl()) -> Callable:
    """A column function from text to score, learned from rows whose crc32 class (of 4) isn't 2."""
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= cfg.most_bytes)
    sample, share = labelled(short, labels, "toxic", 4, 2, cfg.per_class)
    rows = (
        sample.select("doc_id", "text", "label").mapInArrow(_distinct(cfg), "doc_id long, label int, at binary")
        .toPandas().sort_values(["doc_id", "at"])
    )
    truth = rows["label"].to_numpy(np.float64)
    if len(rows) and 0 < truth.mean() < 1:
        at, w, intercept = fit([np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["at"]], truth, cfg)
    else:
        at, w, intercept = np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        buf, offs = X.flat(texts)
        dense = np.zeros(1 << cfg.bits, np.float32)
        dense[at] = w
        return pa.array(probabilities(buf, offs, dense, intercept, cfg))

    score.n_weights = len(at)
    return score


def scored(docs: DataFrame, labels: DataFrame, cfg: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = train(docs, labels, cfg)
    out = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return out.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )
