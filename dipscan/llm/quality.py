"""Document quality from a byte-level convolutional network, trained and run in numpy.

A text is read as bytes (folded into a few dozen classes) in overlapping chunks that cover it
whole. Learned filters slide over each chunk and are max-pooled; a small hidden layer turns a
chunk's maxima into a state; the states' mean over all chunks gives one probability. Fitting uses
a bounded sample of labelled rows and, of each, chunks evenly spaced over the whole text; scoring
reads every byte.

Defined cases. Null and empty texts are one chunk of padding and get a score. Null or repeated ids
are scored like others. Without labels of both kinds the score is the share of label 1 (0.5 without
labels). Empty table: empty result.
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
class Net:
    filters: int = 24
    width: int = 8  # bytes a filter sees
    chunk: int = 256  # positions of a chunk; its last bytes overlap the next
    hidden: int = 16
    per_class: int = 2500  # labelled rows of each kind to fit on
    fit_chunks: int = 12  # of each, evenly spaced
    steps: int = 900  # batches to fit on
    batch: int = 24
    rate: float = 0.004
    threshold: float = 0.3


def _byte_classes() -> np.ndarray:
    """0 is padding; lower-case letters and punctuation stand for themselves."""
    of = np.zeros(256, np.int64)
    of[97:123] = np.arange(1, 27)
    of[65:91] = 27
    of[48:58] = 28
    of[[9, 11, 12, 13, 32]] = 29
    of[10] = 30
    of[128:192], of[192:] = 31, 32
    rest = np.flatnonzero(of == 0)
    marks = [c for c in rest if 32 < c < 127]
    of[rest] = 33
    of[marks] = 34 + np.arange(len(marks))
    return of


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1


def chunks(buf: np.ndarray, offs: np.ndarray, cfg: Net) -> tuple[np.ndarray, np.ndarray]:
    """Class codes (chunk, position) with the overlap, and each document's offsets into the chunks."""
    size = np.diff(offs)
    count = np.maximum(1, -(-size // cfg.chunk))
    coffs = np.r_[0, np.cumsum(count)]
    padded = np.zeros(coffs[-1] * cfg.chunk + cfg.width - 1, np.int64)
    if len(buf):
        padded[np.arange(len(buf)) + np.repeat(coffs[:-1] * cfg.chunk - offs[:-1], size)] = CLASSES[buf]
    rows = np.lib.stride_tricks.as_strided(
        padded, (coffs[-1], cfg.chunk + cfg.width - 1), (padded.strides[0] * cfg.chunk, padded.strides[0])
    ).copy()
    rows[coffs[1:] - 1, cfg.chunk:] = 0  # a document's last chunk doesn't see the next document
    return rows, coffs


def _pair_tables(w: np.ndarray) -> np.ndarray:
    """Sums of two neighboring positions' weights: half the lookups."""
    return (w[0::2, :, None, :] + w[1::2, None, :, :]).reshape(len(w) // 2, -1, w.shape[2])


def _responses(rows: np.ndarray, tables: np.ndarray, cfg: Net) -> np.ndarray:
    """(chunk, position, filter)."""
    pairs = rows[:, :-1] * N_CLASSES + rows[:, 1:]
    y = tables[0][pairs[:, : cfg.chunk]]
    for i in range(1, len(tables)):
        y += tables[i][pairs[:, 2 * i: 2 * i + cfg.chunk]]
    return y


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, cfg: Net) -> dict[str, np.ndarray]:
    """Adam on the logistic loss; ``rows`` are the documents' chunks."""
    rng = np.random.default_rng(17)
    p = {
        "w": rng.normal(0, 0.25, (cfg.width, N_CLASSES, cfg.filters)).astype(np.float32),
        "b": np.zeros(cfg.filters, np.float32),
        "a": rng.normal(0, cfg.filters ** -0.5, (cfg.filters, cfg.hidden)).astype(np.float32),
        "c": np.zeros(cfg.hidden, np.float32),
        "v": rng.normal(0, cfg.hidden ** -0.5, cfg.hidden).astype(np.float32),
        "o": np.zeros(1, np.float32),
    }
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, shift = 0, np.arange(cfg.width)
    while step < cfg.steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), cfg.batch):
            docs = order[at: at + cfg.batch]
            x = np.concatenate([rows[d] for d in docs])
            n = np.array([len(rows[d]) for d in docs])
            start = np.r_[0, np.cumsum(n)[:-1]]
            y = _responses(x, _pair_tables(p["w"]), cfg)
            peak = y.argmax(axis=1)
            m = np.take_along_axis(y, peak[:, None, :], axis=1)[:, 0, :] + p["b"]
            r = np.maximum(m, 0)
            h = np.tanh(r @ p["a"] + p["c"])
            mean = np.add.reduceat(h, start) / n[:, None]
            gap = 1 / (1 + np.exp(-(mean @ p["v"] + p["o"]))) - labels[docs]
            gap = (gap / len(docs)).astype(np.float32)
            dh = np.repeat(gap / n, n)[:, None] * p["v"] * (1 - h * h)
            dm = (dh @ p["a"].T) * (m > 0)
            seen = x[np.arange(len(x))[:, None, None], peak[:, :, None] + shift]  # (chunk, filter, width)
            flat = (shift * N_CLASSES + seen) * cfg.filters + np.arange(cfg.filters)[None, :, None]
            g = {
                "w": np.bincount(flat.ravel(), np.repeat(dm.ravel(), cfg.width), p["w"].size).reshape(p["w"].shape),
                "b": dm.sum(0), "a": r.T @ dh, "c": dh.sum(0), "v": gap @ mean, "o": gap.sum(keepdims=True),
            }
            step += 1
            for k, value in g.items():
                first[k] = 0.9 * first[k] + 0.1 * value
                second[k] = 0.99 * second[k] + 0.01 * value * value
                move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                p[k] = (p[k] - cfg.rate * move).astype(np.float32)
    # the sample's classes are even, the corpus' are not
    here = labels.mean()
    share = min(max(share, 1e-3), 1 - 1e-3)
    p["o"] = p["o"] + np.float32(np.log(share / (1 - share)) - np.log(here / (1 - here)))
    return p


def probabilities(buf: np.ndarray, offs: np.ndarray, p: dict[str, np.ndarray], cfg: Net) -> np.ndarray:
    """One score per document, over all of its bytes; memory is bounded whatever a text's length."""
    out = np.empty(len(offs) - 1)
    tables = _pair_tables(p["w"])
    step = max(1, X.SLICE // 16 // cfg.chunk)
    for i, j in X.blocks(offs):
        rows, coffs = chunks(buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i], cfg)
        states = np.empty((len(rows), cfg.hidden))
        for k in range(0, len(rows), step):
            m = _responses(rows[k: k + step], tables, cfg).max(axis=1) + p["b"]
            states[k: k + step] = np.tanh(np.maximum(m, 0) @ p["a"] + p["c"])
        mean = np.add.reduceat(states, coffs[:-1]) / np.diff(coffs)[:, None]
        out[i:j] = 1 / (1 + np.exp(-(mean @ p["v"] + p["o"])))
    return out


def _spaced(cfg: Net):
    """A labelled row's chunks, evenly spaced over the whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("codes", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            codes = []
            for i, j in X.blocks(offs):
                rows, coffs = chunks(buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i], cfg)
                for a, b in zip(coffs[:-1], coffs[1:], strict=True):
                    take = np.unique(np.linspace(a, b - 1, cfg.fit_chunks).round().astype(int))
                    codes.append(rows[take].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(codes, pa.binary())], schema=schema
            )

    return run


def train(docs: DataFrame, labels: DataFrame, cfg: Net = Net()) -> Callable:
    """A column function from text to score, learned from rows whose crc32 class (of 5) isn't 0."""
    sample, share = labelled(docs, labels, "quality", 5, 0, cfg.per_class)
    rows = (
        sample.select("doc_id", "text", "label").mapInArrow(_spaced(cfg), "doc_id long, label int, codes binary")
        .toPandas().sort_values(["doc_id", "codes"])
    )
    truth = rows["label"].to_numpy(np.float64)
    if len(rows) and 0 < truth.mean() < 1:
        width = cfg.chunk + cfg.width - 1
        data = [np.frombuffer(c, np.uint8).reshape(-1, width).astype(np.int64) for c in rows["codes"]]
        p = fit(data, truth, share, cfg)
    else:
        p = None

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        buf, offs = X.flat(texts)
        return pa.array(np.full(len(texts), share) if p is None else probabilities(buf, offs, p, cfg))

    return score


def scored(docs: DataFrame, labels: DataFrame, cfg: Net = Net()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = train(docs, labels, cfg)
    out = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return out.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, cfg: Net = Net()) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    score = train(docs, labels, cfg)
    return docs.where(score(F.col("text").cast("string")) >= cfg.threshold)
