"""Text scores from a log-bilinear language model trained with noise-contrastive estimation.

Tokens are a text's words (A-Z folded) and one end. Token counts come from all training rows, as
sums that combine in each task before they are shuffled. The model predicts the frequent words, and
``other`` for the rest, from the two tokens before. Its vocabulary grows with the square root of the
number of distinct training tokens. Words are cut by rank into as many classes as a class has
words; a token's probability is its class's times its own within the class. Both are log-bilinear:
the dot product of the summed context vectors and the class's or word's vector, plus a bias.

Every training token is fitted once, in random order within its block, so what is learned grows in
proportion to the corpus. Rows fall into ``rounds`` by a hash; in each round every
task takes noise-contrastive steps on its own rows in numpy, starting from the parameters of the
round before, and the tasks' parameters are averaged in Spark, block by block, each weighted by how often
the task met it. Parameters are float32, (3 * vocabulary + classes) * (size + 2) of them: some 15 MB
for 1e9 distinct words. Tasks of a round are at most ``wide_partitions``, whatever the input.

Normalisers are exact: per token one matrix product with all classes and one with all words of its
class. A word outside the vocabulary takes the probability of ``other`` times its share
(c + 1) / (N' + V' + 1) of the training tokens out of vocabulary, so the whole is normalised.

Counts of the most frequent words go to every task, a bounded table; all other words meet their
counts in a join.

Defined cases. Null and empty texts are one end token. A null id is neither held out nor learned
from. Repeated rows count and score each. Words of equal count enter the vocabulary by hash. Texts
of any length are read whole, in blocks of tokens. No training rows: all counts are 0. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.common import crc_mod
from dipscan.session import materialize, wide_partitions

END = np.int64(0x5EED0E0D)  # hash of the end token


BLOCK = 64  # parameter rows that travel together
STEP = 1 << 14  # tokens scored at a time


@dataclass(frozen=True)
class Bilinear:
    vocabulary: float = 1.5  # words of the model per square root of the distinct training tokens
    size: int = 24  # of a vector
    frequent: int = 262_144  # words whose counts every task holds, at least the vocabulary
    rounds: int = 4  # averaged passes, each over its own share of the rows
    noise: int = 8  # words drawn per class and batch, and classes per batch
    share: float = 1.0  # of every training text's tokens, fitted once: all, unless a caller asks for fewer
    batch: int = 256
    rate: float = 0.3
    start: float = 10.0  # of the sums of squared gradients: larger makes first steps shorter


def _tokens(batch: pa.RecordBatch, column: int):
    """Blocks of (rows, token hashes with ends, each row's offsets into them)."""
    buf, offs = X.flat(batch.column(column))
    for i, j in X.blocks(offs):
        part = buf[offs[i]: offs[j]]
        starts, ends, woffs = X.words(part, offs[i: j + 1] - offs[i])
        toffs = woffs + np.arange(len(woffs))
        out = np.full(toffs[-1], END, np.int64)
        at = np.ones(len(out), bool)
        at[toffs[1:] - 1] = False
        out[at] = X.word_hashes(part, starts, ends).view(np.int64)
        yield i, j, out, toffs


def _count(batches):
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])
    for batch in batches:
        seen = [np.unique(tokens, return_counts=True) for _, _, tokens, _ in _tokens(batch, 0)]
        if seen:
            h, back = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            c = np.bincount(back, np.concatenate([s[1] for s in seen])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], schema=schema)


def _ids(tokens: np.ndarray, toffs: np.ndarray, vocab: np.ndarray, place: np.ndarray, other: int, start: int):
    """Item numbers of tokens (``other`` outside the sorted ``vocab``) and of the two before (``start`` if none)."""
    at = np.minimum(np.searchsorted(vocab, tokens), len(vocab) - 1)
    w = np.where(vocab[at] == tokens, place[at], other)
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    first = toffs[:-1]
    two[first] = one[first] = start
    second = first[np.diff(toffs) > 1] + 1
    two[second] = start
    return w, one, two


class Net:
    """Parameters of the model: one row per context, word and class, its last column a bias.

    Item i (by falling count) is word ``i % members`` of class ``i // members``. ``table`` holds, in
    this order, the items and the start as the token before, the same as the token before that, the
    words and the classes. ``gain`` is the sum of squared gradients that scales a row's steps.
    """

    def __init__(self, unigram: np.ndarray, cfg: Bilinear):
        self.cfg, self.items = cfg, len(unigram)
        self.members = max(int(np.ceil(np.sqrt(self.items))), 1)
        self.classes = -(-self.items // self.members)
        self.earlier = self.items + 1
        self.word = 2 * self.earlier
        self.group = self.word + self.classes * self.members
        p = np.zeros(self.classes * self.members)
        p[: self.items] = (unigram + 1) / (unigram + 1).sum()
        p = p.reshape(self.classes, self.members)
        self.p_class = p.sum(axis=1)
        self.p_word = p / self.p_class[:, None]
        rng = np.random.default_rng(3)
        self.table = rng.normal(0, 0.1, (self.group + self.classes, cfg.size + 1)).astype(np.float32)
        self.table[: self.word, -1] = 0
        with np.errstate(divide="ignore"):
            logs = np.log(self.p_word).ravel()
        self.table[self.word: self.group, -1] = np.maximum(logs, -1e9)  # places without a word
        self.table[self.group:, -1] = np.log(self.p_class)
        self.gain = np.full(len(self.table), cfg.start, np.float32)
        self.met = np.zeros(len(self.table), np.float32)
        self.log_class = np.log(cfg.noise * self.p_class).astype(np.float32)
        self.log_word = np.maximum(logs + np.log(cfg.noise), -1e9).astype(np.float32)
        self.cum_class = np.cumsum(self.p_class)
        # class c's words share the range from c to c + 1
        self.cum_word = (np.cumsum(self.p_word, axis=1) + np.arange(self.classes)[:, None]).ravel()

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        q = self.table.take(one, axis=0) + self.table.take(self.earlier + two, axis=0)
        q[:, -1] = 1
        return q

    def move(self, rows: np.ndarray, slopes: np.ndarray) -> None:
        """One scaled gradient step; equal rows add up first."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        g = np.add.reduceat(slopes[order], cut, axis=0)
        at = rows[cut]
        self.gain[at] += (g * g).mean(axis=1)
        self.table[at] -= self.cfg.rate * g / np.sqrt(self.gain[at])[:, None]
        self.met[at] += np.diff(np.r_[cut, len(rows)])

    def learn(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """A noise-contrastive step on one batch: class against classes, word against words of its class."""
        k, dim = self.cfg.noise, self.cfg.size + 1
        order = np.argsort(w, kind="stable")
        w, one, two = w[order], one[order], two[order]
        q = self.context(one, two)
        cls = w // self.members
        words, groups = self.table[self.word: self.group], self.table[self.group:]
        # classes: the same noise for the whole batch
        drawn = np.minimum(np.searchsorted(self.cum_class, rng.random(k)), self.classes - 1)
        mine, noise = groups[cls], groups[drawn]
        hit = _sigmoid(np.einsum("bd,bd->b", q, mine) - self.log_class[cls]) - 1
        miss = _sigmoid(q @ noise.T - self.log_class[drawn])
        slope = hit[:, None] * mine + miss @ noise
        class_rows, class_slopes = np.r_[cls, drawn], np.concatenate([hit[:, None] * q, miss.T @ q])
        # words: the same noise for all tokens of a class, which lie together
        cut = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        here = cls[cut]
        which = np.repeat(np.arange(len(here)), np.diff(np.r_[cut, len(cls)]))
        ids = np.searchsorted(self.cum_word, here[:, None] + rng.random((len(here), k)))
        ids = np.minimum(ids, (here[:, None] + 1) * self.members - 1)
        mine, noise = words.take(w, axis=0), words.take(ids, axis=0).take(which, axis=0)
        hit = _sigmoid(np.einsum("bd,bd->b", q, mine) - self.log_word[w]) - 1
        miss = _sigmoid(np.einsum("bd,bkd->bk", q, noise) - self.log_word[ids][which])
        slope += hit[:, None] * mine + np.einsum("bk,bkd->bd", miss, noise)
        missed = np.add.reduceat((miss[:, :, None] * q[:, None, :]).reshape(len(w), -1), cut, axis=0)
        word_rows = np.r_[w, ids.ravel()]
        word_slopes = np.concatenate([hit[:, None] * q, missed.reshape(-1, dim)])
        slope[:, -1] = 0
        self.move(one, slope)
        self.move(self.earlier + two, slope)
        self.move(self.word + word_rows, word_slopes)
        self.move(self.group + class_rows, class_slopes)

    def log_prob(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log probability of items after their contexts, exactly normalised."""
        out = np.empty(len(w))
        words = self.table[self.word: self.group].reshape(self.classes, self.members, -1)
        groups = self.table[self.group:]
        for at in range(0, len(w), STEP):
            part = slice(at, at + STEP)
            order = np.argsort(w[part] // self.members, kind="stable")
            v = w[part][order]
            q, cls = self.context(one[part][order], two[part][order]), v // self.members
            got = _chosen(q @ groups.T, cls)
            cut = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                got[i:j] += _chosen(q[i:j] @ words[cls[i]].T, v[i:j] % self.members)
            out[at + order] = got
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30), dtype=np.float32))


def _chosen(scores: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log softmax of every row at one column."""
    scores -= scores.max(axis=1, keepdims=True)
    mine = scores[np.arange(len(scores)), column].astype(np.float64)
    np.exp(scores, out=scores)
    return mine - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _train(shared, cfg: Bilinear):
    """Rows (part, block, met, values) of the parameters that a task's texts have moved."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("met", pa.binary()), ("rows", pa.binary())])

    def run(batches):
        m = shared.value
        net = Net(m["unigram"], cfg)
        net.table, net.gain = m["table"].copy(), m["gain"].copy()
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([m["round"], part])
        for batch in batches:
            for _, _, tokens, toffs in _tokens(batch, 0):
                w, one, two = _ids(tokens, toffs, m["vocab"], m["place"], m["other"], net.items)
                order = rng.permutation(len(w))[: int(np.ceil(cfg.share * len(w)))]
                for at in range(0, len(order), cfg.batch):
                    i = order[at: at + cfg.batch]
                    net.learn(w[i], one[i], two[i], rng)
        moved = np.unique(np.flatnonzero(net.met) // BLOCK)
        values = np.column_stack([net.table, net.gain])
        for i in range(0, len(moved), 1024):
            some = moved[i: i + 1024]
            cut = [slice(b * BLOCK, (b + 1) * BLOCK) for b in some.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), part, np.int32)), pa.array(some),
                pa.array([net.met[c].tobytes() for c in cut], pa.binary()),
                pa.array([values[c].tobytes() for c in cut], pa.binary()),
            ], schema=schema)

    return run


def _average(group: pd.DataFrame) -> pd.DataFrame:
    """One block's parameters over all tasks, weighted by how often each met them."""
    group = group.sort_values("part")
    weight = total = 0.0
    for met, rows in zip(group["met"], group["rows"], strict=True):
        met = np.frombuffer(met, np.float32).astype(np.float64)
        weight = weight + met
        total = total + met[:, None] * np.frombuffer(rows, np.float32).reshape(len(met), -1)
    mean = np.where(weight[:, None] > 0, total / np.maximum(weight, 1)[:, None], np.nan).astype(np.float32)
    return pd.DataFrame({"block": [group["block"].iloc[0]], "rows": [mean.tobytes()]})


def fit(learn: DataFrame, model: dict, cfg: Bilinear) -> Net:
    """The net after all rounds over ``learn`` (one column of texts)."""
    spark = learn.sparkSession
    net = Net(model["unigram"], cfg)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(cfg.rounds))
    for i in range(cfg.rounds):
        shared = spark.sparkContext.broadcast({**model, "table": net.table, "gain": net.gain, "round": i})
        parts = learn.where(turn == i).select("text").coalesce(wide_partitions(spark))
        moved = (
            parts.mapInArrow(_train(shared, cfg), "part int, block long, met binary, rows binary")
            .groupBy("block").applyInPandas(_average, "block long, rows binary").toPandas()
        )
        shared.unpersist()
        for block, rows in zip(moved["block"], moved["rows"], strict=True):
            new = np.frombuffer(bytes(rows), np.float32).reshape(-1, cfg.size + 2)
            kept = ~np.isnan(new[:, 0])
            at = block * BLOCK + np.flatnonzero(kept)
            net.table[at], net.gain[at] = new[kept, :-1], new[kept, -1]
    return net


def _score(shared, cfg: Bilinear):
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("counts", pa.float64()), ("n_other", pa.int64()), ("others", pa.float64()),
        ("model", pa.float64()), ("rare", pa.list_(pa.int64())),
    ])

    def run(batches):
        m = shared.value
        net = Net(m["unigram"], cfg)
        net.table = m["table"]
        for batch in batches:
            for i, j, tokens, toffs in _tokens(batch, 3):
                at = toffs[:-1]
                w, one, two = _ids(tokens, toffs, m["vocab"], m["place"], m["other"], net.items)
                lm = net.log_prob(w, one, two)
                f = np.minimum(np.searchsorted(m["h"], tokens), max(len(m["h"]) - 1, 0))
                known = m["h"][f] == tokens if len(m["h"]) else np.zeros(len(tokens), bool)
                logs = np.where(known, m["log"][f], 0.0) if len(m["h"]) else np.zeros(len(tokens))
                other = w == m["other"]
                rare = ~known & (tokens != END)
                add = lambda x: np.add.reduceat(x.astype(np.float64), at)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(i, j - i) for c in range(3)], pa.array(np.diff(toffs)),
                    pa.array(add(known).astype(np.int64)), pa.array(add(logs)),
                    pa.array(add(other).astype(np.int64)), pa.array(add(np.where(other, logs, 0.0))),
                    pa.array(add(lm) / np.log(10)),
                    X.lists(tokens[rare], np.r_[0, np.cumsum(add(rare).astype(np.int64))]),
                ], schema=schema)

    return run


def scored(docs: DataFrame, cfg: Bilinear = Bilinear()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    learn = rows.where("doc_id IS NOT NULL AND NOT held_out").select("doc_id", "text")
    counts = materialize(
        learn.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts"
    )
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("h")).first()
    size = int(np.ceil(cfg.vocabulary * np.sqrt(v)))
    # A sorted limit would send that many rows from every task. The least count that the table has
    # room for comes from the counts of counts; words of lesser counts meet theirs in the join.
    above = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    least = (
        counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(above))
        .where(F.col("upto") <= max(cfg.frequent, size)).agg(F.min("c")).first()[0]
    )
    room = F.lit(False) if least is None else F.col("c") >= least
    top = counts.where(room | (F.col("h") == int(END))).toPandas()
    # the end first: it is a known token whatever the words' counts
    top = top.assign(other=top["h"] != END).sort_values(["other", "c", "h"], ascending=[True, False, True])
    h, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    words = np.unique(np.r_[h[:size], END])
    order = np.argsort(h)
    h, c = h[order], c[order]
    mine = np.zeros(len(words), np.int64)
    held = np.isin(words, h)
    mine[held] = c[np.searchsorted(h, words[held])]
    out_n, out_v = int(n - mine.sum()), int(v - (mine > 0).sum())
    # items by falling count, ``other`` among them
    uses = np.r_[mine, out_n]
    ranked = np.argsort(-uses, kind="stable")
    place = np.argsort(ranked)
    model = {"vocab": words, "place": place[:-1], "other": int(place[-1]), "unigram": uses[ranked].astype(float)}
    net = fit(learn, model, cfg)
    shared = spark.sparkContext.broadcast({**model, "table": net.table, "h": h, "log": np.log10(c + 1.0)})
    found = materialize(
        rows.mapInArrow(
            _score(shared, cfg),
            "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counts double, n_other long, "
            "others double, model double, rare array<long>",
        ),
        "scores",
    )
    rare = (
        found.select("row", F.explode("rare").alias("h")).join(counts, "h")
        .groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    )
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("counts") + logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + F.col("others") + logs - F.col("n_other") * float(np.log10(out_n + out_v + 1))).alias("score"),
    )
