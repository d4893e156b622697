"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred and rotated so that their signs make balanced bits (ITQ: alternate signs
and the orthogonal Procrustes rotation), with several independent rotations, fitted on a bounded
sample; every vector is indexed. Codes are cut into substrings, each the key of a table: with four
rotations of four 16-bit substrings, any pair within three bits in some rotation meets, and a pair
at cosine 0.98 misses all tables about once in a thousand. Pairs that meet are reranked by cosine
in double precision on the original vectors.

Equal vectors of a label are one class. A table's bucket is cut into blocks; each pair of blocks
is one task's matrix product, which counts a pair only in the first table where it meets and hands
on counts and a spanning forest of the links, never the pairs. So a bucket with a third of all
vectors spreads over many tasks.

Defined cases. Null, zero, null-holding or non-finite vectors, and null labels: no links, component
itself. Vectors of different lengths aren't compared. Null ids: no links, component null, kept.
Repeated rows (one id, equal vectors) are separate vectors of a class. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm.common import components
from dipscan.session import materialize


@dataclass(frozen=True)
class Itq:
    least_cosine: float = 0.98
    rotations: int = 4
    bits: int = 64
    substring: int = 16
    sample: int = 20_000  # vectors to fit rotations on
    rounds: int = 30
    block: int = 512  # classes of a bucket that are multiplied with another block at once

    @property
    def tables(self) -> int:
        return self.rotations * (self.bits // self.substring)


def learn(x: np.ndarray, cfg: Itq) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (dimension, rotations * bits) projection of unit vectors ``x``."""
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    centred = x - mean
    rng = np.random.default_rng(29)
    if len(x) > 1:
        values, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, np.argsort(-values, kind="stable")]
    else:
        axes = np.eye(d)
    out = []
    while sum(w.shape[1] for w in out) < cfg.rotations * cfg.bits:
        w = axes[:, : cfg.bits]
        r, _ = np.linalg.qr(rng.normal(size=(w.shape[1], w.shape[1])))
        v = centred @ w
        for _ in range(cfg.rounds if len(x) > 1 else 0):
            u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ t).T
        out.append(w @ r)
    return mean, np.concatenate(out, axis=1)[:, : cfg.rotations * cfg.bits]


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first: squares of very large or small numbers leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(models: dict, cfg: Itq):
    """(table, key, codes) of every class, for vectors of any of the known lengths."""
    schema = pa.schema([
        ("label", pa.int64()), ("dim", pa.int32()), ("node", pa.int64()), ("weight", pa.int64()),
        ("vector", pa.binary()), ("codes", pa.list_(pa.int32())),
    ])

    def run(batches):
        power = 1 << np.arange(cfg.substring)
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _unit(part.column(4))
                mean, turn = models[int(d)]
                bits = ((x - mean) @ turn >= 0).reshape(len(x), cfg.tables, cfg.substring)
                codes = (bits @ power).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(i) for i in range(4)], pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(x) + 1, dtype=np.int32) * cfg.tables), pa.array(codes.reshape(-1))
                    ),
                ], schema=schema)

    return run


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row it reaches."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _products(cfg: Itq):
    """One row per pair of blocks: weighted counts of links and their spanning forest."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for batch in batches:
            table, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            members = batch.column(2)
            nodes, counts, others = [], [], []
            bounds = members.offsets.to_numpy()
            inner = members.values
            node, weight = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            side, vectors = inner.field(2).to_numpy(zero_copy_only=False), inner.field(3)
            codes = inner.field(4)
            for r in range(len(table)):
                a, b = bounds[r], bounds[r + 1]
                if b - a < 2:
                    continue
                v = np.stack([np.frombuffer(x, np.float64) for x in vectors.slice(a, b - a).to_pylist()])
                c = codes.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                s = side[a:b]
                # a block with itself, or rows of one block with rows of the other
                first, second = (np.arange(b - a),) * 2 if own[r] else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
                i, j = np.nonzero(v[first] @ v[second].T >= cfg.least_cosine)
                i, j = first[i], second[j]
                ok = i < j if own[r] else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                for t in range(table[r]):
                    new = c[i, t] != c[j, t]
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                w = weight[a:b]
                total = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
                hit = np.flatnonzero(total)
                matrix = np.zeros((len(hit), len(hit)), bool)
                at = np.zeros(b - a, np.int64)
                at[hit] = np.arange(len(hit))
                matrix[at[i], at[j]] = matrix[at[j], at[i]] = True
                nodes.append(node[a:b][hit])
                counts.append(total[hit].astype(np.int64))
                others.append(node[a:b][hit][_forest(matrix)])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (nodes, counts, others)], schema=schema
                )

    return run


def linked(vectors: DataFrame, cfg: Itq = Itq()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, label, embedding)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    useful = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("_use", F.coalesce(useful, F.lit(False)))
    classes = materialize(
        rows.where("_use").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
        .select("label", F.size("v").alias("dim"), "node", "weight", "v"),
        "classes",
    )
    models = {}
    for dim, n in classes.groupBy("dim").count().collect():  # lengths of vectors: one, as a rule
        # by hash, so that reruns agree and no task sends more than its part of the sample
        share = min(1.0, 0.95 * cfg.sample / n) if n > cfg.sample else 1.0
        luck = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = classes.where((F.col("dim") == dim) & luck).limit(cfg.sample).select("v")
        x = [_unit(b.column("v").combine_chunks()) for b in [sample.toArrow()]]
        models[int(dim)] = learn(x[0], cfg)
    coded = materialize(
        classes.mapInArrow(
            _keys(models, cfg),
            "label long, dim int, node long, weight long, vector binary, codes array<int>",
        ),
        "codes",
    )
    key = ["table", "label", "dim", "code"]
    spread = coded.select("label", "dim", "node", F.posexplode("codes").alias("table", "code"))
    sizes = (
        spread.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(*key, F.ceil(F.col("n") / cfg.block).cast("int").alias("blocks"))
    )
    met = coded.select("*", F.posexplode("codes").alias("table", "code")).join(sizes, key)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, mine).alias("a"), F.greatest(o, mine).alias("b"), (o < mine).cast("int").alias("side")),
    )
    units = met.select(*key, "node", "weight", "vector", "codes", F.explode(pairs).alias("p")).groupBy(
        *key, "p.a", "p.b"
    ).agg(F.collect_list(F.struct("node", "weight", "p.side", "vector", "codes")).alias("members"))  # two blocks at most
    found = materialize(
        units.select("table", (F.col("a") == F.col("b")).alias("own"), "members")
        .mapInArrow(_products(cfg), "node long, links long, other long"),
        "links",
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = (
        classes.select("label", "v", "node", "weight").join(counts, "node", "left").join(labels, "node", "left")
        .select("label", "v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "node").alias("component_id"))
    )
    inside = rows.where("_use").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    outside = rows.where("NOT _use").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return inside.union(outside).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
