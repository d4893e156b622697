"""Near-duplicate documents by banded MinHash, verified by odd sketches and then by full sets.

A document's set holds its distinct five-word shingles. MinHash samples are cut into bands for
candidates; the same samples are folded into a parity bitmap (odd sketch), whose XOR population
count estimates a pair's similarity. Only pairs the estimate can't rule out reach the exact check.

Documents with equal sets form one class, settled by an aggregate; classes are compared by
representative. Within a bucket nobody is compared with everybody: a first round compares every
class with one hub; the next compares one hub per (bucket, component) with the other components'
members, the following ones ever larger shares of what has not been a hub, until no bucket holds
two components that have unmet members. As links merge components, few members are left by then.

Defined cases. Null or wordless text: empty set, linked with nothing. Null ``doc_id``: component
null, kept, linked with nothing. Rows that share an id: each text has its own class. Repeated rows:
same class, each row is returned; ``deduplicated`` keeps one of them. Ties: a group goes by its
smallest id, and of several texts of that id the one of least hash stays. A very long text is read
whole, in slices of a megabyte. Empty table: empty result. Extra columns of any name are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.common import components
from dipscan.session import materialize


@dataclass(frozen=True)
class Bands:
    """40 bands of 5 samples miss a pair of similarity 0.75 with probability 2e-5."""

    bands: int = 40
    rows: int = 5
    words: int = 5
    similar_percent: int = 75
    samples: int = 1024  # folded into the parity bitmap
    sketch_words: int = 32  # 64-bit words of the bitmap
    #: Estimates below this don't reach the exact check: nearly four standard errors below 0.75.
    least_estimate: float = 0.68
    #: After one hub per component: hubs are a 64th of the unmet members, an eighth, all.
    hub_shares: tuple[int, ...] = (64, 8, 1)


def _documents(batch: pa.RecordBatch, k: int):
    """Blocks of (document rows, distinct shingles, their offsets)."""
    buf, offs = X.flat(batch.column(1))
    for i, j in X.blocks(offs):
        part = buf[offs[i]: offs[j]]
        starts, ends, woffs = X.words(part, offs[i: j + 1] - offs[i])
        values, soffs = X.shingles(X.word_hashes(part, starts, ends), woffs, k)
        yield i, j, *X.distinct(values, soffs)


def _samples(values: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(sample, document) minima of ``n`` hash functions; ``at`` starts each document's values."""
    mult = (X.stream(seed, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (X.stream(seed + 1, n) >> np.uint64(32)).astype(np.uint32)
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((n, len(at)), np.uint32)
    if len(at):
        for s in range(n):
            out[s] = np.minimum.reduceat(low * mult[s] + add[s], at)
    return out


def _signatures(cfg: Bands):
    n_samples = cfg.bands * cfg.rows
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("version", pa.int64()),
    ])

    def run(batches):
        salt = X.stream(13, cfg.bands + 1)
        weight = X.stream(14, cfg.rows) | np.uint64(1)
        for batch in batches:
            ids, versions = batch.column(0), batch.column(2)
            for i, j, values, offs in _documents(batch, cfg.words):
                n = np.diff(offs)
                sums = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(X.mix(values), out=sums[0, 1:])
                np.cumsum(X.mix(values ^ salt[cfg.bands]), out=sums[1, 1:])
                h = sums[:, offs[1:]] - sums[:, offs[:-1]]
                rows = np.flatnonzero(n)
                samples = _samples(values, offs[:-1][rows], n_samples, 11)
                keys = np.empty((len(rows), cfg.bands), np.uint64)
                for b in range(cfg.bands):
                    acc = np.full(len(rows), salt[b], np.uint64)
                    for r in range(cfg.rows):
                        acc += samples[b * cfg.rows + r] * weight[r]
                    keys[:, b] = X.mix(acc)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                    X.lists(keys.reshape(-1).view(np.int64), np.r_[0, np.cumsum((n > 0) * cfg.bands)]),
                    versions.slice(i, j - i),
                ], schema=schema)

    return run


_SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, version long"


def _sets(cfg: Bands):
    """A document's full set and the odd sketch of its MinHash samples."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        salt = X.stream(17, cfg.samples)
        for batch in batches:
            for i, j, values, offs in _documents(batch, cfg.words):
                rows = np.flatnonzero(np.diff(offs))
                samples = _samples(values, offs[:-1][rows], cfg.samples, 15)
                sketch = np.zeros((len(rows), cfg.sketch_words), np.uint64)
                for s in range(cfg.samples):
                    bit = X.mix(samples[s].astype(np.uint64) + salt[s]) % np.uint64(64 * cfg.sketch_words)
                    sketch[np.arange(len(rows)), bit >> np.uint64(6)] ^= np.uint64(1) << (bit & np.uint64(63))
                full = (np.diff(offs) > 0) * cfg.sketch_words
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), X.lists(values.view(np.int64), offs),
                    X.lists(sketch.reshape(-1).view(np.int64), np.r_[0, np.cumsum(full)]),
                ], schema=schema)

    return run


def _alike(cfg: Bands, a: str, b: str):
    """Whether the odd sketches leave a pair possible: J ~ 1 + n/(4k) ln(1 - 2 popcount/n)."""
    n, k = 64 * cfg.sketch_words, cfg.samples
    most = n / 2 * (1 - np.exp((cfg.least_estimate - 1) * 4 * k / n))
    differing = sum(
        F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(cfg.sketch_words)
    )
    return differing <= int(np.ceil(most))


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: Bands) -> DataFrame:
    """Pairs whose full sets are alike enough; the larger side's set moves once, to its hub."""
    mine = sets.select(F.col("node").alias("u"), F.col("members").alias("su"))
    hubs = sets.select(F.col("node").alias("v"), F.col("members").alias("sv"))
    joined = pairs.join(mine.hint("merge"), "u").join(hubs.hint("merge"), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return (
        joined.select("u", "v", shared.alias("i"), F.size("su").alias("a"), F.size("sv").alias("b"))
        .where(F.col("i") * 100 >= cfg.similar_percent * (F.col("a") + F.col("b") - F.col("i")))
        .select("u", "v").distinct()
    )


def near_duplicates(docs: DataFrame, cfg: Bands = Bands()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return _grouped(docs, cfg).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, cfg: Bands) -> DataFrame:
    """doc_id, version (the text's hash), n_shingles, component_id, kept of every row.

    A node is a class of equal sets, numbered; an id may stand for several texts.
    """
    two = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
    )
    sig = materialize(two.mapInArrow(_signatures(cfg), _SIGNATURE), "signatures")
    same = ["h1", "h2", "n_shingles"]
    named = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy(*same).agg(F.min(F.struct("doc_id", "version")).alias("rep"))
    # numbered in order of their smallest ids, so that hubs are the earliest documents: originals, mostly
    classes = materialize(classes.orderBy("rep").withColumn("node", F.monotonically_increasing_id()), "numbers")
    members = named.join(classes.select(*same, "node", F.col("rep.doc_id").alias("first")), same)
    reps = classes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.version").alias("version"))
    reps = materialize(
        reps.join(named.select("doc_id", "version", "bands"), ["doc_id", "version"])
        .dropDuplicates(["node"]).select("node", "doc_id", "version", "bands"), "classes",
    )
    spread = reps.select("node", F.posexplode("bands")).select("node", F.col("pos").alias("band"), F.col("col").alias("bucket"))
    hubs = (
        spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
        .where("hub < top").select("bucket", "hub")
    )
    rows = materialize(spread.join(hubs, "bucket"), "buckets")  # (bucket, node, band, hub)
    nodes = reps.select("node", "doc_id", "version").join(rows.select("node").distinct(), "node")
    texts = two.join(nodes, ["doc_id", "version"]).select("node", "text")
    sets = texts.mapInArrow(_sets(cfg), "node long, members array<long>, sketch array<long>")
    if not named.groupBy("doc_id", "version").count().where("count > 1").isEmpty():  # repeated rows
        sets = sets.dropDuplicates(["node"])
    sets = materialize(sets, "sets")
    reps = reps.select("node", "bands")
    sketches = sets.select("node", "sketch")
    first = rows.groupBy("node").agg(F.min("hub").alias("v")).where("v < node").withColumnRenamed("node", "u")
    first = (
        first.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("ku")), "u")
        .join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("kv")), "v")
        .where(_alike(cfg, "ku", "kv")).select("u", "v")
    )
    links = materialize(_confirmed(first, sets, cfg), "links")
    labels = components(links)
    unmet = rows.select("bucket", "band", "node").join(sketches, "node").join(reps, "node")
    for share in (None, *cfg.hub_shares):
        named = unmet.join(labels, "node", "left").select(
            "bucket", "band", "node", "sketch", "bands", F.coalesce("component_id", "node").alias("c")
        )
        split = (
            named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"))
            .where("low < high").select("bucket")
        )
        named = materialize(named.join(split, "bucket", "left_semi"), "unmet")
        if named.isEmpty():
            break
        if share is None:
            first_of = named.groupBy("bucket", "c").agg(F.min("node").alias("own"))
            named = named.join(first_of, ["bucket", "c"]).withColumn("is_hub", F.col("node") == F.col("own"))
        else:
            named = named.withColumn("is_hub", F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
        lead = named.where("is_hub").select(
            "bucket", F.col("c").alias("hc"), F.col("node").alias("v"), F.col("sketch").alias("kv"), F.col("bands").alias("bv")
        )
        # two hubs meet once; a pair that shares buckets meets in the first of them
        new = (F.col("c") != F.col("hc")) & (~F.col("is_hub") | (F.col("node") > F.col("v")))
        earliest = F.array_position(F.zip_with("bands", "bv", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
        pairs = (
            named.join(lead, "bucket").where(new & _alike(cfg, "sketch", "kv") & earliest)
            .select(F.col("node").alias("u"), "v")
        )
        found = materialize(_confirmed(pairs, sets, cfg), "links")
        unmet = named.where("NOT is_hub").select("bucket", "band", "node", "sketch", "bands")
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    # a group goes by its smallest id
    group = classes.select("node", F.col("rep.doc_id").alias("first")).join(labels, "node")
    least = group.groupBy("component_id").agg(F.min("first").alias("_least"))
    group = group.join(least, "component_id").select("node", "_least")
    linked = members.join(group, "node", "left").select(
        "doc_id", "version", "n_shingles", F.coalesce("_least", "first").alias("component_id")
    )
    alone = sig.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "version", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, cfg: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, told apart by id and text; one of equal such rows."""
    found = materialize(_grouped(docs, cfg), "groups")
    # a group's smallest id may stand for several of its texts: one stays
    texts = found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("component_id", "doc_id").agg(F.min("version").alias("_one"))
    out = found.join(texts, ["component_id", "doc_id"], "left").where(~F.col("kept") | (F.col("version") != F.col("_one")))
    drop = out.select(F.col("doc_id").alias("_gid"), F.col("version").alias("_gv")).distinct()
    version = F.xxhash64(F.col("text").cast("string"))
    mine = F.col("doc_id").cast("long")
    stay = docs.join(drop, (mine == F.col("_gid")) & (version == F.col("_gv")), "left_anti")
    again = found.groupBy("doc_id", "version").count().where("count > 1 AND doc_id IS NOT NULL").drop("count")
    again = again.select(F.col("doc_id").alias("_gid"), F.col("version").alias("_gv"))
    if again.isEmpty():
        return stay
    on = (mine == F.col("_gid")) & (version == F.col("_gv"))
    return stay.join(again, on, "left_anti").unionByName(
        stay.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])
    )
