"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists.

A word is compared only inside blocks. Two words one edit apart agree on all before or on all after
the edit, so with the shorter one's length ``m`` cut at ``m // 2`` they share either that prefix or
the remaining suffix: each word is dealt to a prefix block and a suffix block for its own length and
for the length below. A block that holds too many code points is cut again on the same principle
(its free middle in two), whatever its size, until one code point is free; then it can't hold more
words than the alphabet squared. No pair is met in two blocks: a suffix block leaves pairs alone that
also share the prefix.

A block is a sorted list. Its words are scanned together: for a query and a range of the list with
a common prefix there is one row of the edit matrix, three cells wide. Going one code point deeper
splits the range where the LCP of neighbors ends, so neighbors reuse the row of all they share,
and a range whose row exceeds one edit in every cell is skipped as a whole.

Defined cases. Null or empty text, or text without letters: no words. Null id: counts as an empty id
in the hash that picks deletions. Repeated rows: each one counts. Ties in a form's n: the smallest
word in code-point order. A very long text is read whole; a very long word is compared like any
other. Empty table: empty result. Only ``doc_id`` and ``text`` are read, so extra columns of any
name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.common import fold
from dipscan.session import materialize, spread

RUN = "[A-Za-zÀ-ÿ]+"
FAR = 9  # more edits than matter


@dataclass(frozen=True)
class Variants:
    noise: int = 97  # a run loses a code point where this divides its hash
    least_length: int = 5
    least_count: int = 3
    dominance: int = 2  # a form is at least so many times as frequent
    block_points: int = 1 << 20  # code points in a block before it is cut
    chunk_points: int = 1 << 21  # cells of the code-point matrix scanned at once
    frontier: int = 1 << 21  # (query, range) states at once, about


def vocabulary(docs: DataFrame, cfg: Variants = Variants()) -> DataFrame:
    """(word, n): distinct runs after the deletions, long and frequent enough."""
    raw = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("raw"),
    )
    # lower() is the quick way where it can only meet A-Z
    plain = F.octet_length("raw") == F.char_length("raw")
    run = raw.select("id", F.when(plain, F.lower("raw")).otherwise(fold(F.col("raw"))).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % cfg.noise == 0, cut).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word")).where(F.char_length("word") >= cfg.least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.least_count)
    )


_BLOCK = ["m", "p", "s", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: what a block's words share, the first ``p`` and the last ``s`` code points."""
    tail = F.when(F.col("s") > 0, F.substring("word", F.char_length("word") - F.col("s") + 1, F.col("s"))).otherwise("")
    head = F.substring("word", F.lit(1), F.col("p"))
    return rows.withColumn("key", F.concat(head, F.lit(" "), tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once with a longer common prefix, once with a longer common suffix.

    ``below`` keeps pairs apart: those with a common prefix of that length were met elsewhere.
    """
    free = F.col("m") - F.col("p") - F.col("s")
    half = F.floor(free / 2).cast("int")
    first = F.struct((F.col("p") + half).alias("p"), F.col("s"), F.col("below"))
    second = F.struct(
        F.col("p"), (F.col("s") + free - half).cast("int").alias("s"),
        F.least(F.col("below"), F.col("p") + half).alias("below"),
    )
    return _keyed(
        rows.select("word", "n", "m", F.explode(F.array(first, second)).alias("x"))
        .select("word", "n", "m", "x.p", "x.s", "x.below")
    )


def blocks(words: DataFrame, cfg: Variants = Variants()) -> DataFrame:
    """(word, n, m, p, s, below, key): every word in every block that it belongs to."""
    length = F.char_length("word")
    dealt = words.select(
        "word", "n", F.explode(F.filter(F.array(length, length - 1), lambda x: x >= cfg.least_length)).alias("m")
    )
    whole = dealt.select("word", "n", "m", F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(2**31 - 1).alias("below"))
    now, done = materialize(_halves(whole), "blocks"), None
    while True:
        hot = (
            now.groupBy(*_BLOCK).agg(F.sum(length).alias("points"))
            .where((F.col("points") > cfg.block_points) & (F.col("m") - F.col("p") - F.col("s") > 1)).drop("points")
        )
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            return now if done is None else done.union(now)
        rest = now.join(hot, _BLOCK, "left_anti").select(*now.columns)
        done = rest if done is None else done.union(rest)
        now = materialize(_halves(now.join(hot, _BLOCK, "left_semi")), "blocks")


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) and offsets of a string column."""
    buf, offs = X.flat(column)
    lead = buf == 0xC3
    points = buf | (np.r_[False, lead[:-1]] * 0x40).astype(np.uint8) if len(buf) else buf
    before = np.r_[0, np.cumsum(lead)]
    return points[~lead], offs - before[offs]


def _whole_blocks(batches, cfg: Variants) -> Iterator[pa.Table]:
    """Tables of whole blocks out of sorted batches; the last block of a table waits for the rest."""
    held: list[pa.Table] = []

    def cells(parts):
        return sum(p.num_rows for p in parts) * (1 + max(int(p["m"].to_numpy().max()) for p in parts))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if cells(held) < cfg.chunk_points:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        last = np.flatnonzero(_changes(rows))[-1]
        if last:
            yield rows.slice(0, last)
        held = [rows.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _changes(rows: pa.Table) -> np.ndarray:
    """Which rows begin a block."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = True
    for name in _BLOCK:
        values = rows[name].combine_chunks()
        if name == "key":
            values = values.dictionary_encode()
            values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).indices
        out[1:] |= np.diff(np.asarray(values)) != 0
    return out


def near_rows(matrix: np.ndarray, lengths: np.ndarray, lcp: np.ndarray, queries: np.ndarray, block: tuple, m, p):
    """(query row, list row) one edit apart.

    ``lcp[i]`` is what row i shares with the row above (-1 at a block's first row); ``block`` has the
    first and the last row + 1 of each query's block.
    """
    none = np.zeros(0, np.int64)
    q = lo = hi = none
    e = np.zeros((3, 0), np.int8)
    found_q, found_t = [], []
    n_rows, width = matrix.shape
    depth, last = int(p.min(initial=width)), int(p.max(initial=0))
    while depth < width and (len(q) or depth <= last):
        new = np.flatnonzero(p == depth)
        if len(new):
            q, lo, hi = np.r_[q, queries[new]], np.r_[lo, block[0][new]], np.r_[hi, block[1][new]]
            row = np.empty((3, len(new)), np.int8)
            row[:] = [[1 if depth else FAR], [0], [1]]
            e = np.concatenate([e, row], axis=1)
        starts = np.flatnonzero(lcp <= depth)
        group = np.cumsum(lcp <= depth) - 1
        first = group[lo]
        count = group[hi - 1] - first + 1
        parent = np.repeat(np.arange(len(q)), count)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        lo = starts[child]
        hi = np.r_[starts, n_rows][child + 1]
        q, e, c = q[parent], e[:, parent], matrix[lo, depth]
        # a word that ends here: its cell for the query's whole length
        left = lengths[q] - depth
        ends = np.flatnonzero((c == 0) & (np.abs(left) <= 1))
        hit = ends[e[left[ends] + 1, ends] == 1]
        found_q.append(q[hit])
        found_t.append(lo[hit])
        a = e[0] + (c != matrix[q, depth - 1]) if depth else np.full(len(q), FAR, np.int8)
        a = np.minimum(a, e[1] + 1)
        a[left < 0] = FAR
        b = np.minimum(np.minimum(e[1] + (c != matrix[q, depth]), e[2] + 1), a + 1)
        b[left < 1] = FAR
        after = matrix[q, depth + 1] if depth + 1 < width else np.zeros(len(q), np.uint8)
        d = np.minimum(e[2] + (c != after), b + 1)
        d[left < 2] = FAR
        live = (c != 0) & (np.minimum(np.minimum(a, b), d) <= 1)
        q, lo, hi, e = q[live], lo[live], hi[live], np.stack([a[live], b[live], d[live]]).astype(np.int8)
        depth += 1
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_t])


def _near(cfg: Variants):
    schema = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])

    def run(batches):
        for rows in _whole_blocks(batches, cfg):
            words, n = rows["word"].combine_chunks(), rows["n"].combine_chunks()
            points, offs = _latin(words)
            size = np.diff(offs)
            matrix = np.zeros((len(size), int(size.max()) + 1), np.uint8)
            matrix[np.repeat(np.arange(len(size)), size), np.arange(len(points)) - np.repeat(offs[:-1], size)] = points
            fresh = _changes(rows)
            differ = matrix[1:] != matrix[:-1]
            lcp = np.r_[-1, np.where(fresh[1:], -1, np.where(differ.any(1), differ.argmax(1), matrix.shape[1]))]
            start = np.flatnonzero(fresh)
            stop = np.r_[start[1:], len(size)]
            number = np.cumsum(fresh) - 1
            m, p = rows["m"].to_numpy(), rows["p"].to_numpy()
            below = rows["below"].to_numpy()
            many = stop - start
            asks = np.flatnonzero((size == m) & (many[number] > 1))
            weight = np.cumsum(np.minimum(many[number[asks]], 1000))
            share = weight // cfg.frontier
            for part in np.split(asks, np.flatnonzero(np.diff(share)) + 1) if len(asks) else []:
                at = number[part]
                q, t = near_rows(matrix, size, lcp, part, (start[at], stop[at]), m[part], p[part])
                apart = matrix[q] != matrix[t]
                good = apart.argmax(1) < below[q]
                q, t = q[good], t[good]
                back = size[t] > size[q]  # the longer word asks nothing here
                q, t = np.r_[q, t[back]], np.r_[t, q[back]]
                if len(q):
                    yield pa.RecordBatch.from_arrays([words.take(q), n.take(q), words.take(t), n.take(t)], schema=schema)

    return run


def near_pairs(words: DataFrame, cfg: Variants = Variants()) -> DataFrame:
    """(a, na, b, nb): every ordered pair of words one edit apart, once."""
    dealt = spread(blocks(words, cfg), *_BLOCK).sortWithinPartitions(*_BLOCK, "word")
    return dealt.mapInArrow(_near(cfg), "a string, na long, b string, nb long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain word -> form. A chain's n doubles with every step, so it ends."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                   F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, cfg: Variants = Variants()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    words = materialize(vocabulary(docs, cfg), "words")
    best = near_pairs(words, cfg).groupBy("a", "na").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("x"), "b")).alias("y")
    )
    good = -F.col("y.x") >= cfg.dominance * F.col("na")
    best = materialize(best.select(
        F.col("a").alias("word"), "n_near", F.when(good, F.col("y.b")).alias("form"), F.when(good, -F.col("y.x")).alias("form_n"),
    ), "near")
    ends = roots(best.where("form IS NOT NULL"))
    return (
        words.join(best, "word", "left").join(ends, "word", "left")
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
