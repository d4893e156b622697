"""Line deduplication by pairwise alignment.

Every line that isn't blank begins an anchor: it, and the lines after it until there are five words or
40 bytes. So a line of five words is an anchor by itself, and short lines, or lines of a script without
spaces, are anchors in small windows. Documents meet through anchors, never as pairs within a group:

* each (anchor, occurrence) links its holders with the first of them, the one with the smallest id,
  whether the anchor is rare or held by a third of all documents;
* a rare anchor, with four holders at most, links each of them with all earlier ones;
* two anchors in a row link their holders with the first document that has both in a row, so a copy
  also meets its own original where the first holder of the lines has them in another order.

For each linked pair the anchors (numbered if one recurs in a document) are aligned as patience diff
does: the longest run of them that rises in both documents. Aligned anchors, with the equal blank or
trailing lines around them, are the common blocks; they are deleted from the later document. Pairs of the
first kind are aligned on the anchors that link them, the others on all that both hold.

Defined cases. Null or empty text: returned as it is. Null id: neither first holder nor later,
returned as it is. Repeated rows (same id): no document is later than itself, all are treated
alike. Ties: the order is by id; of several texts under a first holder's id the one of least hash
stands for it. A very long text or line is read whole, in slices of a megabyte where lines allow it.
Empty table: empty result. Extra columns of any name pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.common import boxed
from dipscan.session import materialize


@dataclass(frozen=True)
class Lines:
    anchor_words: int = 5
    anchor_bytes: int = 40
    rare: int = 4  # holders of a rare anchor at most


_ANCHOR = (
    "doc_id long, version long, pos int, span int, h1 long, h2 long, k int, g1 long, g2 long, before array<long>, after array<long>"
)
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("h1", pa.int64()),
    ("h2", pa.int64()), ("k", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())),
])


def _spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """A list column of values[first:last]."""
    n = last - first
    offs = np.r_[0, np.cumsum(n)]
    at = np.arange(offs[-1]) + np.repeat(first - offs[:-1], n)
    return X.lists(values[at], offs)


def _anchors(cfg: Lines):
    def run(batches):
        plain, other = X.stream(21, 256), X.stream(22, 256)
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            ids, versions = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in X.blocks(offs):
                part, o = buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
                breaks = np.flatnonzero(part == 10)
                starts = np.sort(np.r_[o[:-1], breaks + 1], kind="stable")
                ends = np.sort(np.r_[breaks, o[1:]], kind="stable")
                # each document has one line more than line breaks
                loffs = np.r_[0, np.cumsum(1 + np.diff(np.searchsorted(breaks, o)))]
                doc = np.repeat(np.arange(j - i), np.diff(loffs))
                words = X.words(part, o)[0]
                n_words = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                h1 = X.span_hashes(part, starts, ends, plain).view(np.int64)
                h2 = X.span_hashes(part, starts, ends, other).view(np.int64)
                # the line at which each line's window is long enough, if it lies in the same document
                so_far = np.r_[0, np.cumsum(n_words)]
                size = np.r_[0, np.cumsum(ends - starts)]
                until = np.minimum(
                    np.searchsorted(so_far, so_far[:-1] + cfg.anchor_words), np.searchsorted(size, size[:-1] + cfg.anchor_bytes)
                ) - 1
                at = np.flatnonzero((n_words > 0) & (until < loffs[doc + 1]))
                if not len(at):
                    continue
                until = until[at]
                w1 = X.span_hashes(part, starts[at], ends[until], plain).view(np.int64)
                w2 = X.span_hashes(part, starts[at], ends[until], other).view(np.int64)
                d = doc[at]
                order = np.lexsort((at, w1, d))
                fresh = np.r_[True, (np.diff(w1[order]) != 0) | (np.diff(d[order]) != 0)]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                k = np.empty(len(at), np.int32)
                k[order] = np.arange(len(at)) - run_start
                previous = np.r_[-1, at[:-1]]
                previous = np.where(np.r_[-1, d[:-1]] == d, previous + 1, loffs[d])
                following = np.r_[at[1:], len(doc)]
                following = np.where(np.r_[d[1:], -1] == d, following, loffs[d + 1])
                # two anchors in a row; a document's last one stands with nothing
                last = np.r_[d[1:] != d[:-1], True]
                pair = [X.mix(w.view(np.uint64) + np.where(last, 0, np.roll(X.mix(w.view(np.uint64)), -1))).view(np.int64) for w in (w1, w2)]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(d + i)), pa.array(versions[d + i]), pa.array((at - loffs[d]).astype(np.int32)),
                    pa.array((until - at + 1).astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(k),
                    *(pa.array(g, mask=last) for g in pair), _spans(h1, previous, at),
                    _spans(h1, at + 1, following),
                ], schema=_SCHEMA)

    return run


def _agreeing(a, b):
    """How many leading elements two arrays share."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(equal)).cast("int")


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by piles (patience)."""
    tops, piles, back = [], [], [0] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _align(batches):
    """Per document: its matches with all partners, as parallel arrays sorted by (partner, pos)."""
    for frame in batches:
        starts, stops = [], []
        for holder, pos, other, back, ahead in zip(
            frame["f"], frame["p"], frame["q"], frame["nb"], frame["na"], strict=True
        ):  # ``ahead``: how many lines go with the anchor's first one
            gone: list[tuple[int, int]] = []
            cut = np.r_[0, np.flatnonzero(np.diff(holder)) + 1, len(holder)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                for i in rising(other[a:b].tolist()):
                    gone.append((int(pos[a + i] - back[a + i]), int(pos[a + i] + ahead[a + i] + 1)))
            gone.sort()
            first, last = [], []
            for s, e in gone:
                if last and s <= last[-1]:
                    last[-1] = max(last[-1], e)
                else:
                    first.append(s)
                    last.append(e)
            starts.append(first)
            stops.append(last)
        yield frame[["doc_id", "version"]].assign(gone_from=starts, gone_to=stops)


def common_blocks(docs: DataFrame, cfg: Lines = Lines()) -> DataFrame:
    """(doc_id, version, gone_from, gone_to): runs of lines to delete, by place in the document.

    ``version`` is the hash of the text, so that rows which share an id don't mix.
    """
    three = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("version"),
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = materialize(three.mapInArrow(_anchors(cfg), _ANCHOR), "anchors")
    key = ["h1", "h2", "k"]
    first = (
        lines.groupBy(*key).agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
        .where("f < last").drop("last")
    )
    # only these columns and rows are looked at more than once
    shared = materialize(lines.join(first, key), "shared")
    side = ["version", F.col("pos").alias("q"), F.col("before").alias("qb"), F.col("after").alias("qa")]
    at_first = (
        shared.where("doc_id = f").groupBy(*key).agg(F.min(F.struct(*side)).alias("x")).select(*key, "x.q", "x.qb", "x.qa")
    )

    def matched(rows: DataFrame) -> DataFrame:
        ahead = F.greatest(_agreeing("after", "qa"), F.col("span") - 1)
        return rows.select(
            "doc_id", "version", "f", "pos", "q", _agreeing(F.reverse("before"), F.reverse("qb")).alias("nb"), ahead.alias("na")
        )

    met = matched(shared.where("doc_id > f").join(at_first, key))
    # partners beside the first holders: earlier holders of rare anchors, first holders of two in a row
    rare = shared.where(F.col("holders") <= cfg.rare).select(*key, "doc_id", "f")
    earlier = rare.where("doc_id > f").select(*key, F.col("doc_id").alias("partner"))
    rare = rare.join(earlier, key).where("partner < doc_id").select("doc_id", "partner")
    row = shared.where("g1 IS NOT NULL").select("g1", "g2", "doc_id", "f")
    both = row.groupBy("g1", "g2").agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last")).where("partner < last").drop("last")
    row = row.join(both, ["g1", "g2"]).where("partner < doc_id AND partner <> f").select("doc_id", "partner")
    partners = materialize(rare.union(row).distinct(), "partners")
    mine = shared.select("doc_id", "version", "pos", "span", "before", "after", *key).join(partners, "doc_id")
    theirs = shared.join(partners.select(F.col("partner").alias("doc_id")).distinct(), "doc_id", "left_semi")
    theirs = theirs.groupBy("doc_id", *key).agg(F.min(F.struct(*side)).alias("x")).select(
        F.col("doc_id").alias("partner"), *key, "x.q", "x.qb", "x.qa"
    )
    met = met.unionByName(matched(mine.join(theirs, ["partner", *key]).withColumnRenamed("partner", "f")))
    # one array per document, no longer than the document has lines (and once per repeated row)
    rows = met.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("f", "pos", "q", "nb", "na"))).alias("m")
    )
    arrays = rows.select(
        "doc_id", "version", F.col("m.f").alias("f"), F.col("m.pos").alias("p"), F.col("m.q").alias("q"),
        F.col("m.nb").alias("nb"), F.col("m.na").alias("na"),
    )
    return arrays.mapInPandas(_align, "doc_id long, version long, gone_from array<int>, gone_to array<int>")


def deduplicated(docs: DataFrame, cfg: Lines = Lines()) -> DataFrame:
    """``_doc`` (a row of ``docs``) and ``_lines`` (n_lines, n_removed, text: what is left)."""
    gone = common_blocks(docs, cfg).select(
        F.col("doc_id").alias("_gid"), F.col("version").alias("_gv"), "gone_from", "gone_to"
    )
    gone = gone.select("_gid", "_gv", F.struct("gone_from", "gone_to").alias("_gone"))
    text = F.col("_doc.text")
    rows = boxed(docs).join(
        gone, (F.col("_doc.doc_id").cast("long") == F.col("_gid")) & (F.xxhash64(text) == F.col("_gv")), "left"
    )
    lines = F.split(text, "\n", -1)
    keep_from = F.concat(F.array(F.lit(0)), F.col("_gone.gone_to"))
    keep_to = F.concat(F.col("_gone.gone_from"), F.array(F.size(lines)))
    kept = F.flatten(F.transform(
        F.arrays_zip(keep_from.alias("a"), keep_to.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])
    ))
    removed = F.aggregate(
        F.arrays_zip(F.col("_gone.gone_from").alias("a"), F.col("_gone.gone_to").alias("b")),
        F.lit(0), lambda t, r: t + r["b"] - r["a"],
    )
    hit = F.col("_gone").isNotNull()
    return rows.select(
        "_doc",
        F.struct(
            F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).alias("n_lines"),
            F.when(hit, removed).otherwise(0).alias("n_removed"),
            F.when(hit, F.array_join(kept, "\n")).otherwise(text).alias("text"),
        ).alias("_lines"),
    )


def remaining(docs: DataFrame, cfg: Lines = Lines()) -> DataFrame:
    """``docs`` with what is left of each text; a text that is gone altogether goes with its row."""
    rows = deduplicated(docs, cfg)
    rows = rows.where((F.col("_lines.n_removed") == 0) | F.col("_lines.text").rlike(r"[^\x20\x09-\x0D]"))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col("_lines.text").alias("text"))
        elif name == "n_chars":
            same = F.col("_lines.n_removed") == 0
            out.append(F.when(same, F.col("_doc.n_chars")).otherwise(F.length("_lines.text")).alias(name))
        else:
            out.append(F.col(f"_doc.`{name}`"))
    return rows.select(*out)


def report(docs: DataFrame, cfg: Lines = Lines()) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row."""
    return deduplicated(docs.select("doc_id", "text"), cfg).select(
        "_doc.doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.text"
    )
