"""Exact removal of repeated 50-byte strings, with a run-length Burrows-Wheeler index per bucket.

Every 50-byte window has an anchor: the leftmost 8-byte string of least hash in it. Neighboring
windows with one anchor form a segment (at most 43 windows, 92 bytes), dealt to a bucket by the
anchor's hash; so equal windows, wherever they stand, meet in one bucket. Buckets grow in number
with the input, not in size.

Texts that are equal as a whole need no index: all but the one with the smallest id go entirely, and
only that one is cut into segments. Equality is that of a 256-bit hash, as for the result's own.

In a bucket, segments that agree with another document's on 29 bytes around the anchor are kept:
two that share a window do. Equal segments are one string with its smallest document. Strings that
share anchor contexts with other strings go into an index: their suffixes are sorted, the BWT is
kept as runs with the LF value of each run's head, and each class of rows that agree on 50 bytes
holds its smallest document, sampled once per class. Streaming every string backward through the
runs then gives its matching statistics at the threshold: for each window the class, hence the
first document that holds it. A window goes if that document is smaller than the segment's own.

Defined cases. Null text: empty. Null id: neither removed from nor compared. Rows that share an id
(equal or not) are compared with smaller ids only. Texts under 50 bytes: nothing goes. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.session import materialize


@dataclass(frozen=True)
class Index:
    window: int = 50
    anchor: int = 8
    bucket_bytes: int = 4 << 20  # of text, per bucket
    flush_bytes: int = 8 << 20  # of text, packed at once

    @property
    def spread(self) -> int:  # anchors in a window
        return self.window - self.anchor + 1

    @property
    def side(self) -> int:  # bytes beside the anchor that two equal windows share on one side at least
        return (self.window - self.anchor) // 2


_PLACE = np.uint64((1 << 20) - 1)


def segments(buf: np.ndarray, offs: np.ndarray, cfg: Index):
    """(document, start, windows, anchor's place in the segment, anchor's hash), for under 2**20 bytes."""
    n = len(buf)
    if n < cfg.window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    starts = np.arange(n - cfg.anchor + 1)
    h = X.span_hashes(buf, starts, starts + cfg.anchor, X.stream(51, 256))
    low = (h & ~_PLACE) | starts.astype(np.uint64)
    width = 1
    while width * 2 <= cfg.spread:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = cfg.spread - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), size)[: len(low)]
    valid = np.arange(len(low)) + cfg.window <= offs[1:][doc]
    at = (low & _PLACE).astype(np.int64)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(fresh)
    total = np.r_[0, np.cumsum(valid)]
    following = np.r_[first[1:], len(low)]
    return doc[first], first, total[following] - total[first], at[first] - first, low[first] >> np.uint64(20)


def _slices(offs: np.ndarray, cfg: Index):
    """(first document, last, from byte, to byte): blocks under 2**20 bytes; a longer text in overlapping parts."""
    for i, j in X.blocks(offs, (1 << 20) - 1):
        if offs[j] - offs[i] < 1 << 20:
            yield i, j, int(offs[i]), int(offs[j])
        else:
            step = (1 << 20) - cfg.window
            for a in range(int(offs[i]), int(offs[j]), step):
                yield i, j, a, min(a + step + cfg.window - 1, int(offs[j]))


def _pack(cfg: Index, n_buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, offs = X.flat(batch.column(2))
            parts, held = [], 0

            def flush(parts, buf=buf, rows=rows, docs=docs):
                if not parts:
                    return
                doc, start, windows, anchor, h, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                bucket = (X.mix(h) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                doc, start, windows, anchor, at, bucket = (x[order] for x in (doc, start, windows, anchor, at, bucket))
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
                names, payloads = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    size = windows[a:b] + cfg.window - 1
                    o = np.r_[0, np.cumsum(size)]
                    body = buf[np.arange(o[-1]) + np.repeat(at[a:b] - o[:-1], size)]
                    d = docs[doc[a:b]]
                    payloads.append(squeeze.compress(b"".join((
                        np.int64(b - a).tobytes(), np.diff(d, prepend=0).tobytes(), (rows[doc[a:b]] - d).tobytes(),
                        start[a:b].tobytes(), windows[a:b].astype(np.uint8).tobytes(),
                        anchor[a:b].astype(np.uint8).tobytes(), body.tobytes(),
                    ))))
                    names.append(bucket[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(names, np.int32)), pa.array(payloads, pa.binary())], schema=schema
                )

            for i, j, a, b in _slices(offs, cfg):
                o = np.clip(offs[i: j + 1], a, b) - a
                doc, start, windows, anchor, h = segments(buf[a:b], o, cfg)
                doc = doc + i
                parts.append((doc, start + a - offs[doc], windows, anchor, h, start + a))
                held += b - a
                if held >= cfg.flush_bytes:
                    yield from flush(parts)
                    parts, held = [], 0
            yield from flush(parts)

    return run


def _unpack(payloads: list[bytes], cfg: Index):
    out = []
    for p in payloads:
        raw = zstandard.ZstdDecompressor().decompress(p)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        wide = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        small = np.frombuffer(raw, np.uint8, 2 * n, 8 + 24 * n).reshape(2, n)
        d = np.cumsum(wide[0])
        out.append((d, d + wide[1], wide[2], small[0].astype(np.int64), small[1].astype(np.int64),
                    np.frombuffer(raw, np.uint8, -1, 8 + 26 * n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _group_range(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each row's key holds more than one value."""
    order = np.argsort(key)
    cuts = np.flatnonzero(np.r_[True, np.diff(key[order].view(np.int64)) != 0]) if len(key) else np.zeros(0, int)
    out = np.zeros(len(key), bool)
    if len(key):
        v = value[order]
        several = np.minimum.reduceat(v, cuts) != np.maximum.reduceat(v, cuts)
        out[order] = np.repeat(several, np.diff(np.r_[cuts, len(key)]))
    return out


class RunIndex:
    """Run-length BWT of strings, with the smallest document of each class of ``window`` equal bytes."""

    def __init__(self, body: np.ndarray, offs: np.ndarray, docs: np.ndarray, window: int):
        n_strings, size = len(offs) - 1, np.diff(offs)
        self.offs = offs + np.arange(n_strings + 1)  # with a separator after each string
        n = int(self.offs[-1])
        t = np.zeros(n + 4, np.int64)
        t[np.arange(len(body)) + np.repeat(np.arange(n_strings), size)] = body.astype(np.int64) + 1
        ends = self.offs[1:] - 1
        # four symbols and the place; a separator is unlike any other, ordered by string
        until = np.repeat(ends, size + 1) - np.arange(n)
        packed = np.zeros(n, np.int64)
        for i in range(4):
            packed = (packed << 9) | np.where(until >= i, t[i: n + i], 0)
        order = np.argsort((packed << 27) | np.arange(n)) if n < 1 << 27 else np.lexsort((np.arange(n), packed))
        fresh = np.r_[True, np.diff(packed[order]) != 0] | (until[order] < 4)
        rank, length, at_32 = np.empty(n, np.int64), 4, None
        rank[order] = np.cumsum(fresh) - 1
        while length < int(size.max(initial=0)) + 1 or length <= 32:
            if length == 32:
                at_32 = rank.copy()
            tail = np.zeros(n, np.int64)
            tail[:-length] = rank[length:] if length < n else 0
            key = rank * (n + 1) + np.where(until >= length, tail + 1, 0)
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[True, np.diff(key[order]) != 0]) - 1
            length *= 2
        last = t[order - 1]  # the BWT; before the first string stands the last separator
        heads = np.flatnonzero(np.r_[True, np.diff(last) != 0])
        lengths = np.diff(np.r_[heads, n])
        # LF of a run's head: symbols that are smaller, and equal ones in earlier runs
        by = np.argsort(last[heads], kind="stable")
        lf = np.empty(len(heads), np.int64)
        lf[by] = np.r_[0, np.cumsum(lengths[by])[:-1]]
        self.heads, self.lf = heads, lf
        # rows that agree on the window: equal in its first and in its last 32 bytes
        far = np.minimum(order + window - 32, n - 1)
        new = np.r_[True, (np.diff(at_32[order]) != 0) | (np.diff(at_32[far]) != 0)]
        self.classes = np.cumsum(new) - 1
        string = np.repeat(np.arange(n_strings), size + 1)[order]
        self.first = np.minimum.reduceat(docs[string], np.flatnonzero(new))

    def stream(self, window: int) -> list[np.ndarray]:
        """First document of every window of every string, read backward through the runs, all strings abreast."""
        size = np.diff(self.offs) - 1
        order = np.argsort(-size, kind="stable")
        out = np.zeros(int(self.offs[-1]), np.int64)
        row, lanes = order.copy(), len(order)  # the separators' rows, in order of the strings
        for step in range(1, int(size.max(initial=0)) + 1):
            lanes = int(np.searchsorted(-size[order], -step, "right"))
            run = np.searchsorted(self.heads, row[:lanes], "right") - 1
            row = self.lf[run] + row[:lanes] - self.heads[run]
            if step >= window:
                out[self.offs[order[:lanes]] + size[order[:lanes]] - step] = self.first[self.classes[row]]
        return out


def _resolve(payloads: list[bytes], cfg: Index):
    """(row, from, to) of the bytes to remove that a bucket finds."""
    doc, row, start, windows, anchor, body = _unpack(payloads, cfg)
    size = windows + cfg.window - 1
    offs = np.r_[0, np.cumsum(size)]
    plain = X.stream(52, 256)
    # contexts of the anchor, to the right and to the left
    both = np.zeros(len(doc), bool)
    contexts = []
    for lead in (0, cfg.side):
        a = offs[:-1] + anchor - lead
        b = a + cfg.anchor + cfg.side
        fits = np.flatnonzero((anchor >= lead) & (b <= offs[1:]))
        h = X.span_hashes(body, a[fits], b[fits], plain)
        both[fits] |= _group_range(h, doc[fits])
        contexts.append((fits, h))
    kept = np.flatnonzero(both)
    if not len(kept):
        return None
    h1 = X.span_hashes(body, offs[:-1][kept], offs[1:][kept], plain)
    h2 = X.span_hashes(body, offs[:-1][kept], offs[1:][kept], X.stream(53, 256))
    order = np.lexsort((doc[kept], h2, h1))
    fresh = np.r_[True, (np.diff(h1[order].view(np.int64)) != 0) | (np.diff(h2[order].view(np.int64)) != 0)]
    string = np.empty(len(kept), np.int64)
    string[order] = np.cumsum(fresh) - 1
    sample = kept[order[np.flatnonzero(fresh)]]  # a string's first document comes first
    first = doc[sample]
    # strings whose contexts other strings share: their windows may have begun elsewhere
    of = np.full(len(doc), -1)
    of[kept] = string
    several = np.zeros(len(first), bool)
    for fits, h in contexts:
        inside = of[fits] >= 0
        several[of[fits][inside][_group_range(h[inside], of[fits][inside])]] = True
    w = windows[sample]
    woffs = np.r_[0, np.cumsum(w)]
    answer = np.repeat(first, w)
    if several.any():
        at = np.flatnonzero(several)
        s = size[sample[at]]
        o = np.r_[0, np.cumsum(s)]
        text = body[np.arange(o[-1]) + np.repeat(offs[sample[at]] - o[:-1], s)]
        index = RunIndex(text, o, first[at], cfg.window)
        found = index.stream(cfg.window)
        n = w[at]
        inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        answer[np.repeat(woffs[at], n) + inner] = found[np.repeat(index.offs[:-1], n) + inner]
    n = windows[kept]
    inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    gone = answer[np.repeat(woffs[string], n) + inner] < np.repeat(doc[kept], n)
    at = np.flatnonzero(gone)
    if not len(at):
        return None
    seg = np.repeat(np.arange(len(kept)), n)[at]
    cut = np.r_[True, (np.diff(at) != 1) | (np.diff(seg) != 0)]
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(at)] - 1
    where = start[kept][seg[begin]]
    return row[kept][seg[begin]], where + inner[at[begin]], where + inner[at[end]] + cfg.window


def _buckets(cfg: Index):
    schema = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def answer(payloads):
        found = _resolve(payloads, cfg)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    def run(batches):
        now, payloads = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and payloads:
                    yield from answer(payloads)
                    payloads = []
                now = bucket
                payloads.append(payload.as_py())
        if payloads:
            yield from answer(payloads)

    return run


_KEPT = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: binary>"


def _cut(texts: pa.Array, begins: pa.Array, ends: pa.Array, keep: bool) -> pa.Array:
    buf, offs = X.flat(texts)
    out = []
    for i, (a, b) in enumerate(zip(begins, ends, strict=True)):
        body = buf[offs[i]: offs[i + 1]]
        spans, gone = 0, 0
        if a.is_valid:
            first, last = a.values.to_numpy(), b.values.to_numpy()
            last = np.minimum(last, len(body))
            order = np.argsort(first)
            first, last = first[order], np.maximum.accumulate(last[order])
            fresh = np.r_[True, first[1:] > last[:-1]]
            begin, end = first[fresh], np.r_[last[:-1][fresh[1:]], last[-1]]
            mask = np.zeros(len(body) + 1, np.int64)
            mask[begin] += 1
            mask[end] -= 1
            stay = np.cumsum(mask)[:-1] == 0
            spans, gone = len(begin), len(body) - int(stay.sum())
            body = body[stay]
        raw = body.tobytes()
        out.append((int(offs[i + 1] - offs[i]), gone, spans, hashlib.sha256(raw).hexdigest(), raw if keep else None))
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def deduplicated(docs: DataFrame, cfg: Index = Index(), keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep``, the kept bytes, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("row", F.col("doc_id"))
    else:  # ids don't tell rows apart
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-int(size) // cfg.bucket_bytes))
    long = f"doc_id IS NOT NULL AND octet_length(text) >= {cfg.window}"
    whole = rows.where(long).select("row", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"))
    whole = materialize(whole, "hashes")
    shared = whole.groupBy("h").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most")
    copies = materialize(whole.join(shared, "h").where("doc_id > _least").select("row"), "copies")
    gone = _spans(rows.where(long).join(copies, "row", "left_anti") if not copies.isEmpty() else rows.where(long), n_buckets, cfg)
    gone = gone.unionByName(copies.select(
        "row", F.array(F.lit(0).cast("long")).alias("begins"), F.array(F.lit(2**62).cast("long")).alias("ends")
    ))

    @F.arrow_udf(_KEPT)
    def cut(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        return _cut(_opened(texts), begins, ends, keep)

    # texts meet their spans in compressed form
    small = rows.select("doc_id", "row", "text").mapInArrow(_closed, "doc_id long, row long, text binary")
    out = small.join(gone, "row", "left").select("doc_id", cut("text", "begins", "ends").alias("x"))
    columns = ["x.n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256"] + ["x.kept"] * keep
    return out.select("doc_id", *columns)


def _closed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "row", "text"])


def _opened(texts: pa.Array) -> pa.Array:
    widen = zstandard.ZstdDecompressor()
    return pa.array([widen.decompress(t.as_buffer()) if t.is_valid else None for t in texts], pa.large_binary())


def _spans(rows: DataFrame, n_buckets: int, cfg: Index) -> DataFrame:
    """(row, begins, ends) of the spans to remove, written."""
    packed = rows.select("row", "doc_id", "text")
    packed = packed.mapInArrow(_pack(cfg, n_buckets), "bucket int, payload binary")
    spans = (
        packed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_buckets(cfg), "row long, a long, b long")
    )
    # no more spans than the text has windows
    gone = spans.groupBy("row").agg(F.collect_list("a").alias("begins"), F.collect_list("b").alias("ends"))
    return materialize(gone, "spans")
