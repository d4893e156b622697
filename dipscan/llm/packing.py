"""Packing into sequences of 1024 tokens by lexical retrieval.

Each document is tokenised once. Whole windows of a long document are sequences of their own, cut at
once; what is left of it (under a window) is a piece to pack. The terms of a piece are its token
ids, so the statistics of BM25 over all pieces - document frequencies, mean length - are a table no
longer than the vocabulary, and small enough for the driver and every task.

The index is sharded by a piece's heaviest term (frequency times rarity): pieces that share it stand
together. A histogram of these terms, again no longer than the vocabulary, lays out the shards: light
terms share one, a heavy term is spread over as many as its tokens need by a hash of its pieces, so no
shard grows with the input. A task gets many shards and takes one after another. In a shard the first
unused piece is the seed; its terms' postings give the BM25 score of every unused piece, and they
fill the window by falling score: whole if they fit, the first that doesn't is cut where the window
ends, and what is left of it stays unused. The pieces left at a shard's end seed the next shard's
windows; those at a task's end make sequences with power-of-two lengths, which need no padding.

Ids equal those of ``tokenizers`` with the JSON file. The fast library holds the same vocabulary; it
takes the texts made of letters and signs whose classes are alike everywhere (below U+0250), which
the tests compare one by one; any other text, or one with the special token's name, goes through
``tokenizers`` itself.

Defined cases. Null or empty text: the closing id alone. Null id: packed like any other. Repeated rows:
each is packed. Ties in score: the earlier piece of the shard, which is sorted by id and text hash.
A very long text: whole windows, cut in one pass. Empty table: empty result. Only ``doc_id`` and
``text`` are read, so extra columns of any name are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.session import materialize, wide_partitions


#: Characters whose class may differ between two libraries' Unicode versions.
_UNSETTLED = re.compile("[^\x00-\u024f]")


@dataclass(frozen=True)
class Packing:
    tokenizer: str  # the JSON file
    ranks: str  # the same vocabulary as ranks
    pattern: str  # its word pattern
    window: int = 1024
    close: int = 0  # the id after each document
    shard_tokens: int = 1 << 19
    k1: float = 1.2
    b: float = 0.75


def public(**other) -> Packing:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers as P

    return Packing(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, **other)


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str, pattern: str):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    exact = Tokenizer.from_file(tokenizer)
    names = tuple(t.content for t in exact.get_added_tokens_decoder().values())
    return exact, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), names


def vocabulary_size(cfg: Packing) -> int:
    return _encoders(cfg.tokenizer, cfg.ranks, cfg.pattern)[0].get_vocab_size(with_added_tokens=True)


def token_ids(text: str | None, cfg: Packing) -> np.ndarray:
    """The ids of ``text`` and the closing one."""
    exact, fast, names = _encoders(cfg.tokenizer, cfg.ranks, cfg.pattern)
    text = text or ""
    if _UNSETTLED.search(text) or any(name in text for name in names):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    ids.append(cfg.close)
    return np.frombuffer(array("I", ids), np.uint32)


_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_TYPES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(cfg: Packing):
    """Whole windows as finished pieces (``rest`` null), and what is left of each document in ``rest``."""
    schema = _PIECE.append(pa.field("rest", pa.binary()))
    kind = "<u2" if vocabulary_size(cfg) <= 1 << 16 else "<u4"

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), cfg)
                n = len(ids)
                for at in range(0, n - cfg.window + 1, cfg.window):
                    # even numbers; those of the packed sequences are odd
                    number = ((task << 31) + made) * 2
                    rows.append((doc, at, cfg.window, _crc(ids[at: at + cfg.window]), n, number, 0, None))
                    made += 1
                left = n % cfg.window
                if left:
                    rows.append((doc, n - left, left, None, n, None, None, ids[n - left:].astype(kind).tobytes()))
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, kind


def _terms(ids: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, term, frequency) of pieces laid end to end, sorted by piece and term."""
    piece = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    both, tf = np.unique(piece * size + ids.astype(np.int64), return_counts=True)
    return both // size, both % size, tf


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = X.flat(column)
    width = np.dtype(kind).itemsize
    return buf.view(kind), offs // width


def _counted(kind: str, size: int):
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            ids, offs = _unpacked(batch.column(0), kind)
            df += np.bincount(_terms(ids, offs, size)[1], minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["term", "df"])

    return run


def _heaviest(ids: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each piece's term of the greatest frequency times rarity (ties: the smallest id)."""
    piece, term, tf = _terms(ids, offs, len(idf))
    if not len(piece):
        return term
    weight = tf * idf[term]
    start = np.flatnonzero(np.r_[True, np.diff(piece) != 0])
    top = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, start), np.diff(np.r_[start, len(piece)])))
    return term[top[np.r_[True, np.diff(piece[top]) != 0]]]


def _leading(kind: str, idf: np.ndarray):
    def run(batches):
        tokens = np.zeros(len(idf), np.int64)
        for batch in batches:
            ids, offs = _unpacked(batch.column(0), kind)
            np.add.at(tokens, _heaviest(ids, offs, idf), np.diff(offs))
        seen = np.flatnonzero(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(tokens[seen])], ["term", "tokens"])

    return run


def layout(tokens: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every term, from the tokens of the pieces it leads."""
    parts = -(-tokens // shard_tokens)
    light = parts <= 1
    # light terms side by side fill shards by their running sum; heavy ones come after them
    running = np.cumsum(np.where(light, tokens, 0))
    first = running // shard_tokens
    after = int(first[-1]) + 1 if len(first) else 0
    heavy = np.where(light, 0, parts)
    first = np.where(light, first, after + np.cumsum(heavy) - heavy)
    return first, np.maximum(parts, 1)


def _dealt(kind: str, idf: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """The pieces with their shard."""
    def run(batches):
        for batch in batches:
            ids, offs = _unpacked(batch.column(3), kind)
            lead = _heaviest(ids, offs, idf)
            chance = np.array([zlib.crc32(ids[a:b].tobytes() + str(d).encode()) for a, b, d in zip(
                offs[:-1], offs[1:], batch.column(0).to_pylist(), strict=True)], np.int64)
            shard = first[lead] + chance % parts[lead]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(chance)],
                                             [*batch.schema.names, "shard", "chance"])

    return run


class Shard:
    """Unused pieces of one shard behind an inverted index."""

    def __init__(self, pieces: list, idf: np.ndarray, mean: float, cfg: Packing):
        self.pieces = pieces  # [doc_id, start, ids, doc_tokens]
        n = np.array([len(p[2]) for p in pieces], np.int64)
        offs = np.r_[0, np.cumsum(n)]
        ids = np.concatenate([p[2] for p in pieces]) if pieces else np.zeros(0, np.uint32)
        piece, term, tf = _terms(ids, offs, len(idf))
        weight = idf[term] * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * n[piece] / mean))
        self.of = np.searchsorted(piece, np.arange(len(pieces) + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = piece[order], weight[order]
        sorted_term = term[order]
        self.start = np.searchsorted(sorted_term, term)
        self.stop = np.searchsorted(sorted_term, term, "right")
        self.useful = idf[term] > 0
        self.unused = np.ones(len(pieces), bool)
        self.size = n

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces with a score, best first."""
        a, b = self.of[seed], self.of[seed + 1]
        keep = self.useful[a:b]
        start, n = self.start[a:b][keep], (self.stop[a:b] - self.start[a:b])[keep]
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        score = np.bincount(self.posting[at], self.weight[at], len(self.pieces))
        score[~self.unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def windows(shard: Shard, cfg: Packing, last: bool) -> Iterator[list]:
    """Full windows as lists of pieces; unless ``last``, pieces too few for a window stay unused."""
    left = sum(len(p[2]) for p in shard.pieces)
    seed = 0
    while left >= cfg.window or (last and left):
        while not shard.unused[seed]:
            seed += 1
        room, window = cfg.window, []

        def take(i: int, n: int, window=window):
            doc, start, ids, total = shard.pieces[i]
            window.append((doc, start, ids[:n], total))
            shard.size[i] -= n
            if n == len(ids):
                shard.unused[i] = False
            else:
                shard.pieces[i] = [doc, start + n, ids[n:], total]
            return n

        room -= take(seed, min(room, len(shard.pieces[seed][2])))
        near = shard.neighbours(seed) if room else np.zeros(0, np.int64)
        at = 0
        while room:  # the next one by score that fits
            fits = np.flatnonzero(shard.size[near[at:]] <= room)
            if not len(fits):
                break
            at += int(fits[0]) + 1
            room -= take(near[at - 1], int(shard.size[near[at - 1]]))
        for i in near[shard.unused[near]] if room else []:  # a cut of the best one left fills the gap
            room -= take(i, min(room, int(shard.size[i])))
            if not room:
                break
        at = seed
        while room and left - (cfg.window - room) > 0:  # nobody is alike: the next unused ones
            at += 1
            if shard.unused[at]:
                room -= take(at, min(room, len(shard.pieces[at][2])))
        left -= cfg.window - room
        yield window


def powers_of_two(window: list) -> Iterator[list]:
    """A window that isn't full, cut into sequences whose lengths are powers of two."""
    total = sum(len(p[2]) for p in window)
    todo = [list(p) for p in window]
    for bit in reversed(range(total.bit_length())):
        room, part = total & (1 << bit), []
        while room:
            doc, start, ids, n = todo[0]
            part.append((doc, start, ids[:room], n))
            if len(ids) > room:
                todo[0] = [doc, start + room, ids[room:], n]
            else:
                todo.pop(0)
            room -= len(part[-1][2])
        if part:
            yield part


def _packed(kind: str, idf: np.ndarray, mean: float, cfg: Packing):
    def shards(batches):
        held, now = [], None
        for batch in batches:
            ids, offs = _unpacked(batch.column(3), kind)
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for k, (doc, start, total, shard) in enumerate(zip(*columns, strict=True)):
                if held and shard != now:
                    yield held
                    held = []
                held.append([doc, start, ids[offs[k]: offs[k + 1]].copy(), total])
                now = shard
        if held:
            yield held

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        rest: list = []

        def rows(window):
            nonlocal made
            at, out = 0, []
            for doc, start, ids, total in window:
                out.append((doc, start, len(ids), _crc(ids), total, ((task << 31) + made) * 2 + 1, at))
                at += len(ids)
            made += 1
            return out

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

        for held in shards(batches):
            shard = Shard(rest + held, idf, mean, cfg)
            out = [r for w in windows(shard, cfg, last=False) for r in rows(w)]
            rest = [p for p, unused in zip(shard.pieces, shard.unused, strict=True) if unused]
            if out:
                yield table(out)
        out = [r for w in windows(Shard(rest, idf, mean, cfg), cfg, last=True) for part in powers_of_two(w) for r in rows(part)]
        if out:
            yield table(out)

    return run


def pieces(docs: DataFrame, cfg: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, kind = _tokenised(cfg)
    cut = materialize(two.mapInArrow(run, _TYPES + ", rest binary"), "tokens")
    left = cut.where("rest IS NOT NULL").select("doc_id", "start", "doc_tokens", "rest")
    size = vocabulary_size(cfg)
    bodies = left.select("rest")
    df = np.zeros(size)
    for r in bodies.mapInArrow(_counted(kind, size), "term long, df long").groupBy("term").agg(F.sum("df").alias("n")).collect():
        df[r.term] = r.n  # as many rows as the vocabulary at most
    whole = bodies.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rest")).alias("bytes")).first()
    mean = (whole.bytes or 0) / np.dtype(kind).itemsize / max(whole.n, 1)
    idf = np.maximum(np.log((whole.n - df + 0.5) / (df + 0.5)), 0.0)
    tokens = np.zeros(size, np.int64)
    heads = bodies.mapInArrow(_leading(kind, idf), "term long, tokens long").groupBy("term").agg(F.sum("tokens").alias("n"))
    for r in heads.collect():  # likewise
        tokens[r.term] = r.n
    first, parts = layout(tokens, cfg.shard_tokens)
    shards = int((first + parts).max())
    dealt = left.mapInArrow(
        _dealt(kind, idf, first, parts), "doc_id long, start long, doc_tokens long, rest binary, shard long, chance long"
    )
    n = max(1, min(shards, wide_partitions(spark)))
    sorted_shards = dealt.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "chance", "start")
    packed = sorted_shards.mapInArrow(_packed(kind, idf, mean, cfg), _TYPES)
    return cut.where("rest IS NULL").drop("rest").unionByName(packed)
