"""Spelling variants, whitening and packing against brute force; their edge cases."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from dipscan.llm import packing, registry, spelling, whitening
from dipscan.llm.common import table

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, shard string")


# spelling


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                count[w] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    holes, near, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def found(rows):
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@needs_tables
def test_variants_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert found(registry.queries()["op11_spelling"](spark, FOLDER).collect()) == brute_variants(rows)


@pytest.mark.parametrize("cfg", [spelling.Variants(), spelling.Variants(block_points=40, chunk_points=500, frontier=20)])
def test_variants_in_crowded_blocks(spark, cfg):
    """Families around one stem, repeated letters, accents, a word of 3 000 letters; blocks cut again and again."""
    rng = np.random.default_rng(3)
    stems = ["internationals", "aaaaaaaaa", "abababab", "Éléphant", "façade", "straße", "z" * 3000]
    words = []
    for stem in stems:
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.integers(0, 3)):
                at, kind = rng.integers(0, len(w)), rng.integers(0, 3)
                w[at: at + int(kind != 0)] = [] if kind == 1 else [str(rng.choice(list("abéz")))]
            words += ["".join(w)] * int(rng.integers(3, 9))
    rows = [(i, " ".join(words[i::7])) for i in range(7)] + [(None, "façade façade façades façades façades"), (9, None), (10, ""), (10, "1 2 3")]
    assert found(spelling.variants(docs(spark, rows), cfg).collect()) == brute_variants(rows)


def test_no_variants(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, "once only"), (2, None)])).collect() == []


# whitening


def test_projectors_find_eigenvectors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 31, 64):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        for values in (rng.normal(size=n), np.r_[np.ones(n // 2) * 7, np.zeros(n - n // 2)], np.ones(n) * 3, 10.0 ** np.linspace(4, -12, n)):
            a = q * values @ q.T
            a = (a + a.T) / 2
            e, x = whitening.divide(a)
            scale = max(np.abs(values).max(), 1e-300)
            assert np.abs(e - np.sort(values)[::-1]).max() <= 1e-13 * scale
            assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13 and np.abs(a @ x - x * e).max() <= 1e-13 * scale
            u = whitening.qdwh(a - values.mean() * 1.01 * np.eye(n))
            assert np.abs(u @ u - np.eye(n)).max() < 1e-12


def brute_whitening(vectors, components=4):
    """{vec_id: rows}, by numpy's own eigenvectors."""
    x = {i: np.floor(np.array(v, float) * 256).astype(np.int64) for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return {
        i: [(n, int(((n * v - s) ** 2).sum()), (v - s / n) @ u[:, k] / np.sqrt(e[k]), e[k] / e.sum()) for k in range(components)]
        for i, v in x.items()
    }


@needs_tables
def test_whitening_of_the_tables(spark):
    want = brute_whitening({r.vec_id: r.embedding for r in table(spark, FOLDER, "embeddings").collect()})
    rows = registry.queries()["op12_qdwh"](spark, FOLDER).collect()
    sign = {}
    assert len(rows) == 4 * len(want)
    for r in rows:
        n, deviation, z, share = want[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(share, rel=1e-9)
        assert r.whitened * sign.setdefault(r.component, np.sign(r.whitened * z)) == pytest.approx(z, abs=1e-8)
        assert 0 <= r.identity_error < 1e-8


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, x string"
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.5]), (None, [0.5, -1.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.0, -3.25]),
    ]
    out = whitening.whitened(spark.createDataFrame([(*r, 0, "y") for r in rows], kind)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted((i, c) for i in (0, 1, 1, 2, 10) for c in (1, 2))
    assert {r.n for r in out} == {4}
    assert whitening.whitened(spark.createDataFrame([], kind)).collect() == []
    # without variance along a component it has no whitened value; one vector has none at all
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0], 0, "y") for i in range(5)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat} == {0.0, 1.0}
    one = whitening.whitened(spark.createDataFrame([(3, [1.0, 5.0], 0, "y")], kind)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2
    # deviations beyond 64 bits
    far = whitening.whitened(spark.createDataFrame([(1, [3e16], 0, "y"), (2, [1.0], 0, "y"), (3, [2.0], 0, "y")], kind)).collect()
    assert all(r.deviation is None for r in far)


# packing


@pytest.fixture(scope="module")
def cfg():
    return packing.public()


def test_fast_ids_are_the_tokenizers(cfg):
    exact, fast, names = packing._encoders(cfg.tokenizer, cfg.ranks, cfg.pattern)
    for c in map(chr, range(1, 0x250)):
        for t in (c, f"a{c}b", c * 2, f"1{c}", f" {c}!", f"x {c}{c}  y", f"{c}'s{c}", f"\n{c} ", f"9{c}9 .{c}"):
            assert exact.encode(t, add_special_tokens=False).ids == fast.encode_ordinary(t)
    for t in (f"a{names[0]}b", "中文 字　符", "\U0001f600 x", "", None):
        assert packing.token_ids(t, cfg).tolist() == [*exact.encode(t or "", add_special_tokens=False).ids, 0]


def checked(rows, texts, cfg):
    """Every id in one piece, gapless sequences, no padding; returns the sequences."""
    exact = packing._encoders(cfg.tokenizer, cfg.ranks, cfg.pattern)[0]
    sequences, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        spans[r.doc_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*exact.encode(t or "", add_special_tokens=False).ids, 0])
    assert set(want) == set(spans)
    for i, all_ids in want.items():
        assert sum(r.length for r in spans[i]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at, ids = 0, all_ids[0]
            for r in sorted(spans[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start: at], "<u4").tobytes())
    return sequences


@needs_tables
def test_packing_of_the_tables(spark, cfg):
    texts = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    checked(registry.queries()["op13_retrieval_packing"](spark, FOLDER).collect(), texts, cfg)


def test_packing_edges(spark, cfg):
    rows = [
        (1, ""), (2, None), (None, "one two"), (3, "again and again"), (3, "again and again"), (4, "word " * 30_000),
        (5, "b" * 9_000), (6, "word " * 1023), (7, "word " * 1022), (8, "<|endoftext|> 中文"),
    ]
    checked(packing.pieces(docs(spark, rows), cfg).collect(), rows, cfg)
    assert packing.pieces(docs(spark, []), cfg).collect() == []


def test_neighbours_are_alike(spark, cfg):
    """Texts of three subjects in random order: sequences hold one subject each, but for the last ones."""
    rng = np.random.default_rng(5)
    exact = packing._encoders(cfg.tokenizer, cfg.ranks, cfg.pattern)[0]
    names = [w for w in exact.get_vocab() if w.isascii() and w.isalpha() and len(w) > 4][:900]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rng.choice(names[300 * (i % 3): 300 * (i % 3) + 300], 120))))
    for shard_tokens in (1 << 19, 4000):
        small = packing.public(shard_tokens=shard_tokens)
        sequences = checked(packing.pieces(docs(spark, rows).coalesce(1), small).collect(), rows, cfg)
        whole = [x for x in sequences.values() if sum(r.length for r in x) == 1024]
        pure = sum(len({r.doc_id % 3 for r in x}) == 1 for x in whole)
        assert pure >= (0.8 if shard_tokens > 4000 else 0.5) * len(whole)


def test_scores_against_brute_force(cfg):
    rng = np.random.default_rng(6)
    held = [[i, 0, rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint32), 1] for i in range(50)]
    n, lengths = 50, np.array([len(p[2]) for p in held])
    df = np.array([sum(t in p[2] for p in held) for t in range(40)])
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
    shard = packing.Shard(held, idf, lengths.mean(), cfg)
    shard.unused[[3, 7]] = False
    for seed in range(50):
        want = {}
        for i in range(50):
            total = 0.0
            for t in set(held[seed][2].tolist()):
                tf = int((held[i][2] == t).sum())
                total += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / lengths.mean()))
            if total > 0 and i not in (3, 7):
                want[i] = total
        got = shard.neighbours(seed)
        assert set(got.tolist()) == set(want)
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got[:-1], got[1:]))


def test_layout_bounds_shards():
    tokens = np.array([10, 0, 5_000, 40, 700, 30, 0, 90])
    first, parts = packing.layout(tokens, 100)
    assert parts.tolist() == [1, 1, 50, 1, 7, 1, 1, 1]
    used = [s for f, p, t in zip(first, parts, tokens, strict=True) if t for s in range(f, f + p)]
    heavy = [s for f, p in zip(first, parts, strict=True) if p > 1 for s in range(f, f + p)]
    assert len(set(heavy)) == len(heavy) and not set(heavy) & {int(f) for f, p in zip(first, parts, strict=True) if p == 1}
    assert max(used) + 1 == 57 + len({int(f) for f, p in zip(first, parts, strict=True) if p == 1})
