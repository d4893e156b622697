"""Results against brute force, SQL, or held-out truth."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from dipscan.llm import decontaminate, itq, line_dedup, lm, minhash, mixing, quality, registry, rindex, text, toxicity
from dipscan.llm.common import components, table
from dipscan.llm.line_dedup import rising

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}


def run(spark, name, folder=FOLDER):
    return registry.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    theirs = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    mine = sorted((tuple(r[c] for c in columns) for r in run(spark, name)), key=repr)
    assert mine == sorted(theirs.fetchall(), key=repr)


def anchors_of(lines):
    """{line: its anchor's last line} of a document's lines."""
    out = {}
    for p, line in enumerate(lines):
        if not WORD.search(line):
            continue
        words = size = 0
        for e in range(p, len(lines)):
            words, size = words + len(WORD.findall(lines[e])), size + len(lines[e].encode())
            if words >= 5 or size >= 40:
                out[p] = e
                break
    return out


def brute_lines(texts):
    """{doc: lines to delete}, pair by pair."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    ends = {i: anchors_of(x) for i, x in lines.items()}
    keyed, holders, rows = {}, {}, {}
    for i in sorted(lines):
        seen = Counter()
        for p, e in ends[i].items():
            anchor = "\n".join(lines[i][p: e + 1])
            keyed[i, p] = anchor, seen[anchor]
            seen[anchor] += 1
            holders.setdefault(keyed[i, p], []).append(i)
        order = list(ends[i])
        for a, b in zip(order[:-1], order[1:]):
            rows.setdefault((keyed[i, a][0], keyed[i, b][0]), []).append(i)
    where = {i: {keyed[i, p]: p for p in ends[i]} for i in lines}
    out = {}
    for i in lines:
        pairs, partners, gone = {}, set(), set()
        order = list(ends[i])
        for n, p in enumerate(order):
            group = holders[keyed[i, p]]
            if group[0] < i:
                pairs.setdefault((0, group[0]), []).append((p, where[group[0]][keyed[i, p]]))
            if len(group) <= 4:
                partners |= {j for j in group[1:] if j < i}
            # a pair of anchors counts where its first one is shared at all
            if n + 1 < len(order) and len(group) > 1:
                two = [j for j in rows[keyed[i, p][0], keyed[i, order[n + 1]][0]] if any(
                    len(holders[keyed[j, q]]) > 1 for q in ends[j] if keyed[j, q][0] == keyed[i, p][0])]
                if two[0] < i and two[0] != group[0]:
                    partners.add(two[0])
        for j in partners:
            pairs[1, j] = [(p, where[j][keyed[i, p]]) for p in order if keyed[i, p] in where[j]]
        matches = {}
        for (_, j), met in pairs.items():
            matches.setdefault(j, set()).update(met)
        for j, met in matches.items():
            met = sorted(met)
            for x in rising([q for _, q in met]):
                p, q = met[x]
                gone |= set(range(p, ends[i][p] + 1))
                for step in (1, -1):
                    p, q = met[x]
                    while True:
                        p, q = p + step, q + step
                        inside = 0 <= p < len(lines[i]) and 0 <= q < len(lines[j])
                        if not inside or lines[i][p] != lines[j][q] or p in ends[i] or q in ends[j]:
                            break
                        gone.add(p)
        out[i] = gone
    return out


@pytest.mark.parametrize("folder", [FOLDER, LARGER])
def test_line_alignment(spark, folder):
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    want = brute_lines(texts)
    for r in run(spark, "op2_line_alignment", folder):
        mine = texts[r.doc_id].split("\n")
        assert (r.doc_id, r.n_lines, r.n_removed) == (r.doc_id, len(mine), len(want[r.doc_id]))
        assert r.text == "\n".join(x for p, x in enumerate(mine) if p not in want[r.doc_id])


def test_no_copy_is_left(spark):
    """Copies whose lines the first holder has in another order, or once only; of short lines; without spaces."""
    four = [f"this is line number {w} of the four" for w in ("one", "two", "three", "four")]
    twice = ["a line that comes twice in here", "some other line in between them", "a line that comes twice in here"]
    short = [f"item {i}" for i in range(200)]
    script = ["".join(chr(0x4E00 + (7 * i + 3 * j) % 900) for j in range(9)) for i in range(50)]
    cases = [
        [four[::-1], four, four], [["a line that comes twice in here"], twice, twice], [short, short], [script, script],
        [four[::-1], four[:2] + ["x y"] + four[2:], four[:2] + ["x y"] + four[2:]],
    ]
    for case in cases:
        docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(case)], "doc_id long, text string")
        rows = {r.doc_id: r for r in line_dedup.report(docs).collect()}
        assert rows[0].n_removed == 0
        assert rows[len(case) - 1].n_removed == len(case[-1])
        assert {i: r.n_removed for i, r in rows.items()} == {i: len(x) for i, x in brute_lines({i: "\n".join(x) for i, x in enumerate(case)}).items()}


def brute_windows(rows):
    first, out = {}, {}
    for i in sorted(rows):
        raw = rows[i].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p: p + 50], i) < i:
                gone[p: p + 50] = b"\1" * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_run_index(spark, texts):
    want = brute_windows(texts)
    for r in run(spark, "op4_run_index"):
        assert want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_run_index_on_periodic_and_overlapping_texts(spark):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("ab "), 900))
    rows = {i: base[a:b] + "x" * (i * 7) + base[c: c + 60] for i, (a, b, c) in enumerate(rng.integers(0, 800, (60, 3)))}
    rows |= {100: "a" * 400, 101: "a" * 49, 102: "a" * 50, 103: "ab" * 200, 104: "é" * 90, 105: "é" * 90 + "a" * 60}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_windows(rows)
    for cfg in (rindex.Index(), rindex.Index(bucket_bytes=2000, flush_bytes=3000)):
        for r in rindex.deduplicated(df, cfg).collect():
            assert want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_language_model(spark, texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall(t.translate(fold)), "\0end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    rows = run(spark, "op7_log_bilinear")
    for r in rows:
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), n)
        assert r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id]))
    held_rows = [r for r in run(spark, "op7_log_bilinear", LARGER) if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_language_model_is_normalised():
    rng = np.random.default_rng(2)
    cfg = lm.Bilinear(batch=64)
    net = lm.Net(np.arange(8.0, 1, -1), cfg)
    w, one, two = rng.integers(0, 7, 300), rng.integers(0, 8, 300), rng.integers(0, 8, 300)
    for at in range(0, 300, 64):
        net.learn(w[at: at + 64], one[at: at + 64], two[at: at + 64], rng)
    items, before, earlier = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(8), np.arange(8), indexing="ij"))
    total = np.exp(net.log_prob(items, before, earlier)).reshape(7, -1).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-5)


def test_language_model_learns_what_follows(spark):
    # each word is followed by one of two: a context tells nearly all that counts alone don't
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(60)])
    rows = []
    for i in range(1500):
        at, out = int(rng.integers(60)), []
        for _ in range(200):
            out.append(words[at])
            at = (7 * at + 3 + int(rng.integers(2))) % 60
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in lm.scored(df, lm.Bilinear(vocabulary=8.0, share=1.0)).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.base_score for r in held) / tokens < -1.7
    assert sum(r.score for r in held) / tokens > -1.0


def test_average_weighs_by_meetings():
    values = [np.full((lm.BLOCK, 3), x, np.float32) for x in (1, 4)]
    met = [np.r_[3, 0, np.zeros(lm.BLOCK - 2)].astype(np.float32), np.r_[1, 2, np.zeros(lm.BLOCK - 2)].astype(np.float32)]
    group = lm.pd.DataFrame({
        "part": [1, 0], "block": [5, 5], "met": [m.tobytes() for m in met], "rows": [v.tobytes() for v in values],
    })
    mean = np.frombuffer(lm._average(group)["rows"][0], np.float32).reshape(lm.BLOCK, 3)
    assert np.allclose(mean[0], 1.75) and np.allclose(mean[1], 4) and np.isnan(mean[2:]).all()


def test_vectors_near_and_far(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    near = np.repeat(centres, 12, axis=0) + rng.normal(size=(480, 32)) * np.repeat(rng.uniform(0.02, 0.25, 40), 12)[:, None]
    x = np.concatenate([near, near[:30], rng.normal(size=(100, 32))]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(true, False)
    for cfg in (itq.Itq(), itq.Itq(block=5)):
        got = {r.vec_id: r for r in itq.linked(df, cfg).collect()}
        counts = np.array([got[i].n_links for i in range(len(x))])
        assert (counts <= true.sum(axis=1)).all() and counts.sum() >= 0.97 * true.sum()
        for i, r in got.items():
            assert r.kept == (r.component_id == i) and r.component_id <= i


def test_mix_meets_targets(spark):
    rows = run(spark, "op3_entropy_mix", LARGER)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op3_entropy_mix", LARGER)))
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    total, weight = sum(size.values()), {s: 1 + k % 3 for k, s in enumerate(sorted(size))}
    assert sum(target.values()) == pytest.approx(total)
    for s in size:
        assert target[s] <= 3 * size[s] * (1 + 1e-12)
        assert taken[s] == pytest.approx(target[s], rel=0.03)
    open_ = [target[s] / weight[s] for s in size if target[s] < 3 * size[s] * (1 - 1e-9)]
    assert max(open_) == pytest.approx(min(open_))


def test_targets_stop_at_three_times_the_source(spark):
    hist = spark.createDataFrame([("a", 10, 1), ("b", 100, 10), (None, 5, 2), ("z", 0, 4)], "_key string, size long, n long")
    got = {r._key: r._target for r in mixing.targets(hist).collect()}
    # weights a 1, b 2, z 3, null 1; z has nothing to take, null at most 30, a at most 30
    assert got == pytest.approx({"a": 30.0, "b": 960.0, "z": 0.0, None: 30.0})


def test_reparameterised_questions(spark):
    item = "A train leaves Paris at 9 and covers 120 km in 2 hours before it meets the train that Anna took to Lyon"
    same = item.replace("Paris", "Berlin").replace("120", "75").replace("Anna", "Otto").replace(" 2 ", " 3 ")
    mixed = item.replace("120 km in 2 hours", "2 km in 2 hours")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    other = "A train leaves nothing to wish for and the people of this town have always liked it that way"
    docs = spark.createDataFrame(
        [(1, "Before. " + same + ". After it all."), (2, item), (3, other), (4, mixed)], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert set(got) >= {1, 2} and 3 not in got
    assert got[2].same_values and not got[1].same_values and got[1].n_slots >= 3
    twice = item.replace("9", "2")  # one value of the item, two of the document
    clash = twice.replace("at 2", "at 5")
    assert decontaminate.report(
        spark.createDataFrame([(1, clash)], "doc_id long, text string"),
        spark.createDataFrame([(7, twice)], "item_id long, text string"),
    ).collect() == []


def test_scattered_agreement_is_no_run(spark):
    words = [f"word{i}" for i in range(100)]
    scattered = [w if i < 6 or i % 8 == 0 else f"other{i}" for i, w in enumerate(words)]
    in_a_row = [w if i < 13 else f"other{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(scattered)), (2, " ".join(in_a_row))], "doc_id long, text string")
    got = decontaminate.report(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {2}


def test_contamination_by_values_halves_and_short_items(spark):
    series = "3 8 15 24 35 48 63 80 99 120 143 168"
    other = "4 9 16 25 36 49 64 81 100 121 144 169"
    half = "a farmer sells 5 apples to his neighbor and keeps the others for himself"
    rest = "then he buys 5 pears at once from the old market in town"
    bench = spark.createDataFrame(
        [(1, series), (2, f"{half} {rest}"), (3, "what is 5 plus 7"), (4, "Paris 1900")], "item_id long, text string"
    )
    docs = spark.createDataFrame([
        (1, f"table of numbers {series} and so on"), (2, f"table of numbers {other} and so on"),
        (3, f"{half.replace('5', '6')} nobody ever saw 7 of these again"), (4, "tell me what is 31 plus 12 please"),
        (5, "born in Paris 1900 as a child"), (6, "born in Paris 1901 as a child"),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 4)}


def ranks(truth, score):
    order = np.argsort(np.argsort(score))
    n = truth.sum()
    return (order[truth == 1].sum() - n * (n - 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize("name,column", [("op5_ftrl", "toxic"), ("op6_byte_cnn", "quality")])
def test_classifiers_on_held_out_rows(spark, name, column):
    truth = {r.doc_id: r[column] for r in table(spark, LARGER, "labels").collect()}
    modulus, held = (4, 2) if column == "toxic" else (5, 0)
    rows = [r for r in run(spark, name, LARGER)]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    rows = [r for r in rows if r.held_out and r.doc_id in truth]
    y, s = np.array([truth[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert ranks(y, s) > 0.8


def test_classifiers_see_the_end_of_a_long_text(spark):
    cfg = quality.Net()
    long = np.frombuffer(b"the quiet words of this page " * 80_000, np.uint8)
    rows, coffs = quality.chunks(long, np.array([0, len(long)]), cfg)
    assert len(rows) == -(-len(long) // cfg.chunk) and (rows[-1][: len(long) % cfg.chunk or cfg.chunk] > 0).all()
    parts = toxicity.features(long, np.array([0, len(long)]), toxicity.Ftrl())
    assert len(parts[0][0]) == 80_000 * 6


def test_near_duplicates_of_a_family(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for p in rng.choice(200, rng.integers(0, 12), replace=False):
            words[p] = f"x{i}_{p}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k: k + 5]) for k in range(196)} for _, t in rows]
    parent = list(range(120))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root(i) for i in range(120)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component_id for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_words_are_runs_of_other_bytes():
    import pyarrow as pa

    said = ["", None, " a\tb\x0bc ", "é x", "one"]
    buf, offs = text.flat(pa.array(said))
    starts, ends, woffs = text.words(buf, offs)
    got = [[bytes(buf[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(woffs[:-1], woffs[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in said]


def test_minhash_tells_texts_of_one_id_apart(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    b = "red orange yellow green blue indigo violet black white grey brown pink gold silver bronze copper iron steel tin lead"
    rows = [
        (1, a, "x"), (3, a + " more", "x"), (3, b, "x"), (3, b, "x"), (4, a, "x"), (5, b + " zinc", "y"), (None, a, "x"), (None, a, "x"),
        (6, "", "x"), (6, "", "x"), (7, None, "z"), (2, "other words entirely here " + b[::-1], "w"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got[(3, 17, 1, False)] == 1 and got[(3, 16, 3, True)] == 2  # text b is a group of its own
    assert got[(1, 16, 1, True)] == 1 and got[(4, 16, 1, False)] == 1 and got[(5, 17, 3, False)] == 1
    assert got[(None, 16, None, True)] == 2 and got[(6, 0, 6, True)] == 2
    stay = sorted((r.doc_id or 0, r.text or "") for r in minhash.deduplicated(docs).collect())
    assert stay == sorted([(0, a), (0, a), (1, a), (2, rows[-1][1]), (3, b), (6, ""), (7, "")])


def test_language_model_fits_every_token(monkeypatch):
    """Unless asked for fewer, training meets each token of each text once."""
    cfg, met = lm.Bilinear(batch=64), []
    words = np.unique(np.r_[lm.X.word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2])).view(np.int64), lm.END])
    net = lm.Net(np.arange(4.0, 0, -1), cfg)
    shared = type("Shared", (), {"value": {
        "unigram": np.arange(4.0, 0, -1), "table": net.table, "gain": net.gain, "round": 0,
        "vocab": words, "place": np.arange(3), "other": 3,
    }})
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(lm.Net, "learn", lambda self, w, one, two, rng: met.extend(w.tolist()))
    texts = lm.pa.RecordBatch.from_arrays([lm.pa.array(["a b c " * 100, "a", None])], ["text"])
    list(lm._train(shared, cfg)([texts]))
    counts = dict(zip(*np.unique(met, return_counts=True), strict=True))
    place = {int(h): i for i, h in enumerate(words)}
    assert len(met) == 301 + 2 + 1 and counts[3] == 100 and counts[place[int(lm.END)]] == 3
