"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

import corpus_pipeline
from dipscan.llm import decontaminate, itq, licenses, line_dedup, lm, minhash, mixing, quality, rindex, toxicity

LONG = "the long words go on and on without an end in sight\n" * 40_000
SAID = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (1, "", "en", "a", 0), (2, None, "en", "b", None), (None, SAID, None, None, None), (None, None, None, None, None),
    (3, SAID, "en", "a", 1), (3, SAID, "en", "a", 1), (4, SAID + " more", "en", None, 2), (5, LONG, "de", "b", 3),
    (6, "short", None, "a", 5), (7, " \t\n ", "en", "", 4), (8, "Licensed under CC BY-NC 4.0.", "en", "a", 9),
    (9, SAID + "\n\n" + SAID.upper(), "en", "b", 9), (3, "another text under the same id", "en", "a", 1),
]
CLASH = ["size", "rate", "target", "copy", "row", "node", "bucket", "h", "label", "score", "version", "_gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
SMALL = quality.Net(steps=5, per_class=5)


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


def labels(spark, rows=((4, 1, 1), (6, 0, 0), (8, 1, 0), (9, 0, 1), (99, 1, 1), (None, 1, 1), (1, None, None))):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, SAID), (1, None), (None, "too short"), (2, ""))):
    return spark.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "line": lambda s, d: line_dedup.report(d),
    "mix": lambda s, d: mixing.plan(d),
    "index": lambda s, d: rindex.deduplicated(d),
    "toxic": lambda s, d: toxicity.scored(d, labels(s)),
    "quality": lambda s, d: quality.scored(d, labels(s), SMALL),
    "lm": lambda s, d: lm.scored(d, lm.Bilinear(vocabulary=2.0, frequent=20)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(spark, name):
    out = PER_ROW[name](spark, docs(spark)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, docs(spark, [])).collect() == []


def test_scores_are_probabilities(spark):
    for out in (toxicity.scored(docs(spark), labels(spark)), quality.scored(docs(spark), labels(spark), SMALL)):
        for r in out.collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None


def test_without_labels_scores_are_defined(spark):
    none = labels(spark, [])
    for out in (toxicity.scored(docs(spark), none), quality.scored(docs(spark), none, SMALL)):
        assert {round(r.score, 6) for r in out.collect()} == {0.5}


def test_matches_and_notices(spark):
    hits = {(r.doc_id, r.item_id) for r in decontaminate.report(docs(spark), bench(spark)).collect()}
    assert hits == {(None, 1), (3, 1), (4, 1), (9, 1)}
    assert decontaminate.report(docs(spark, []), bench(spark)).collect() == []
    assert decontaminate.report(docs(spark), bench(spark, [])).collect() == []
    found = [(r.doc_id, r.license) for r in licenses.licenses(docs(spark)).collect()]
    assert found == [(8, "CC-BY-NC-4.0")]
    assert licenses.licenses(docs(spark, [])).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], None), (5, None, 0), (6, [], 0),
        (7, [0.0, 0.0], 0), (8, [inf, 1.0], 0), (9, [nan, 1.0], 0), (10, [None, 1.0], 0), (None, [1.0, 2.0], 0),
        (11, [1.0, 2.0], 0), (12, [1.0, 2.0, 3.0], 0), (13, [2.0, -1.0], 0),
    ]
    out = itq.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows)
    assert {k: got[k] for k in (1, 2, 11)} == {1: (2, 1), 2: (2, 1), 11: (2, 1)}
    assert all(got[k] == (0, k) for k in got if k not in (1, 2, 11))
    assert itq.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_stages_keep_columns(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        now = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES[1:]:
            following = stage(spark, now, str(tmp_path))
            if name != "mixing sources":
                assert following.columns == now.columns
            assert following.count() <= (3 if name == "mixing sources" else 1) * now.count()
            now = following
