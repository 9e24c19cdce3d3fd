"""Recall of the vector search against brute force, at the registered setting."""

import numpy as np
import pytest

from haze.llm import near_dedup, vector_search


def clustered(rng):
    centers = rng.standard_normal((25, 32))
    return (centers[:, None] + 0.25 * rng.standard_normal((25, 80, 32))).reshape(-1, 32)


TABLES = {
    "isotropic": lambda rng: rng.standard_normal((2000, 32)),
    "clustered": clustered,
    "norm-skewed": lambda rng: rng.standard_normal((2000, 32)) * rng.lognormal(0, 1, (2000, 1)),
    "one direction": lambda rng: np.ones(24) + 0.1 * rng.standard_normal((1500, 24)),
}


@pytest.mark.parametrize("name", TABLES)
def test_recall_at_the_registered_setting(spark, name):
    x = TABLES[name](np.random.default_rng(12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.nearest(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], [score[m[1]] for m in mine], rtol=1e-12)
        hit += len(set(best.tolist()) & {m[1] for m in mine})
    assert hit / (20 * len(got)) >= 0.9, hit / (20 * len(got))


def test_odd_lengths_and_short_lists(spark):
    """The most frequent length counts; a query whose lists hold too little sees the others too."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0]), (1, [3.0])] + [(i, rng.standard_normal(8).tolist()) for i in range(20, 220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, "vec_id % 20 = 0", k=195, probes=0.3)
    assert {(r.query_id, r["count"]) for r in got.groupBy("query_id").count().collect()} == {(q, 195) for q in range(20, 220, 20)}


def test_near_duplicates_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b"), (3, "other", 7, "c")], "doc_id long, text string, `__gone` int, `__row` string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_stages_delete_what_earlier_ones_left(spark):
    import os

    from haze.llm.common import bucketed, materialize, scratch_dir, stage
    docs = spark.range(10)
    outside = materialize(docs)
    with stage(docs):
        first = materialize(docs)
        table = bucketed(docs, "id", 2)
    name = table.inputFiles()[0].split("file:")[1].lstrip("/").rsplit("/", 1)[0]
    written = materialize(first)     # what the stage kept, as a table of its own
    folder = lambda df: "/" + df.inputFiles()[0].split("file:")[1].lstrip("/").rsplit("/", 1)[0]
    one, two = folder(first), "/" + name
    assert os.path.isdir(one) and os.path.isdir(two)
    with stage(written):
        second = materialize(written)
    assert not os.path.exists(one) and not os.path.exists(two)
    assert outside.count() == written.count() == second.count() == 10
    with stage(second):              # still read: its folder stays
        pass
    assert second.count() == 10 and scratch_dir(spark) != scratch_dir(spark)
