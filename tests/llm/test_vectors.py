"""Nearest neighbours: doubles, repeated rows, and how many rows a query visits as the table grows."""

import numpy as np

from framelake.llm import ann


def ranked(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_doubles_are_not_rounded(spark):
    near = [(i, [1.0 + (40 - i) * 1e-9, 0.5, 0.5]) for i in range(40)]
    rows = [*near, (60, [1e200, 0.0, 0.0])]
    got = ranked(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0))
    of = {i: np.array(v) for i, v in rows}
    for q in (0, 20):
        want = sorted((-float(np.multiply(of[q], of[i]).sum()), i) for i in of if i != q)[:20]
        assert [(-s, v) for qid, _, v, s in got if qid == q] == want
    assert len({s for q, _, _, s in got if q == 0}) == 20 and len(got) == 60


def test_repeated_rows_are_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.75])]
    got = ranked(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), recall=1.0))
    assert len(got) == 3 * 5 and sorted({r for _, r, _, _ in got}) == [1, 2, 3, 4, 5]
    # By hand: a row's own twin comes first with 1.0, then both of id 1, then id 2, then the other direction.
    twins = [(1, 20, 1.0), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.25), (5, 20, 0.0)]
    other = [(1, 2, 0.75), (2, 1, 0.5), (3, 1, 0.5), (4, 20, 0.0), (5, 20, 0.0)]
    assert sorted((r, v, s) for _, r, v, s in got) == sorted(twins * 2 + other)


def visited(vectors, leaf):
    tree = ann.KMeansTree(vectors, leaf)
    visits = ann.calibrate(tree, vectors)
    rows_in = np.bincount(tree.file(vectors), minlength=len(tree.leaf_of))
    return np.mean([sum(rows_in[x] for x in tree.visits(q, visits, rows_in, 21)) / len(vectors) for q in vectors[::200]])


def test_share_of_rows_visited_falls_on_clustered_vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    share = [visited(centres[rng.integers(0, 400, n)] + rng.normal(size=(n, 16)) * 0.05, 200) for n in (2_000, 20_000)]
    assert share[1] < 0.5 * share[0]


def test_recall_on_clusters_at_two_sizes(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    for n in (1_000, 6_000):
        vectors = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.1
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
        got = ann.nearest(table, fit_rows=2_000, leaf=100).toPandas()
        found = []
        for q, rows in got.groupby("query_id"):
            order = np.lexsort((np.arange(n), -(vectors @ vectors[q])))
            found.append(len(set(rows.vec_id) & set([i for i in order if i != q][:20])) / 20)
        assert len(found) == n // 20 and np.mean(found) >= 0.9
