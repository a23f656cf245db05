"""Embedding near-duplicates against brute force."""

import numpy as np
from pyspark.sql import functions as F

from inkproof.llm import multi_index as M
from inkproof.llm.queries import op6_multi_index
from tests.llm.test_minhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(matrix, least=0.95):
    return M.unit(matrix.astype(np.float64)) @ M.unit(matrix.astype(np.float64)).T >= least


def test_recall(spark):
    """Given vectors, and partners of each at similarities from the threshold up."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    given = M.unit(np.array([r.embedding for r in rows]))
    rng = np.random.default_rng(5)
    noise = rng.standard_normal(given.shape)
    noise = M.unit(noise - (noise * given).sum(1)[:, None] * given)
    near = rng.uniform(0.95, 1, (len(given), 1))
    matrix = np.concatenate([given, near * given + np.sqrt(1 - near**2) * noise]).astype(np.float32)
    linked = brute(matrix)
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(matrix)], "vec_id long, embedding array<float>")
    many = {r.vec_id: r.n_links for r in M.near_duplicates(frame).collect()}
    assert sum(many.values()) >= 0.95 * linked.sum() > 0
    assert all(many[n] <= linked[n].sum() for n in many)


def test_query(spark):
    rows = op6_multi_index(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        linked = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        nodes = [("r", i) for i in range(linked.shape[0])] + [("c", j) for j in range(linked.shape[1])]
        ways = [(("c", int(j)), ("r", int(i))) for i, j in zip(*np.nonzero(linked))]
        forest = M.spanning_forest(linked)
        assert all(linked[i, j] for i, j in forest) and len(forest) < len(nodes)
        assert roots(nodes, ways) == roots(nodes, [(("c", j), ("r", i)) for i, j in forest])


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(2)
    index = M.Index(rng.random((9, 4)), rng.random((7, 4)), 5)
    vectors = rng.random((50, 8))
    one, two = M._distances(vectors[:, :4], index.first), M._distances(vectors[:, 4:], index.second)
    grid = (one[:, :, None] + two[:, None, :]).reshape(50, -1)
    assert (M.traverse(index, vectors, 20) == grid.argsort(1)[:, :20]).all()


def test_groups_nulls_and_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(n, base[n % 40] + 0.02 * rng.standard_normal(16)) for n in range(400)]
    rows = [(n, v.tolist(), 1) for n, v in rows]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 3, 1), (905, [float("inf")] * 16, 1), (None, rows[0][1], 1), (906, [], 1)]
    frame = spark.createDataFrame(rows + odd + rows[:2], SCHEMA).withColumn("cell", F.lit(1))
    matrix = np.array([r[1] for r in rows], np.float32)
    linked = brute(matrix)
    want = roots(range(400), [(int(i), int(j)) for i, j in zip(*np.nonzero(linked)) if i != j])
    for block in (2048, 5):
        got = M.near_duplicates(frame, block=block, codes=4).collect()
        assert len(got) == len(rows) + len(odd) + 2
        for r in got:
            if r.vec_id is not None and r.vec_id < 400:
                assert (r.n_links, r.component_id, r.kept) == (linked[r.vec_id].sum() - 1, want[r.vec_id], want[r.vec_id] == r.vec_id)
            else:
                assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert M.near_duplicates(frame.limit(0)).collect() == []
    assert M.near_duplicates(frame.where("vec_id >= 900 and vec_id <> 904")).where("n_links > 0").count() == 0


def test_every_length_has_an_index(spark):
    rng = np.random.default_rng(6)
    rows = [(n, rng.standard_normal(4).tolist()) for n in range(60)]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (102, [2.0, 4.0, 6.1]), (103, [3.0]), (104, [5.0]), (105, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[n] for n in range(100, 106)] == [(2, 100), (2, 100), (2, 100), (1, 103), (1, 103), (0, 105)]


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(7)
    some = rng.standard_normal((50, 8))
    rows = [(n, some[0].tolist()) for n in range(3000)] + [(5000 + n, v.tolist()) for n, v in enumerate(some)]
    rows += [(7000, (some[0] * 2 + 0.01).tolist()), (8000, some[0].tolist()), (8000, some[1].tolist()), (8000, some[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, _ = M.classes(M.valid(frame))
    # the copies, the others, the near one, and the id with two vectors
    assert vectors.count() == 1 + 49 + 1 + 2
    by = {r.vec_id: r for r in M.near_duplicates(frame).collect()}
    linked = brute(np.array([v for _, v in rows[3000:]]))
    others = int(linked[0, 1:50].sum())
    assert others == 0 and by[0].n_links == 3000 + 1 + 1 and by[2999].component_id == 0 and not by[5000].kept
    assert by[7000].n_links == 3000 + 1 + 1 and by[8000].n_links == 3001 + 1 + 1
    assert M.grid_codes(51_200) == 32 and M.grid_codes(10**12) == 1000 and M.grid_codes(1) == 4


def test_links_found_one_way_count_for_both(spark):
    """Each vector visits one cell or two; what either of a pair finds is a link of both."""
    rng = np.random.default_rng(4)
    base = M.unit(rng.standard_normal((300, 16)))
    noise = M.unit(rng.standard_normal(base.shape))
    matrix = M.unit(np.concatenate([base, base + 0.3 * noise, np.repeat(base[:1], 30, 0)]))
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    linked = brute(matrix)
    np.fill_diagonal(linked, False)
    for visits, block in ((1, 2048), (2, 2048), (2, 7)):
        index = M.Index(M.codebook(matrix[:, :8], 8), M.codebook(matrix[:, 8:], 8), visits)
        cells = M.traverse(index, matrix, visits)
        visited = (cells[:, :, None] == cells[:, 0]).any(1)  # row visits the home of column
        want = (linked & (visited | visited.T)).sum(1)
        got = M.links(frame, index, 0.95, block).where("b is null").groupBy("a").agg(F.sum("many").alias("n")).collect()
        assert {r.a: r.n for r in got} == {n: w for n, w in enumerate(want.tolist()) if w}
        assert visits == 1 or (want != (linked & visited).sum(1)).any()
