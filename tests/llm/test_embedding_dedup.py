import numpy as np
from docloom.llm.common import connected_components
from docloom.llm.embedding_dedup import near_vectors, op4_embedding_dedup, tables_for

SF = "/root/testdata/sf0.001"


def brute(ids, x, threshold):
    x = np.array(x, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k in range(len(ids)):
        low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return {i: (int(near[k].sum()), low[find(k)]) for k, i in enumerate(ids)}


def clusters(seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((700, 16))
    for k in range(300, 500):  # one chain-like dense group
        x[k] = x[300] + rng.standard_normal(16) * 0.25
    for k in range(500, 600):
        x[k] = x[rng.integers(0, 300)] + rng.standard_normal(16) * 0.15
    x[600:700] = x[600]  # copies
    return rng.permutation(10_000)[:700].tolist(), x


def test_equals_brute_force(spark):
    ids, x = clusters()
    rows = [(i, [float(y) for y in v]) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(ids, x, 0.95)
    for block in (1024, 40):  # with buckets split into blocks too
        got = near_vectors(df, block=block, recall=0.999999).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [], "b"), (3, [0.0, 0.0], "c"), (4, [1.0, None], "d"), (5, [nan, 1.0], "e"), (6, [inf, 1.0], "f"), (7, [1.0, 1.0], "g"), (8, [2.0, 2.0], "h"), (9, [1.0, 1.0, 0.0], "i"), (10, [-1.0, -1.0], "j"), (11, [1e-30, 1e-30], "k"), (None, [1.0, 1.0], "l"), (12, [0.0, -0.0], "m"), (13, [3.0, -1.0], "n"), (13, [3.0, -1.0], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    for k in (1, 2, 3, 4, 5, 6, 9, 10, 12):
        assert got[k] == (0, k, True)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[11] == (2, 7, False)
    assert got[None] == (0, None, True) and got[13] == (1, 13, True)
    assert near_vectors(df.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 4000), (4000, 4500), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(101)) and all(got[k] == 1000 for k in range(1000, 1200))
    assert got[5000] == got[4500] == got[4000] == 4000


def test_query(spark):
    got = {r.vec_id: (r.n_links, r.component_id) for r in op4_embedding_dedup(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert got == brute([r.vec_id for r in rows], [r.embedding for r in rows], 0.95)
    assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** 12) ** tables_for(0.95, 12, 0.999) >= 0.999


def test_recall_at_the_threshold(spark):
    """As deployed: pairs whose cosine is just at or above 0.95, among many others."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    off = rng.standard_normal((2000, 64))
    off -= (off * a).sum(1)[:, None] * a
    off /= np.linalg.norm(off, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.955, 2000)[:, None]
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * off])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    want = brute(list(range(4000)), x, 0.95)
    links = sum(n for n, _ in want.values())
    assert links >= 4000 and sum(n for n, _ in got.values()) >= 0.995 * links
    assert all(got[i][0] <= want[i][0] for i in want)


def test_buckets_of_one_key(spark):
    """Vectors of different dimension never link, were their bucket the same."""
    rows = [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [1.0, 1.0, 0.0]), (4, [3.0, 3.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}
