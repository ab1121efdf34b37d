"""Published figures: small matrices, layers, and two networks trained for a step."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators import coo, kernels, linalg
from gridloom.plans.model import Model
from gridloom.plans.words import Machine


def dense(df, h, w):
    out = np.zeros((h, w))
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_products_and_elements(spark):
    a, b = coo.matrix(spark, [[1, 2, 3], [4, 5, 6]]), coo.matrix(spark, [[1, 1]] * 3)
    ones = coo.constant(spark, 2, 3, 1.0)
    assert dense(coo.matmul(a, b), 2, 2).tolist() == [[6, 6], [15, 15]]
    assert dense(coo.combine(a, ones, "+", ["i", "j"]), 2, 3).tolist() == [[2, 3, 4], [5, 6, 7]]
    assert dense(coo.combine(a, ones, "-", ["i", "j"]), 2, 3).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert dense(coo.matmul(coo.matrix(spark, [[1, 2, 3], [0, 4, 5]]), b), 2, 2).tolist() == [[6, 6], [9, 9]]


def test_factorisations(spark):
    m = coo.matrix(spark, [[2, 2, 5], [1, 1, 1], [4, 6, 8]])
    assert linalg.det(m).first()["v"] == pytest.approx(6)
    want = [[1 / 3, 7 / 3, -0.5], [-2 / 3, -2 / 3, 0.5], [1 / 3, -2 / 3, 0]]
    assert np.allclose(dense(linalg.inverse(m), 3, 3), want) and np.allclose(dense(linalg.lu_inverse(m), 3, 3), want)
    p = linalg.plu(coo.matrix(spark, [[1, 2, 4], [3, 8, 14], [2, 6, 13]]))
    assert np.allclose(dense(p.where("part = 'LU'"), 3, 3), [[3, 8, 14], [2 / 3, 2 / 3, 11 / 3], [1 / 3, -1, 3]], atol=1e-4)
    s = coo.matrix(spark, [[1, -1, -2], [-3, 5, -4], [1, -1, 4]])
    assert dense(coo.upper(s), 3, 3).tolist() == [[1, -1, -2], [0, 5, -4], [0, 0, 4]]
    assert dense(coo.lower(s), 3, 3).tolist() == [[1, 0, 0], [-3, 1, 0], [1, -1, 1]]
    with pytest.raises(linalg.Singular):
        linalg.plu_dense(np.ones((3, 3)))
    assert linalg.det_dense(np.ones((3, 3))) == 0


def test_linear_layer(spark):
    m = Model(1, (1, 2, 1)).linear(3).set(0, "w", [[0.1, 0.2], [0.3, 0.4], [0.5, 0.6]]).set(0, "b", [1, 2, 3])
    x = spark.createDataFrame([(0, [10.0, 20.0])], "id bigint, x array<double>")
    assert np.allclose(m.forward(x).first()["x"], [6, 13, 20])


def network(hidden):
    m = Model(1, (1, 2, 1), "ref").linear(hidden).sigmoid().linear(2).sigmoid()
    w0 = [[0.15, 0.2], [0.25, 0.3], [0.2, 0.15]][:hidden]
    w2 = [[0.4, 0.45, 0.5], [0.55, 0.5, 0.45]] if hidden == 3 else [[0.4, 0.45], [0.5, 0.55]]
    return m.set(0, "w", w0).set(0, "b", [0.35] * hidden).set(2, "w", w2).set(2, "b", [0.6] * 2)


def test_two_layers_one_sample(spark):
    m = network(3)
    x = spark.createDataFrame([(0, [0.05, 0.1], [0.01, 0.99])], "id bigint, x array<double>, t array<double>")
    assert np.allclose(m.forward(x, 1).first()["x"], [0.3775, 0.3925, 0.3750], atol=1e-4)
    assert np.allclose(m.forward(x).first()["x"], [0.80254, 0.81629], atol=1e-4)
    dx = m.input_gradient(x).first()["x"]
    assert np.allclose(dx, [0.16429, 0.17295], atol=1e-4)
    m.backprop(x)
    g = m.gradients
    assert np.allclose(g[2, "b"], [0.79254, -0.17371], atol=1e-4)
    assert np.allclose(g[2, "w"], [[0.4702, 0.4731, 0.4697], [-0.1031, -0.1037, -0.1029]], atol=1e-4)
    assert np.allclose(g[0, "b"], [0.22148, 0.26979, 0.31810], atol=1e-4)
    assert np.allclose(g[0, "w"], [[0.0111, 0.0221], [0.0135, 0.0270], [0.0159, 0.0318]], atol=1e-4)
    m.sgd(0.5, 0.0)
    assert np.allclose(m.params[2, "w"], [[0.1649, 0.2135, 0.2651], [0.6015, 0.5518, 0.5015]], atol=1e-4)
    assert np.allclose(m.params[0, "w"], [[0.1445, 0.1889], [0.2433, 0.2865], [0.1920, 0.1341]], atol=1e-4)
    assert np.allclose(m.params[0, "b"], [0.23926, 0.21511, 0.19095], atol=1e-4)


def test_two_layers_three_samples(spark):
    m = network(2)
    x = spark.createDataFrame([(i, [0.05, 0.1], [0.01, 0.99]) for i in range(3)], "id bigint, x array<double>, t array<double>").repartition(3)
    m.backprop(x)
    assert np.allclose(m.gradients[2, "b"], [2.22410, -0.65121], atol=1e-4)
    assert np.allclose(m.gradients[2, "w"], [[1.3195, 1.3275], [-0.3863, -0.3887]], atol=1e-4)
    assert np.allclose(m.gradients[0, "w"], [[0.0282, 0.0564], [0.0321, 0.0643]], atol=1e-4)
    m.sgd(0.5, 0.0)
    assert np.allclose(m.params[2, "b"], [-0.5120, 0.9256], atol=1e-4)
    assert np.allclose(m.params[0, "b"], [0.0680, 0.0287], atol=1e-4)


def test_gradients_against_differences(spark):
    """By central differences of half the squared error; up-sampling takes the mean instead, as documented."""
    rng = np.random.default_rng(0)
    m = Model(3, (6, 6, 1), seed=3).conv2d(0.3, 2).tanh().maxpool(2).batchnorm().dconv2d(0.1, 2).elu().avgpool(3).selu().flatten().linear(3)
    rows = [(i, rng.normal(size=36).tolist(), rng.normal(size=3).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, t array<double>").coalesce(1)
    m.backprop(df)
    x = np.array([r[1] for r in rows]).reshape(4, 6, 6, 1)
    t = np.array([r[2] for r in rows])

    def loss():
        stats = {}
        for i, l in enumerate(m.layers):
            if l.op == "batchnorm":
                h = m._forward(x, np.arange(4), stats, i)[-1]
                stats[i] = (h.mean((0, 1, 2)), h.var((0, 1, 2)))
        y = m._forward(x, np.arange(4), stats, len(m.layers))[-1].reshape(4, 3)
        return 0.5 * ((y - t) ** 2).sum()

    for name, g in m.gradients.items():
        p = m.params[name]
        for k in rng.choice(p.size, min(5, p.size), replace=False):
            old = p.flat[k]
            p.flat[k] = old + 1e-5
            up = loss()
            p.flat[k] = old - 1e-5
            down = loss()
            p.flat[k] = old
            assert g.flat[k] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-4), name


@given(st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_laws_of_factorisation(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n)) + 3 * np.eye(n)
    if abs(np.linalg.det(a)) < 1e-2:
        return
    order, lu, _ = linalg.plu_dense(a)
    assert np.allclose((np.tril(lu, -1) + np.eye(n)) @ np.triu(lu), a[order])
    assert np.allclose(linalg.inverse_dense(a) @ a, np.eye(n), atol=1e-6)
    assert linalg.det_dense(a) == pytest.approx(np.linalg.det(a))
    b = np.arange(n, dtype=float)
    assert np.allclose(a @ linalg.solve_plu(order, lu, b), b, atol=1e-6)


@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([2, 3]), st.integers(0, 999))
@settings(max_examples=40, deadline=None)
def test_pools_of_any_size(h, w, k, seed):
    x = np.random.default_rng(seed).normal(size=(2, h, w, 2))
    for how, f in (("max", np.max), ("min", np.min), ("avg", np.mean)):
        got = kernels.pool(x, k, how)
        assert got.shape == (2, -(-h // k), -(-w // k), 2)
        assert got[1, -1, -1, 1] == pytest.approx(f(x[1, (got.shape[1] - 1) * k :, (got.shape[2] - 1) * k :, 1]))
        assert kernels.pool_gradient(x, np.ones_like(got), k, how).sum() == pytest.approx(got.size)


def test_block_product_equals_the_plain_one(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(37, 50)), rng.normal(size=(50, 23))
    got = linalg.block_matmul(coo.matrix(spark, a.tolist()), coo.matrix(spark, b.tolist()), 16)
    assert np.allclose(dense(got, 37, 23), a @ b)


def test_chain_order():
    assert coo.chain_order([(10, 1000), (1000, 5), (5, 500)]) == ((0, 1), 2)


# -- the stack language


def test_scalars(spark):
    m = Machine(spark)
    assert m.run("54.9999 55 < . 55.0001 55 < .") == "-1 0 "
    assert m.run(": stars 60 for 42 emit next ; stars") == "*" * 61
    assert m.run("17 5 mod . 17.5 5 fmod . $ff . %101 . 7 3 and . -7.5 f>s . 10 2 pow .") == "2 2.5 255 5 3 -7 1024 "
    assert m.run("variable x 3 x ! 4 x +! x @ . x ?") == "7 7 "
    assert m.run(": f dup 0> if drop .\" pos\" else drop .\" no\" then ; 3 f -3 f") == "posno"
    assert m.run(": g 5 0 do i . loop ; g") == "0 1 2 3 4 "
    assert m.run(": h 0 begin 1+ dup 5 = until ; h . 3 constant c c . 4 value v v . 9 to v v .") == "5 3 4 9 "
    assert m.run('3 s" %d cats" sprintf type') == "3 cats"
    assert m.run(": w 0 begin dup 3 < while dup . 1+ repeat drop ; w 255 hex . decimal") == "0 1 2 ff "
    assert m.run("1 2 3 rot . . . depth .") == "1 3 2 0 "
    with pytest.raises(KeyError):
        m.run("nosuchword")


def test_tensors(spark):
    m = Machine(spark)
    assert m.run("2 3 matrix{ { 1 2 3 } { 4 5 6 } } 3 2 matrix ones @ sum .") == "42 "
    assert m.run("2drop drop 3 3 matrix{ { 2 2 5 } { 1 1 1 } { 4 6 8 } } det .") == "6 "
    assert m.run("inverse @ sum .").startswith("3")
    m = Machine(spark)
    m.run("3 vector{ 1 1 1 } 3 3 matrix{ { 5 7 4 } { 3 -1 3 } { 6 7 5 } } solve")
    assert np.allclose(m.ss[-1].values(), [8, -1, -8])
    m = Machine(spark)
    assert m.run("2 2 matrix{ {1 2} {3 4} } 10 swap drop").strip() == ""
    m = Machine(spark)
    m.run("2 3 matrix{ {1 2 3} {4 5 6} } 10 *")
    assert m.ss[-1].values().tolist() == [10, 20, 30, 40, 50, 60]
    assert m.run("max . min . avg . dim").split() == ["60", "10", "35"]
    m.run("drop 1 3 0 -1 slice")
    assert m.ss[-1].values().tolist() == [20, 30, 50, 60] and m.ss[-1].shape == (1, 2, 2, 1)
    m.run("transpose")
    assert m.ss[-1].values().tolist() == [20, 50, 30, 60]
    with pytest.raises(ValueError, match="cells"):
        m.run("5 5 reshape2")


def test_network_script(spark):
    m = Machine(spark)
    m.run("""1 1 2 1 nn.model 0.35 3 linear sigmoid 0.6 2 linear sigmoid
        3 2 matrix{ {0.15 0.2} {0.25 0.3} {0.2 0.15} } 1 nn.w=
        3 vector{ 0.35 0.35 0.35 } 1 nn.b=
        2 3 matrix{ {0.4 0.45 0.5} {0.55 0.5 0.45} } 3 nn.w=
        2 vector{ 0.6 0.6 } 3 nn.b=
        1 1 2 1 tensor ={ 0.05 0.1 } forward
        1 1 2 1 tensor ={ 0.01 0.99 } nn.onehot=""".replace("={", "={"))
    loss = m.run("loss.mse .")
    assert float(loss) == pytest.approx(0.658292, abs=1e-4)
    m.run("backprop 0.5 0 nn.sgd 3 nn.w")
    assert np.allclose(m.ss[-1].values(), [0.1649, 0.2135, 0.2651, 0.6015, 0.5518, 0.5015], atol=1e-4)


def test_dataset_loop(spark, tmp_path):
    from gridloom.sources import corpora

    rows = [(i, i % 2, [float(i % 2), 1.0], 1, 2, 1) for i in range(10)]
    spark.createDataFrame(rows, corpora.SCHEMA).write.parquet(f"{tmp_path}/c")
    corpora.register("tiny", lambda s: s.read.parquet(f"{tmp_path}/c"))
    m = Machine(spark)
    m.run("4 1 2 1 nn.model 2 linear softmax 4 dataset tiny")
    m.run(": epoch for forward backprop 0.1 nn.sgd next ;")
    m.run("variable hits")
    m.run("epoch")
    assert m.ss[-1].epoch == 1 and m.ss[-1].step == 3


def test_dataset_loop_takes_as_many_jobs_for_many_batches(spark, tmp_path):
    """Each step of a loop over batches put the whole corpus in order again."""
    from gridloom.sources import corpora

    spark.range(300).selectExpr("id as sample_id", "cast(id % 2 as int) as label", "array(1.0D, cast(id as double)) as x").write.parquet(f"{tmp_path}/c")
    corpora.register("three_hundred", lambda s: s.read.parquet(f"{tmp_path}/c"))
    sc, jobs, seen = spark.sparkContext, {}, {}
    for size in (100, 3):
        sc.setJobGroup(f"loop-{size}", "a loop over batches")
        m = Machine(spark)
        m.run(f"variable batches : count 1 batches +! ; {size} dataset three_hundred")
        m.run(": loop for count next ; loop batches @")
        seen[size], jobs[size] = m.ss[-1], len(sc.statusTracker().getJobIdsForGroup(f"loop-{size}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen == {100: 3.0, 3: 100.0} and jobs[100] == jobs[3]


def test_batches_of_a_feed(spark, tmp_path):
    from gridloom.sources import corpora

    spark.range(10).selectExpr("9 - id as sample_id", "0 as label", "array(1.0D) as x").write.parquet(f"{tmp_path}/c")
    corpora.register("ten", lambda s: s.read.parquet(f"{tmp_path}/c"))
    m = Machine(spark)
    m.run("4 dataset ten")
    got = []
    for _ in range(4):
        got.append(sorted(r["sample_id"] for r in m.ss[-1].batch().collect()))
        m.run("fetch")
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], []]
    m.run("rewind nn.len")
    assert m.ss[-1] == 10 and m.ss[-2].batch().count() == 4
    with pytest.raises(ValueError, match="batches of 0"):
        m.run("0 dataset ten")


def test_samples_times_a_matrix_is_one_plan_without_a_join(spark, tmp_path):
    """Joined by its 8 inner indices, 8 tasks at most got all cells; ids that repeat, and values that are missing, as in the SQL."""
    import duckdb

    from gridloom.queries import ORACLES, QUERIES

    whole = [float(k % 13 - 6) for k in range(64)]
    rows = [(0, whole), (1, whole), (1, whole[::-1]), (2, [None] * 8 + [1.5, None] * 28), (3, whole[:20]), (4, []), (5, None), (6, [*whole, 9.0, 9.0]), (7, [float("nan"), float("inf")] * 32), (-8, whole)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["matmul_batch_broadcast"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT n, i, j, v FROM ({ORACLES['matmul_batch_broadcast']})").fetchall()
    assert sorted(map(repr, df.select("n", "i", "j", "v").toLocalIterator())) == sorted(f"Row(n={n}, i={i}, j={j}, v={v!r})" for n, i, j, v in want)
    assert len(want) == 9 * 64
    with pytest.raises(ValueError, match="8 x 7"):
        coo.sample_matmul(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "embedding", (8, 7), [[1.0]] * 8, "vec_id")


def test_samples_times_a_matrix_equals_cells_times_a_matrix(spark):
    m = [[1.0, -2.0, 0.5], [0.0, 3.0, -1.0]]
    df = spark.range(5).selectExpr("id as n", "transform(sequence(0, 7), k -> double(id * 8 + k) / 7) as x")
    cells = coo.tensor(df, "x", (4, 2, 1), "n").selectExpr("n", "h as i", "w as j", "v")
    want = {(r["n"], r["i"], r["j"]): r["v"] for r in coo.batch_matmul(cells, coo.matrix(spark, m), shared=True).collect()}
    got = {(r["n"], r["i"], r["j"]): r["v"] for r in coo.sample_matmul(df, "x", (4, 2), m, "n").collect()}
    assert got == pytest.approx(want) and len(got) == 60


@pytest.mark.parametrize("script", ["3 2 2 1 tensor ones 1 2 2 1 tensor ={ 1 2 3 4 } matmul", "1 2 2 1 tensor ={ 1 2 3 4 } 3 2 2 1 tensor ones matmul"])
def test_one_matrix_for_all_samples_is_broadcast(spark, script):
    """Joined by a shuffle, its few inner indices brought all samples' cells into as few tasks."""
    m = Machine(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m.run(script)
        assert "SortMergeJoin" not in m.ss[-1].df._jdf.queryExecution().executedPlan().toString()
        m.run("sum")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert m.ss[-1] == 60.0
