import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.functions import metrics
from vespera.functions.bitset import make_bitset
from vespera.operators.knn import effective_k, knn, knn_batch
from vespera.types import EngineError, Element, Metric


def rows(spark, data, kind="float"):
    cast = int if kind == "smallint" else float
    return spark.createDataFrame([(i, [cast(x) for x in v]) for i, v in data.items()], f"id long, vec array<{kind}>")


def found(df):
    return [(r["id"], round(r["distance"], 5)) for r in df.collect()]


def test_l1_golden(spark):
    v = rows(spark, {i: [i + 0.1] * 4 for i in (0, 14, 15, 16, 30)})
    assert found(knn(v, [15.2] * 4, 3, "l1")) == [(15, 0.4), (16, 3.6), (14, 4.4)]


def test_l2_is_squared(spark):
    v = rows(spark, {10: [3.0, 0.0, 0.0, 0.0], 20: [2.0, 2.0, 0.0, 0.0]})
    assert found(knn(v, [0.0] * 4, 2, "l2")) == [(20, 8.0), (10, 9.0)]


def test_cos_order_and_zeros(spark):
    v = rows(spark, {10: [10.0, 0, 0, 0], 20: [2.0, 1, 0, 0], 30: [1.0, 2, 0, 0], 40: [0.0, 1, 0, 0], 50: [-1.0, 0, 0, 0]})
    assert [i for i, _ in found(knn(v, [1.0, 0, 0, 0], 5, "cos"))] == [10, 20, 30, 40, 50]
    z = rows(spark, {10: [0.0] * 4, 20: [1.0, 0, 0, 0]})
    for more in ({}, {"strategy": "numpy"}, {"strategy": "lambda"}):
        assert found(knn(z, [0.0] * 4, 2, "cos", **more)) == [(10, 0.0), (20, 1.0)]
    stored = z.withColumn("n", metrics.inverse_norm(F.col("vec")))
    assert found(knn(stored, [0.0] * 4, 2, "cos", inv_norm_col="n")) == [(10, 0.0), (20, 1.0)]


def test_integers_do_not_overflow(spark):
    v = rows(spark, {1: [32767] * 4, 2: [-32768] * 4}, "smallint")
    assert found(knn(v, [-32768] * 4, 2, "l1", "i16")) == [(2, 0.0), (1, 4 * 65535.0)]
    assert found(knn(v, [-32768] * 4, 2, "l2", "i16")) == [(2, 0.0), (1, 4 * 65535.0**2)]


def test_ties_take_the_lower_id(spark):
    v = rows(spark, {i: [float(i)] * 4 for i in range(100)})
    assert [i for i, _ in found(knn(v, [50.0] * 4, 3, "l1"))] == [50, 49, 51]


@pytest.mark.parametrize("metric", ["l1", "l2", "cos"])
@pytest.mark.parametrize("dim", [4, 64, 200])
def test_strategies_agree_with_numpy(spark, metric, dim):
    rng = np.random.default_rng(dim)
    data = {i: rng.normal(size=dim).astype(np.float32).tolist() for i in range(60)}
    q = rng.normal(size=dim).astype(np.float32).tolist()
    want = metrics.numpy_distances(np.array(list(data.values()), np.float32), np.array(q), Metric(metric), Element.f32)
    order = sorted((round(d, 5), i) for i, d in enumerate(want))[:7]
    for s in ("lambda", "numpy", "unrolled"):
        assert sorted((d, i) for i, d in found(knn(rows(spark, data), q, 7, metric, strategy=s))) == order


def test_window_of_limit_and_offset(spark):
    v = rows(spark, {i: [i + 0.1] * 4 for i in (0, 14, 15, 16, 30)})
    assert [i for i, _ in found(knn(v, [15.2] * 4, metric="l1", limit=2, offset=1))] == [16, 14]
    assert [i for i, _ in found(knn(v, [15.2] * 4, 100, "l1", limit=1))] == [15]
    assert found(knn(v, [15.2] * 4, metric="l1", limit=0)) == []
    assert effective_k(None, None) == 10 and effective_k(5, -1) == 5 and effective_k(3, 2, 4) == 3 and effective_k(None, 2, -7) == 2
    for k in (0, -1, 2.5, True):
        with pytest.raises(EngineError, match="k must be > 0"):
            knn(v, [1.0] * 4, k)
    with pytest.raises(EngineError, match="WHERE query"):
        knn(v, [], 3)


def test_limit_is_one_top_k_node(spark):
    v = rows(spark, {i: [float(i)] * 4 for i in range(9)})
    plan = knn(v, [1.0] * 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_allow_lists(spark):
    v = rows(spark, {i: [float(i)] * 4 for i in range(3)})
    ids = spark.createDataFrame([(0,)], "x long")
    for allowed in (ids, make_bitset([0]), [0]):
        assert [i for i, _ in found(knn(v, [2.1] * 4, 3, allowed=allowed))] == [0]
    assert len(found(knn(v, [2.1] * 4, 3, allowed=None))) == 3
    assert found(knn(v, [2.1] * 4, 3, allowed=b"")) == []
    with pytest.raises(EngineError):
        knn(v, [2.1] * 4, 3, allowed="0")


def test_batch_equals_single_queries(spark):
    rng = np.random.default_rng(3)
    data = {i: rng.integers(-3, 4, 6).astype(float).tolist() for i in range(300)}
    v = rows(spark, data).repartition(3)
    qs = v.where("id % 50 = 0")
    for metric in ("l1", "l2", "cos"):
        for most in (4096, 2):
            got = knn_batch(v, qs, 4, metric, query_id="id", query_vec="vec", max_queries=most).collect()
            for q in range(0, 300, 50):
                own = [(r["id"], round(r["distance"], 5)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
                assert own == found(knn(v, data[q], 4, metric))


def test_many_l1_queries_on_one_row_group(spark, tmp_path, monkeypatch):
    from vespera.operators import knn as module

    rng = np.random.default_rng(8)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(500)], "id long, vec array<float>").coalesce(1).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    few = sorted(map(tuple, knn_batch(v, v.where("id % 50 = 0"), 3, "l1", query_id="id", query_vec="vec").collect()))
    for most, dealt in ((module.MOST_DEALT, True), (0, False)):
        monkeypatch.setattr(module, "HEAVY", 8)
        monkeypatch.setattr(module, "MOST_DEALT", most)
        got = knn_batch(v, v.where("id % 50 = 0"), 3, "l1", query_id="id", query_vec="vec")
        assert ("RoundRobinPartitioning(4)" in got._jdf.queryExecution().executedPlan().toString()) == dealt
        assert sorted(map(tuple, got.collect())) == few and len(few) == 30


def test_lateral_query_is_a_batch(spark, tmp_path):
    import __spark_entry__ as entry
    from vespera.plans import sql

    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, (300, 8)) * np.float32(0.1)  # with ties and copies
    table = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    table.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["knn_lateral"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    sql.expose(spark, "outer_vectors", table.selectExpr("vec_id AS id", "embedding AS vec"), "l1")
    want = spark.sql("SELECT o.id AS query_id, n.id, round(n.distance, 6) AS distance FROM outer_vectors o, LATERAL knn_outer_vectors(o.vec, 3) n WHERE o.id % 50 = 0")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 18


@pytest.mark.parametrize("element", ["f32", "f16", "i16"])
def test_l1_bounds_lose_no_row(element):
    from vespera.operators.knn import _Best

    rng = np.random.default_rng(7)
    for scale, k in ((1, 3), (1000, 40), (32767, 1)):
        q, rows = (np.round(rng.uniform(-scale, scale, (n, 24)) * (1 if element == "i16" else 0.3), 0 if element == "i16" else 2) for n in (300, 2500))
        rows[1000:2300] = rows[0]  # copies, more than any k
        q[:4] = rows[0]
        rows = rows.astype(np.int16 if element == "i16" else np.float16 if element == "f16" else np.float32)
        rows = rows.astype(np.float32) if element == "f16" else rows
        q = np.array([metrics.query_values(x, Element(element)) for x in q], np.float64)
        best, ids = _Best(q, k, Metric.l1, Element(element)), rng.permutation(2500)
        for part in np.array_split(np.arange(2500), [2, 1100, 1101]):
            best.take(ids[part], rows[part])
        for x in (*range(6), 299):
            d = metrics.pair_l1(rows, q[x][None, :], Element(element))
            order = np.lexsort((ids, d))[:k]
            mine = best.query == x
            assert best.ids[mine].tolist() == ids[order].tolist() and best.d[mine].tolist() == d[order].tolist()


def test_l1_beyond_single_precision(spark):
    v = rows(spark, {1: [3e38, 0.0, 0.0, 0.0], 2: [2e38, 2e38, 2e38, 0.0], 3: [1e38] * 4, 4: [3e38, 3e38, 0.0, 0.0]})
    got = knn_batch(v, v.where("id = 1"), 4, "l1", query_id="id", query_vec="vec").collect()
    assert [(r["id"], r["distance"]) for r in sorted(got, key=lambda r: r["rank"])] == [(r["id"], r["distance"]) for r in knn(v, [3e38, 0.0, 0.0, 0.0], 4, "l1").collect()]


def test_half_precision(spark):
    from vespera.functions.vectext import half

    v = rows(spark, {1: [0.1, 0.2, 0.3, 65504.0]}).select("id", half(F.col("vec")).alias("vec"))
    assert list(v.first()["vec"]) == np.array([0.1, 0.2, 0.3, 65504.0], np.float16).astype(np.float32).tolist()
    assert found(knn(v, [0.1, 0.2, 0.3, 65504.0], 1, "l2", "f16")) == [(1, 0.0)]


def test_angles(spark):
    v = rows(spark, {i: [math.cos(i * math.pi / 200), math.sin(i * math.pi / 200), 0.0, 0.0] for i in range(100)})
    got = found(knn(v, [1.0, 0, 0, 0], 10, "cos"))
    assert got[0][0] == 0 and [d for _, d in got] == sorted(d for _, d in got)


def test_large_k_by_counts(spark, monkeypatch):
    from vespera.operators import knn as module

    rng = np.random.default_rng(3)
    data = {int(i): [float(x) for x in rng.integers(0, 4, 3)] for i in rng.permutation(900)} | {1000: [1e6, 0.0, 0.0], 1001: [1e-9, 0.0, 0.0]}
    v = rows(spark, data).unionByName(spark.createDataFrame([(2000, None)], "id long, vec array<float>")).repartition(5).cache()
    for metric in ("l1", "l2", "cos"):
        want = found(knn(v, [1.0, 0.0, 2.0], 950, metric))
        assert len(want) == 902
        with monkeypatch.context() as m:
            m.setattr(module, "MOST_K", 4)
            m.setattr(module, "BINS", 8)
            for k in (5, 37, 500, 901, 902, 950):
                out = knn(v, [1.0, 0.0, 2.0], k, metric)
                assert found(out) == want[:k]
            assert "TakeOrderedAndProject" not in out._jdf.queryExecution().toString()
            assert found(knn(v, [1.0, 0.0, 2.0], None, metric, limit=40, offset=7)) == want[7:47]
            assert found(knn(v.where("false"), [1.0, 0.0, 2.0], 10, metric)) == []
    v.unpersist()
