import pytest
from pyspark.sql import functions as F

from vespera.functions import vectext
from vespera.functions.bitset import bit_at, bitset_agg, bitset_ids, make_bitset
from vespera.plans import sql
from vespera.sources.ini import metadata_from_ini, metadata_to_ini, parse_ini
from vespera.types import EngineError, Metadata


def ids(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"id {kind}")


def test_bitset_cases(spark):
    assert bitset_agg(ids(spark, [0, 1, None, 8, 8])).first()["bitset"].hex() == "0301"
    assert bitset_agg(ids(spark, [])).first()["bitset"] == b""
    assert bitset_agg(ids(spark, [40])).first()["bitset"] == bytes(5) + b"\x01" == make_bitset([40])
    with pytest.raises(Exception, match="non-negative"):
        bitset_agg(ids(spark, [-1])).collect()
    with pytest.raises(EngineError, match="must be an integer"):
        bitset_agg(ids(spark, ["oops"], "string"))
    with pytest.raises(Exception, match="too large"):
        bitset_agg(ids(spark, [1 << 40])).collect()


def test_bitset_groups_and_back(spark):
    df = spark.createDataFrame([("a", 3), ("a", 17), ("b", 0), ("c", None)], "g string, id long")
    back = bitset_ids(bitset_agg(df, by=["g"]), "bitset")
    assert sorted(map(tuple, back.collect())) == [("a", 3), ("a", 17), ("b", 0)]
    inside = ids(spark, range(-1, 40)).where(bit_at(F.lit(make_bitset([3, 17])), F.col("id")))
    assert [r["id"] for r in inside.collect()] == [3, 17]


def test_bitset_in_sql(spark):
    sql.register(spark)
    ids(spark, [0, 1, None, 8, 8]).createOrReplaceTempView("bitset_ids")
    assert spark.sql("SELECT hex(bitset_agg(id)) AS b FROM bitset_ids").first()["b"] == "0301"


def test_parse_on_the_driver():
    assert vectext.parse_vector("1.0,, 2  3e1,-4", "f32", 4) == [1.0, 2.0, 30.0, -4.0]
    assert vectext.parse_vector("[ 1, 2, 3, 4 ]", "i16", 4) == [1, 2, 3, 4]
    for text, kind, message in (
        ("1 2 3", "f32", "truncated"), ("nope 1 2 3", "f32", "invalid f32 token"), ("1 2 3 4 5", "f32", "extra tokens"), ("nan 1 2 3", "f32", "non-finite f32"),
        ("1.7 1 2 3", "i16", "invalid i16"), ("40000 1 2 3", "i16", "out of range"), ("70000 1 2 3", "f16", "non-finite f16"),
    ):
        with pytest.raises(EngineError, match=message):
            vectext.parse_vector(text, kind, 4)


def test_parse_as_expression(spark):
    df = spark.createDataFrame([("1.5, 2 3e1,-4",), (None,)], "t string")
    assert [r[0] for r in df.select(vectext.parsed(F.col("t"), "f32", 4)).collect()] == [[1.5, 2.0, 30.0, -4.0], None]
    for text, kind, message in (("1 2 3", "f32", "truncated"), ("nope 1 2 3", "f32", "invalid f32 token"), ("1 2 3 4 5", "f32", "extra"), ("inf 1 2 3", "f32", "non-finite"), ("1e50 1 2 3", "f32", "non-finite"), ("1.7 1 2 3", "i16", "invalid i16"), ("40000 1 2 3", "i16", "out of range")):
        with pytest.raises(Exception, match=message):
            spark.createDataFrame([(text,)], "t string").select(vectext.parsed(F.col("t"), kind, 4)).collect()


def test_format(spark):
    assert vectext.format_vector([1.0, 2.5, 0.1]) == "[ 1, 2.5, 0.1 ]"
    df = spark.createDataFrame([([1.0, 2.5, 0.1],)], "v array<float>")
    assert df.select(vectext.formatted(F.col("v"))).first()[0] == "[ 1, 2.5, 0.100000001 ]"


def test_fill():
    assert vectext.fill_vector(2.9, "i16", 4) == [2] * 4
    for kind, x in (("i16", 40000.0), ("f16", 70000.0), ("f32", 1e40), ("f32", float("nan"))):
        with pytest.raises(EngineError):
            vectext.fill_vector(x, kind, 4)


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1.0, 2.0, 3.0, 4.0\r\n")
    for s in (None, spark):
        assert vectext.load_query(s, f"@{tmp_path}/q.txt") == "1.0, 2.0, 3.0, 4.0"
        with pytest.raises(EngineError, match="failed to open file"):
            vectext.load_query(s, "@/no/such/file")


def test_table_function(spark):
    v = spark.createDataFrame([(i, [float(i)] * 4) for i in range(20)], "id long, vec array<float>")
    sql.expose(spark, "some_vectors", v, "l1")
    q = "array(5f, 5f, 5f, 5f)"
    assert [r["id"] for r in spark.sql(f"SELECT * FROM knn_some_vectors({q}, 3)").collect()] == [5, 4, 6]
    assert spark.sql(f"SELECT * FROM knn_some_vectors({q})").count() == 10
    assert [r["id"] for r in spark.sql(f"SELECT * FROM knn_some_vectors_in({q}, array(1, 19), 1)").collect()] == [1]
    pairs = spark.sql("SELECT o.id AS a, n.id AS b FROM some_vectors o, LATERAL knn_some_vectors(o.vec, 1) n").collect()
    assert all(r["a"] == r["b"] for r in pairs) and len(pairs) == 20


def test_ini():
    text = "; c\n[dataset]\ndirs = /a, ,/b\nbroken\nrange_size=1000\ndim=8\ntype=i16\ndist_func=cos\n"
    meta = metadata_from_ini("/x/items.ini", text)
    assert (meta.name, meta.dirs, meta.range_size, meta.dim, meta.type, meta.dist_func) == ("items", ("/a", "/b"), 1000, 8, "i16", "cos")
    assert metadata_from_ini("/x/items.ini", metadata_to_ini(meta)) == meta
    assert parse_ini("a=1")[""] == {"a": "1"} and meta.dir_slot(5) == 1
    with pytest.raises(EngineError):
        metadata_from_ini("x.ini", "[dataset]\ndirs=/a\n")


def test_limits():
    for bad in ({"dim": 3}, {"dim": 4097}, {"type": "F32"}, {"dist_func": "cosine"}, {"name": "a/b"}, {"range_size": 0}):
        with pytest.raises(EngineError):
            Metadata(**({"name": "x", "dim": 4} | bad))
