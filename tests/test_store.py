import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.plans import overlay
from vespera.plans.engine import Dataset, Engine
from vespera.plans.store import Store
from vespera.sources import generate, vecfile
from vespera.sources.files import Files
from vespera.streaming.ingest import ingest
from vespera.types import EngineError, Element


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, f"file://{tmp_path}/db") as e:
        yield e


def table(spark, live, gone=()):
    rows = [(i, [float(i if x is None else x)] * 4, "U") for i, x in live] + [(i, None, "D") for i in gone]
    return spark.createDataFrame(rows, "id long, vec array<float>, op string")


def load(e, spark, ids, gone=()):
    e.open_dataset.load(table(spark, [(i, None) for i in ids], gone))


def counts(e):
    return sorted((r["kind"], r["file_id"], r["vectors"], r["deleted"]) for r in e.open_dataset.store.stats().collect())


def live(e):
    return sorted(r["id"] for r in e.open_dataset.rows().select("id").collect())


def test_small_load_becomes_a_delta_and_grows(engine, spark):
    engine.create("a")
    load(engine, spark, range(20))
    load(engine, spark, [20])
    assert counts(engine) == [("base", 0, 20, 0), ("delta", 0, 1, 0)]
    load(engine, spark, [21])
    assert counts(engine) == [("base", 0, 20, 0), ("delta", 0, 2, 0)]
    assert live(engine) == list(range(22))


def test_large_load_is_merged(engine, spark):
    engine.create("a")
    load(engine, spark, range(5))
    load(engine, spark, range(5, 8))
    assert counts(engine) == [("base", 0, 8, 0)]


def test_delta_triggers_merge_and_deletes_survive(engine, spark):
    engine.create("a")
    load(engine, spark, range(10))
    load(engine, spark, [80])
    load(engine, spark, range(50, 55))
    assert counts(engine) == [("base", 0, 16, 0)]
    engine.close("a")
    engine.create("b")
    load(engine, spark, range(10))
    load(engine, spark, [], [3])
    assert counts(engine) == [("base", 0, 10, 0), ("delta", 0, 0, 1)] and 3 not in live(engine)
    load(engine, spark, range(50, 55))
    assert counts(engine) == [("base", 0, 14, 0)] and 3 not in live(engine)


def test_delta_algebra(spark):
    old, new = table(spark, [(2, None), (4, None)], [1, 5]), table(spark, [(i, None) for i in (1, 3, 4, 6)], [2, 7])
    got = overlay.merge_deltas(old, new).collect()
    assert sorted(r["id"] for r in got if r["op"] == "U") == [1, 3, 4, 6] and sorted(r["id"] for r in got if r["op"] == "D") == [2, 5, 7]


def test_only_touched_ranges_change(engine, spark):
    engine.create("a", range_size=100)
    engine.generate(500)
    load(engine, spark, [1, 250, 499])
    assert [c[1] for c in counts(engine) if c[0] == "delta"] == [0, 2, 4]
    before = engine.open_dataset.store.manifest()
    engine.merge_delta()
    after = engine.open_dataset.store.manifest()
    assert not after.delta and after.base[1] == before.base[1] and after.base[0] != before.base[0]
    assert len(live(engine)) == 500
    engine.open_dataset.store.vacuum()
    assert len(live(engine)) == 500 and not engine.open_dataset.store.check().collect()


def test_pending_is_invisible_until_flushed(engine, spark):
    d = engine.create("a", dist_func="l1")
    load(engine, spark, [1, 2, 3])
    engine.ups2(9, 9.0)
    engine.ups2(1, 15.0)
    assert d.get(9) is None and engine.knn([1.0] * 4, 1) == [1] and engine.kres() == 1 and engine.kres(0) == 1 and engine.kres(7) == 0
    engine.merge_accumulator()
    assert engine.get(9) == "[ 9, 9, 9, 9 ]" == engine.gres() and engine.get(1) == "[ 15, 15, 15, 15 ]"
    with pytest.raises(EngineError, match="Vector not found"):
        engine.get(1000)


def test_close_flushes_and_reopen_replays(engine, spark):
    d = engine.create("a")
    load(engine, spark, range(5))
    engine.ups2(2, 500.0)
    engine.delete(3)
    engine.close("a")
    engine.open("a")
    assert engine.get(2) == "[ 500, 500, 500, 500 ]" and 3 not in live(engine)
    engine.ups2(7, 7.0)
    engine.dataset.lock.release()  # the writer is gone without closing
    engine.dataset = None
    d = engine.open("a")
    assert d.get(7) is None and d.pending.ids() == [7]
    engine.close("a")
    d = engine.open("a")
    assert d.pending.ids() == [7]  # what was only replayed stays in the log
    d.flush()
    assert d.get(7) == [7.0] * 4


def test_pressure_flushes(engine):
    d = engine.create("a", accumulator_size=256, dist_func="l1")
    d.apply([(i, [float(i)] * 4) for i in range(60)])
    assert d.pending.bytes <= 256
    d.flush()
    assert engine.knn([0.0] * 4, 5) == [0, 1, 2, 3, 4] and engine.knn([59.0] * 4, 3) == [59, 58, 57]


def test_last_pending_operation_wins(engine):
    d = engine.create("a")
    d.apply([(1, [1.0] * 4), (1, None), (2, None), (2, [2.0] * 4)])
    assert d.pending.ids() == [2] and d.pending.deleted_ids() == [1]
    d.flush()  # deletes in a range without base are nothing
    assert d.get(1) is None and d.get(2) == [2.0] * 4
    d.delete(77_000)
    d.flush()
    assert len(live(engine)) == 1


def test_bulk_deletes_need_a_base(engine, spark):
    engine.create("a")
    with pytest.raises(EngineError, match="invalid deleted items"):
        load(engine, spark, [], [3])


def test_first_load_reads_its_input_once(engine, spark, tmp_path):
    engine.create("a")
    store, read = engine.open_dataset.store, spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = tmp_path / "db" / "a" / "data"
    store.apply(table(spark, []), bulk=True)
    with pytest.raises(EngineError, match="invalid deleted items"):
        store.apply(table(spark, [(1, None), (2, None)], [3]), bulk=True)
    assert not list(data.glob("version=*")) and store.manifest().number == 0
    store.apply(table(spark, [(i, None) for i in range(50)]).mapInArrow(count, "id long, vec array<float>, op string"), bulk=True)
    assert read.value == 50 and live(engine) == list(range(50)) and store.manifest().number == 1


def test_damaged_log(engine):
    d = engine.create("a")
    d.upsert(1, "1, 2, 3, 4")
    path = f"{d.store.dir}/pending/{0:020d}.json"
    text = d.store.files.read(path).replace("3.0", "4.0")
    d.store.files.remove(path)
    assert d.store.files.write(path, text)
    with pytest.raises(EngineError, match="damaged"):
        Dataset(engine.spark, engine.root, "a")


def test_one_writer(engine, spark):
    d = engine.create("a")
    d.upsert(1, "1 2 3 4")
    other = Dataset(spark, engine.root, "a")
    with pytest.raises(EngineError, match="another writer"):
        other.delete(1)
    d.flush()
    assert other.get(1) == [1.0, 2.0, 3.0, 4.0]
    d.close()
    other.delete(1)
    other.close()
    assert other.get(1) is None


def test_cos_zero_in_delta(engine, spark):
    engine.create("a", dist_func="cos")
    engine.open_dataset.load(spark.createDataFrame([(20 + i, [i + 1.0, 0.0, 0.0, 0.0]) for i in range(5)], "id long, vec array<float>"))
    engine.ups2(10, 0.0)
    engine.merge_accumulator()
    got = engine.open_dataset.knn([0.0] * 4, 2).collect()
    assert [(r["id"], r["distance"]) for r in got] == [(10, 0.0), (20, 1.0)]


def test_errors(engine, spark):
    for bad in ({"dim": 3}, {"dist_func": "cosine"}, {"range_size": 10}, {"type": "f64"}):
        with pytest.raises(EngineError):
            engine.create("x", **bad)
    with pytest.raises(EngineError, match="no such dataset"):
        engine.open("x")
    engine.create("x")
    with pytest.raises(EngineError, match="open already"):
        engine.open("x")
    for pattern, count in ((7, 10), (0, 0)):
        with pytest.raises(EngineError):
            engine.generate(count, pattern=pattern)
    with pytest.raises(EngineError, match="Duplicate ids"):
        load(engine, spark, [1, 1])
    with pytest.raises(EngineError, match="truncated"):
        engine.open_dataset.knn("1, 2, 3", 3)
    with pytest.raises(EngineError):
        engine.upsert(-1, "1 2 3 4")
    engine.close("x")
    with pytest.raises(EngineError, match="exists"):
        engine.create("x")
    engine.drop("x")
    with pytest.raises(EngineError, match="no such dataset"):
        engine.drop("x")
    with pytest.raises(EngineError, match="no dataset is open"):
        engine.ups2(1, 1.0)


def test_text_files(engine, spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("f32,4\n\n12 : [ 1.5, 2, 3, 4 ]\nnote\n3 : [ 0 0 0 0 ]\n")
    header, rows = vecfile.read_vectors(spark, str(path))
    assert header.line() == "f32,4" and not header.binary
    with pytest.raises(Exception, match="truncated|invalid"):
        path.write_text("f32,4\n12 : [ 1.5, 2, 3 ]\n")
        vecfile.read_vectors(spark, str(path))[1].collect()
    for text, message in (("f32,4\n12 : 1, 2 ]\n", r"missing '\['"), ("f32,4\n12 : [ 1, 2\n", r"missing '\]'"), ("f64,4\n", "unknown element"), ("f32,4,zip\n", "unknown mode"), ("f32,3\n", "dim"), ("f32,4\n-2 : [ 1, 2, 3, 4 ]\n", "id must")):
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            vecfile.read_vectors(spark, str(path))[1].collect()
    path.write_text("f32,4\n1 : [ 1, 2, 3, 4 ]\n2 : [ 5, 6, 7, 8 ]\n")
    engine.create("a")
    engine.load_file(str(path))
    path.write_text("f32,4\n1 : []\n2 : [ 9, 9, 9, 9 ]\n")
    engine.load_file(str(path))
    assert [r["line"] for r in engine.lines().collect()] == ["2 : [ 9, 9, 9, 9 ]"]
    vecfile.write_text(engine.open_dataset.rows(), str(tmp_path / "out"), Element.f32, 4)
    assert [tuple(r) for r in vecfile.read_text(spark, str(tmp_path / "out"))[1].select("id", "vec").collect()] == [(2, [9.0] * 4)]
    assert vecfile.has_ids(rows.limit(0), 1, 1) is False


def test_binary_files(engine, spark, tmp_path):
    path = tmp_path / "v.bin"
    for kind in ("f32", "f16", "i16"):
        body = vecfile.pack_records([5, 6], [[1, 2, 3, 4], [5, 6, 7, 8]], Element(kind))
        path.write_bytes(f"{kind},4,bin\n".encode() + body)
        header, rows = vecfile.read_vectors(spark, str(path))
        assert header.binary and sorted((r["id"], [float(x) for x in r["vec"]]) for r in rows.collect()) == [(5, [1.0, 2.0, 3.0, 4.0]), (6, [5.0, 6.0, 7.0, 8.0])]
    path.write_bytes(b"i16,4,bin\n" + body[:-1])
    with pytest.raises(Exception, match="truncated"):
        vecfile.read_vectors(spark, str(path))[1].collect()
    engine.create("a")
    with pytest.raises(EngineError, match="type"):
        engine.load_file(str(path))


def walked(count, dim, max_val, every=0):
    """The detailed pattern step by step."""
    vec, col, out = [0] * dim, 0, []
    for i in range(count):
        if every and i > 0 and i % every == 0:
            out.append(None)
            continue
        out.append(list(vec))
        if col >= dim:
            col, vec = 0, [0] * dim
        else:
            vec[col] += 1
            if vec[col] == max_val:
                col += 1
    return out


@pytest.mark.parametrize("every", [0, 3])
def test_detailed_generator(spark, every):
    rows = generate.generate(spark, 70, 5, generate.DETAILED, 4, "i16", max_val=6, every_n_deleted=every).orderBy("id").collect()
    assert [None if r["vec"] is None else list(r["vec"]) for r in rows] == walked(70, 4, 6, every)
    f = generate.generate(spark, 5, 0, generate.DETAILED, 4, "f32", max_val=0.025).orderBy("id").collect()
    assert [[round(x, 2) for x in r["vec"]] for r in f] == [[0, 0, 0, 0], [0.01, 0, 0, 0], [0.02, 0, 0, 0], [0.03, 0, 0, 0], [0.03, 0.01, 0, 0]]


def test_generators(engine, spark):
    s = generate.generate(spark, 6, 10, generate.SEQUENTIAL, 4, "f32", every_n_deleted=2).orderBy("id").collect()
    assert [r["op"] for r in s] == ["U", "U", "D", "U", "D", "U"] and round(s[1]["vec"][3], 3) == 11.1
    m = generate.manual(spark, [(3, True), (4, False)], 4, "i16").orderBy("id").collect()
    assert list(m[0]["vec"]) == [3] * 4 and m[1]["vec"] is None
    assert list(generate.generate(spark, 1, 40000, 0, 4, "i16").first()["vec"]) == [40000 - 65536] * 4
    with pytest.raises(EngineError):
        generate.generate(spark, 5, 0, 0, 4, "f32", every_n_deleted=2, binary=True)
    engine.create("a", range_size=100, dist_func="l2")
    engine.generate_bin(250)
    assert len(engine.open_dataset.store.manifest().base) == 3 and engine.knn("9.5 9.5 9.5 9.5", 3) == [9, 10, 8]


def test_streaming_ingest(engine, spark, tmp_path):
    d = engine.create("a")
    source = tmp_path / "ops"
    schema = "id long, vec array<float>, op string, seq long"
    first = [(i, [float(i)] * 4, "U", i) for i in range(30)] + [(3, None, "D", 99), (4, [44.0] * 4, "U", 99)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        ingest(d, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert d.get(4) == [44.0] * 4 and d.get(3) is None and len(live(engine)) == 29
    version = d.store.manifest().number
    spark.createDataFrame([(5, None, "D", 100)], schema).coalesce(1).write.mode("append").parquet(str(source))
    ingest(d, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert len(live(engine)) == 28 and d.store.manifest().number == version + 1


def test_stats_and_shell(engine, spark, capsys):
    from vespera.shell import Shell

    shell = Shell(engine)
    for line in ("create s dim=4 dist_func=l1", "gen 20 0 0", "ups2 50 7.5", "del 3", "stats", "macc", "knn 2 7.5 7.5 7.5 7.5", "get 50", "nonsense", "mdelta", "print", "close s"):
        assert shell.onecmd(line) is False
    out = capsys.readouterr().out
    assert '"vectors": 1' in out and "[50, 7]" in out and "[ 7.5, 7.5, 7.5, 7.5 ]" in out and "unknown command" in out and "3 : [" not in out.replace("13 : [", "")
    assert Store(spark, engine.root, "s").exists()


def test_lifecycle_keeps_results(engine, spark):
    engine.create("a", range_size=200, dist_func="l2")
    engine.generate(1000)
    for r in range(3):
        new = [(1000 + 40 * r + i, None) for i in range(40)]
        engine.open_dataset.load(table(spark, [*new, *((i, i + 0.5) for i in range(20 * r, 20 * r + 20))], [500 + 10 * r + i for i in range(10)]))
    before = [engine.knn([float(q)] * 4, 5) for q in (10, 505, 1050)]
    engine.merge_delta()
    assert before == [engine.knn([float(q)] * 4, 5) for q in (10, 505, 1050)]
    assert len(live(engine)) == 1000 + 120 - 30
    assert engine.ids_of([10.5] * 4).collect()[0]["id"] == 10


def test_binary_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(1000)}
    for n, part in enumerate((range(0, 1), range(1, 700), range(700, 1000))):
        (tmp_path / f"{n}.bin").write_bytes(b"f32,6,bin\n" + vecfile.pack_records(list(part), [vectors[i] for i in part], Element.f32))
    (tmp_path / "empty.bin").write_bytes(b"f32,6,bin\n")
    for size in (1, 999, 64 << 20):
        header, rows = vecfile.read_binary(spark, f"file://{tmp_path}", range_bytes=size)
        assert header.dim == 6 and {r["id"]: list(r["vec"]) for r in rows.collect()} == vectors
    (tmp_path / "short.bin").write_bytes(b"f32,6,bin\nabc")
    with pytest.raises(Exception, match="truncated binary record"):
        vecfile.read_binary(spark, f"file://{tmp_path}")[1].collect()


def test_binary_files_over_two_gigabytes(spark, tmp_path):
    dim = 4096
    size = 8 + 4 * dim
    n = (2_300_000_000 // size) + 1
    with open(tmp_path / "large.bin", "wb") as f:  # sparse: all but the last record are zeros with id 0
        f.write(b"f32,4096,bin\n")
        f.seek(13 + (n - 1) * size)
        f.write(vecfile.pack_records([77], [[1.0] * dim], Element.f32))
    header, rows = vecfile.read_vectors(spark, f"file://{tmp_path}/large.bin")
    assert header.dim == dim and rows.where("id > 0").select("id").collect() == [(77,)] and rows.select("id").count() == n


def test_headers_of_large_text_files(spark, tmp_path):
    with open(tmp_path / "large.txt", "wb") as f:
        f.write(b"i16,4\n5 : [ 1, 2, 3, 4 ]\n")
        f.truncate(3_000_000_000)
    assert vecfile.read_header(spark, f"file://{tmp_path}/large.txt").dim == 4


def test_one_of_several_writers_publishes(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}")
    path = f"file://{tmp_path}/1.json"
    assert files.write(path, "one") and not files.write(path, "two") and files.read(path) == "one"
    assert sorted(n for n in files.names(f"file://{tmp_path}") if not n.startswith(".")) == ["1.json"]
    assert files.create(f"file://{tmp_path}/own") and not files.create(f"file://{tmp_path}/own")


def test_lock_is_freed_with_its_process(spark, engine, tmp_path):
    import subprocess
    import sys

    engine.create("a")
    path = engine.dataset.lock.local
    code = f"import fcntl, os, sys; f = os.open({path!r}, os.O_RDWR | os.O_CREAT); fcntl.flock(f, fcntl.LOCK_EX); print('held', flush=True); sys.stdin.read()"
    other = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    assert other.stdout.readline() == b"held\n"
    with pytest.raises(EngineError, match="another writer"):
        engine.upsert(1, [1.0] * 4)
    other.kill()
    other.wait()
    engine.upsert(1, [1.0] * 4)


def test_sql_follows_the_dataset(engine):
    engine.create("a", dist_func="cos")
    load(engine, engine.spark, [1, 2, 3])
    count = lambda: engine.sql("SELECT count(*) FROM a").first()[0]
    assert count() == 3
    engine.ups2(9, 9.0)
    assert count() == 3
    engine.merge_accumulator()
    assert count() == 4
    near = "SELECT id FROM knn_a_bits(array(1f, 1f, 1f, 1f), {}, 5)"
    assert [r["id"] for r in engine.sql(near.format("X'0602'")).collect()] == [1, 2, 9] and engine.sql(near.format("X''")).count() == 0 and engine.sql(near.format("null")).count() == 4


def test_ranges_lie_in_several_dirs(spark, tmp_path):
    dirs = [f"file://{tmp_path}/d{i}" for i in range(3)]
    with Engine(spark, f"file://{tmp_path}/root") as e:
        d = e.create("a", range_size=11, dirs=dirs)
        load(e, spark, range(100))
        assert [len(list((tmp_path / f"d{i}/a/data").glob("version=*/kind=base/file_id=*"))) for i in range(3)] == [4, 3, 3]
        e.ups2(50, 0.5)
        d.flush()
        e.merge_delta()
        d.store.vacuum()
        assert d.get(50) == [0.5] * 4 and d.get(99) is not None and d.rows().count() == 100
        e.drop("a")
        assert not any((tmp_path / f"d{i}/a/data").exists() for i in range(3))


def test_binary_files_written(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: (F.col("id") * j).cast("smallint")).alias("vec"))
    path = f"file://{tmp_path}/packed"
    vecfile.write_binary(rows, path, Element.i16, 5)
    header, back = vecfile.read_vectors(spark, path)
    assert (header.element, header.dim, header.binary) == (Element.i16, 5, True)
    assert sorted((r["id"], r["vec"]) for r in back.collect()) == sorted((r["id"], r["vec"]) for r in rows.collect())
    assert not [f for f in (tmp_path / "packed").iterdir() if f.name[0] == "_"]
    with pytest.raises(EngineError, match="path exists"):
        vecfile.write_binary(rows, path, Element.i16, 5)
    empty = f"file://{tmp_path}/none"
    vecfile.write_binary(rows.where("false"), empty, Element.i16, 5)
    assert vecfile.read_vectors(spark, empty)[1].count() == 0
    with pytest.raises(Exception, match="no deletes"):
        vecfile.write_binary(rows.withColumn("vec", F.when(F.col("id") != 3, F.col("vec"))), f"file://{tmp_path}/gone", Element.i16, 5)


def test_read_only_and_visible_query(engine, spark):
    d = engine.create("a", dist_func="l2")
    load(engine, spark, range(20))
    for text in ("insert into a values (1, null)", " UPDATE `a` SET id = 1", "delete from A where id = 1", "TRUNCATE TABLE a", "MERGE INTO a USING b ON true WHEN MATCHED THEN DELETE"):
        with pytest.raises(EngineError, match="read-only"):
            engine.sql(text)
    assert engine.sql("SELECT count(*) AS n FROM a").first()["n"] == 20
    found = d.knn("3 3 3 3", 2, show=True).collect()
    assert [(r["id"], r["query"], r["k"]) for r in found] == [(3, "3 3 3 3", 2), (2, "3 3 3 3", 2)]
    assert d.knn([3.0] * 4, 1, show=True).first()["query"] == "[ 3, 3, 3, 3 ]"
