import pytest
from pyspark.sql import functions as F

from keelson.operators.gates import GateError
from keelson.sources import archive, publish, tables

SCHEMA = "k long, a string, x double, l array<string>, m map<string,int>, b binary"
ROWS = [(1, "x", 1.5, ["p", None], {"u": 1}, bytearray(b"\x00")), (2, None, None, None, None, None), (3, "", 0.0, [], {}, bytearray()), (3, "", 0.0, [], {}, bytearray())]


def test_fingerprint_knows_rows_not_their_order(spark):
    t = spark.createDataFrame(ROWS, SCHEMA)
    lock = publish.lock_of(t)
    assert publish.lock_of(t.repartition(3, "k").select("b", "m", "l", "x", "a", "k")) == lock
    publish.require_lock(t.orderBy(F.desc("k")), lock)
    for changed in (t.withColumn("a", F.coalesce("a", F.lit(""))), t.dropDuplicates(["k"]), t.withColumn("x", F.when(F.col("k") == 1, 1.6).otherwise(F.col("x"))), t.withColumnRenamed("a", "c"), t.union(t)):
        with pytest.raises(GateError):
            publish.require_lock(changed, lock)
    assert publish.lock_of(t.limit(0)) == "0:0:0"


def test_cells_do_not_run_together(spark):
    one, two = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    three = spark.createDataFrame([("1:xb=", "y")], "a string, b string")
    assert len({publish.lock_of(t) for t in (one, two, three)}) == 3


def good(spark, n=20):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, F.lit("b")).otherwise(F.lit("a")).alias("g"), (F.col("id") * 2).alias("v"))


def test_a_broken_gate_publishes_nothing(spark, tmp_path):
    root, name = str(tmp_path), "checked.t"
    gates = {"rows": 20, "conditions": {"v": F.col("v") >= 0}, "groups": ("g", {"a": 15, "b": 5}), "root": root}
    found = publish.publish_checked(good(spark), name, "k", **gates)
    assert found["n_rows"] == 20 and found["group_a"] == 15 and spark.table(name).count() == 20
    publish.require_published(spark, name)
    broken = [
        good(spark, 21), good(spark).withColumn("v", F.when(F.col("k") != 7, F.col("v"))), good(spark).withColumn("g", F.lit("a")),
        good(spark).withColumn("g", F.when(F.col("k") > 0, F.col("g"))), good(spark).withColumn("k", F.when(F.col("k") > 0, F.col("k"))),
        good(spark).withColumn("k", F.greatest("k", F.lit(1))), good(spark, 0),
    ]
    for t in broken:
        with pytest.raises(GateError):
            publish.publish_checked(t, name, "k", **gates)
        assert spark.table(name).agg(F.sum("v")).first()[0] == 380
    assert len(list((tmp_path / "published" / name).iterdir())) == 1
    publish.publish_checked(good(spark).withColumn("v", F.col("v") + 1), name, "k", **gates)
    assert spark.table(name).agg(F.sum("v")).first()[0] == 400
    publish.require_published(spark, name)


def test_a_published_table_that_was_changed_is_refused(spark, tmp_path):
    publish.publish_checked(good(spark), "checked.u", "k", root=str(tmp_path))
    folder = next((tmp_path / "published" / "checked.u").iterdir())
    good(spark, 1).write.mode("append").parquet(str(folder))
    spark.catalog.refreshTable("checked.u")
    with pytest.raises(GateError):
        publish.require_published(spark, "checked.u")


def test_counts_are_taken_during_the_write(spark, tmp_path):
    """One job over the input, told by how often a row of it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = good(spark).mapInArrow(count, "k long, g string, v long")
    publish.publish_checked(t, "checked.w", "k", rows=20, conditions={"v": F.col("v") >= 0}, root=str(tmp_path))
    assert seen.value == 20


def test_locked_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "b.json").write_text("[2]")
    hashes = archive.file_hashes(spark, f"{tmp_path}/*.json")
    locked = {r.name: r.sha256 for r in hashes.collect()}
    publish.require_file_hashes(hashes, locked)
    for bad in ({**locked, "a.json": "0"}, {**locked, "c.json": "0"}, {"a.json": locked["a.json"]}):
        with pytest.raises(GateError):
            publish.require_file_hashes(hashes, bad)


def test_payloads_keep_their_shape(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"a": {"b": [1, null, "x"]}, "n": 2.5}, {"a": null, "z": "é"}]')
    t = tables.read_payloads(spark, str(tmp_path / "p.json"))
    rows = [r[0] for r in t.select(F.to_json("payload")).collect()]
    assert rows == ['[{"a":{"b":[1,null,"x"]},"n":2.5},{"a":null,"z":"é"}]']


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,c\n1,2.5,x\n,3,\n")
    t = tables.read_typed_csv(spark, str(tmp_path / "t.csv"), "a double, b int")
    assert t.dtypes == [("a", "double"), ("b", "int")] and [tuple(r) for r in t.collect()] == [(2.5, 1), (3.0, None)]
    assert dict(tables.read_typed_csv(spark, str(tmp_path / "t.csv")).dtypes) == {"b": "int", "a": "double", "c": "string"}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_typed_csv(spark, str(tmp_path / "t.csv"), "c int").collect()
