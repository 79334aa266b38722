import json

import pytest
from pyspark.sql import functions as F

from keelson.functions.scalars import ascii_json, canonical_json
from keelson.sources import archive
from keelson.streaming import log

PARAMS = ['{"b": 1, "a": {"d": null, "c": [1, 2.5, "x"]}}', '{"name": "Zoë 漢 😀", "q": "a\\"b"}', "{}", None]


def downloads(spark, n, start=0):
    rows = [
        (["portal", "roster"][i % 2], 2020 + i % 3, PARAMS[i % 4], f"t{i:04}", None, bytearray(b"[%d]" % (i % 5)), 200, "u", {"etag": f"e{i}", "LAST-modified": "m"} if i % 3 else None)
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, log.DOWNLOAD)


def contents(spark, root):
    return sorted(map(repr, log.read_log(spark, root).collect()))


def test_json_is_canonical(spark):
    got = [r[0] for r in spark.createDataFrame([(p,) for p in PARAMS], "p string").select(canonical_json(F.col("p"))).collect()]
    assert got == [None if p is None else json.dumps(json.loads(p), sort_keys=True, separators=(",", ":")) for p in PARAMS]
    text = "".join(map(chr, [*range(32, 300), 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]))
    assert spark.createDataFrame([(text,)], "t string").select(ascii_json(F.col("t"))).first()[0] == text.encode("ascii", "backslashreplace").decode().replace("\\x", "\\u00").replace(
        "\\U00010000", "\\ud800\\udc00"
    ).replace("\\U0010ffff", "\\udbff\\udfff")


def test_a_batch_that_is_run_twice_leaves_the_log_unchanged(spark, tmp_path):
    root = str(tmp_path / "log")
    assert log.read_log(spark, root).count() == 0
    assert log.append(downloads(spark, 20), 0, root)
    first = contents(spark, root)
    assert not log.append(downloads(spark, 20), 0, root) and contents(spark, root) == first
    assert log.append(downloads(spark, 15, 20), 1, root) and log.append(downloads(spark, 5, 50), 0, root, "other")
    rows = sorted(log.read_log(spark, root).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(1, 41)) and [r.offset for r in rows] == [*range(20), *range(15), *range(5)]
    assert rows[1].etag == "e1" and rows[1].last_modified == "m" and rows[0].etag is None and rows[1].params_json == json.dumps(json.loads(PARAMS[1]), sort_keys=True, separators=(",", ":"))
    assert rows[3].params_json == "{}" and rows[7].byte_count == 3 and rows[7].object_path.startswith("objects/")
    assert archive.latest_object(log.read_log(spark, root), "roster", 2020).first().id == max(r.id for r in rows if r.endpoint == "roster" and r.season == 2020)


def test_a_broken_batch_is_written_anew(spark, tmp_path):
    root = str(tmp_path / "log")
    log.append(downloads(spark, 4), 0, root)
    log.append(downloads(spark, 6, 4), 1, root)
    good = contents(spark, root)
    (tmp_path / "log" / "stream=downloads" / "batch=1" / "_SUCCESS").unlink()
    assert log.append(downloads(spark, 6, 4), 1, root) and contents(spark, root) == good


def test_stream_into_the_log(spark, tmp_path):
    """Two runs of a stream with the same checkpoint, and one with a lost checkpoint, whose batches the log has already."""
    root, source = str(tmp_path / "log"), str(tmp_path / "in")

    def run(checkpoint):
        stream = spark.readStream.schema(log.DOWNLOAD).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(log.sink(root)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    downloads(spark, 10).coalesce(1).write.mode("append").parquet(source)
    run("a")
    downloads(spark, 7, 10).coalesce(1).write.mode("append").parquet(source)
    run("a")
    rows = log.read_log(spark, root).collect()
    assert sorted(r.id for r in rows) == list(range(1, 18)) and sorted({r.batch for r in rows}) == [0, 1]
    run("b")
    assert log.read_log(spark, root).count() == 17


def test_utc_now_has_milliseconds(spark):
    now = spark.range(1).select(log.utc_now().alias("t")).first().t
    assert len(now) == 24 and now[10] == "T" and now.endswith("Z")


def test_payloads_are_fetched_in_tasks(spark):
    got = archive.ingest_seasons(spark, "roster", lambda e, p: json.dumps({"e": e, **p}).encode(), 2020, 2023, {"team": "X", "no": None})
    rows = sorted((r.season, r.params_json, bytes(r.content)) for r in got.collect())
    assert [r[0] for r in rows] == [2020, 2021, 2022, 2023] and rows[0][1] == '{"team":"X","year":2020}' and json.loads(rows[0][2]) == {"e": "roster", "team": "X", "year": 2020}
    assert got.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="neither a list nor an object"):
        archive.ingest_seasons(spark, "roster", lambda e, p: b"3", 2020, 2020).collect()
    with pytest.raises(ValueError):
        archive.ingest_seasons(spark, "nope", lambda e, p: b"[]", 2020, 2020)
