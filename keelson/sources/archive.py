"""A content-addressed store of payloads with an append-only download log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import materialize

# The endpoints that can be ingested.
ENDPOINTS = ("portal", "roster", "player_stats", "returning", "team_stats", "records")

LOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False), T.StructField("endpoint", T.StringType(), False),
        T.StructField("season", T.IntegerType()), T.StructField("params_json", T.StringType(), False),
        T.StructField("requested_at", T.StringType()), T.StructField("received_at", T.StringType()),
        T.StructField("sha256", T.StringType(), False), T.StructField("byte_count", T.LongType()),
        T.StructField("object_path", T.StringType()), T.StructField("http_status", T.IntegerType()),
        T.StructField("source_url", T.StringType()), T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.StringType()), T.StructField("request_id", T.StringType()),
        T.StructField("schema_version", T.StringType()),
    ]
)


def object_path(sha: Column, suffix: str = ".json") -> Column:
    return F.concat(F.lit("objects/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(suffix))


def addressed(payloads: DataFrame, content: str) -> DataFrame:
    """``sha256``, ``byte_count``, ``object_path`` of each payload (text as UTF-8)."""
    raw = F.col(content).cast("binary")
    t = payloads.withColumns({"sha256": F.sha2(raw, 256), "byte_count": F.octet_length(raw).cast("long")})
    return t.withColumn("object_path", object_path(F.col("sha256")))


def objects(payloads: DataFrame, content: str) -> DataFrame:
    """One row per different payload: what a store holds after any number of identical downloads."""
    t = addressed(payloads, content)
    return t.groupBy("sha256").agg(F.first("byte_count").alias("byte_count"), F.first("object_path").alias("object_path"), F.count("*").alias("n_downloads"))


def store(payloads: DataFrame, content: str, root: str) -> None:
    """Add payloads that the store doesn't have yet, partitioned by the first two digits of the hash.

    Files of a failed or repeated task are never visible: Spark's committer publishes whole tasks.
    """
    spark = payloads.sparkSession
    new = addressed(payloads, content).select("sha256", "byte_count", F.col(content).cast("binary").alias("content"))
    new = new.dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    try:
        old = spark.read.parquet(root).select("sha256")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(old, "sha256", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(root)


def canonical_params(params: Mapping[str, object] | None) -> str:
    return json.dumps({k: v for k, v in (params or {}).items() if v is not None}, sort_keys=True, separators=(",", ":"))


def header(headers: Column, name: str) -> Column:
    """A header of a map column, whatever its case."""
    found = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(found), F.lit(1))


def latest(log: DataFrame, by: list[str], value: str = "object_path", order: str = "id") -> DataFrame:
    """The newest value per key."""
    return log.groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def latest_object(log: DataFrame, endpoint: str, season: int | None = None, params: Mapping[str, object] | None = None) -> DataFrame:
    """The newest entry of an endpoint; season and exact parameters are filters only where given. Filters reach the scan."""
    t = log.where(F.col("endpoint") == endpoint)
    if season is not None:
        t = t.where(F.col("season") == season)
    if params is not None:
        t = t.where(F.col("params_json") == canonical_params(params))
    return t.orderBy(F.col("id").desc()).limit(1)


def with_ids(entries: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Numbers entries in order, from ``first``.

    Sorted ranges are written with each row's place in its range; a range then starts where the ones before it end, so
    only one number per range meets in a task, however long the log.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = entries.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # The upper bits of _at are the range, the lower 33 the place in it.
    rows = materialize(ranges, "log").withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "_range").withColumn("id", F.col("_start") + place + first).drop("_range", "_start", "_at")


def parsed_params(log: DataFrame, schema: str = "map<string,string>") -> DataFrame:
    """``params_json`` as a nested column ``params``, in log order. As ``variant`` it needs no schema: numbers, nested values
    and nulls stay what they are, and are read with ``F.variant_get``."""
    value = F.parse_json("params_json") if schema == "variant" else F.from_json("params_json", schema)
    return log.withColumn("params", value).drop("params_json").orderBy("id")


def valid_root(payload: Column) -> Column:
    """Whether a payload is JSON whose root is a list or an object."""
    return F.coalesce(F.trim(payload).rlike(r"^[\[{]"), F.lit(False)) & F.get_json_object(payload, "$").isNotNull()


def ingest(spark: SparkSession, endpoint: str, fetch: Callable[[str, dict], bytes], season: int | None = None, params: Mapping[str, object] | None = None) -> DataFrame:
    """Fetch one payload on the driver (the transport is the caller's) and give it as a row; unknown endpoints and roots that
    are neither list nor object are refused."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint: {endpoint}")
    asked = {k: v for k, v in {"year": season, **(params or {})}.items() if v is not None}
    payload = fetch(endpoint, asked)
    if not isinstance(json.loads(payload), list | dict):
        raise ValueError("the payload's root is neither a list nor an object")
    row = [(endpoint, season, canonical_params(asked), bytearray(payload))]
    return addressed(spark.createDataFrame(row, "endpoint string, season int, params_json string, content binary"), "content")


def ingest_all(requests: DataFrame, fetch: Callable[[str, dict], bytes]) -> DataFrame:
    """Fetch one payload for each row of ``endpoint``, ``season``, ``params_json`` (JSON text or null), in tasks: payloads
    never pass through the driver, and a lost task fetches its own again. ``fetch`` (the transport is the caller's) gets
    the endpoint and its parameters. Unknown endpoints and payloads whose root is neither list nor object fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["endpoint"] not in ENDPOINTS:
                    raise ValueError(f"unknown endpoint: {row['endpoint']}")
                asked = {"year": row["season"], **json.loads(row["params_json"] or "{}")}
                row["params_json"] = canonical_params(asked)
                row["content"] = bytes(fetch(row["endpoint"], {k: v for k, v in asked.items() if v is not None}))
                if not isinstance(json.loads(row["content"]), list | dict):
                    raise ValueError("the payload's root is neither a list nor an object")
                # A payload at a time, as each may be large.
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("endpoint", pa.string()), ("season", pa.int32()), ("params_json", pa.string()), ("content", pa.binary())]))

    rows = requests.select("endpoint", F.col("season").cast("int"), "params_json")
    return addressed(rows.mapInArrow(run, "endpoint string, season int, params_json string, content binary"), "content")


def ingest_seasons(spark: SparkSession, endpoint: str, fetch: Callable[[str, dict], bytes], start: int, end: int, params: Mapping[str, object] | None = None) -> DataFrame:
    """One payload for each season of a range, each fetched in a task of its own (``ingest_all``); a range that ends before it
    starts, and unknown endpoints, are refused."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint: {endpoint}")
    if end < start:
        raise ValueError("the last season is before the first")
    years = spark.range(start, end + 1, 1, end + 1 - start).select(F.lit(endpoint).alias("endpoint"), F.col("id").cast("int").alias("season"), F.lit(canonical_params(params)).alias("params_json"))
    return ingest_all(years, fetch)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of files."""
    t = spark.read.format("binaryFile").load(path)
    return t.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_count"))
