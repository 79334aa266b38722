"""The append-only download log as a sink of streams: a batch that is run again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json
from ..sources.archive import LOG, addressed, header, with_ids

#: What a download is known by before it has an id; ``params`` is JSON text, ``headers`` a map of texts.
DOWNLOAD = "endpoint string, season int, params string, requested_at string, received_at string, content binary, http_status int, source_url string, headers map<string,string>"


def log_rows(downloads: DataFrame, schema_version: str = "v1") -> DataFrame:
    """Downloads as rows of the log, without ids: parameters in canonical form, hash, length and path of the payload, and the
    headers ``ETag``, ``Last-Modified`` and ``X-Request-Id`` whatever their case. Null headers and parameters are empty."""
    t = addressed(downloads, "content")
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    t = t.withColumns(
        {
            "params_json": F.coalesce(canonical_json(F.col("params")), F.lit("{}")),
            "etag": header(headers, "ETag"),
            "last_modified": header(headers, "Last-Modified"),
            "request_id": header(headers, "X-Request-Id"),
            "schema_version": F.lit(schema_version),
        }
    )
    return t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG.fields if f.name != "id"])


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All rows of finished batches: the log's columns, ``stream``, ``batch`` and ``offset`` (the place in the batch)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG.fields)
    where, fs = _path(spark, root)
    if not fs.exists(where):
        return spark.createDataFrame([], f"{schema}, offset long, stream string, batch long")
    return spark.read.schema(f"{schema}, offset long, stream string, batch long").parquet(root)


def append(downloads: DataFrame, batch: int, root: str, stream: str = "downloads", order: tuple[str, ...] = ("requested_at", "endpoint", "params_json", "sha256")) -> bool:
    """Add a batch to the log at ``root``; false, and nothing is written, if the log has it already.

    Rows are numbered in ``order``, in sorted ranges, from the last id of the log on. A batch becomes visible as a whole when
    its folder is finished; what a broken attempt left is written anew. Batches of a stream come one after the other, as
    Structured Streaming has it; a log has one writer at a time.
    """
    spark = downloads.sparkSession
    folder = f"{root}/stream={stream}/batch={batch}"
    where, fs = _path(spark, f"{folder}/_SUCCESS")
    if fs.exists(where):
        return False
    last = read_log(spark, root).where((F.col("stream") != stream) | (F.col("batch") != batch)).agg(F.max("id")).first()[0] or 0
    rows = with_ids(log_rows(downloads), list(order), last + 1).withColumn("offset", F.col("id") - (last + 1))
    rows.select(*[f.name for f in LOG.fields], "offset").write.mode("overwrite").parquet(folder)
    return True


def sink(root: str, stream: str = "downloads") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: appends each micro-batch of ``DOWNLOAD`` rows once, whatever is run again after a
    failure. The batch id that Spark gives is the key."""

    def run(rows: DataFrame, batch: int) -> None:
        append(rows, batch, root, stream)

    return run


def utc_millis(time: Column) -> Column:
    """A time as ISO text in UTC with milliseconds, as the log has them."""
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))
    return F.concat(F.date_format(zoned, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def utc_now() -> Column:
    """When the query started, as ``utc_millis``."""
    return utc_millis(F.current_timestamp())
