"""Publishing a table in one pass: it is written, counted, checked and locked, and only then seen."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import GateError
from .scratch import shared_dir

LOCK = "keelson.fingerprint"  #: the table property that keeps a lock


def _text(name: str, kind: T.DataType) -> Column:
    """A cell as text that tells null, an empty text and neighbouring cells apart."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        c = F.hex(c)
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType):
        c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    else:
        c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two numbers of 60 bits for each row, from the SHA-256 of its columns in order of their names."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    sha = F.sha2(F.concat(*[F.concat(F.lit(f"{f.name}="), _text(f.name, f.dataType)) for f in fields], F.lit("")), 256)
    return tuple(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def _sums(df: DataFrame) -> list[Column]:
    a, b = row_hashes(df)
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.count("*").alias("n_rows"), *[F.coalesce(F.sum(c).cast("decimal(38,0)"), zero).cast("string").alias(n) for c, n in ((a, "sum_a"), (b, "sum_b"))]]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``n_rows``, ``sum_a``, ``sum_b``: equal for equal rows with equal column names in any order and layout of rows
    and columns, repeated rows counted. Sums are partial before they meet, so the table is read once and not shuffled."""
    return df.agg(*_sums(df))


def lock_of(df: DataFrame) -> str:
    return ":".join(map(str, fingerprint(df).first()))


def require_lock(df: DataFrame, lock: str) -> DataFrame:
    """Refuses a table that isn't the locked one."""
    if (found := lock_of(df)) != lock:
        raise GateError(f"the table's fingerprint is {found}, not {lock}")
    return df


def require_published(spark: SparkSession, table: str) -> DataFrame:
    """A published table, if it still is what its lock says; refused without a lock."""
    found = [r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key == LOCK]
    if not found:
        raise GateError(f"{table} has no lock")
    return require_lock(spark.table(table), found[0])


def require_file_hashes(hashes: DataFrame, locked: dict[str, str]) -> None:
    """Refuses files (``name``, ``sha256``, as of ``archive.file_hashes``) that aren't exactly the locked ones."""
    found = {r.name: r.sha256 for r in hashes.where(F.col("name").isin(list(locked))).collect()}
    more = hashes.where(~F.col("name").isin(list(locked))).select("name").limit(1).collect()
    if bad := {n: found.get(n) for n in locked if found.get(n) != locked[n]} | {r.name: "not locked" for r in more}:
        raise GateError(f"files differ from the locked ones: {bad}")


def write_observed(df: DataFrame, path: str, conditions: dict[str, Column] | None = None, groups: tuple[str, list] | None = None, key: str | None = None) -> dict:
    """Write ``df`` and give what was counted on the way: the fingerprint, ``null_keys``, ``broken_<name>`` for each condition
    (null is broken) and ``group_<value>`` for each value of the column in ``groups``, ``group_others`` for all else."""
    counts = [F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(f"broken_{n}") for n, c in (conditions or {}).items()]
    if key:
        counts.append(F.coalesce(F.sum(F.col(key).isNull().cast("long")), F.lit(0)).alias("null_keys"))
    if groups:
        by, values = groups
        counts += [F.coalesce(F.sum(F.col(by).eqNullSafe(F.lit(v)).cast("long")), F.lit(0)).alias(f"group_{v}") for v in values]
        known = F.coalesce(F.col(by).isin(values), F.lit(False))
        counts.append(F.coalesce(F.sum((~known).cast("long")), F.lit(0)).alias("group_others"))
    seen = Observation(f"publish-{uuid.uuid4().hex}")
    df.observe(seen, *_sums(df), *counts).write.mode("overwrite").parquet(path)
    return seen.get


def publish_checked(df: DataFrame, table: str, key: str, rows: int | None = None, conditions: dict[str, Column] | None = None,
                    groups: tuple[str, dict[str, int]] | None = None, root: str | None = None) -> dict:
    """Publish ``df`` as ``table`` (``schema.name``) if all gates hold; else ``GateError``, and what was published stays.

    The rows are read and written once, into a folder of their own; row count, null keys, ``conditions``, the locked counts
    of ``groups`` (a column and the rows of each of its values; other values are refused) and the lock are counted during
    that write. Only repeated keys need a shuffle: of the written key column, pre-aggregated. Then the table's location is
    set to the new folder. The lock is kept as a property of the table. Returns the counts.
    """
    spark = df.sparkSession
    folder = f"{(root or shared_dir(spark)).rstrip('/')}/published/{table}/{uuid.uuid4().hex}"
    found = write_observed(df, folder, conditions, (groups[0], list(groups[1])) if groups else None, key)
    bad = {k: v for k, v in found.items() if (k.startswith("broken_") or k == "null_keys") and v}
    if rows is not None and found["n_rows"] != rows:
        bad["n_rows"] = found["n_rows"]
    for value, n in (groups[1] if groups else {}).items():
        if found[f"group_{value}"] != n:
            bad[f"group_{value}"] = found[f"group_{value}"]
    if groups and found["group_others"]:
        bad["group_others"] = found["group_others"]
    written = spark.read.schema(df.schema).parquet(folder)
    if not bad and written.groupBy(key).count().where("count > 1").limit(1).count():
        bad["repeated_keys"] = True
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if bad:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        raise GateError(f"contract broken: {bad}")
    lock = f"{found['n_rows']}:{found['sum_a']}:{found['sum_b']}"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    if spark.catalog.tableExists(table) and spark.table(table).schema == written.schema:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, path=folder, source="parquet", schema=written.schema)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{LOCK}' = '{lock}')")
    return found
