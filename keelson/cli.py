"""Commands. Each starts or joins a Spark session; its master and resources are those of ``spark-submit``."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import flow
from .operators import audit, resolve
from .sources import archive, tables
from .sources.scratch import materialize, workspace
from .streaming import log


def _transport(name: str) -> Callable[[str, dict], bytes]:
    """``module:function`` that fetches a payload."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keelson")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="archive an endpoint's payloads for a range of seasons")
    c.add_argument("endpoint", choices=sorted(archive.ENDPOINTS))
    c.add_argument("--start", type=int, required=True)
    c.add_argument("--end", type=int, required=True)
    c.add_argument("--team")
    c.add_argument("--root", required=True)
    c.add_argument("--transport", required=True, help="module:function that takes an endpoint and parameters and gives bytes")
    c = sub.add_parser("resolve", help="resolve entries to roster rows")
    c.add_argument("--portal", required=True)
    c.add_argument("--roster", required=True)
    c.add_argument("--output", required=True)
    c = sub.add_parser("land", help="load files as the tables of a schema")
    for name in ("portal", "roster", "stats", "schema"):
        c.add_argument(f"--{name}", required=True)
    c = sub.add_parser("run", help="run steps on a schema's tables, all if none are named")
    c.add_argument("steps", nargs="*", choices=[*flow.STEPS, []])
    c.add_argument("--schema", required=True)
    c.add_argument("--years", type=int, nargs="+", required=True, help="holdout years")
    c.add_argument("--season", type=int, required=True, help="the season to be scored")
    c.add_argument("--first", type=int, required=True, help="the first season with statistics two years back")
    c.add_argument("--audit-rows", type=int, default=flow.C.AUDIT_ROWS)
    c = sub.add_parser("precision", help="precision of filled label sheets, weighted by the strata of all resolutions")
    c.add_argument("labels")
    c.add_argument("--schema", required=True)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the last line of its output is JSON."""
    parser = _parser()
    a = parser.parse_args(argv)
    if getattr(a, "end", 0) < getattr(a, "start", 0):
        parser.error("--end must not be before --start")
    spark = spark or SparkSession.builder.appName(f"keelson {a.command}").getOrCreate()
    if a.command == "ingest":
        with workspace(spark):
            found = archive.ingest_seasons(spark, a.endpoint, _transport(a.transport), a.start, a.end, {"team": a.team} if a.team else None)
            # Written, so that each payload is fetched once, for the store and the log.
            found = materialize(found.withColumn("requested_at", log.utc_now()), "downloads")
            archive.store(found, "content", f"{a.root}/objects")
            batch = (log.read_log(spark, f"{a.root}/log").where("stream = 'downloads'").agg(F.max("batch")).first()[0] or 0) + 1
            nothing = F.lit(None)
            rows = found.select(
                "endpoint", "season", F.col("params_json").alias("params"), "requested_at", log.utc_now().alias("received_at"), "content",
                nothing.cast("int").alias("http_status"), nothing.cast("string").alias("source_url"), nothing.cast("map<string,string>").alias("headers"),
            )
            log.append(rows, batch, f"{a.root}/log")
        out = {"endpoint": a.endpoint, "seasons": a.end + 1 - a.start, "batch": batch, "root": a.root}
    elif a.command == "resolve":
        entries = flow.named(flow.load(spark, a.portal), flow.ENTRY)
        entries = entries.withColumn("entry_key", flow.entry_key(entries.columns))
        with workspace(spark):
            tables.write_jsonl(resolve.resolve(entries, flow.named(flow.load(spark, a.roster), flow.ROSTER)), a.output)
        counts = {r.status: r.n for r in spark.read.json(a.output).groupBy("status").agg(F.count("*").alias("n")).collect()}
        out = {"rows": sum(counts.values()), "status_counts": counts, "output": a.output}
    elif a.command == "land":
        flow.save(spark, a.schema, flow.land(*(flow.load(spark, x) for x in (a.portal, a.roster, a.stats))))
        out = {"schema": a.schema}
    elif a.command == "run":
        settings = flow.Settings(tuple(a.years), a.season, a.first, audit_rows=a.audit_rows)
        out = {"schema": a.schema, "rows": flow.run(spark, a.schema, settings, a.steps)}
    else:
        labels = flow.load(spark, a.labels)
        population = spark.table(f"{a.schema}.resolutions").where("status = 'resolved'").groupBy("match_strategy").agg(F.count("*").alias("population_n"))
        strategy = spark.table(f"{a.schema}.resolutions").select(F.col("entry_key").alias("portal_key"), "match_strategy")
        found = audit.weighted_precision(labels.drop("match_strategy").join(strategy, "portal_key"), population, "match_strategy")
        out = json.loads(tables.summary_json(found).first().json)
    print(json.dumps(out, sort_keys=True))
    return 0
