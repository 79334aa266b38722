"""Scalar functions, sources and filters as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import NICKNAMES, POSITION_GROUPS
from ..operators import audit, gates, present
from ..sources import archive, publish
from ..sources.scratch import shared_dir
from ..streaming import log as download_log
from .registry import query, table

NORM = "trim(regexp_replace(lower(replace(strip_accents({}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
_FIRST = "['Mike', 'Michael', 'Matt', 'Matthew', 'Bill', 'Billy', 'Bob', 'Jon', 'Johnny', 'Zoë', 'Jake', '']"
_CODES = "['QB', 'hb', 'OT', 'DE', 'S', 'PK', 'K', 'P', 'LS', 'X Y', '', 'ATH', 'ILB']"


def _pick(names: str, key: str) -> str:
    """An element of a list by a key, in Spark and DuckDB alike."""
    return f"element_at(array({names[1:-1]}), cast({key} % {names.count(',') + 1} + 1 as int))"


def _pick_sql(names: str, key: str) -> str:
    return f"({names})[CAST({key} % {names.count(',') + 1} + 1 AS INTEGER)]"


@query("n01_n02_normalize", f"SELECT doc_id, sha256({NORM.format('text')}) AS sha, CAST(length({NORM.format('text')}) AS INTEGER) AS n FROM documents")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", S.normalize_token(F.col("text")).alias("x"))
    return t.select("doc_id", F.sha2("x", 256).alias("sha"), F.length("x").alias("n"))


_LAST = "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' WHEN 2 THEN ', sr' ELSE '' END)"


@query("n03_last_name", f"SELECT p_partkey, trim(regexp_replace({NORM.format(_LAST)}, '(^| )(jr|sr|ii|iii|iv|v)$', '')) AS last_name FROM part")
def last_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_last_name(F.expr(_LAST)).alias("last_name"))


_ALIASES = ", ".join(f"('{n}', {i})" for i, g in enumerate(NICKNAMES) for n in g)


@query(
    "n04_alias",
    f"""WITH g(n, i) AS (VALUES {_ALIASES}), x AS (
      SELECT p_partkey, {NORM.format(_pick_sql(_FIRST, 'p_partkey'))} AS a, {NORM.format(_pick_sql(_FIRST, 'p_size'))} AS b FROM part)
    SELECT p_partkey, a <> '' AND b <> '' AND (a = b OR coalesce(g1.i = g2.i, false)) AS alias
    FROM x LEFT JOIN g g1 ON g1.n = a LEFT JOIN g g2 ON g2.n = b""",
)
def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (S.normalize_token(F.expr(_pick(_FIRST, k))) for k in ("p_partkey", "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", S.first_name_alias(a, b).alias("alias"))


_RAW = f"upper(replace({_pick_sql(_CODES, 'p_partkey')}, ' ', ''))"
_GROUP = f"CASE {_RAW} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_GROUPS.items()) + f" ELSE {_RAW} END"


@query(
    "n06_n07_groups",
    f"""SELECT p_partkey, {_GROUP} AS grp, CASE WHEN {_RAW} IN ('K', 'PK') THEN 'K' WHEN {_RAW} IN ('P', 'LS') THEN {_RAW}
    WHEN {_RAW} = '' THEN 'OTHER' ELSE {_GROUP} END AS model_grp FROM part""",
)
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(_pick(_CODES, "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", S.position_group(code).alias("grp"), S.model_position_group(code).alias("model_grp"))


@query("n08_n10_first_value", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, CAST(p_partkey AS VARCHAR)) AS id FROM part")
def first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.first_value(F.when(F.col("p_size") > 25, F.col("p_size")), F.col("p_partkey")).alias("id"))


@query(
    "n11_n12_identity_key",
    f"""SELECT c_custkey, sha256(concat('{{"destination":"', {NORM.format('c_mktsegment')}, '","eligibility":"","first_name":"', {NORM.format('c_name')}, '","last_name":"smith",',
    '"origin":"nation ', c_nationkey, '","position":"DL","rating":"","season":', 2020 + c_nationkey % 5, ',"stars":"', CASE WHEN c_nationkey % 4 > 0 THEN CAST(c_nationkey % 4 AS VARCHAR) ELSE '' END,
    '","transfer_date":"2024 01 05"}}')) AS k FROM customer""",
)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of ten fields, from a table with camel-case names."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.lit(2020) + F.col("c_nationkey") % 5).alias("season"), F.col("c_name").alias("firstName"), F.lit("Smith, Jr.").alias("lastName"),
        F.lit("d/t").alias("position"), F.concat(F.lit("Nation-"), "c_nationkey").alias("origin"), F.col("c_mktsegment").alias("destination"),
        F.lit("2024-01-05").alias("transferDate"), F.lit(0.0).alias("rating"), (F.col("c_nationkey") % 4).alias("stars"),
    )
    return c.select("c_custkey", S.entry_key(c.columns).alias("k"))


@query(
    "n01_n02_marked_names",
    f"SELECT p_partkey, {NORM.format(chr(39).join(['replace(translate(p_name, ', 'sai', ', ', 'šāÍ', '), ', 'o', ', concat(', 'o', ', chr(769)))']))} AS name FROM part",
)
def marked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose letters carry marks, composed and as characters of their own."""
    marked = F.replace(F.translate("p_name", "sai", "šāÍ"), F.lit("o"), F.lit("o\u0301"))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_token(marked).alias("name"))


_WIDE = {"a": ("½", "1⁄2"), "s": ("Ⅷ", "VIII"), "o": ("№", "No"), "e": ("㎏", "kg"), "i": ("⑩", "10"), "u": ("한", "\u1112\u1161\u11ab"), "d": ("ẞ", "ss")}
_DECOMPOSED = "p_name"
for _c, (_, _x) in _WIDE.items():
    _DECOMPOSED = f"replace({_DECOMPOSED}, '{_c}', '{_x.upper()}')"


@query("n01_n02_n05_compatibility", f"SELECT p_partkey, {NORM.format(_DECOMPOSED)} AS name, trim(regexp_replace({NORM.format(_DECOMPOSED)}, '(^| )(jr|sr|ii|iii|iv|v)$', '')) AS last_name FROM part")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with characters that compatibility decomposition makes several."""
    wide = F.translate("p_name", "".join(_WIDE), "".join(x for x, _ in _WIDE.values()))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_team(wide).alias("name"), S.normalize_last_name(wide).alias("last_name"))


@query(
    "n06_n07_marked_codes",
    f"""SELECT p_partkey, {_GROUP} AS grp, CASE WHEN {_RAW} IN ('K', 'PK') THEN 'K' WHEN {_RAW} IN ('P', 'LS') THEN {_RAW}
    WHEN {_RAW} = '' THEN 'OTHER' ELSE {_GROUP} END AS model_grp FROM part""",
)
def marked_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of ``n06_n07_groups`` in lower case, with signs between their letters."""
    code = F.concat(F.lit("("), F.regexp_replace(F.lower(F.expr(_pick(_CODES, "p_partkey"))), "(.)", "$1/"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", S.position_group(code).alias("grp"), S.model_position_group(code).alias("model_grp"))


@query("n13_similarity")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return p.select("p_name", "p_brand", S.similarity(F.lower("p_name"), F.lower("p_brand")).alias("ratio"))


@query("n14_n16_feature_name", f"SELECT p_partkey, replace({NORM.format('p_type')}, ' ', '_') || '_' || replace({NORM.format('p_brand')}, ' ', '_') AS f FROM part")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.feature_name(F.col("p_type"), F.col("p_brand")).alias("f"))


@query("n15_strict_number", "SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS x FROM orders")
def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.format_number(F.floor("o_totalprice"), 0), F.when(F.col("o_orderkey") % 2 == 0, F.lit("%")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.strict_number(text).alias("x"))


@query("n17_n18_lenient_number", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS x, value AS y FROM events")
def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).when(F.col("event_id") % 7 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.lenient_number(text).alias("x"), S.plain_number(F.col("value")).alias("y"))


@query(
    "n19_n22_parse",
    "SELECT doc_id, CAST(toxic AS INTEGER) AS f, quality = 1 AS b, true AS p, CAST(1990 + doc_id % 9 AS INTEGER) AS s FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL",
)
def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").where("toxic is not null and quality is not null")
    word = F.when(F.col("quality") == 1, F.lit(" Yes")).otherwise(F.lit("false"))
    year = F.concat(F.lit(" "), (1990 + F.col("doc_id") % 9).cast("string"))
    return t.select("doc_id", S.binary_flag(F.col("toxic")).alias("f"), S.boolean(word).alias("b"), S.present(word).alias("p"), S.season(year).alias("s"))


@query("n23_sigmoid", "SELECT doc_id, round(greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-(n_chars - 2000) / 900.0)))), 9) AS p FROM documents")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.sigmoid((F.col("n_chars") - 2000) / 900.0), 9).alias("p"))


@query(
    "n25_n26_display",
    "SELECT p_partkey, p_brand || ' / ' || p_type AS label, contains(lower(p_name), 'a') AS hit, CASE WHEN p_size % 3 <> 0 THEN round(p_size / CAST(p_size % 3 AS DOUBLE), 6) END AS r FROM part",
)
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.round(S.share(F.col("p_size"), F.col("p_size") % 3), 6)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" / ", "p_brand", "p_type").alias("label"), S.contains_text(F.col("p_name"), "A").alias("hit"), r.alias("r"))


@query("s04_objects", "SELECT sha256(html) AS sha256, CAST(octet_length(encode(any_value(html))) AS BIGINT) AS byte_count, 'objects/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.json' AS object_path, count(*) AS n_downloads FROM pages GROUP BY sha256(html)")
def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.objects(table(spark, sf_dir, "pages"), "html")


@query("s05_s07_log", "SELECT event_type AS endpoint, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS id, event_id FROM events")
def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), "event_id", "ts")
    return archive.with_ids(t, ["ts", "event_id"]).select("endpoint", F.col("id").cast("int").alias("id"), "event_id").orderBy("id")


_SENT = """'{"z": [1, {"y": null, "b": "é"}], "k": ' || event_id || '}'"""


@query(
    "s05_append",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY user_id % 3, ts, event_id) AS id, user_id % 3 AS batch, sha256(props) AS h FROM events)
    SELECT id, event_type AS endpoint, CAST(year(ts) AS INTEGER) AS season, '{"k":' || event_id || ',"z":[1,{"b":"\\u00e9","y":null}]}' AS params_json, h AS sha256,
      CAST(strlen(props) AS BIGINT) AS byte_count, 'objects/' || substr(h, 1, 2) || '/' || h || '.json' AS object_path, 'e' || event_id AS etag, NULL::VARCHAR AS last_modified,
      CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS request_id, batch, id - min(id) OVER (PARTITION BY batch) AS "offset" FROM e""",
)
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of downloads appended to the log, the last one twice."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_type").alias("endpoint"), F.year("ts").alias("season"), F.expr(_SENT).alias("params"),
        # Milliseconds and the id, so that rows have one order.
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad("event_id", 12, "0")).alias("requested_at"), F.lit(None).cast("string").alias("received_at"),
        F.col("props").cast("binary").alias("content"), F.lit(200).alias("http_status"), F.lit("").alias("source_url"),
        F.create_map(F.lit("eTAG"), F.concat(F.lit("e"), "event_id"), F.when(F.col("event_id") % 2 == 0, F.lit("X-REQUEST-id")).otherwise(F.lit("x-other")), F.concat(F.lit("r"), "event_id")).alias("headers"),
        F.pmod("user_id", F.lit(3)).alias("part"),
    )
    root = f"{shared_dir(spark)}/keelson/log-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 2):
        download_log.append(rows.where(F.col("part") == batch), batch, root, order=("requested_at",))
    t = download_log.read_log(spark, root)
    return t.select("id", "endpoint", "season", "params_json", "sha256", "byte_count", "object_path", "etag", "last_modified", "request_id", "batch", "offset")


@query("n24_utc_millis", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS t FROM events")
def utc_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", download_log.utc_millis(F.col("ts")).alias("t"))


_SHA = "sha256(concat(" + ", ".join(f"'{c}=', coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("c_custkey", "c_nationkey", "c_seg")) + "))"


@query(
    "g05_fingerprint",
    f"""WITH t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_seg FROM customer), h AS (SELECT {_SHA} AS h FROM t)
    SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_a, CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS VARCHAR) AS sum_b FROM h""",
)
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's fingerprint, whatever the order of its rows and columns."""
    t = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_seg"), "c_nationkey", "c_custkey")
    return publish.fingerprint(t.repartition(7, "c_nationkey"))


@query(
    "g02_g06_a24_observed",
    """SELECT * FROM (SELECT 'n_rows' AS metric, count(*) AS n FROM orders UNION ALL SELECT 'null_keys', count(*) - count(o_orderkey) FROM orders
    UNION ALL SELECT 'broken_price', count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) FROM orders UNION ALL SELECT 'broken_status', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
    UNION ALL SELECT 'group_F', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'group_X', 0 UNION ALL SELECT 'group_others', count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus <> 'F') FROM orders)""",
)
def observed_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates count while a table is written."""
    o = table(spark, sf_dir, "orders")
    conditions = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")}
    found = publish.write_observed(o, f"{shared_dir(spark)}/keelson/observed-{uuid.uuid4().hex}", conditions, ("o_orderstatus", ["F", "X"]), "o_orderkey")
    rows = [(k, v) for k, v in found.items() if not k.startswith("sum_")]
    return spark.createDataFrame(rows, "metric string, n long")


_NESTED = """'{"k": ' || event_id || ', "a": {"list": [1.5, null, "x", {"deep": true}], "none": null}, "props": ' || props || '}'"""


@query(
    "s08_s09_variant",
    f"""WITH j AS (SELECT event_id AS id, CAST({_NESTED} AS JSON) AS j FROM events)
    SELECT id, CAST(j->>'$.k' AS BIGINT) AS k, CAST(j->>'$.props.k' AS INTEGER) AS props_k, CAST(j->>'$.a.list[0]' AS DOUBLE) AS number, j->>'$.a.list[2]' AS word,
      true AS none, CAST(j->>'$.a.list[3].deep' AS BOOLEAN) AS deep, '{{"a":{{"list":[1.5,null,"x",{{"deep":true}}],"none":null}},"k":' || id || ',"props":' || replace(CAST(j->'props' AS VARCHAR), ' ', '') || '}}' AS json FROM j""",
)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of any shape: numbers, nested values and nulls come back as they went in."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_NESTED).alias("params_json"))
    p = archive.parsed_params(t, "variant")
    get = lambda path, kind: F.variant_get("params", path, kind)
    return p.select(
        "id", get("$.k", "long").alias("k"), get("$.props.k", "int").alias("props_k"), get("$.a.list[0]", "double").alias("number"), get("$.a.list[2]", "string").alias("word"),
        F.is_variant_null(get("$.a.none", "variant")).alias("none"), get("$.a.list[3].deep", "boolean").alias("deep"), F.to_json("params").alias("json"),
    )


@query("s05_s07_log_all", "SELECT event_type AS endpoint, row_number() OVER (ORDER BY ts, event_id) AS id, event_id FROM events")
def log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log, numbered."""
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), "event_id", "ts")
    return archive.with_ids(t, ["ts", "event_id"]).select("endpoint", "id", "event_id")


@query("s06_latest", "SELECT user_id, event_type, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "props", "event_id")


@query("s08_params", "SELECT event_id AS id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("params_json"))
    return archive.parsed_params(t, "struct<k:int>").select("id", F.col("params.k").alias("k"))


_PAYLOAD = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '"text"' ELSE substr(props, 1, length(props) - 1) END"""


@query("s02_valid_root", "SELECT event_id, event_id % 4 < 2 AS ok FROM events")
def valid_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and lists are roots; a text is none, nor is an object without its end."""
    return table(spark, sf_dir, "events").select("event_id", archive.valid_root(F.expr(_PAYLOAD)).alias("ok"))


@query("s02_valid_root_all", "SELECT event_id, true AS ok FROM events")
def valid_root_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", archive.valid_root(F.col("props")).alias("ok"))


@query("s14_union_of_fields", "SELECT n_nationkey AS k, n_name, n_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, NULL, r_name FROM region")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import union_of_fields

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return union_of_fields([n.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), r.select(F.col("r_regionkey").alias("k"), "r_name")])


@query("s16_summary_json", """SELECT concat('{"n":', count(*), ',"o_orderstatus":"', o_orderstatus, '"}') AS json FROM orders GROUP BY o_orderstatus""")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import summary_json as as_json

    return as_json(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query(
    "s15_label_template",
    """SELECT CAST(o_orderkey AS VARCHAR) AS portal_key, CAST(year(o_orderdate) AS VARCHAR) AS season, '' AS first_name, '' AS last_name, '' AS position, '' AS origin,
    '' AS destination, o_orderstatus AS predicted_status, CAST(o_custkey AS VARCHAR) AS predicted_player_id, '' AS predicted_score,
    '' AS expected_player_id, '' AS label_outcome, '' AS split, '' AS reviewer, '' AS notes FROM orders""",
)
def label_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return audit.label_template(o.select(F.col("o_orderkey").alias("entry_key"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("player_id")))


@query("p09_filtered", "SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = present.filtered(table(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#22", "Brand#33"], "p_size": []}, "E", ("p_name", "p_type"))
    return t.select("p_partkey", "p_brand", "p_name")


@query(
    "p08_g06_conditions",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS null_keys,
    CAST(count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS BIGINT) AS broken_price,
    CAST(count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) AS BIGINT) AS broken_status FROM orders""",
)
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return gates.measure(o, "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


@query(
    "g02_group_counts",
    """WITH h AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1), w(g2, locked) AS (VALUES ('F', 7298), ('O', 10), ('X', 3))
    SELECT coalesce(g, g2) AS grp, n, CAST(locked AS BIGINT) AS locked, n IS NOT DISTINCT FROM locked AS ok FROM h FULL JOIN w ON g = g2""",
)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.group_counts(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 7298, "O": 10, "X": 3})


@query(
    "j11_reconcile",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0),
    b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, a.k IS NULL AS only_right, b.k IS NULL AS only_left
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(a.v - b.v) > 1e-12""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    moved = o.withColumn("v", F.col("v") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))
    return gates.reconcile(o.where("k % 5 <> 0"), moved.where("k % 11 <> 0"), "k", "v")


@query("a25_cross_table", """SELECT c_mktsegment, CAST(count(*) FILTER (c_nationkey = 0) AS BIGINT) AS "0", CAST(count(*) FILTER (c_nationkey = 1) AS BIGINT) AS "1", CAST(count(*) FILTER (c_nationkey IN (0, 1)) AS BIGINT) AS total FROM customer GROUP BY 1""")
def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    return present.cross_table(t, "c_mktsegment", "nation", ["0", "1"])


@query("w04_rank", "SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS group_rank FROM customer WHERE c_acctbal > 0")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return present.ranked(t, "c_mktsegment", "c_acctbal").select("c_custkey", "c_mktsegment", "group_rank")


@query("o04_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.top(table(spark, sf_dir, "customer"), "c_acctbal", 20, "c_custkey").select("c_custkey", "c_acctbal")


@query("o05_order", "SELECT n_nationkey, n_regionkey FROM nation")
def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").withColumn("r", F.col("n_regionkey").cast("string"))
    return present.in_order(t, "r", ["3", "1", "0"], "n_nationkey").select("n_nationkey", "n_regionkey")


@query("a26_overview", "SELECT (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1) AS mode, min(p_size) AS least, max(p_size) AS most, count(DISTINCT p_brand) AS n_different FROM part")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.overview(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("u03_u04_sets", "SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3")
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.select("r_regionkey").exceptAll(n.where("n_nationkey < 3").select("n_regionkey").distinct())


@query(
    "u04_key_differences",
    """SELECT k, true AS only_left FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey > 4 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT k, false FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey > 4)""",
)
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the customers of some nations and those with finished orders from being the same set."""
    c = table(spark, sf_dir, "customer").where("c_nationkey > 4").select(F.col("c_custkey").alias("k"))
    return gates.key_differences(c, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")
