"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal

import duckdb
import pytest

from keelson.plans.all_queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 8)
    return list(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    QUERIES[name](spark, DIR).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_parts_are_resolved(spark, duck):
    """Each part is an entry, and the candidates of all entries are counted over all parts."""
    want = duck.execute("""
      with p as (select p_partkey as k, p_brand as b, p_size > 40 as later, case when p_partkey % 13 <> 0 then split_part(p_type, ' ', -1) end as g, split_part(p_type, ' ', -1) as rg from part),
      c as (select e.k, count(*) filter (r.rg = e.g) as same, count(r.k) as n from p e left join p r on r.b = e.b and not r.later and e.k % 17 <> 0 group by e.k)
      select 'e' || k, case when same > 0 then same else n end from c""").fetchall()
    assert len(want) == duck.execute("select count(*) from part").fetchone()[0]
    assert sorted((r.entry_key, r.candidate_count) for r in QUERIES["r03_resolve"](spark, DIR).collect()) == sorted(want)
    assert QUERIES["r04_resolve_fallback_all"](spark, DIR).count() == len(want)
