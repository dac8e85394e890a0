"""Every registered query on the smallest tables against its SQL in DuckDB."""

import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
from conftest import SF

import __spark_entry__ as entry
from tools.compare import TABLES, compare

# Reports that have no row at this size.
EMPTY = {"check_brand_store_gap"}


def is_ours(name):
    return not re.match(r"op\d+_|pipeline$", name)


def test_every_query_has_sql():
    assert {n for n in entry.queries() if is_ours(n)} == {n for n in entry.oracle_sql() if is_ours(n)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    oracles = entry.oracle_sql()

    def one(item):
        name, fn = item
        text, _, ok = compare(spark, con.cursor(), SF, name, fn, oracles[name])
        # A report that is empty on purpose-dirtied data would check nothing.
        return None if ok and (text != "ok 0" or name in EMPTY) else f"{name}: {text}"

    with ThreadPoolExecutor(4) as pool:
        assert [r for r in pool.map(one, [q for q in entry.queries().items() if is_ours(q[0])]) if r] == []
