"""Registered queries against their DuckDB forms on what larger tables hold: high keys and urls that repeat."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rentwire.plans.catalog import ORACLES, QUERIES


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLES[name])
    at = [[x[0] for x in want.description].index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["L63_footprint_parts", "L64_footprints", "L69_clicks_in_footprints"])
def test_suppliers_of_any_number(spark, tmp_path, name):
    keys = [k for first in (0, 1999, 5720, 5980, 59_980, 359_980, 9_999_980) for k in range(first, first + 20)]
    same(spark, tmp_path, name, supplier=pa.table({"s_suppkey": pa.array(keys, pa.int64()), "s_name": [f"Supplier#{k}" for k in keys]}))


def page(k, url, words, times):
    """A page with a headline of its own, and as many paragraphs of some words."""
    said = f"{words} {k} " * 12
    return k, url, f"<html><head><title>{words} {k}</title></head><body><article><h1>{words} {k}</h1>{f'<p>{said}</p>' * times}</article></body></html>"


@pytest.mark.parametrize("name", ["N29_fetch_statistics", "N15_page_status", "N16_enriched"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    rows = [page(k, f"https://n.example.com/{k % 5}", ("Clinic opens tower", "Nurses strike again")[k // 5 % 2], k // 5) for k in range(25)]
    page_id, url, html = map(list, zip(*rows))
    same(spark, tmp_path, name, pages=pa.table({"page_id": pa.array(page_id, pa.int64()), "url": url, "html": html}))
