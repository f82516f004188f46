"""Queries over tables whose keys or texts go beyond those of the small ones, against their SQL."""

import os

import duckdb

from oracle import TABLES, same
from terrano.plans import registry


def changed(sf, folder, **selections):
    """The tables of ``sf``, some of them replaced by a selection of DuckDB."""
    for t in TABLES:
        if t in selections:
            con = duckdb.connect()
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            con.execute(f"COPY ({selections[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_last_item_with_part_keys_beyond_a_million(spark, sf, tmp_path):
    """A part key beyond a million counts as a later line, as the SQL's one number has it."""
    d = changed(sf, tmp_path, lineitem="SELECT * REPLACE (1 + l_partkey * 7919 % 1200000 AS l_partkey) FROM lineitem")
    assert same(spark, registry.QUERIES["joi15_last_wins"], registry.SQL["joi15_last_wins"], d) == 1500


def test_pages_that_name_an_address_twice(spark, sf, tmp_path):
    """Every mention counts, as in the SQL."""
    d = changed(sf, tmp_path, pages="SELECT * REPLACE (html || '<p>Uno@otra.com, uno@otra.com</p><b>test@otra.com dos' || page_id || '@otra.com</b><p>uno@otra.com</p>' AS html) FROM pages")
    assert same(spark, registry.QUERIES["web10_pages"], registry.SQL["web10_pages"], d) == 50
