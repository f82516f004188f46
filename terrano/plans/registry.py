"""The registered queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from terrano.plans import column_queries, file_queries, listing_queries, listing_sql, page_queries, place_queries, place_sql, table_queries, value_queries, work_queries

QUERIES = {**listing_queries.QUERIES, **place_queries.QUERIES, **value_queries.QUERIES, **column_queries.QUERIES, **table_queries.QUERIES, **page_queries.QUERIES, **work_queries.QUERIES, **file_queries.QUERIES}
SQL = {**listing_sql.SQL, **place_sql.SQL, **value_queries.SQL, **column_queries.SQL, **table_queries.SQL, **page_queries.SQL, **work_queries.SQL, **file_queries.SQL}

__all__ = ["QUERIES", "SQL"]
