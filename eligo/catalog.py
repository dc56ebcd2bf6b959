"""All queries of the domain, and the SQL that checks them."""

from eligo import cases, collect_queries, notice_queries, queries, review_queries, strict_queries, view_queries

PARTS = (queries, view_queries, collect_queries, notice_queries, strict_queries, review_queries, cases)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
