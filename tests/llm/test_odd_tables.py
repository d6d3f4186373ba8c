"""The queries of the llm package on empty tables and on tables with NULLs in every column, repeated rows and an extra column."""

from tidegauge.llm import queries


def test_queries_on_odd_tables(spark, odd_tables):
    _, folder = odd_tables
    for name, q in queries.QUERIES.items():
        if name not in ("p7_space", "p8_shares", "p9_languages", "p9_segments"):
            assert q(spark, folder).count() >= 0, name
