"""The queries on empty tables and on tables with NULLs in every column, repeated rows and an extra column."""

import pytest

from tidegauge.plans import cqueries, fqueries, pqueries, squeries

#: Repeated times make these raise, as documented.
RAISES = {"align_auto", "align_min", "align_max"}
#: The stream of the test tables' own schema, and queries that don't read the tables.
LEFT_OUT = {"stream_resample", "tree_formats", "tree_writers", "tree_yaml", "tree_operations", "table_embedded", "sensor_names", "cli_times", "cli_list", "cli_dump"}


@pytest.mark.filterwarnings("ignore")
def test_queries_on_odd_tables(spark, odd_tables):
    kind, folder = odd_tables
    for module in (pqueries, squeries, cqueries, fqueries):
        for name, q in module.QUERIES.items():
            if name in LEFT_OUT or name.startswith(("reduce_", "resample_")) and name[-3:] not in ("ian", "nds", "pan", "rge"):
                continue
            if kind == "nulls" and name in RAISES:
                with pytest.raises(ValueError):
                    q(spark, folder)
            else:
                assert q(spark, folder).count() >= 0, name
