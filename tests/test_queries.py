"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lakeweave.plans import registry
from lakeweave.sources.tables import DOMAINS

# All patterns over three domains, and those that a domain's own columns and steps shape over the others.
WHOLE, SHAPED = ("orders", "shipments", "events"), ("dedup_latest", "funnel", "rate_normalization")
NAMES = [n for n in sorted(registry.SQL) if not any(n.endswith(f"_{d}") and n.removesuffix(f"_{d}") not in SHAPED and n in registry.patterns.SQL for d in DOMAINS if d not in WHOLE)]
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    show = lambda x: round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x.isoformat() if hasattr(x, "isoformat") else x
    return sorted((tuple(show(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, tiny, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = registry.QUERIES[name](spark, tiny)
    got = db.execute(registry.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(got.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
