"""The registered queries of this subpackage against their SQL twins, over whole tables."""

import duckdb
import pytest

from batida.llm import queries

TABLES = "documents pages conversations benchmark labels".split()


def rows(names, values):
    """Sorted rows with their columns by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([r[k] for k in order]) for r in values)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name, size):
    folder = f"/root/testdata/{size}"
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = queries.QUERIES[name](spark, folder)
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
