"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from bitempo.plans import answers, facts, graph, history, ledger, mapping, reason, search, state, stream
from tests.rows import duck, spark_rows

ALL = {k: (f, m.ORACLES.get(k)) for m in (history, facts, graph, search, ledger, mapping, state, reason, answers, stream) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, small_dir, name):
    query, sql = ALL[name]
    got, columns = spark_rows(query(spark, small_dir))
    if sql:
        want, names = duck(sql, small_dir)
        assert columns == names
        assert got == want
