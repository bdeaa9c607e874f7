import datetime

from trailweave import constants as C
from trailweave.operators import learning


def test_contexts_are_ranked_before_they_are_gathered(spark):
    """Accesses are counted, not gathered: of 300 accesses in 30 contexts the 20 contexts that came last are kept."""
    start = datetime.datetime(2024, 1, 1)
    contexts = [None if i % 31 == 30 else f"c{i % 31}" for i in range(300)]
    rows = [(i, "file", "p", "file:p", c, start + datetime.timedelta(seconds=i // 2)) for i, c in enumerate(contexts)]
    rows.append((999, None, None, "odd", "x", start))
    found = learning.learned_vertices(spark.createDataFrame(rows, "id bigint, type string, path string, vertex string, context string, at timestamp"))
    got = {r.id: r for r in found.collect()}
    assert got["file:p"].contexts == [*dict.fromkeys(contexts)][-C.CONTEXTS_RECORDED :]
    assert got["file:p"].access_count == 300 and got["file:p"].last_accessed == rows[299][5] and got["odd"].contexts == ["x"]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
