import pytest

from trailweave.llm import common


@pytest.mark.parametrize("join", [common.spread_join, common.group_join])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_joins_are_joins(spark, join, how):
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(60)], "id int, k int")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (9, "c")], "k int, v string")
    got, want = join(left, right, ["k"], [F.col("id")], how), left.join(right, ["k"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_functions_travel_without_the_package(tmp_path):
    """Workers may not have this package: what tasks call is pickled by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from trailweave.llm import decontaminate, language, mainhtml, nearcopies, tokens

    calls = [(mainhtml.main_text, ("<p class=x>A text, so it is.</p>",)), (decontaminate.normal_words, ("a b",)), (nearcopies.shingle_set, ("a b c",)), (tokens.byte_letters, ()), (lambda t: [*language.Grams(3, 64).batches([t])], ("ab",))]
    (tmp_path / "calls").write_bytes(cloudpickle.dumps(calls))
    code = "import pickle; print([bool(len(f(*a))) for f, a in pickle.load(open('calls', 'rb'))])"
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.strip() == str([True] * 5)


def test_bits_split_without_loss(spark):
    from pyspark.sql import functions as F

    from trailweave.llm.common import member_bits, split_by_bits

    rows = spark.range(5000).selectExpr("if(id = 7, null, id) as id", "'b' as _bits", "'a' as _at", "'c' as _bucket")
    known = rows.filter("id % 10 = 0 or id is null")
    may, never = split_by_bits(rows, member_bits(known, F.struct("id")), F.struct("id"))
    wanted = {r.id for r in known.collect()}
    assert may.columns == rows.columns and wanted <= {r.id for r in may.collect()}
    assert may.count() + never.count() == 5000 and may.count() < 510
    assert split_by_bits(rows, member_bits(known.limit(0), F.col("id")), F.col("id"))[1].count() == 5000
