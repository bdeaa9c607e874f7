import zlib

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_lines import brute as dedup
from tests.llm.test_nearcopies import brute as copies
from trailweave.llm import language, lines, mixing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.keep(stage(spark, docs, SF))
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name == "language_id":
            scored = {r.doc_id: r for r in language.identify(docs).collect()}
            assert {r.doc_id for r in after} == {d for d, r in scored.items() if r.lang_pred != "und" and r.score >= 0.5}
        elif name == "line_dedup":
            want = dedup([(d, r.text) for d, r in before.items()], lines.MIN_WORDS)
            assert {r.doc_id: r.text for r in after} == {d: left for (d, _), (n, left) in want.items() if not n or left.split()}
            assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id].text)
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in after) == sorted({*copies([(d, r.text) for d, r in before.items()])})
        elif name == "decontamination":
            assert sorted(r.doc_id for r in after) == sorted(d for d, r in before.items() if not contaminated(r.text, bench)[-1])
            assert not any(contaminated(r.text, bench)[1] for r in after if contaminated(before[r.doc_id].text, bench)[1])
        else:
            assert {r.doc_id for r in after} == {*before} and sorted(map(tuple, after)) == sorted(map(tuple, mixing.mix(docs).collect()))
        assert out.columns == columns or name == "source_mixing"
        seen[name] = len(after)
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
    assert zlib and seen["near_dedup"] < seen["line_dedup"] < len(columns) * 1000


def test_empty_and_odd_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat", "en", None, 7), (3, "the cat", "en", None, 7), (None, "the dog and the cat", "en", "s", 1), (4, "the " * 100, "en", "s", None), (5, "the " * 100, "en", "t", 4)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.keep(stage(spark, docs, SF))
        assert {r.doc_id for r in docs.collect()} == ({3, 4, None} if given else set())


def test_extra_columns_and_long_texts(spark):
    """Columns with the names that operators use inside pass through; the order and the types are kept."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _deleted_lines int, _slot int, gone string, key string, th bigint, _made int, _copy boolean"
    rows = [(i, f"the cat number {i} and the dog number {i} went out", "en", "s", 1, i, 7, "g", "k", 5, 3, True) for i in range(8)] + [(20, long, "en", "s", len(long), 9, 7, "g", "k", 5, 3, False)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.keep(stage(spark, docs, SF))
        assert out.columns == docs.columns or name == "source_mixing"
        docs = out
    got = {r.doc_id: r for r in docs.collect()}
    assert got[20].text == long and all((r._deleted_lines, r._slot, r.gone, r.key, r.th, r._made) == (9 if d == 20 else d, 7, "g", "k", 5, 3) for d, r in got.items())
