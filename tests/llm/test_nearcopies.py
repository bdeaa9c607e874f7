import random
import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from trailweave.llm import nearcopies

SCHEMA = "doc_id bigint, text string"


def brute_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [brute_set(text) for _, text in rows]
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                root[find(i)] = find(j)
    return [min((d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None), default=None) for i in range(len(rows))]


def check(spark, rows):
    got = nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, ((d, c) for (d, _), c in zip(rows, brute(rows)))))


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(64)]
    edited = " ".join([*words[:63], "new"])
    rows = [(2, " ".join(words)), (56, edited), (None, edited.upper()), (3, None), (4, " \n"), (5, "a b"), (6, "A  b"), (7, "a c"), (None, "only here"), (2, " ".join(words)), (8, " ".join(words[:20]))]
    check(spark, rows)
    assert nearcopies.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("block", [256, 3])
def test_dense_keys(spark, monkeypatch, block):
    """Variants of few texts, chained: keys hold many nodes, not all of which are like the least one."""
    monkeypatch.setattr(nearcopies, "PAIRED_NODES", 2)
    monkeypatch.setattr(nearcopies, "BLOCK_NODES", block)
    r = random.Random(3)
    rows = []
    for _ in range(3):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            words = [*words]
            words[r.randrange(120)] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    check(spark, rows)


def test_block_links():
    import numpy as np

    sets = [np.arange(k, k + 100) for k in (0, 5, 10, 300)]
    assert nearcopies.block_links([1, 2, 3, 4], [0, 0, 0, 0], [1, 2, 3, 4], sets, 0.8) == [(2, 1), (3, 1)]
    assert nearcopies.block_links([1, 2, 3, 4], [0, 0, 1, 1], [1, 1, 3, 4], sets, 0.8) == [(3, 1)]


def test_stage_drops_near_copies(spark):
    """Near copies that a 2-bit radius leaves in: documents 145 and 177."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {*brute(rows)} and not {145, 177} & left


def test_simhash_links_lead(spark, monkeypatch):
    """Without min-hash keys what SimHash reaches is linked all the same, and exact sets still decide."""
    from trailweave.llm import simhash

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows += [(10_000 + k, " ".join([*words[:k], *words])) for k in range(3)]
    rows += [(20_000, " ".join(words[:5])), (20_001, " ".join(words[:5]).upper()), (20_002, "only five words are here")]
    monkeypatch.setattr(nearcopies, "band_keys", lambda hashes: [])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {row.doc_id: row.component_id for row in nearcopies.near_copies(docs).collect()}
    sets = [nearcopies.shingle_set(text) for _, text in rows]
    prints = [p % (1 << 64) for p in simhash.fingerprints(len(rows), enumerate_blocks(sets)).tolist()]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 and len(sets[i]) and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
    differ = [(i, j) for i, j in alike if sets[i].tobytes() != sets[j].tobytes()]
    assert len(differ) >= 3 and all(got[rows[i][0]] == got[rows[j][0]] for i, j in alike)
    whole = dict(zip([d for d, _ in rows], brute(rows), strict=True))
    assert all(whole[d] == whole[c] for d, c in got.items())


def enumerate_blocks(sets):
    return ((i, s) for i, s in enumerate(sets) if len(s))
