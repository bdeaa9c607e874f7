"""The shared folder: what is put there, and that it goes."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from trailweave.sources import shared


def test_nothing_stays_after_a_block(spark):
    root = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = {*root.glob("*")}
    with shared.released(spark):
        kept = shared.kept(spark.range(5))
        assert kept.count() == 5 and {*root.glob("kept-*")} - before
        with shared.released(spark):
            shared.kept(kept)
    assert {*root.glob("*")} == before and not shared.in_block()


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session)
