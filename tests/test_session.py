"""Life cycle of intermediate tables."""

import os

import pytest

from stratocast import session
from stratocast.features import build
from stratocast.plans import datasets as D
from stratocast.queries import QUERIES
from stratocast.session import commit, intermediates, scratch, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path):
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/shared")


def folders(spark):
    return set(os.listdir(session.shared_dir(spark).removeprefix("file://")))


def test_nothing_stays_behind_a_committed_build(spark, tables, tmp_path):
    before = folders(spark)
    events = tables.settle.where("city = 'click' and day = date'2024-01-15'")
    got = commit(spark, lambda: build(D.hourly(events), D.inputs(tables), ["clock", "observed", "shape", "quantiles", "labels", "forecast"]), f"file://{tmp_path}/rows")
    assert folders(spark) == before and got.count() == 14 and got.where("vc_q50_f_sofar is not null").count() > 0


def test_streams_and_failures_leave_nothing_either(spark):
    before = folders(spark)
    with intermediates(spark) as paths:
        assert QUERIES["stream_cooldown"](spark, SF).count() > 0
    assert len(paths) >= 2 and folders(spark) == before
    with pytest.raises(ZeroDivisionError), intermediates(spark):
        written(spark.range(3), "failing")
        1 / 0
    assert folders(spark) == before


def test_scopes_nest(spark):
    with intermediates(spark) as outer:
        a = written(spark.range(3), "outer")
        with intermediates(spark) as inner:
            written(spark.range(3), "inner")
        assert a.count() == 3 and len(outer) == len(inner) == 1
    kept = scratch(spark, "free")
    assert kept not in outer
