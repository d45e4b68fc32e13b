"""Rows joined with their classes, where one class holds most rows and many hold one."""

import pytest

from rasterloom.llm import components, ego_join


@pytest.mark.parametrize("share", [1, 3, 20, 1000])
def test_every_row_gets_its_class(spark, monkeypatch, share):
    monkeypatch.setattr(components, "HOT_SHARE", share)
    keys = ["a"] * 40 + ["b"] * 15 + [f"k{i}" for i in range(45)] + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(4)
    counted = {k: keys.count(k) for k in keys if k is not None and k != "k3"}
    classes = spark.createDataFrame([(k, n, f"class {k}") for k, n in counted.items()], "key string, weight long, name string")
    got = sorted(tuple(r) for r in components.join_classes(rows, classes, ["key"], len(keys)).select("id", "key", "name").collect())
    assert got == [(i, k, f"class {k}") for i, k in enumerate(keys) if k in counted]


@pytest.mark.parametrize("share", [2, 1000])
def test_repeated_and_unusable_vectors(spark, monkeypatch, share):
    """Most rows are one vector or none at all; each is counted, and what links with nothing stands alone."""
    monkeypatch.setattr(components, "HOT_SHARE", share)
    rows = [(i, 1, [1.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, 1, [1.0, 0.1, 0.0]) for i in range(3)] + [(200 + i, 1, None) for i in range(40)] + [(300, 1, [0.0, 0.0, 0.0]), (301, None, [1.0, 0.0, 0.0]), (302, 2, [1.0, 0.0, 0.0]), (303, 1, [0.0, 1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ego_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert all(got[v] == ((62, 0, v == 0) if v < 200 else (0, v, True)) for v in got)
