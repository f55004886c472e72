import pytest

from evigraph.operators import simulation


def test_simulation_without_strict_is_one_round(spark, monkeypatch):
    monkeypatch.setattr(simulation, "_until_stable", lambda *_: pytest.fail("a second round"))
    allowed = spark.createDataFrame([(0, 1, 10), (0, 2, 20), (0, 3, 30)], "instance int, u int, v int")
    edges = spark.createDataFrame([(0, 1, u) for u in (1, 2, 3, 4)], "instance int, edge int, u int")
    d_match = spark.createDataFrame([(0, 1, 1, 1, 10), (0, 1, 1, 2, 20), (0, 1, 2, 3, 30), (0, 1, 2, 4, 40)], "instance int, edge int, sc int, u int, v int")
    assert sorted(tuple(r) for r in simulation.edge_simulation(allowed, edges, d_match).collect()) == [(0, 1, 10), (0, 2, 20)]
