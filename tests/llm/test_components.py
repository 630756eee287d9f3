import pytest

from framesift.llm import components as module
from framesift.llm.components import components


@pytest.mark.parametrize("size", [module.TASK_EDGES, 6])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr(module, "TASK_EDGES", size)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 70), (70, 100), (5, 5), (None, 3), (200, 201), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
