import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scarp.functions import metrics

VECTORS = [[1.0, 0.0, 2.0], [1.0, 0.0, 2.0], [0.0, 3.0, 0.0], [0.0, 0.0, 0.0], [-1.0, 2.0, 0.5]]
PLAIN = [m for m in ("tanimoto", "dice", "cosine", "euclidean", "manhattan", "hamming", "sokal_michener")]


@pytest.mark.parametrize("name", PLAIN)
def test_column_and_block_agree(spark, name):
    rows = [(i, j, u, v) for i, u in enumerate(VECTORS) for j, v in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, "i int, j int, u array<double>, v array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in df.select("i", "j", metrics.distance(F.col("u"), F.col("v"), name).alias("d")).collect()}
    want = metrics.get_metric(name).block(np.array(VECTORS), np.array(VECTORS))
    assert all(abs(got[i, j] - want[i, j]) < 1e-12 for i, j in got)


def test_zero_vectors_and_equal_ones():
    z, u = np.zeros((1, 3)), np.array([[1.0, 2.0, 0.0]])
    for name, both, one in (("tanimoto", 0, 1), ("dice", 0, 1), ("cosine", 0, 1), ("euclidean", 0, 5**0.5), ("manhattan", 0, 3)):
        block = metrics.get_metric(name).block
        assert block(z, z)[0, 0] == both and block(z, u)[0, 0] == pytest.approx(one)
        assert block(u, u)[0, 0] == pytest.approx(0, abs=1e-15)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=4, max_size=4), min_size=2, max_size=6))
def test_symmetry_and_bounds(vectors):
    a = np.array(vectors)
    for name in PLAIN:
        d = metrics.get_metric(name).block(a, a)
        assert np.allclose(d, d.T)
        bound = metrics.get_metric(name).upper_bound
        if bound == 2.0:
            assert d.min() >= -1e-9 and d.max() <= bound + 1e-9


def test_tensor_distance_of_equal_and_shifted_sets():
    x = np.array([[0.0, 0.0], [1.0, 1.0]])
    assert metrics.tensor_distance(x, x) == 0
    assert metrics.tensor_distance(x, x + 3) > 0


def test_registry():
    metrics.register_metric("always", lambda a, b: np.full((len(a), len(b)), 0.25), similarity=True, upper_bound=1.0)
    assert metrics.get_metric("always").block(np.zeros((1, 2)), np.zeros((2, 2))).tolist() == [[0.75, 0.75]]
    with pytest.raises(ValueError):
        metrics.get_metric("none of these")
