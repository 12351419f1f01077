from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftnet.operators import matrices
from weftnet.operators.tensor import Tensor, add_all


def seq(spark, labels, dims, im=2.0):
    return Tensor.from_data(spark, labels, dims, [complex(k, im * k) for k in range(int(np.prod(dims)))])


def array(t):
    return np.array(t.data()).reshape(t.dims)


def drawn(spark, seed, labels, dims):
    r = np.random.default_rng(seed)
    x = r.integers(-5, 6, dims) + 1j * r.integers(-5, 6, dims)
    return Tensor.from_data(spark, labels, dims, x.ravel().tolist()), x


@pytest.mark.parametrize(
    ("left", "right", "rule", "labels"),
    [("k", "k", "k,k->", ()), ("mk", "k", "mk,k->m", ("m",)), ("k", "nk", "k,nk->n", ("n",)), ("mk", "nk", "mk,nk->mn", ("m", "n")), ("mkn", "nq", "mkn,nq->mkq", ("m", "k", "q"))],
)
def test_products(spark, left, right, rule, labels):
    size = {"k": 4, "m": 2, "n": 3, "q": 5}
    (a, x), (b, y) = drawn(spark, 1, list(left), [size[c] for c in left]), drawn(spark, 2, list(right), [size[c] for c in right])
    t = a.contract(b)
    assert t.labels == labels
    assert np.array_equal(array(t), np.einsum(rule, x, y))


def test_two_shared_labels_and_outer(spark):
    a, x = drawn(spark, 3, ["u", "v"], [4, 3])
    assert a.contract(a.transpose(["v", "u"])).scalar() == (x * x).sum()
    outer = seq(spark, ["a"], [2]).contract(seq(spark, ["b"], [3]))
    assert outer.labels == ("a", "b")
    assert np.allclose(array(outer), np.multiply.outer(array(seq(spark, ["a"], [2])), array(seq(spark, ["b"], [3]))))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_contraction_is_einsum(spark, data):
    dims = {x: data.draw(st.integers(1, 3)) for x in "abcde"}
    left = data.draw(st.lists(st.sampled_from("abcde"), unique=True, min_size=1, max_size=3))
    right = data.draw(st.lists(st.sampled_from("abcde"), unique=True, min_size=1, max_size=3))
    r = np.random.default_rng(data.draw(st.integers(0, 99)))
    arrays = [r.integers(-3, 4, [dims[x] for x in labels]) + 1j * r.integers(-3, 4, [dims[x] for x in labels]) for labels in (left, right)]
    a, b = (Tensor.from_data(spark, labels, x.shape, x.ravel().tolist()) for labels, x in zip((left, right), arrays, strict=True))
    out = [x for x in left if x not in right] + [x for x in right if x not in left]
    want = np.einsum(f"{''.join(left)},{''.join(right)}->{''.join(out)}", *arrays)
    assert np.array_equal(array(a.contract(b)), want)


def test_add_slice_transpose_reshape(spark):
    t = seq(spark, ["a", "b", "c"], [2, 3, 4])
    x = array(t)
    assert np.array_equal(array(t.transpose(["c", "a", "b"])), x.transpose(2, 0, 1))
    assert np.array_equal(array(t.transpose([1, 0, 2])), x.transpose(1, 0, 2))
    assert np.array_equal(array(t.slice("b", 2)), x[:, 2])
    r = t.reshape([6, 4])
    assert r.labels == ("?a", "?b")
    assert np.array_equal(array(r), x.reshape(6, 4))
    assert np.array_equal(array(t.reshape([8], batch=["b"])), x.transpose(1, 0, 2).reshape(3, 8))
    s = t.add(t.transpose(["c", "a", "b"]))
    assert s.labels == t.labels
    assert np.array_equal(array(s), 2 * x)
    assert np.array_equal(array(t.conj()), x.conj())
    assert np.array_equal(array(t.scale(2j)), 2j * x)


def test_labels_that_are_no_identifiers(spark):
    t = seq(spark, ["0-1", "A", "a"], [2, 2, 2]).contract(seq(spark, ["A", "`"], [2, 3]))
    assert t.labels == ("0-1", "a", "`")
    assert t.shown(["p", "q", "r"]).columns == ["p", "q", "r", "re", "im"]


def test_values(spark):
    t = seq(spark, ["a", "b"], [2, 3])
    assert t.value([1, 2]) == 5 + 10j
    assert t.value([0, 0]) == 0
    assert t.value_at(4) == 4 + 8j
    assert t.set_value([0, 0], 9).data()[0] == 9
    assert t.set_value([1, 1], -1j).value([1, 1]) == -1j
    assert t.size == 6 and not t.is_scalar
    assert Tensor.scalar_of(spark).scalar() == 0
    assert Tensor.scalar_of(spark, 2j).is_scalar
    assert seq(spark, ["i"], [2]).describe() == "Size=2\nIndices={i}\nData={(0,0) (1,2)}"


def test_equality(spark):
    t = seq(spark, ["a", "b"], [2, 3])
    assert t.equals(seq(spark, ["a", "b"], [2, 3]))
    assert not t.equals(t.transpose(["b", "a"]))
    assert not t.equals(t.scale(1 + 1e-9)) and t.equals(t.scale(1 + 1e-9), 1e-6)


def test_densify_and_random(spark):
    t = Tensor.from_entries(spark, ["a"], [4], [((2,), 5)]).densify()
    assert sorted(r["x0"] for r in t.df.collect()) == [0, 1, 2, 3]
    x = np.array(Tensor.random(spark, ["a"], [500], seed=3).data())
    assert (np.abs(x.real) <= 1).all() and (np.abs(x.imag) <= 1).all() and np.std(x.real) > 0.4
    assert np.array_equal(x, np.array(Tensor.random(spark, ["a"], [500], seed=3).data()))


def test_errors(spark):
    t = seq(spark, ["a", "b"], [2, 3])
    with pytest.raises(ValueError, match="repeated"):
        t.rename(0, "b")
    with pytest.raises(ValueError, match="no label"):
        t.slice("z", 0)
    with pytest.raises(ValueError, match="outside"):
        t.slice("a", 2)
    with pytest.raises(ValueError):
        t.reshape([5])
    with pytest.raises(ValueError):
        t.transpose(["a"])
    with pytest.raises(ValueError):
        t.transpose([0, 0])
    with pytest.raises(ValueError):
        t.value([0, 3])
    with pytest.raises(ValueError, match="can't add"):
        t.add(seq(spark, ["a", "c"], [2, 3]))
    with pytest.raises(ValueError, match="values here"):
        t.contract(seq(spark, ["a"], [3]))
    with pytest.raises(ValueError):
        Tensor.from_data(spark, ["a"], [2], [1])
    with pytest.raises(TypeError):
        Tensor.from_data(spark, ["a"], [2], [1, 2], precision="int8")


def test_precision(spark):
    t = Tensor.from_data(spark, ["a"], [2], [1, 0.1], precision="float")
    assert dict(t.df.dtypes)["re"] == "float"


def test_repeated_coordinates(spark):
    """An operand whose rows aren't summed yet gives the same as its sum, in every operator."""
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (2, 5.0), (2, -1.0)], "i long, x double")
    loose, whole = (Tensor.from_relation(rows, {"i": F.col("i")}, F.col("x"), dims={"i": 3}, summed=s) for s in (False, True))
    assert not loose.summed and whole.summed and loose.equals(whole) and whole.equals(loose)
    other = seq(spark, ["j"], [2])
    outer = loose.contract(other)
    assert not outer.summed and outer.shown().count() == 2 and outer.equals(whole.contract(other))
    assert loose.densify().df.count() == 3 and loose.densify().data() == [3, 0, 4]
    assert loose.transpose(["i"]).scale(2).conj().rename("i", "k").densify().data() == [6, 0, 8]
    assert loose.contract(loose).summed and loose.contract(loose).scalar() == 25
    assert loose.add(loose).data() == [6, 0, 8] and loose.set_value([0], 7).densify().data() == [7, 0, 4]
    assert np.allclose(matrices.diagonal_exp(Tensor.from_relation(rows, {"i": F.col("i"), "j": F.col("i")}, F.col("x"), dims={"i": 3, "j": 3}, summed=False)).data(), np.diag(np.exp([3, 0, 4])).ravel())
    with pytest.raises(Exception, match="out of range"):
        Tensor.from_relation(rows, {"i": F.col("i")}, F.col("x"), dims={"i": 2}, check=True).df.collect()


def test_random_does_not_depend_on_partitions(spark):
    rows = lambda t: sorted(map(tuple, t.df.collect()))
    want = rows(Tensor.random(spark, ["a", "b"], [30, 20], seed=5))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "11")
    try:
        assert rows(Tensor.random(spark, ["a", "b"], [30, 20], seed=5)) == want
    finally:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", before) if before else spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert rows(Tensor.random(spark, ["a"], [50])) != rows(Tensor.random(spark, ["a"], [50]))


def test_matrices(spark):
    m = Tensor.from_data(spark, ["i", "j"], [2, 2], [1, 2j, 3, 4])
    x = array(m)
    assert np.array_equal(array(matrices.multiply(m, m)), x @ x)
    assert np.array_equal(array(matrices.power(m, 5)), np.linalg.matrix_power(x, 5))
    assert np.array_equal(array(matrices.power(m, 0)), np.eye(2))
    assert np.array_equal(array(matrices.minus(m, matrices.eye(spark, 2))), x - np.eye(2))
    assert np.allclose(array(matrices.diagonal_exp(m)), np.diag(np.exp(np.diag(x))))
    assert np.array_equal(array(matrices.diagonal(spark, [1, 2j])), np.diag([1, 2j]))
    assert np.array_equal(array(add_all([m, m, m])), 3 * x)
