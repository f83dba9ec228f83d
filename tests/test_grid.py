"""Grids against NumPy on the gathered array."""

import numpy as np
import pytest

import gridframe as g
from gridframe.operators import scan
from pyspark.sql import functions as F

X = np.arange(189.0).reshape(9, 7, 3)
I = np.arange(24).reshape(6, 4) - 7  # noqa: E741
C = (X + 1j * X[::-1])[:4]
B = I % 3 == 0
N = X.copy()
N[2, 1, 0] = N[5, 3, 1] = np.nan
ARRAYS = {"X": X, "I": I, "C": C, "B": B, "N": N}


@pytest.fixture(scope="module")
def grids(spark):
    return {k: g.array(spark, v, n_blocks=4, split=(0, 1)) for k, v in ARRAYS.items()}


def same(got, expected):
    got = got.to_numpy() if isinstance(got, g.GridFrame) else np.asarray(got)
    expected = np.asarray(expected)
    assert got.shape == expected.shape and got.dtype == expected.dtype
    if got.dtype.kind in "fc":
        np.testing.assert_allclose(got, expected, rtol=1e-12, atol=1e-12)
    else:
        np.testing.assert_array_equal(got, expected)


CASES = {
    "round trip": lambda X, I, C, B, N: C,
    "expression": lambda X, I, C, B, N: 2 * X + np.sin(X) - X / 3,
    "reflected": lambda X, I, C, B, N: 1 - X + 5 // (X + 1),
    "floor divide": lambda X, I, C, B, N: I // 4,
    "floor divide negative": lambda X, I, C, B, N: I // -5,
    "float floor divide": lambda X, I, C, B, N: X // 2.5,
    "mod": lambda X, I, C, B, N: np.mod(I, -5),
    "fmod": lambda X, I, C, B, N: np.fmod(I, 5),
    "divide by zero": lambda X, I, C, B, N: I / (I - I),
    "power": lambda X, I, C, B, N: I**3,
    "root": lambda X, I, C, B, N: X**0.5,
    "row broadcast": lambda X, I, C, B, N: X + np.arange(3),
    "column broadcast": lambda X, I, C, B, N: X * np.arange(7)[:, None],
    "compare": lambda X, I, C, B, N: (I > 3) == (I < 5),
    "nan compare": lambda X, I, C, B, N: N == N,
    "where": lambda X, I, C, B, N: np.where(I > 0, I, 0),
    "clip": lambda X, I, C, B, N: np.clip(X, 5, 50),
    "clip one side": lambda X, I, C, B, N: np.clip(X, None, 50.0),
    "round": lambda X, I, C, B, N: np.round(X / 7, 1),
    "log": lambda X, I, C, B, N: np.log(I * 1.0),
    "minimum nan": lambda X, I, C, B, N: np.minimum(N, 5.0),
    "fmax nan": lambda X, I, C, B, N: np.fmax(N, 5.0),
    "bits": lambda X, I, C, B, N: np.bitwise_xor(np.left_shift(I, 2), 6),
    "invert": lambda X, I, C, B, N: np.invert(I),
    "gcd": lambda X, I, C, B, N: np.gcd(I, 12),
    "lcm": lambda X, I, C, B, N: np.lcm(I, 12),
    "logical": lambda X, I, C, B, N: np.logical_xor(B, I > 2),
    "nextafter": lambda X, I, C, B, N: np.nextafter(X, 3.0),
    "spacing": lambda X, I, C, B, N: np.spacing(X),
    "logaddexp": lambda X, I, C, B, N: np.logaddexp(X, 3.0),
    "signs": lambda X, I, C, B, N: np.copysign(X, -1.0) * np.heaviside(X, 0.5),
    "complex product": lambda X, I, C, B, N: C * C + C,
    "complex modulus": lambda X, I, C, B, N: abs(C),
    "complex parts": lambda X, I, C, B, N: np.real(np.conj(C)) + np.imag(C),
    "angle": lambda X, I, C, B, N: np.angle(C, deg=True),
    "sum": lambda X, I, C, B, N: np.sum(X),
    "sum axis": lambda X, I, C, B, N: np.sum(X, axis=(0, 2), keepdims=True),
    "sum no axis": lambda X, I, C, B, N: np.sum(I, axis=()),
    "int sum": lambda X, I, C, B, N: np.sum(I, axis=1),
    "bool sum": lambda X, I, C, B, N: np.sum(B),
    "complex sum": lambda X, I, C, B, N: np.sum(C, axis=1),
    "mean": lambda X, I, C, B, N: np.mean(X, axis=1),
    "bool mean": lambda X, I, C, B, N: np.mean(B),
    "var": lambda X, I, C, B, N: np.var(X, ddof=1),
    "std axis": lambda X, I, C, B, N: np.std(X, axis=0),
    "complex var": lambda X, I, C, B, N: np.var(C),
    "min": lambda X, I, C, B, N: np.min(I, axis=0),
    "nan min": lambda X, I, C, B, N: np.min(N, axis=0),
    "nan max": lambda X, I, C, B, N: np.max(N, axis=(0, 1)),
    "complex max": lambda X, I, C, B, N: np.max(C),
    "prod": lambda X, I, C, B, N: np.prod(np.mod(I, 3) + 1, axis=1),
    "all": lambda X, I, C, B, N: np.all(B, axis=0),
    "any": lambda X, I, C, B, N: np.any(B),
    "argmax ties": lambda X, I, C, B, N: np.argmax(np.mod(I, 5)),
    "argmin axis": lambda X, I, C, B, N: np.argmin(np.mod(I, 5), axis=1),
    "argmin nan": lambda X, I, C, B, N: np.argmin(N, axis=0),
    "argmax nan": lambda X, I, C, B, N: np.argmax(N),
    "vdot": lambda X, I, C, B, N: np.vdot(C, C),
    "norm": lambda X, I, C, B, N: np.linalg.norm(X),
    "cumsum": lambda X, I, C, B, N: np.cumsum(X, axis=0),
    "cumprod": lambda X, I, C, B, N: np.cumprod(np.mod(I, 3) + 1, axis=1),
    "concatenate": lambda X, I, C, B, N: np.concatenate([X, X + 1], axis=2),
    "stack": lambda X, I, C, B, N: np.stack([X, X + 1], axis=1),
    "out where": lambda X, I, C, B, N: np.add(X, 1, where=X > 50, out=X.copy()),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.filterwarnings("ignore")
def test_matches_numpy(grids, case):
    same(CASES[case](**grids), CASES[case](**ARRAYS))


@pytest.mark.parametrize("key", [np.s_[2:7], np.s_[::-2, 3], np.s_[..., 1], np.s_[8:1:-3, :, ::2], np.s_[3:3], np.s_[-1], np.s_[[3, 1, 1, -1]], np.s_[[3, 1], [2, 0]], np.s_[1, 2, 0]], ids=str)
def test_selection(grids, key):
    same(grids["X"][key], X[key])


def test_mask(grids):
    same(grids["X"][grids["X"] > 100], X[X > 100])


@pytest.mark.parametrize(
    ("key", "value"),
    [(np.s_[2:5, 1], 7.0), (np.s_[::2], np.arange(3.0)), (np.s_[1:3, ::-1], np.arange(42.0).reshape(2, 7, 3)), (np.s_[[1, 2, 1]], np.arange(63.0).reshape(3, 7, 3)), (X > 100, 0.0), (X > 100, np.arange((X > 100).sum()) * 1.0)],
    ids=str,
)
def test_assignment(grids, key, value):
    expected = X.copy()
    expected[key] = value
    same(grids["X"].assign(key, value), expected)


@pytest.mark.parametrize("key", [np.s_[9], np.s_[0, 0, 0, 0], np.s_[..., ...], np.s_[[20]]], ids=str)
def test_bad_indices(grids, key):
    with pytest.raises(IndexError):
        grids["X"][key]


def test_errors(grids, spark):
    with pytest.raises(ValueError):
        grids["X"] + np.ones(5)
    with pytest.raises(ValueError, match="Layouts"):
        grids["X"] + g.array(spark, X, n_blocks=2)
    with pytest.raises(np.exceptions.AxisError):
        grids["X"].sum(axis=3)
    with pytest.raises(ValueError):
        grids["X"].sum(axis=(0, 0))
    with pytest.raises(TypeError):
        np.sort(grids["X"])
    with pytest.raises(TypeError):
        hash(grids["X"])
    with pytest.raises(ValueError):
        bool(grids["X"])
    with pytest.raises(ValueError):
        g.arange(spark, 0, 5, 0)
    with pytest.raises(TypeError):
        grids["C"].argmax()
    with pytest.raises(ValueError):
        g.zeros(spark, (0, 3)).max()


def test_narrow_integers_wrap(spark):
    a = np.arange(250, 256, dtype=np.uint8)
    with np.errstate(all="ignore"):
        same(g.array(spark, a) + np.uint8(9), a + np.uint8(9))
    same(g.array(spark, np.arange(5, dtype="f4")) * 2, np.arange(5, dtype="f4") * 2)


@pytest.mark.parametrize("args", [(5,), (2, 9), (5, -3, -2), (0.5, 3, 0.25)])
def test_arange(spark, args):
    same(g.arange(spark, *args), np.arange(*args))


@pytest.mark.parametrize("args", [(0, 1, 7), (0, 1, 7, False), (3, -2, 1), (0, 1, 0)])
def test_linspace(spark, args):
    same(g.linspace(spark, *args), np.linspace(*args))


def test_empty(spark):
    assert g.zeros(spark, (0, 3)).sum() == 0.0 and g.zeros(spark, (0,)).all()


def test_validate(spark):
    g.ones(spark, (3, 2)).validate()
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0)], "i long, x double")
    with pytest.raises(ValueError):
        g.from_table(rows, ["i"], "x", (2,)).validate()


def test_one_projection_for_a_chain(grids):
    a = grids["X"]
    plan = (2 * a + np.sin(a) - a / 3).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_units(spark):
    m, cm = g.array(spark, np.arange(1.0, 5), unit="m"), g.array(spark, np.arange(1.0, 5) * 100, unit="cm")
    np.testing.assert_allclose((m + cm).to_numpy(), 2 * np.arange(1.0, 5))
    assert str((m + cm).unit) == "m" and (m * m).unit == g.unit("m^2") and np.sqrt(m * m).unit == g.unit("m")
    assert (m == cm).to_numpy().all()
    assert (m / cm).unit.dimensionless
    np.testing.assert_allclose(m.to_units("km").to_numpy(), np.arange(1.0, 5) / 1000)
    with pytest.raises(g.UnitError):
        m + g.array(spark, np.arange(1.0, 5), unit="s")
    with pytest.raises(g.UnitError):
        np.exp(m)
    with pytest.raises(g.UnitError):
        m.prod()
    with pytest.raises(g.UnitError):
        m.cumsum()
    with pytest.raises(g.UnitError):
        g.unit("deg_C")
    np.testing.assert_allclose(m.assign(np.s_[:2], cm[:2]).to_numpy(), np.arange(1.0, 5))


def test_labels(spark):
    a = g.ones(spark, (2, 3)).labeled("x", "y")
    assert a.to_labelled().columns == ["x", "y", "v"] and (a + 1).dims == ("x", "y") and a.sum(axis=0).dims == ("y",)
    with pytest.raises(ValueError):
        a.labeled("x", "x")


def test_npy(spark, tmp_path):
    for k, a in (*ARRAYS.items(), ("f", np.asfortranarray(C)), ("0", np.array(2.5)), ("32", np.arange(6, dtype="f4"))):
        np.save(tmp_path / f"{k}.npy", a)
        same(g.load(spark, str(tmp_path / f"{k}.npy")), a)
        if a.ndim:
            g.save(g.array(spark, a), str(tmp_path / f"{k}-out.npy"))
            np.testing.assert_array_equal(np.load(tmp_path / f"{k}-out.npy"), a)


def test_from_local(spark):
    rows = [(r, i, j, float(100 * r + 10 * i + j)) for r in range(3) for i in range(r + 1) for j in range(3)]
    pieces = spark.createDataFrame(rows, "r long, a long, b long, x double")
    same(g.from_local(pieces, "r", ["a", "b"], "x", (3,)), np.array([x for *_, x in rows]).reshape(6, 3))
    with pytest.raises(ValueError):
        g.from_local(pieces.where("not (r = 1 and a = 0 and b = 0)"), "r", ["a", "b"], "x", (3,))


SCANNED = [
    np.arange(1, 25).reshape(4, 6), np.arange(1, 25, dtype=np.int32).reshape(4, 6) - 9, (np.arange(24).reshape(4, 6) % 5 - 2) * (1 + 0.5j), np.arange(24, dtype=np.uint8).reshape(4, 6) * 11,
    np.full((4, 6), 2**62) - 3, np.arange(24).reshape(4, 6) % 3 == 0, np.linspace(-2, 2, 24).reshape(4, 6), np.full((4, 6), 2**40 + 1, np.uint64),
]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("x", SCANNED, ids=lambda x: f"{x.dtype}-{x.flat[1]}")
def test_running_totals_and_products_as_numpy(spark, x, monkeypatch):
    a = g.array(spark, x, n_blocks=4)
    for span in (100, 4):
        monkeypatch.setattr(scan, "SPAN", span)
        for f in (np.cumsum, np.cumprod):
            for axis in (0, 1):
                got, want = f(a, axis=axis), f(x, axis=axis)
                assert got.dtype == want.dtype
                if want.dtype.kind in "iu":
                    assert np.array_equal(got.to_numpy(), want)
                else:
                    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-12)
        np.testing.assert_allclose(a[1].cumsum().to_numpy(), x[1].cumsum(), rtol=1e-12)
    assert a.cumsum(1, dtype="complex128").dtype == np.complex128
    np.testing.assert_allclose(a.cumsum(1, dtype="float64").to_numpy(), x.cumsum(1, dtype="float64"))
    for axis in (None, 0, 1, (0, 1)):
        got, want = a.prod(axis=axis), x.prod(axis=axis)
        got = got if axis is None else got.to_numpy()
        assert np.asarray(got).dtype == want.dtype
        np.testing.assert_allclose(got, want, rtol=0 if want.dtype.kind in "iu" else 1e-12)
    assert a.prod(axis=1, keepdims=True).shape == (4, 1)
    with pytest.raises(TypeError):
        a.cumsum()


def test_complex_products_are_products(spark):
    x = np.array([1j, 1j, 2 + 1j, 0.5])
    assert g.array(spark, x).prod() == x.prod()


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("dtype", ["int64", "float64", "complex128", "bool"])
@pytest.mark.parametrize("name", "sum prod mean all any var".split())
def test_axes_without_cells(spark, name, dtype):
    for shape, axis in (((0, 3), 0), ((2, 0), 1), ((0, 3), 1), ((2, 0, 2), (0, 1)), ((0, 3), None)):
        x = np.zeros(shape, dtype)
        got, want = getattr(g.array(spark, x), name)(axis=axis), getattr(x, name)(axis=axis)
        got = got.to_numpy() if isinstance(got, g.GridFrame) else got
        np.testing.assert_array_equal(got, want)
        assert np.asarray(got).dtype == np.asarray(want).dtype


def test_missing_cells_raise(spark):
    a = g.array(spark, np.arange(6).reshape(2, 3))
    with pytest.raises(ValueError, match="rows"):
        a.like(a.value, base=a.base.where("i0 = 0")).to_numpy()


def test_unit_assignment_is_exact_or_raises(spark):
    metres = g.array(spark, np.arange(4), unit="m")
    assert metres.assign(np.s_[1:3], g.array(spark, np.array([200, 300]), unit="cm")).to_numpy().tolist() == [0, 2, 3, 3]
    for bad in (g.array(spark, np.array([5, 100]), unit="cm"), g.array(spark, np.array([0.5, 1.0]), unit="m"), g.array(spark, np.array([1e30, 1.0]), unit="m")):
        with pytest.raises(Exception, match="lose precision"):
            metres.assign(np.s_[1:3], bad).to_numpy()
    with pytest.raises(TypeError):
        metres.assign(np.s_[1:3], g.array(spark, np.array([1j, 2]), unit="m"))


def test_angles_of_zeros(spark):
    y, x = (v.ravel() for v in np.meshgrid([0.0, -0.0, 1.0, -1.0, np.inf, -np.inf, np.nan], [0.0, -0.0, 2.0, -2.0, np.inf, -np.inf, np.nan]))
    got, want = np.arctan2(g.array(spark, y), g.array(spark, x)).to_numpy(), np.arctan2(y, x)
    np.testing.assert_allclose(got, want, rtol=1e-15)
    assert np.array_equal(np.signbit(got), np.signbit(want) & ~np.isnan(want))


@pytest.mark.parametrize("seed", range(3))
def test_cuts_searched_on_executors(spark, seed, monkeypatch):
    from gridframe.operators import placement
    from gridframe.plans.layout import weighted_cuts

    rng = np.random.default_rng(seed)
    monkeypatch.setattr(placement, "SEARCHED", 12)
    for dtype in (np.int64, np.float64):
        w = rng.choice([0, 0, 0, 1, 2, 5, 10], (60, 4)).astype(dtype)
        for n in (2, 5, 9):
            assert placement.searched_cuts(g.array(spark, w), 0, n, 2) == weighted_cuts(w.sum(axis=1), n, 2)
    with pytest.raises(ValueError):
        placement.searched_cuts(g.array(spark, -w), 0, 2)
    assert placement.searched_cuts(g.array(spark, 0 * w), 0, 3) == (0, 20, 40, 60)


def test_numbering_in_levels(spark, monkeypatch):
    from gridframe.operators import select

    monkeypatch.setattr(select, "SPAN_BITS", 2)
    x = np.arange(300)
    a = g.array(spark, x)
    assert np.array_equal(a[np.mod(a, 7) < 3].to_numpy(), x[x % 7 < 3])
    b = a.assign(np.mod(a, 5) == 0, np.arange(60) * 10).to_numpy()
    assert np.array_equal(b[::5], np.arange(60) * 10)


@pytest.mark.parametrize("x", [np.arange(60).reshape(5, 12), np.array(3.5), np.zeros((0, 3)), np.arange(6).reshape(2, 3) * (1 - 2j), np.arange(5, dtype=np.uint64), np.array([True, False])], ids=lambda x: f"{x.dtype}{x.shape}")
def test_npy_by_file_uri(spark, tmp_path, x):
    path = f"file://{tmp_path}/a.npy"
    g.save(g.array(spark, x), path)
    assert np.array_equal(np.load(tmp_path / "a.npy"), x) and np.load(tmp_path / "a.npy").dtype == x.dtype
    assert np.array_equal(g.load(spark, path).to_numpy(), x)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.npy"]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    a = g.array(spark, np.arange(100), n_blocks=2)
    fails = a.like(F.when(F.col("i0") == 77, F.raise_error(F.lit("no such value")).cast("long")).otherwise(a.value))
    short = a.like(a.value, base=a.base.where("i0 <> 5"))
    for bad, said in ((fails, "no such value"), (short, "99 of 100")):
        with pytest.raises(Exception, match=said):
            g.save(bad, str(tmp_path / "b.npy"))
        assert not [p for p in tmp_path.iterdir() if p.name.startswith("b.npy")]


def test_profiles(spark):
    x = np.arange(600).reshape(20, 30)
    a = g.array(spark, x)
    with g.Profile(spark) as p:
        with p.region("energy"):
            assert (a * a).sum() == (x * x).sum()
        rows = a[5:].sum(axis=0).cumsum()
        assert p.rows() == {"reduce": 600} and p.jobs("energy") >= 1
        with p.region("lines"):
            assert np.array_equal(rows.to_numpy(), x[5:].sum(axis=0).cumsum())
    assert p.rows() == {"reduce": 600 + 450, "select": 450, "scan": 30} and p.jobs("lines") >= 1
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    plan = a.sum(axis=0).df._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" not in plan
