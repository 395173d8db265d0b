"""Golden values, analytic results and round trips of the engine."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import geometry as g
from skyframe.functions import models
from skyframe.functions import special as sp
from skyframe.operators import grid as gr
from skyframe.operators import matrices as mx
from skyframe.operators import mock, pairs
from skyframe.operators import signal as sg
from skyframe.plans.catalog import QUERIES, SQL
from skyframe.sources import blocks, config, tables
from tests.conftest import SF

TABLES = ["nation", "orders", "lineitem", "embeddings"]


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def comparable(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", ["cell_counts", "kl_projection", "sep_rmu", "legendre_p", "residual_matrix", "bias_term", "mixing_identity_estimate", "mixing_inverse_2x2", "pk_rebin_weighted", "pairs_rr", "healpix_nest", "healpix_ring_centre", "estimator_two_cells", "signal_matrix_rsd", "sample3d", "xi_sampled", "scan_blocks", "overlapping_bins"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert comparable(df.collect(), df.columns) == comparable(want.fetchall(), cols)


def test_periodic_distance(spark):
    far = value(spark, g.box_separation((10, 20, 30), (70, 80, 90), 100))
    near = value(spark, g.box_separation((10, 20, 30), (70, 80, 50), 100))
    assert math.isclose(far, math.sqrt(3 * 40**2)) and math.isclose(near, math.sqrt(2 * 40**2 + 20**2))


def test_matrix_golden_values(spark):
    a = np.array([[1, 1, 2], [2, 4, -3], [3, 6, -5]], float)
    assert np.allclose(mx.inverse(a), [[2, -17, 11], [-1, 11, -7], [0, 3, -2]])
    t = 2 * np.eye(5) - np.eye(5, k=1) - np.eye(5, k=-1)
    assert np.allclose(mx.square_root(t @ t), t)
    n, j = 11, 5
    up = [math.sqrt(j * (j + 1) - m * (m + 1)) / 2 for m in range(-j, j)]
    rows = [(k, k + 1, v) for k, v in enumerate(up)] + [(k + 1, k, v) for k, v in enumerate(up)]
    s = spark.createDataFrame(rows, "i long, j long, v double")
    evals, vecs = mx.top_modes(s, n, 6)
    assert np.allclose([r["lambda"] for r in evals.orderBy("i").collect()], [5, 4, 3, 2, 1, 0], atol=1e-10)
    dense = np.diag(up, 1) + np.diag(up, -1)
    for i, lam in ((r["i"], r["lambda"]) for r in evals.collect()):
        v = np.array([r["v"] for r in vecs.where(F.col("i") == i).orderBy("a").collect()])
        assert np.allclose(dense @ v, lam * v, atol=1e-9)


def test_distributed_modes(spark, monkeypatch):
    monkeypatch.setattr(mx, "DRIVER", 0)
    s = spark.range(400).select(F.floor(F.col("id") / 20).alias("i"), (F.col("id") % 20).alias("j")).withColumn("v", F.exp(-0.2 * F.abs(F.col("i") - F.col("j"))))
    got = [r["lambda"] for r in mx.top_modes(s, 20, 3)[0].orderBy("i").collect()]
    want = np.sort(np.linalg.eigvalsh(np.exp(-0.2 * np.abs(np.subtract.outer(np.arange(20), np.arange(20))))))[::-1][:3]
    assert np.allclose(got, want)


def test_window_rows_sum_to_one():
    f = np.array([[4.0, 1.0], [1.0, 3.0]])
    for kind in ("inverse", "root", "identity"):
        e = mx.estimate(f, np.array([1.0, 2.0]), np.zeros(2), kind)
        assert np.allclose(e["window"].sum(axis=1), 1)


def test_quadrature():
    got, _ = sg.adaptive(lambda p: np.sin(p[:, 0]) * np.cos(p[:, 1]) * np.exp(p[:, 2]), [0, 0, 0], [1, 1, 1], epsrel=1e-10)
    assert math.isclose(got, 0.664669679978137714, rel_tol=1e-9)
    got, _ = sg.adaptive(lambda p: 1 / np.sqrt(p[:, 0]), [0], [1], epsrel=1e-4)
    assert abs(got - 2) < 2e-3


def test_signal_matrix_of_known_models(spark):
    cells = gr.number_cells(sg.cell_integral(gr.Grid((0, 0, 0), (2, 1, 1), (2, 1, 1)).cells(spark), lambda x, y, z: F.lit(1.0) + x * 0, 2))
    assert [r["v"] for r in sg.signal_matrix(cells, lambda r: F.lit(1.0) + r * 0, 2).collect()] == pytest.approx([1.0] * 4)
    cube = gr.number_cells(sg.cell_integral(gr.Grid((0, 0, 0), (10, 10, 10), (1, 1, 1)).cells(spark), lambda x, y, z: F.lit(1.0) + x * 0, 2))
    s2 = 25.0  # a wide Gaussian: few nodes are enough
    got = sg.signal_matrix(cube, lambda r: (2 * math.pi * s2) ** -1.5 * F.exp(-r * r / (2 * s2)), 6).first()["v"]
    s, size = math.sqrt(s2), 10.0
    one = size * math.erf(size / math.sqrt(2) / s) - s * math.sqrt(2 / math.pi) * (1 - math.exp(-size * size / 2 / s2))
    assert math.isclose(got * 1000, one**3, rel_tol=1e-3)  # the matrix is over the root of both cells' 1000 points


def test_gaussian_transform(spark):
    k = spark.range(2001).select(F.col("id").alias("i"), (F.col("id") * 0.005).alias("k")).withColumn("p", (2 * math.pi) ** 1.5 * F.exp(-F.col("k") * F.col("k") / 2))
    r = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "r double")
    for row in sg.transform(k, r, 0, 2, 1e9).collect():
        assert abs(row["xi"] - math.exp(-row["r"] ** 2 / 2)) < 1e-5


def test_models(spark):
    with pytest.raises(KeyError):
        models.make({"model": "none"})
    m = models.make({"model": "test", "A": "2", "b": "0.1"})
    assert math.isclose(value(spark, m.xi(F.lit(2.0))), 2 * math.exp(-0.4)) and math.isclose(value(spark, m.xi_deriv(1, F.lit(2.0))), -8 * math.exp(-0.4))
    bands = {"n_bands": "3", "kmin": "0.01", "kmax": "0.31"}
    for name, arg in (("real", (10.0,)), ("kaiser", (10.0, 0.3)), ("knots", (10.0,)), ("bins", (1.5,))):
        m = models.make({"model": name, **bands, "knots": "0.01 0.1 0.2 0.3", "edges": "0, 1, 2, 3", "values": "5 6 7"})
        total = sum(m.param(n) * value(spark, m.xi_deriv(n, *map(F.lit, arg))) for n in range(m.n_params))
        assert math.isclose(value(spark, m.xi(*map(F.lit, arg))), total, rel_tol=1e-9)


def test_pairs_count_each_once(spark):
    rng = np.random.default_rng(3)
    p = rng.random((200, 3)) * 10
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    for size in (None, 10.0):
        for smax in (0.9, 3.0, 4.9, 6.0):
            d = p[:, None] - p[None]
            if size:
                d -= size * np.round(d / size)
            want = int((np.sqrt((d**2).sum(-1))[np.triu_indices(200, 1)] < smax).sum())
            assert pairs.pairs(df, None, smax, size).count() == want, (size, smax)


def test_field_is_real_and_sampled(spark):
    m = mock.modes(spark, 8, 100.0, lambda k: 1e4 * k * F.exp(-20 * k), 7)
    back = gr.fft(m, 8, inverse=True).agg(F.max(F.abs("im")).alias("im"), F.max(F.abs("re")).alias("re"), F.sum("re").alias("sum")).first()
    assert back["im"] < 1e-9 < back["re"] and abs(back["sum"]) < 1e-8
    v = mock.velocity(m, 8, 100.0, 0.5, 0)
    assert v.count() == 512
    u = spark.range(4000).select(sp.poisson(sp.uniform(1, F.col("id")), F.lit(4.0)).alias("s"), sp.poisson(sp.uniform(2, F.col("id")), F.lit(80.0)).alias("b"), sp.normal(sp.uniform(3, F.col("id"))).alias("n"))
    a = u.agg(F.avg("s"), F.variance("s"), F.avg("b"), F.variance("b"), F.avg("n"), F.variance("n")).first()
    assert [round(x, 1) for x in a] == pytest.approx([4, 4, 80, 80, 0, 1], rel=0.08, abs=0.1)


def test_record_blocks(spark, tmp_path):
    path = str(tmp_path / "a.abn")
    df = spark.range(100).select(F.cos("id").alias("v"), F.col("id").alias("pos"))
    cells = spark.range(3).select(F.col("id").cast("int").alias("a"), F.col("id").cast("float").alias("x"))
    blocks.write_blocks(path, [(df, "d", {"Nmodes": 10}), (cells, "if", {})])
    head = blocks.headers(path)
    assert [(h["n"], h["size"], h["format"]) for h in head] == [(100, 8, "d"), (3, 8, "if")] and head[0]["options"] == {"Nmodes": "10"}
    got = blocks.read_blocks(spark, path, "v", recordsPerTask=30)
    assert got.rdd.getNumPartitions() == 4
    assert [r["v"] for r in got.orderBy("pos").collect()] == pytest.approx([math.cos(i) for i in range(100)], abs=1e-15)
    assert [r["pos"] for r in blocks.read_blocks(spark, path, "v", first=10, last=19).collect()] == list(range(10, 20))
    assert [(r["a"], r["x"]) for r in blocks.read_blocks(spark, path, "a,x", block=1).collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    data = open(path, "rb").read()
    for k in range(0, len(data), 399):
        (tmp_path / f"b{k // 399:02d}").write_bytes(data[k : k + 399])
    parts = blocks.Parts(str(tmp_path / "b"))
    parts.skip(500)
    assert parts.read(10**6) == data[500:] and blocks.read_blocks(spark, str(tmp_path / "b"), "v").count() == 100


def test_config(tmp_path):
    c = config.parse("a = 1 # one\nfoo.a=a\nfoo.b = 'b'\nfood = wise\nlist = 0 1, 2, 3,\n# x = y\na = 2\n")
    assert c["a"] == "2" and config.sub(c, "foo.") == {"a": "a", "b": "b"} and config.array(c, "list", int) == [0, 1, 2, 3]
    config.write(str(tmp_path / "c"), c)
    assert config.read(str(tmp_path / "c"), "a = 3") == {**c, "a": "3"}
    with pytest.raises(KeyError):
        config.require(c, "missing")
    with pytest.raises(KeyError):
        config.choice(c, "food", ["a", "w"])


def test_tables(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# k p\n 1.5  2 3\n\n2.5 4 5 # end\n")
    assert [tuple(r) for r in tables.read_columns(spark, str(p), k=1, p=3).orderBy("k").collect()] == [(1.5, 3.0), (2.5, 5.0)]
    tables.write_map(str(tmp_path / "m.fits"), np.arange(48) / 2, "RING")
    df, nside, order = tables.read_map(spark, str(tmp_path / "m.fits"))
    assert (nside, order, [r["value"] for r in df.orderBy("ipix").collect()]) == (2, "RING", [i / 2 for i in range(48)])
    tables.write_vtk(str(tmp_path / "c.vtk"), gr.Grid((0, 0, 0), (2, 1, 1), (2, 1, 1)).cells(spark), ["veff"])
    assert "POINTS 12 double" in (tmp_path / "c.vtk").read_text()


def test_splines():
    x, y = [0.0, 1.0, 2.5, 4.0, 7.0], [1.0, 2.0, 0.0, 5.0, 5.5]
    t = sp.spline_table(x, y, "cubic")
    for (lo, hi, a, b, c, d), nxt in zip(t, [*t[1:], None], strict=True):
        h = hi - lo
        if nxt:
            assert math.isclose(a + h * (b + h * (c + h * d)), nxt[2], abs_tol=1e-12)
            assert math.isclose(b + h * (2 * c + 3 * h * d), nxt[3], abs_tol=1e-12)
            assert math.isclose(2 * c + 6 * h * d, 2 * nxt[4], abs_tol=1e-12)
    cube = [v**3 for v in x]
    for lo, _, a, b, c, d in sp.spline_table(x, cube, "cubic"):
        assert np.allclose([a, b, c, d], [lo**3, 3 * lo**2, 3 * lo, 1])
