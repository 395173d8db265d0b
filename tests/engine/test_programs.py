"""Configurations to band powers, typed files, surveys and mocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import geometry as g
from skyframe.functions import models
from skyframe.functions import pixels as px
from skyframe.functions import special as sp
from skyframe.operators import grid as gr
from skyframe.operators import matrices as mx
from skyframe.operators import mock, pairs
from skyframe.operators import signal as sg
from skyframe.plans import programs, survey
from skyframe.sources import blocks, config, loaders, tables


@pytest.fixture(scope="module")
def box(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("box")
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, *map(float, rng.random(3) * 40), 1.0) for i in range(4000)], "pos long, x double, y double, z double, w double")
    blocks.write_blocks(str(d / "gals"), [(pts, "4f", {"coordsys": "cartesian"})])
    lines = [f"{a}{e} = {v}" for a in "XYZ" for e, v in (("Min", 0), ("Max", 40))] + ["Nx = 4", "Ny = 3", "Nz = 2", f"galfile = {d}/gals", "nbar = 0.0625", "L = 80", "coordsys = cartesian", "Nmodes = 14", "nodes = 2"]
    lines += [f"{k} = {d}/{k}" for k in ("cellfile", "modefile", "evalfile", "covfile", "pixfile", "estfile")]
    return config.parse("\n".join(lines))


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_config_to_band_powers(spark, box):
    cfg = box | {"model": "test", "A": "0.4", "b": "0.01"}
    got = programs.run_all(spark, cfg)
    cells = {r["a"]: r for r in loaders.read_cells(spark, cfg["cellfile"]).collect()}
    n = len(cells)
    assert n == 24
    # the same, densely
    x, w = sg.nodes(2)
    h = [10, 40 / 3, 20]

    def signal(f):
        s = np.zeros((n, n))
        for i in range(n):
            for j in range(n):
                total = 0.0
                for t in np.ndindex(2, 2, 2):
                    for u in np.ndindex(2, 2, 2):
                        d = [(cells[i][f"d{k + 1}"] - cells[j][f"d{k + 1}"] + x[t[k]] - x[u[k]]) * h[k] for k in range(3)]
                        total += math.prod(w[t[k]] * w[u[k]] for k in range(3)) * f(math.sqrt(sum(v * v for v in d)))
                s[i, j] = total * math.sqrt(cells[i]["nbar"] * cells[j]["nbar"])
        return s

    s = signal(lambda r: 0.4 * math.exp(-0.01 * r * r))
    lam, v = np.linalg.eigh(s)
    lam, v = lam[::-1][:14], v[:, ::-1][:, :14].T
    assert np.allclose([r["lambda"] for r in loaders.read_series(spark, cfg["evalfile"], "lambda").orderBy("i").collect()], lam, rtol=1e-9)
    grid = survey.make(spark, cfg).grid
    pos = [list(r) for r in loaders.read_galaxies(spark, cfg["galfile"]).select("x", "y", "z").collect()]
    count = np.zeros(n)
    for p in pos:
        place = [int((c - lo) * k / (hi - lo)) for c, lo, hi, k in zip(p, grid.lo, grid.hi, grid.n, strict=True)]
        count[(place[0] * 3 + place[1]) * 2 + place[2]] += 1
    nbar = np.array([cells[a]["nbar"] for a in range(n)])
    y = v @ ((count - nbar) / np.sqrt(nbar))
    derivs = [v @ signal(f) @ v.T for f in (lambda r: math.exp(-0.01 * r * r), lambda r: -0.4 * r * r * math.exp(-0.01 * r * r))]
    c = np.diag(1 + lam)
    ci = np.linalg.inv(c)
    rest = c - 0.4 * derivs[0] - 0.01 * derivs[1]
    fisher = np.array([[np.trace(ci @ a @ ci @ b) / 2 for b in derivs] for a in derivs])
    q = np.array([y @ ci @ a @ ci @ y / 2 for a in derivs])
    b = np.array([np.trace(ci @ a @ ci @ rest) / 2 for a in derivs])
    assert np.allclose(dense(got["fisher"], 2), fisher, rtol=1e-7)
    want = mx.estimate(fisher, q, b)
    assert np.allclose([r["v"] for r in got["phat"].orderBy("i").collect()], want["phat"], rtol=1e-6)
    assert np.allclose(dense(got["cov"], 2), want["cov"], rtol=1e-6)


def test_redshift_space_estimate(spark, box):
    cfg = box | {"model": "kaiser", "n_bands": "1", "kmin": "0.02", "kmax": "0.12", "f": "0.5", "Nmodes": "6", "Nx": "2", "Ny": "2", "Nz": "3"}
    got = programs.run_all(spark, cfg)
    assert got["phat"].count() == 3 and got["fisher"].count() == 9
    # along the line of sight and across it, cells are not alike
    s = survey.make(spark, cfg)
    cells = gr.number_cells(s.selection().over(s.grid.cells(spark), 2, False))
    m = models.make(cfg)
    sig = {(r["i"], r["j"]): r["v"] for r in sg.signal_matrix(cells, m.xi, 3).collect()}
    slow = {(r["i"], r["j"]): r["v"] for r in sg.signal_matrix(cells, m.xi, 3, dedup=False).collect()}
    assert sig.keys() == slow.keys() and all(math.isclose(sig[k], slow[k], rel_tol=1e-9, abs_tol=1e-12) for k in sig)
    sphere = gr.Grid((10.0, -0.5, 0.0), (20.0, 0.5, 1.0), (2, 2, 2), True)
    cells = gr.number_cells(sg.cell_integral(sphere.cells(spark), lambda r, mu, phi: F.lit(0.1) + r * 0, 2, True))
    both = {(r["i"], r["j"]): r["v"] for r in sg.spherical_signal(cells, m.xi, 2).collect()}
    assert len(both) == 64 and all(math.isclose(both[i, j], both[j, i], rel_tol=1e-6, abs_tol=1e-12) for i, j in both)


def test_krylov_step_equals_dense(spark, box, tmp_path):
    cfg = box | {"model": "test", "A": "0.4", "b": "0.01", "Nmodes": "5"}
    programs.make_cells(spark, cfg)
    out = []
    for solver in ("dense", "krylov"):
        c = cfg | {"solver": solver, "modefile": str(tmp_path / f"m{solver}"), "evalfile": str(tmp_path / f"e{solver}")}
        programs.find_modes(spark, c)
        out.append([r["lambda"] for r in loaders.read_series(spark, c["evalfile"], "lambda", Nmodes=5).orderBy("i").collect()])
    assert np.allclose(*out, rtol=1e-4)
    with pytest.raises(KeyError):
        programs.find_modes(spark, cfg | {"solver": "none"})
    with pytest.raises(ValueError, match="modes"):
        programs.find_modes(spark, cfg | {"Nmodes": "50"})


def test_surveys_check_their_configuration(spark, tmp_path):
    base = config.parse("XMin=0\nXMax=1\nYMin=2\nYMax=3\nZMin=4\nZMax=5\nNx=6\nNy=7\nNz=8\ngalfile=x\nnbar=2\nL=9\ncoordsys=cartesian")
    s = survey.make(spark, base)
    assert (s.lo, s.hi, s.n) == ((0, 2, 4), (1, 3, 5), (6, 7, 8)) and s.options()["L"] == 9
    r, mu = s.separation().rmu((1, 2, 3), (7, 7, 7))
    assert [x for x in spark.range(1).select(r, mu).first()] == [spark.range(1).select(c).first()[0] for c in g.box_rmu((1, 2, 3), (7, 7, 7), 9)]
    for bad in ({"XMax": "0"}, {"Nx": "0"}):
        with pytest.raises(ValueError):
            survey.make(spark, base | bad)
    with pytest.raises(KeyError):
        survey.make(spark, {k: v for k, v in base.items() if k != "nbar"})
    with pytest.raises(KeyError):
        survey.make(spark, {"survey": "none"})
    mask = np.arange(48) % 3 / 2
    (tmp_path / "radial").write_text("0 0\n10 2\n20 0\n")
    for order in ("RING", "NESTED"):
        tables.write_map(str(tmp_path / "mask"), mask, order)
        sky = survey.make(spark, config.parse(f"RMin=0\nRMax=20\nMuMin=-1\nMuMax=1\nPhiMin=0\nPhiMax=6\nNr=2\nNmu=2\nNphi=2\ncoordsys=spherical\ngalfile=x\nmaskfile={tmp_path}/mask\nradial={tmp_path}/radial"))
        pts = spark.createDataFrame([(5.0, 0.3, 1.0), (15.0, -0.9, 4.0), (25.0, 0.0, 2.0)], "r double, mu double, phi double")
        pixel = px.ring_pixel if order == "RING" else px.nest_pixel
        rows = sky.selection().evaluate(pts.withColumn("p", pixel(2, F.col("mu"), F.col("phi")))).collect()
        assert [r["nbar"] for r in rows] == pytest.approx([mask[r["p"]] * max(0, 2 - abs(r["r"] - 10) / 5) if r["r"] < 20 else 0 for r in rows])


def test_typed_files(spark, tmp_path):
    path = str(tmp_path / "f")
    modes = spark.range(12).select(F.floor(F.col("id") / 4).alias("i"), (F.col("id") % 4).alias("a"), F.cos("id").alias("v"))
    loaders.write_modes(path, modes, 3, 4)
    got, n, cells = loaders.read_modes(spark, path)
    assert (n, cells) == (3, 4) and sorted(map(tuple, got.collect())) == sorted(map(tuple, modes.collect()))
    cov = spark.range(2).join(spark.range(9).withColumnRenamed("id", "k")).select(F.col("id").alias("m"), F.floor(F.col("k") / 3).alias("i"), (F.col("k") % 3).alias("j"), F.sin("k").alias("v")).where("i <= j")
    loaders.write_covariance(path, cov, 3, 2)
    got, n, p = loaders.read_covariance(spark, path)
    assert (n, p) == (3, 2) and sorted(map(tuple, got.collect())) == sorted(map(tuple, cov.collect()))
    full = spark.range(18).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    blocks.write_blocks(path, [(full, "d", {"Nmodes": 3, "Nparams": 2, "packed": 0})])
    assert {(r["m"], r["i"], r["j"]): r["v"] for r in loaders.read_covariance(spark, path)[0].collect()}[1, 0, 2] == 11.0
    with pytest.raises(ValueError):
        loaders.read_modes(spark, path)
    e = mx.estimate(np.array([[4.0, 1], [1, 3]]), np.array([1.0, 2]), np.zeros(2))
    loaders.write_estimate(spark, path, e)
    back = loaders.read_estimate(spark, path)
    assert np.allclose(dense(back["window"], 2), e["window"]) and [r["v"] for r in back["q"].orderBy("i").collect()] == [1.0, 2.0] and len(back) == 7
    with pytest.raises(ValueError):
        loaders.read_cells(spark, path)


def test_parts_written_by_tasks(spark, tmp_path):
    path = str(tmp_path / "big")
    df = spark.range(1000).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("a"), F.sqrt("id").alias("v")).repartition(7)
    for _ in range(2):
        blocks.write_parts(df, path, "id", {"Nmodes": 3})
    assert blocks.headers(path)[0]["n"] == 1000 and blocks.headers(path)[0]["options"] == {"Nmodes": "3"}
    got = blocks.read_blocks(spark, path, "a,v", recordsPerTask=300).orderBy("pos").collect()
    assert [(r["pos"], r["a"], r["v"]) for r in got] == [(i, i, math.sqrt(i)) for i in range(1000)]


def test_particles_and_catalogue(spark, tmp_path):
    rng = np.random.default_rng(2)
    pos, vel = rng.random((500, 3)).astype("f4"), rng.random((500, 3)).astype("f4") / 100
    head = np.array([(1, 20, 500, 0, 0, 1.0, 0.1)], loaders.PARTICLE_HEAD)
    (tmp_path / "dm").write_bytes(head.tobytes() + pos.tobytes() + vel.tobytes())
    df = loaders.read_particles(spark, str(tmp_path / "dm"), 100.0, per_task=200)
    got = np.array([list(r) for r in df.orderBy("id").collect()])
    assert df.rdd.getNumPartitions() == 3 and np.allclose(got[:, 1:4], pos * 100.0, rtol=1e-6) and np.allclose(got[:, 4:], vel * 100.0, rtol=1e-6)
    inside = loaders.particles_in(df, ((0, 50), (0, 100), (20, 100)))
    assert inside.count() == ((got[:, 1] <= 50) & (got[:, 3] >= 20)).sum()
    sky = loaders.particles_in(df, ((0, 60), (-1, 1), (0, 7)), True, (50.0, 50.0, 50.0), True)
    d = got[:, 1:4] - 50
    r = np.linalg.norm(d, axis=1)
    assert sky.count() == (r + (d * got[:, 4:]).sum(axis=1) / r <= 60).sum()
    (tmp_path / "bad").write_bytes(b"\0" * 40)
    with pytest.raises(ValueError):
        loaders.read_particles(spark, str(tmp_path / "bad"), 1.0)
    (tmp_path / "cat").write_text("7 1 2 180.0 30.0 29979.2458 0.1 0.5\n8 1 2 0 -90 600000 1 1\n9 1 2 0 0 4000000 1 1\nshort line\n")
    rows = {r["id"]: r for r in loaders.read_survey_text(spark, str(tmp_path / "cat")).collect()}

    def chi(z):
        e = lambda x: 1 / math.sqrt(0.272 * (1 + x) ** 3 + 0.728)
        steps = [0.001 * k for k in range(int(z / 0.001) + 1)] + [z]
        return 2997.92458 * sum((b - a) * (e(a) + e(b)) / 2 for a, b in zip(steps, steps[1:], strict=False))

    assert len(rows) == 3 and rows[7]["mu"] == pytest.approx(0.5) and rows[7]["phi"] == pytest.approx(math.pi) and rows[8]["mu"] == pytest.approx(-1)
    for k, cz in ((7, 29979.2458), (8, 600000.0), (9, 4e6)):
        assert rows[k]["r"] == pytest.approx(chi(cz / 299792.458), rel=1e-9)


def test_adaptive_cell_pairs(spark):
    """A Gaussian factors into closed forms of each axis."""
    cells = gr.number_cells(sg.cell_integral(gr.Grid((0, 0, 0), (20, 10, 10), (2, 1, 1)).cells(spark), lambda x, y, z: F.lit(1.0) + x * 0, 2))
    got = {(r["i"], r["j"]): r["v"] for r in sg.adaptive_signal(cells, lambda r: np.exp(-r * r / 2), 1e-7).collect()}
    n = 4000
    t = (np.arange(-n, n) + 0.5) / n

    def axis(o):
        return ((1 - abs(t)) * np.exp(-(((o + t) * 10) ** 2) / 2)).sum() / n

    assert got[0, 0] == pytest.approx(1000 * axis(0) ** 3, rel=1e-4) and got[0, 1] == pytest.approx(1000 * axis(1) * axis(0) ** 2, rel=1e-4)
    aniso = {(r["i"], r["j"]): r["v"] for r in sg.adaptive_signal(cells, lambda r, mu: 1 + 0 * r * mu).collect()}
    assert list(aniso.values()) == pytest.approx([1000.0] * 4)


def test_correlation_until_it_holds(spark):
    n = spark.range(300).select("id", *((sp.uniform(1, F.col("id"), F.lit(k)) * 10).alias("xyz"[k]) for k in range(3)))
    draw = lambda k: (n, mock.uniform_catalogue(spark, 400, 10.0, 5).select("id", "x", "y", "z"))
    got, many, agreed = pairs.converge(draw, 2, 0.0, 3.0, 3, {0: (1e-6, 1e-6), 2: (1e-6, 1e-6)}, 10.0, passes=3, most=8)
    assert agreed and many == 4 and got.count() == 3  # the same samples each time: all agree from the second on
    moving = lambda k: (n.where(F.col("id") % (k + 2) > 0), draw(k)[1])
    assert pairs.converge(moving, 2, 0.0, 3.0, 3, {0: (1e-9, 1e-9)}, 10.0, passes=2, most=3)[1:] == (3, False)


def test_mocks(spark, tmp_path):
    points, pk = programs.mock_catalogue(spark, config.parse("N = 8\nL = 100\nnbar = 0.003\nseed = 3\nR = 5\nf = 0.5\nkmax = 0.25\nbins = 3\nA = 2e4"))
    rows = points.collect()
    assert abs(len(rows) - 3000) < 1200 and len({r["id"] for r in rows}) == len(rows) and all(0 <= r[c] <= 100 for r in rows for c in "xyz") and any(r["vx"] for r in rows)
    assert pk.count() == 3
    xi, many, _ = programs.mock_correlation(spark, config.parse("N = 4\nL = 50\nnbar = 0.004\nsmin = 1\nsmax = 12\nnsbins = 2\nnmubins = 2\nmaxsamp = 2\nA = 2e4\nR = 5"))
    assert many == 2 and xi.count() == 2
    full = spark.range(20_000).select("id", *((sp.uniform(9, F.col("id"), F.lit(k)) * 200).alias("xyz"[k]) for k in range(3)))
    blocks.write_blocks(str(tmp_path / "g"), [(full.select(F.col("id").alias("pos"), "x", "y", "z", F.lit(1.0).alias("w")), "4f", {})])
    mask = (np.arange(48) % 2).astype(float)
    tables.write_map(str(tmp_path / "mask"), mask, "NESTED")
    (tmp_path / "radial").write_text("20 0\n40 1\n80 1\n90 0\n95 0\n")
    cfg = {"galfile": str(tmp_path / "g"), "maskfile": str(tmp_path / "mask"), "radial": str(tmp_path / "radial"), "L": "200", "Ngals": "800", "origin": "100 100 100"}
    got = programs.mock_survey(spark, cfg).withColumn("p", px.nest_pixel(2, F.col("mu"), F.col("phi"))).collect()
    assert abs(len(got) - 800) < 150 and all(mask[r["p"]] and 20 < r["r"] < 90 for r in got)
    with pytest.raises(ValueError, match="too few"):
        programs.mock_survey(spark, cfg | {"Ngals": "100000"})


def test_exact_draws(spark):
    def cdf(k, m):
        return sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(int(k) + 1))

    for m in (0.3, 29.0, 45.0, 99.5, 100.5, 2000.0):
        for r in spark.range(40).select(sp.uniform(2, F.col("id")).alias("u")).select("u", sp.poisson(F.col("u"), F.lit(m)).alias("k")).collect():
            assert cdf(r["k"], m) >= r["u"] - 1e-9 and (r["k"] == 0 or cdf(r["k"] - 1, m) < r["u"] + 1e-9)
    c = {(a, b, e): F.lit(float(1 + 3 * a + 2 * b + 5 * e * a)) for a in (0, 1) for b in (0, 1) for e in (0, 1)}
    mean = spark.range(40_000).select(sp.trilinear_draw(c, tuple(sp.uniform(3, F.col("id"), F.lit(k)) for k in range(3))).alias("t")).agg(*(F.avg(f"t.t{k}") for k in (1, 2, 3))).first()
    x = (np.arange(50) + 0.5) / 50
    a, b, e = np.meshgrid(x, x, x, indexing="ij")
    f = 1 + 3 * a + 2 * b + 5 * e * a
    assert list(mean) == pytest.approx([(f * v).sum() / f.sum() for v in (a, b, e)], abs=0.01)
    net = np.array([list(r) for r in spark.range(256).select(*sp.sobol(F.col("id"), 10)).collect()])
    assert all(len(set(np.floor(net[:, k] * 256))) == 256 for k in range(10))
    assert all(len(set(zip(np.floor(net[:, i] * 16), np.floor(net[:, i + 1] * 16), strict=True))) == 256 for i in (0,))


def test_solver_and_products(spark):
    rng = np.random.default_rng(4)
    table = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")

    def back(df, shape):
        out = np.full(shape, np.nan)
        for r in df.collect():
            out[r["i"], r["j"]] = r["v"]
        return out

    a, b = rng.random((7, 10)), rng.random((10, 5))
    assert np.allclose(back(mx.multiply(table(a), table(b), size=4), (7, 5)), a @ b)
    assert np.allclose(back(mx.multiply(table(a.T), table(b.T), "T", "T", size=3), (7, 5)), a @ b)
    assert mx.multiply(table(a).where("i < 3 and j = 2"), table(b).where("j = 1"), size=4).count() == 3
    assert np.allclose(back(mx.submatrix(table(a), 2, 3, 4, 5), (4, 5)), a[2:6, 3:8])
    d = np.diag(np.arange(200) - 150.0) + np.diag(np.ones(199), 1) + np.diag(np.ones(199), -1)
    want = np.linalg.eigvalsh(d)
    for which, best in (("LA", want[::-1][:4]), ("SA", want[:4]), ("LM", want[:4])):
        w, v = mx.KrylovSolver(lambda x: d @ x, 1e-8, which=which).solve(200, 4)
        assert np.allclose(w, best) and np.allclose(d @ v.T, v.T * w, atol=1e-4)
    j = 5
    up = np.array([math.sqrt(j * (j + 1) - m * (m + 1)) / 2 for m in range(-j, j)])
    assert np.allclose(mx.KrylovSolver(lambda x: (np.diag(up, 1) + np.diag(up, -1)) @ x, 1e-12).solve(11, 6)[0], [5, 4, 3, 2, 1, 0], atol=1e-10)
    with pytest.raises(ArithmeticError):
        mx.KrylovSolver(lambda x: d @ x, 1e-14, restarts=1).solve(200, 4)
    s = mx.random_symmetric(spark, 40, 3)
    dense_s = back(s, (40, 40))
    assert np.array_equal(dense_s, dense_s.T)
    w, v = mx.KrylovSolver(mx.matvec(s), 1e-9).solve(40, 3)
    assert np.allclose(w, np.linalg.eigvalsh(dense_s)[::-1][:3])
    m = rng.random((30, 12))
    assert np.allclose(mx.singular_values(table(m), 12, 3)[0], np.linalg.svd(m)[1][:3])
    with pytest.raises(ValueError):
        mx.small(s, 2000, "i", "j", "v")


def test_splines_and_tables(spark):
    x, y = [0.0, 1.0, 2.5, 4.0, 7.0], [1.0, 2.0, 0.0, 5.0, 4.5]
    s = sp.spline_frame(spark, sp.spline_table(x, y, "cubic"))
    at = spark.createDataFrame([(0.3,), (2.0,), (6.5,), (9.0,)], "x double")
    value, slope, bend = ([r["y"] for r in sp.lookup(at, "x", s, "y", order=k).collect()] for k in range(3))
    near = [[r["y"] for r in sp.lookup(at.select((F.col("x") + e).alias("x")), "x", s, "y").collect()] for e in (-1e-4, 1e-4)]
    assert slope == pytest.approx([(b - a) / 2e-4 for a, b in zip(*near, strict=True)], abs=1e-6)
    assert bend == pytest.approx([(a + b - 2 * v) / 1e-8 for a, b, v in zip(*near, value, strict=True)], abs=1e-4)
    top = sp.spline_maximum(s).first()
    grid = sp.lookup(spark.range(7001).select((F.col("id") / 1000).alias("x")), "x", s, "y").agg(F.max("y")).first()[0]
    assert top["y"] == pytest.approx(grid, abs=1e-6) and 5 < top["x"] < 6.5
    nodes = sp.qspline_nodes(64, 64, 4.0, 40.0)
    f = sp.tabled(sp.spline_table(nodes, [math.sin(v / 3) for v in nodes], "cubic"), 64, 64, 4.0, 40.0)
    for r in spark.range(0, 400, 7).select((F.col("id") / 10).alias("x")).select("x", f(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.sin(r["x"] / 3), abs=2e-3)
    over = spark.createDataFrame([(0, 0.0, 2.0), (1, 1.0, 3.0), (2, 5.0, 6.0)], "bin long, lo double, hi double")
    rows = spark.createDataFrame([(v, 1.0 + v) for v in (0.0, 0.5, 1.0, 1.9, 2.0, 4.0, 5.0, 6.0)], "x double, w double")
    got = {r["bin"]: (r["n"], r["total"]) for r in gr.overlapping(rows, "x", "w", over).collect()}
    assert got == {0: (4, pytest.approx(7.4)), 1: (3, pytest.approx(7.9)), 2: (1, pytest.approx(6.0))}
    radial = sp.spline_frame(spark, sp.spline_table([35.0, 50.0, 80.0, 100.0], [0.0, 1.0, 1.0, 0.0]))
    assert mock.support(spark, radial) == (30.0, 100.0)
    with pytest.raises(ValueError):
        mock.support(spark, sp.spline_frame(spark, sp.spline_table([0.0, 1.0], [0.0, 0.0])))


def test_spherical_selection_over_cells(spark):
    """A full sky of constant density: the cells' integrals are their volumes."""
    grid = gr.Grid((1.0, -1.0, 0.0), (2.0, 1.0, 6.0), (2, 2, 3), True)
    mask = spark.range(48).select(F.col("id").alias("ipix"), F.lit(1.0).alias("value"))
    radial = sp.spline_frame(spark, sp.spline_table([0.0, 3.0], [2.0, 2.0]))
    sel = survey.Selection(radial=radial, mask=mask, nside=2)
    rows = sel.over(grid.cells(spark), 3, True).collect()
    assert len(rows) == 12 and all(r["nbar"] == pytest.approx(2 * r["veff"]) for r in rows)


def test_wide_angle_limits(spark):
    """Far away along the line of sight, it is the plane-parallel one; the derivative by growth is that of the value."""
    names = ("00", "02", "11", "20", "22", "31", "42")
    xi = {n: F.lit(0.1 * k + 0.3) for k, n in enumerate(names)}
    at = lambda f, r1=1e7, r2=1e7 + 10, by=False: spark.range(1).select(models.wide_angle(10.0, r1, r2, f, xi, by)).first()[0]
    f, x = 0.5, {n: 0.1 * k + 0.3 for k, n in enumerate(names)}
    want = (1 + 2 * f / 3 + 2 * f * f / 15) * x["02"] + 2 * ((-f / 2 - 3 * f * f / 14) * x["22"] + f * f / 28 * x["42"]) + f * f / 15 * x["02"] - f * f / 21 * x["22"] + 19 * f * f / 140 * x["42"]
    assert at(f) == pytest.approx(want, rel=1e-5)
    assert at(f, 25.0, 30.0, True) == pytest.approx((at(f + 1e-5, 25.0, 30.0) - at(f - 1e-5, 25.0, 30.0)) / 2e-5, rel=1e-6)


def test_smoothing(spark):
    sigma = mock.sigma_for(0.01)
    assert 0.5 * math.erfc(1 / (sigma * math.sqrt(2))) >= 0.01 > 0.5 * math.erfc(1 / ((sigma - 1e-4) * math.sqrt(2)))
    pk = spark.range(401).select(F.col("id").alias("i"), (F.col("id") * 0.002).alias("k")).withColumn("p", 2e4 * F.exp(-10 * F.col("k")))
    got = mock.smoothing_radius(pk, 0.3).first()
    k = np.arange(401) * 0.002

    def spread(r):
        y = k * k * 2e4 * np.exp(-10 * k) * np.exp(-k * k * r * r) / (2 * np.pi**2)
        return math.sqrt(((y[1:] + y[:-1]) / 2 * 0.002).sum())

    assert got["sigma"] == pytest.approx(spread(got["radius"])) and spread(got["radius"]) <= 0.3 < spread(got["radius"] - 0.01)


def test_images(spark):
    """A map drawn as an image and read back keeps its values where pixels are large."""
    sky = spark.range(48).select(F.col("id").alias("ipix"), (F.col("id") % 2).cast("double").alias("value"))
    image = px.map_to_image(spark, sky, 60, 30, 2)
    assert image.count() == 1800 and 0 < image.where("value is null").count() < 900
    back = {r["ipix"]: r["value"] for r in px.image_to_map(image.where("value is not null"), 60, 30, 2).collect()}
    assert len(back) == 48 and sum(abs(back[i] - i % 2) < 0.35 for i in back) >= 44
