"""Text tables, sky map files and meshes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, **columns: int) -> DataFrame:
    """Columns (name = number from 1) of a table separated by white space; # starts a comment."""
    line = F.trim(F.split(F.col("value"), "#")[0])
    df = spark.read.text(path).select(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+").alias("w"), line.alias("line")).where("line <> ''")
    return df.select(*(F.get("w", F.lit(n - 1)).cast("double").alias(c) for c, n in columns.items()))


def write_columns(df: DataFrame, path: str, order_by: str, header: str = "") -> None:
    """Rows in order as text with one blank between values; for results of the size of a histogram."""
    with open(path, "w") as f:
        if header:
            f.write(f"# {header}\n")
        for row in df.orderBy(order_by).toLocalIterator():
            f.write(" ".join(f"{v:.17g}" if isinstance(v, float) else str(v) for v in row) + "\n")


def write_map(path: str, values: np.ndarray, order: str = "NESTED") -> None:
    """A sky map as a binary table of float32, one value a row."""
    nside = int(round((len(values) / 12) ** 0.5))

    def cards(*lines: str) -> bytes:
        return "".join(x.ljust(80) for x in [*lines, "END"]).ljust(-(-80 * (len(lines) + 1) // 2880) * 2880).encode("ascii")

    card = lambda k, v: f"{k:<8}= {v if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else v:>20}"
    text = lambda k, v: f"{k:<8}= '{v:<8}'"
    with open(path, "wb") as f:
        f.write(cards(card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", "T")))
        f.write(cards(text("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 4), card("NAXIS2", len(values)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 1), text("TFORM1", "1E"), text("TTYPE1", "VALUE"), text("PIXTYPE", "HEALPIX"), text("ORDERING", order), card("NSIDE", nside)))
        raw = np.asarray(values, ">f4").tobytes()
        f.write(raw + b"\0" * (-len(raw) % 2880))


def read_map(spark: SparkSession, path: str, per_task: int = 1 << 20) -> tuple[DataFrame, int, str]:
    """((ipix, value), nside, ordering) of a map whose first table column is float32 or float64; tasks read ranges of rows."""
    def head(f, at: int) -> tuple[dict[str, str], int]:
        out: dict[str, str] = {}
        while True:
            f.seek(at)
            data = f.read(2880)
            if len(data) < 2880:
                raise ValueError(f"{path}: the header has no end")
            for k in range(36):
                c = data[80 * k : 80 * k + 80].decode("ascii")
                if c.startswith("END"):
                    return out, at + 2880
                if c[8:10] == "= ":
                    out[c[:8].strip()] = c[10:].split("/")[0].strip().strip("'").strip()
            at += 2880

    with open(path, "rb") as f:
        h, start = head(f, head(f, 0)[1])
    form = h["TFORM1"]
    count, kind = int(form[:-1] or 1), {"E": ">f4", "D": ">f8"}[form[-1]]
    width, n = int(h["NAXIS1"]), int(h["NAXIS2"])

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    f.seek(start + first * width)
                    raw = np.frombuffer(f.read(min(per_task, n - first) * width), np.uint8).reshape(-1, width)
                values = np.ascontiguousarray(raw[:, : count * int(kind[-1])]).view(kind).ravel()
                yield pa.record_batch([pa.array(np.arange(first * count, first * count + len(values))), pa.array(values.astype(np.float32))], names=["ipix", "value"])

    df = spark.range(0, n, per_task, max(1, -(-n // per_task))).mapInArrow(run, "ipix long, value float")
    return df, int(h["NSIDE"]), h["ORDERING"]


def vertices(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((v, x, y, z) distinct corners, (g, corner, v) of the cells); v numbers corners from 0 by position."""
    from ..operators.grid import numbered

    corner = F.array(*(F.struct(F.lit(a + 2 * b + 4 * c).alias("corner"), F.col("max1" if a else "min1").alias("x"), F.col("max2" if b else "min2").alias("y"), F.col("max3" if c else "min3").alias("z")) for c in (0, 1) for b in (0, 1) for a in (0, 1)))
    each = cells.select("g", F.inline(corner))
    points = numbered(each.select("x", "y", "z").distinct(), "x", ["y", "z"], "v").select("v", "x", "y", "z")
    return points, each.join(points, ["x", "y", "z"]).select("g", "corner", "v")


def write_vtk(path: str, cells: DataFrame, values: list[str]) -> None:
    """Cells as a mesh of voxels with a value each (for pictures: of the size of a grid)."""
    points, corners = vertices(cells)
    pts = points.orderBy("v").collect()
    by: dict[int, list[tuple[int, int]]] = {}
    for g, c, v in corners.collect():
        by.setdefault(g, []).append((c, v))
    rows = cells.select("g", *values).orderBy("g").collect()
    with open(path, "w") as f:
        f.write(f"# vtk DataFile Version 2.0\ncells\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {len(pts)} double\n")
        f.writelines(f"{p['x']:.17g} {p['y']:.17g} {p['z']:.17g}\n" for p in pts)
        f.write(f"CELLS {len(rows)} {9 * len(rows)}\n")
        f.writelines("8 " + " ".join(str(v) for _, v in sorted(by[r["g"]])) + "\n" for r in rows)
        f.write(f"CELL_TYPES {len(rows)}\n" + "11\n" * len(rows) + f"CELL_DATA {len(rows)}\n")
        for v in values:
            f.write(f"SCALARS {v} double 1\nLOOKUP_TABLE default\n" + "".join(f"{r[v]:.17g}\n" for r in rows))
