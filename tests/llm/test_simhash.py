import random

import numpy as np
import pytest
import xxhash

from skyframe.llm import simhash
from skyframe.llm.components import connected_components


def plain(text, k=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, bits):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark):
    rng = random.Random(4)
    docs = {i: " ".join(rng.choice(["A", "be", "Sea", "dé", "É", "x y", "w%d" % rng.randrange(90)]) for _ in range(rng.choice([0, 1, 3, 5, 60, 400]))) for i in range(150)}
    for i in range(150, 260):
        w = docs[rng.randrange(150)].split(" ")
        if rng.random() < 0.7 and len(w) > 50:
            w[rng.randrange(len(w))] = "edit"
        docs[i] = "\n".join(w)
    docs[260] = None
    fps = {i: plain(t) for i, t in docs.items()}
    want = closure(fps, 4)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
    assert len(set(want.values())) < len(set(fps.values()))


@pytest.mark.parametrize("direct", [1024, 3])
def test_links_of_planted_fingerprints(spark, direct, monkeypatch):
    """Also where every variant of more than three is cut again."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(5)
    fps = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for k in range(30):
            flips = rng.sample(range(64), rng.randrange(0, 6))
            fps[c * 30 + k] = centre ^ sum(1 << b for b in flips)
    want = closure(fps, 4)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in {f: i for i, f in sorted(fps.items(), reverse=True)}.items()], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.link(df)).collect()}
    first = {f: min(i for i in fps if fps[i] == f) for f in fps.values()}
    assert {i: roots.get(first[fps[i]], first[fps[i]]) for i in fps} == want


def test_large_group_is_cut_without_loss(monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = np.array(sorted({centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 9))) for _ in range(500)}), np.uint64)

    def roots(links):
        comp = list(range(len(fps)))
        for a, b in links:
            x, y = comp[a], comp[b]
            comp = [min(x, y) if c in (x, y) else c for c in comp]
        return comp

    direct = roots(simhash.linked(fps, 4))
    monkeypatch.setattr(simhash, "DIRECT", 10)
    assert roots(simhash.linked(fps, 4)) == direct and len(set(direct)) < len(fps)


def test_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(5, ""), (5, ""), (None, "a b"), (2, "A b"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, None), (2, None)], key=str)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 100), (60, 61)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 60: 60, 61: 60}
