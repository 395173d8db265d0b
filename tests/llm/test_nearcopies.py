"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random

import corpus_pipeline
import numpy as np
import pytest

from skyframe.llm import langid, nearcopies
from tests.conftest import SF
from tests.llm.test_decontam import brute


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)}


def groups_of(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest index that pairs of a Jaccard similarity of 0.8 reach, for each set."""
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(names), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        mark[flat[start[i] : start[i + 1]]] = True
        if len(rest) * 4 > len(sets):
            common = np.add.reduceat(mark[flat], start[:-1], dtype=np.int64)[rest]
        else:
            common = np.array([np.count_nonzero(mark[flat[start[j] : start[j + 1]]]) for j in rest.tolist()], np.int64)
        mark[flat[start[i] : start[i + 1]]] = False
        return 5 * common >= 4 * (size[i] + size[rest] - common)

    return nearcopies.forest(len(sets), near)[1]


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(n)) for n in [60, 150, 400, 1500, 3, 4, 5] * 3]
    for base in texts[:21]:
        for _ in range(6):
            w = base.split()
            for _ in range(rng.randrange(1, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = word().upper()
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    line = [word() for _ in range(40)]
    texts += [" ".join([*line, *(word() for _ in range(rng.randrange(4, 30)))]) for _ in range(40)]
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_brute_force(spark, seed):
    docs = planted(seed)
    want = groups_of({i: grams(t) for i, t in docs.items()})
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(want.values()) and len(got) < len(docs) - 20


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_on_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").where("trim(text) <> ''")
    want = groups_of({r["doc_id"]: grams(r["text"]) for r in df.collect()}) if sf == "sf0.001" else None
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    if want is None:
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        ids = sorted(texts)
        comp = similar([nearcopies.shingles(texts[i].encode()) for i in ids])
        want = {i: ids[c] for i, c in zip(ids, comp, strict=True)}
    assert got == set(want.values())


def chained(seed):
    """Groups of many near copies, chains of texts that are similar to the next one only, and look-alikes just below the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size, many, change in ((200, 60, 3), (120, 25, 5), (300, 30, 9)):
        base = [word() for _ in range(size)]
        for _ in range(many):
            w = list(base)
            for k in rng.sample(range(size), rng.randrange(change + 1)):
                w[k] = word()
            texts.append(" ".join(w))
    chain = [word() for _ in range(160)]
    for _ in range(30):
        texts.append(" ".join(chain))
        at = rng.randrange(0, 150)
        chain[at : at + 6] = [word() for _ in range(6)]
    return dict(enumerate(texts))


@pytest.mark.parametrize(("seed", "part"), [(1, 8192), (2, 10), (3, 4)])
def test_crowded_bands_and_chains(spark, seed, part, monkeypatch):
    """Bands dealt to parts lose no link."""
    monkeypatch.setattr(nearcopies, "PART_SIZE", part)
    monkeypatch.setattr(nearcopies, "SHARE", 30)
    monkeypatch.setattr(nearcopies, "BLOCK_SIZE", part)
    docs = chained(seed)
    sets = {i: grams(t) for i, t in docs.items()}
    want = groups_of(sets)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    got = {}
    for r in nearcopies.near_copies(df).collect():
        got.setdefault(r["root"], set()).add(r["doc_key"])
    groups = {}
    for i, g in want.items():
        groups.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_similar_is_exact_at_the_threshold():
    base = np.arange(100, dtype=np.uint64)
    assert similar([base, base[:80], base[:79], base[21:]]).tolist() == [0, 0, 0, 3]
    assert similar([base, base[:79], base[21:]]).tolist() == [0, 1, 2]


def test_run_on_documents(spark):
    pytest.importorskip("public_tokenizers")
    said = langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.SURE}").collect()
    left = {r["doc_id"]: r["text"] for r in said}
    groups = groups_of({i: grams(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute(list(left.items()), items) if r[5]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == left.keys() - bad


def test_rows_with_null_or_shared_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " end"
    rows = [(None, a), (None, b), (None, b), (None, near(b)), (None, c), (4, near(a)), (5, a), (6, d), (6, e), (6, e), (7, near(e)), (8, f), (2, near(f))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    one = [t for i, t in got if i is None and t in (b, near(b))]
    assert len(one) == 1
    assert sorted(got, key=str) == sorted([(None, a), (None, one[0]), (None, c), (6, d), (6, e), (2, near(f))], key=str)


def test_fingerprints_alone_link_near_copies(spark, monkeypatch):
    """The method of op2 is part of the stage: with no link by bands, texts whose fingerprints are near are still found, and checked exactly."""
    import pyarrow as pa

    from skyframe.llm.simhash import BITS, fingerprint

    words = [f"w{k * k % 997}x{k}" for k in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{k}y{k % 7}" for k in range(3000))]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() <= BITS
    monkeypatch.setattr(nearcopies, "_linker", lambda group: pa.table([pa.array([], pa.int64())] * 2, names=["u", "v"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]
