import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from skyframe.llm import quality


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def texts():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 6, 20, 60, 200):
        for _ in range(6):
            yield "".join(rng.choice(["a", "b", "c", "é$", "#x", "🙂"]) + rng.choice([" ", " ", "\n", "\t\n", "  "]) for _ in range(n))
    yield from ["a a a a", "a b a b a b", "\n\nx\n \nx\ny", " lead", "x y z x y z", "a b c d"]


def test_features(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.features(df).collect():
        if r["doc_id"] == 901:
            assert (r["n_words"], r["n_repeat_words"]) == (3000, 3000)
        else:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(r["text"]), r["text"]


def test_binomial_tail(spark):
    rows = [(n, k) for n in (0, 1, 30, 900) for k in (0, 1, 5, 14, 60)]
    df = spark.createDataFrame(rows, "n long, k long")
    for n, k, got in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.05)).collect():
        want = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) if k < n * 0.05 else 1.0
        assert math.isclose(got, want, rel_tol=1e-9), (n, k)


def corpus():
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(2600):
        good = rng.random() < 0.8
        words = [f"w{rng.randrange(400)}" + ("" if good else rng.choice(["%%", "##"])) for _ in range(60)]
        if rng.random() < 0.004:
            words = [w + "*" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "en", "de", None]) if i % 50 else "rare"))
        labels.append((i, int(good), 0))
    return [*docs, (5000, None, "en"), (None, "x " * 60, "en")], [*labels, labels[0], (1, None, 0), (99999, 1, 0)]


def test_guarantee_and_sql(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lang string, rule int")
    lab = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = sorted(map(tuple, quality.rules(d, lab).collect()), key=str)
    kept = {r[0]: r[7] for r in got}
    good = [i for i, q, _ in labels[:2600] if q]
    assert sum(not kept[i] for i in good) <= 0.05 * len(good)
    bad = [i for i, q, _ in labels[:2600] if not q and docs[i][2] != "rare"]
    assert sum(kept[i] for i in bad) < 0.05 * len(bad)
    assert all(kept[i] for i in range(0, 2600, 50))  # too few labels there for a guarantee: nothing is rejected
    con = duckdb.connect()
    dd = d.where("doc_id is not null").toPandas()
    ll = lab.toPandas()
    con.register("documents", dd)
    con.register("labels", ll)
    want = sorted(map(tuple, con.execute(quality.sql()).fetchall()), key=str)
    assert [x for x in got if x[0] is not None] == want


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert [(r["base_failed"], r["kept"]) for r in quality.rules(d, none).collect()] == [(True, False)]
    assert quality.rules(d.limit(0), none).count() == 0
