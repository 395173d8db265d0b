"""Repeated byte strings and word windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import bytespans, spans
from skyframe.llm.bytespans import drop_repeated_bytes
from skyframe.llm.html import host_order
from skyframe.llm.wordspans import drop_repeated_words


def brute(units_of, docs, w):
    seen, out = {}, {}
    for d in sorted(docs):
        u = units_of(docs[d])
        gone = [False] * len(u)
        for i in range(len(u) - w + 1):
            key = tuple(u[i : i + w])
            if key in seen:
                for j in range(i, i + w):
                    gone[j] = True
            else:
                seen[key] = (d, i)
        out[d] = gone
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocab = ["a", "bb", "the", "ö", "word", "zebra", "%%%", "x9"] + [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    docs = {}
    for d in range(n):
        t = " ".join(rng.choice(vocab) + rng.choice(["", "", "\n", "\t"]) for _ in range(rng.choice([0, 3, 30, 80, 200])))
        if rng.random() < 0.4:
            t = t[: len(t) // 2] + " " + passage[rng.randrange(50) :] + " " + t[len(t) // 2 :]
        if rng.random() < 0.2 and docs:
            t = docs[rng.choice(list(docs))]
        docs[d] = t
    docs[n], docs[n + 1], docs[n + 2] = "", "ab" * 400, "z " * 300
    return docs


def frame(spark, docs):
    rows = [(d, t, "src") for d, t in docs.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, (10**6, None, "n")], "doc_id long, text string, body string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    want = brute(lambda t: t.encode(), docs, 100)
    got = {r["doc_id"]: r for r in drop_repeated_bytes(frame(spark, docs)).collect()}
    assert got[10**6]["n_bytes"] == 0
    for d, t in docs.items():
        raw, gone = t.encode(), want[d]
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(raw), sum(gone), runs), d
        assert bytes(got[d]["kept"]) == kept and got[d]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words(spark, seed):
    docs = corpus(seed)
    want = brute(lambda t: t.encode().split(), docs, 20)
    got = {r["doc_id"]: r for r in drop_repeated_words(frame(spark, docs)).collect()}
    for d, t in docs.items():
        words = t.encode().split()
        kept = b" ".join(x for x, g in zip(words, want[d], strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], bytes(got[d]["kept"])) == (len(words), sum(want[d]), kept), d


def test_long_text_is_cut(monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 800)
    text = " ".join(f"w{i % 150}" for i in range(900)).encode()
    for scheme, units in ((spans.Scheme("word", 20, 6), text.split()), (spans.Scheme("byte", 100, 24), list(text))):
        starts = set()
        for pieces in spans._pieces([((5, 0), text, 0)], scheme):
            r = spans._runs(pieces, scheme)
            for k, (piece, unit, n, begin, end) in enumerate(zip(r.piece, r.unit, r.n, r.begin, r.end, strict=True)):
                at = pieces[piece][1] + unit
                starts.update(range(at, at + n))
                if scheme.unit == "word":
                    assert r.blob[begin:end].split() == units[at:][: n + 19]
                    assert [r.blob[a:b].split() for a, b in r.bounds(k, 20)] == [units[i : i + 20] for i in range(at, at + n)]
        assert starts == set(range(len(units) - scheme.window + 1))


@pytest.mark.parametrize("pages", [False, True])
def test_hot_owners(spark, pages, monkeypatch):
    """A line that all documents have: its windows travel one by one."""
    monkeypatch.setattr(spans, "HOT", 50)
    monkeypatch.setattr(spans, "SHARE", 8)
    monkeypatch.setattr(spans, "TOLD", 1)
    monkeypatch.setattr(spans, "FLUSH", 3000)
    rng = random.Random(5)
    line = "this text is under the licence of all who read it"
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    docs = {d: " ".join([*(word() for _ in range(rng.randrange(40))), line, *(word() for _ in range(rng.randrange(40)))]) for d in range(80)}
    docs |= {d + 100: docs[d] for d in range(0, 80, 9)} | {d + 200: f"{docs[d]} {docs[d]}" for d in range(0, 80, 17)}
    df = frame(spark, docs)
    if not pages:
        for drop, units_of, w in ((drop_repeated_words, lambda t: t.encode().split(), 20), (drop_repeated_bytes, lambda t: t.encode(), 100)):
            want = brute(units_of, docs, w)
            assert {r["doc_id"]: r["n_removed"] for r in drop(df).collect() if r["doc_id"] in docs} == {d: sum(g) for d, g in want.items()}
        return
    found, _ = spans.covered(df.withColumn("host", F.lit("h")), spans.Scheme("word", 8, 3, pages=True, order=host_order), salt_col="host")
    got = {}
    for r in spans.ranges(found).collect():
        got.setdefault(r["doc_key"], set()).update(range(r["first"], r["last"] + 1))
    at = {}
    for d, t in docs.items():
        u = t.split()
        for i in range(len(u) - 7):
            at.setdefault(tuple(u[i : i + 8]), set()).add((d, i))
    want = {}
    for hits in at.values():
        if len({d for d, _ in hits}) > 1:
            for d, i in hits:
                want.setdefault(d, set()).update(range(i, i + 8))
    assert got == want


def test_one_id_with_different_texts(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(100))
    t1, t2, t3 = text(), text(), text()
    df = spark.createDataFrame([(0, t1), (7, t1), (7, t2), (None, t3), (None, t2 + " x"), (9, t3)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in drop_repeated_words(df).collect()) == [("0", 100, 0), ("7", 100, 100), ("7", 100, 100), ("9", 100, 100), ("None", 100, 0), ("None", 101, 0)]
    lone = spark.createDataFrame([(0, t1), (7, t1), (7, t2)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in drop_repeated_bytes(lone).collect()) == [(0, 0), (7, 0), (7, len(t1))]


@pytest.mark.parametrize("seed", range(6))
def test_prefix_free_order(seed, monkeypatch):
    """The windows come in the order of their bytes, whatever the phrases."""
    rng = random.Random(seed)
    for w, period, letters in ((5, 2, "ab"), (20, 4, "a\0b"), (100, 32, "abcdefgh"), (100, 4, "\0"), (20, 2, "abc")):
        monkeypatch.setattr(bytespans, "PERIOD", period)
        draw = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        base = draw(400)
        strings = []
        for _ in range(30):
            i = rng.randrange(300)
            s = draw(rng.choice([0, 30])) + base[i : i + rng.randrange(1, 200)] + draw(rng.randrange(150))
            strings.append((s + draw(w))[: max(w, len(s))].encode())
        order, classes = bytespans.prefix_free_order(strings, w, [])
        wins = [s[i : i + w] for s in strings for i in range(len(s) - w + 1)]
        assert sorted(order.tolist()) == list(range(len(wins)))
        ranked = [wins[i] for i in order]
        assert ranked == sorted(wins)
        assert classes.tolist() == [sorted(set(wins)).index(x) for x in ranked]


def test_phrases_are_prefix_free():
    text = bytes(random.Random(7).choices(b"ab", k=4000))
    buf = np.frombuffer(text, np.uint8)
    begin, end, string = bytespans.phrases(buf, np.array([0, 1500]), np.array([1500, 4000]))
    assert len(begin) > 20 and b"".join(text[a : b if z else b - bytespans.TRIGGER] for a, b, z in zip(begin, end, np.append(string[1:] != string[:-1], True), strict=True)) == text
    inner = {text[a:b] for a, b, z in zip(begin, end, np.append(string[1:] != string[:-1], True), strict=True) if not z}
    suffixes = {p[i:] for p in inner for i in range(len(p) - bytespans.TRIGGER)}
    assert not [s for s in suffixes for k in range(bytespans.TRIGGER + 1, len(s)) if s[:k] in suffixes]


def test_empty_null_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_bytes(none).count() == 0 and drop_repeated_words(none).count() == 0
    t = " ".join(f"u{i}" for i in range(60))
    twice = spark.createDataFrame([(3, t), (3, t), (None, None), (7, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in drop_repeated_words(twice).collect())
    assert got == [(-1, 0, 0), (3, 60, 0), (3, 60, 0), (7, 60, 60)]
    null_first = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in drop_repeated_bytes(null_first).collect()} == {(None, 0), (1, len(t))}


def test_pages_scheme_needs_two_documents(spark):
    t = " ".join(f"u{i}" for i in range(30))
    df = spark.createDataFrame([(1, t, "h"), (2, "x " + t, "h"), (3, t, "g"), (4, f"{t} {t}".replace("u", "q"), "h")], "doc_id long, text string, host string")
    for order in (spans.sorted_order, host_order):
        got = {(r["doc_key"], r["first"], r["last"]) for r in spans.ranges(spans.covered(df, spans.Scheme("word", 10, 4, pages=True, order=order), salt_col="host")[0]).collect()}
        assert {d for d, _, _ in got} == {1, 2}
        assert spans.merged([(a, b) for d, a, b in got if d == 2]) == [(1, 31)]


@pytest.mark.parametrize("copies", [1, 2])
def test_repeats_inside_of_one_run(spark, copies):
    words = {n: f"w{n} " * n for n in range(21, 41)} | {n: " ".join(f"v{n} x{n} y{n}".split() * n)[: n * 4] for n in range(50, 56)}
    raw = {n: chr(65 + n % 50) * n for n in range(101, 181)} | {n: f"{n}-ab" * 30 for n in range(200, 206)}
    for docs, drop, units_of, w in ((words, drop_repeated_words, lambda t: t.encode().split(), 20), (raw, drop_repeated_bytes, lambda t: t.encode(), 100)):
        docs = {d + 1000 * c: t for d, t in docs.items() for c in range(copies)}
        want = brute(units_of, docs, w)
        got = {r["doc_id"]: r["n_removed"] for r in drop(spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)).collect()}
        assert got == {d: sum(want[d]) for d in docs}


def test_repeated_row_with_two_known_passages(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 45), ("b", 60)))
    # of so many words before b, some begin a run at its first window
    docs = {0: a, 1: b} | {d: f"{a} {' '.join(f'q{d}x{i}' for i in range(25))} {b} r{d}" for d in range(2, 200)}
    for drop, units_of, w in ((drop_repeated_words, lambda t: t.encode().split(), 20), (drop_repeated_bytes, lambda t: t.encode(), 100)):
        want = brute(units_of, docs, w)
        got = drop(spark.createDataFrame([(d, t) for d, t in docs.items() for _ in range(3 if d > 1 else 1)], "doc_id long, text string").coalesce(1)).collect()
        assert {(r["doc_id"], r["n_removed"]) for r in got} == {(d, sum(g)) for d, g in want.items()}
        for r in got:
            kept = [u for u, g in zip(units_of(docs[r["doc_id"]]), want[r["doc_id"]], strict=True) if not g]
            assert bytes(r["kept"]) == (bytes(kept) if w == 100 else b" ".join(kept))
