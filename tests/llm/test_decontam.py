import hashlib
import random
import re

from skyframe.llm.decontam import contamination


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, w=10):
    wins = {}
    for i, t in items:
        u = words(t)
        n = min(len(u), w)
        for k in range(len(u) - n + 1) if u and i is not None else ():
            wins.setdefault(tuple(u[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        u, hit, who = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(u) - n + 1):
                got = wins.get(tuple(u[k : k + n]))
                if got:
                    who |= got
                    hit.update(range(k, k + n))
        out.append((d, len(u), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed, short):
    rng = random.Random(seed)
    vocab = ["a", "The", "É", "x-ray", "été", "9", "zoo", "it's"] + [f"W{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([12, 15, 30]))) for i in range(12)] + [(3, text(11)), (None, text(14)), (20, ""), (21, None)]
    if short:
        items += [(30, "zoo W1 W2"), (31, "W7 W8 W9 W10"), (32, "it's")]
    docs = []
    for d in range(60):
        t = text(rng.choice([0, 3, 40, 120]))
        if rng.random() < 0.5:
            u = (rng.choice(items)[1] or "").split(" ")
            t += " " + " ".join(u[rng.randrange(4) :]).upper() + " " + text(5)
        docs.append((d, t))
    return [*docs, docs[3], (None, docs[5][1]), (61, None), (62, "")], items


def test_against_brute_force(spark):
    for seed, short in ((1, False), (2, True)):
        docs, items = case(seed, short)
        df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n_words int, win string")
        it = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, prints int")
        want = brute(docs, items)
        assert sorted(map(tuple, contamination(df, it).collect()), key=str) == want
        assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_without_broadcast_and_empty(spark, monkeypatch):
    from skyframe.llm import common

    docs, items = case(3, True)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, contamination(df, it).collect()), key=str) == brute(docs, items)
    assert sorted(map(tuple, contamination(df, it.limit(0)).collect()), key=str) == brute(docs, [])
    assert contamination(df.limit(0), it).count() == 0
