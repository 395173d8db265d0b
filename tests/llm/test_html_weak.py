import random

import numpy as np
import pyarrow.parquet as pq

from skyframe.llm import html, spans, weak
from skyframe.llm.html import DROP, KEEP, OPEN, blocks, main_text
from skyframe.llm.spans import merged, ranges

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<main><article><h1>Head &amp; tail</h1><p><b>One   two<br><p>Three <a title="a > b">four</a>\n five &lt;x&gt; 5 < 6
<p class="notice">hush<p>six</p><aside>side</aside><ul><li>li one<li>li two</ul><div class="share-buttons"><span>Tweet</span></div>
<article class="comment">first!</article><form><input><textarea>typed</textarea></form><p>last&nbsp;&#8364;</article></main>
<section id="comments"><p>great post</p></section><footer>&copy; x</footer></body></html>"""


def kept(page):
    return [b for said, b in blocks(page) if said == KEEP]


def test_structure():
    got = blocks(PAGE)
    assert kept(PAGE) == ["Head & tail", "One two", "Three four five <x> 5 < 6", "six", "li one", "li two", "last €"]
    assert not [b for said, b in got if said == OPEN] and {"Site", "A", "Buy", "We use", "hush", "side", "Tweet", "first!", "great post", "© x"} <= {b for said, b in got if said == DROP}
    assert blocks(None) == [] and blocks("") == [] and blocks("<p") == []
    assert blocks("plain\n text") == [(OPEN, "plain text")]
    assert blocks('<div><p>a<script>if (1<2) "</p>"') == [(OPEN, "a")]
    assert kept("<main><p>x</p></main><p>y</p>") == ["x"]
    assert not kept("<p " + "a=\"" * 50_000)
    assert blocks("<div>" * 20_000 + "deep" + "</div>" * 20_000) == [(OPEN, "deep")]
    many = "<main><article><p>one</p></article><article><p>two, longer</p></article></main>"
    assert kept(many) == ["one", "two, longer"]
    assert blocks('<article><p>a</p><div class="related">b</div><p class="warning">c</p></article>') == [(KEEP, "a"), (OPEN, "b"), (OPEN, "c")]


def plain_host(pages, repeat):
    """Brute force of the host stage on (id, host, stream): the token places in substrings of `repeat` tokens that two pages of the host have."""
    at = {}
    for i, host, stream in pages:
        t = stream.split()
        for k in range(len(t) - repeat + 1):
            at.setdefault((host, *t[k : k + repeat]), set()).add((i, k))
    gone = {i: set() for i, _, _ in pages}
    for hits in at.values():
        if len({i for i, _ in hits}) > 1:
            for i, k in hits:
                gone[i].update(range(k, k + repeat))
    return gone


def test_host_stage_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(f"m{k}x{i}" for i in range(rng.randrange(6, 14))) for k in range(6)]
    rows, streams = [], []
    for i in range(120):
        host = f"h{rng.randrange(3)}"
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 6))]
        inside = i % 3 == 0
        own = f"own{i} text"
        body = f"<article><p>{own}</p>" + "".join(f'<div class="related">{p}</div>' for p in parts) + "</article>" if inside else "".join(f"<div>{p}</div>" for p in parts)
        rows.append((i, f"http://{host}/{i}", body))
        streams.append((i, host, parts, own if inside else None))
    gone = plain_host([(i, h, " ".join(p)) for i, h, p, _ in streams], 8)
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string").repartition(5)).collect()}
    some = 0
    for i, _, parts, own in streams:
        want, at = [own] if own else [], 0
        for p in parts:
            w = p.split()
            k = [x for j, x in enumerate(w, at) if j not in gone[i]]
            at += len(w)
            some += len(k) < len(w)
            if not own:
                want += [" ".join(k)] if k else []
            elif 2 * len(k) > len(w):
                want.append(p)
        assert got[i] == "\n".join(want), i
    assert some > 50


def test_tables_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in main_text(df).collect()}
    for r in df.collect():
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text) > 0 and "track(" not in text and "©" not in text and "<" not in text.replace("<", "", text.count("&lt;"))
    assert len(got) == 50


def test_host_boilerplate(spark):
    rng = random.Random(1)
    nav = " ".join(f"item{i}" for i in range(12))
    word = lambda: "".join(rng.choice("abcdef") for _ in range(7))
    rows, want = [], {}
    for i in range(30):
        own = " ".join(word() for _ in range(40))
        host = "a.example" if i < 20 else f"h{i}.example"
        rows.append((i, f"http://{host}/{i}", f"<div>{nav}</div><div>{own}</div><div>end of {nav}</div>", "x"))
        want[i] = own if i < 20 else f"{nav}\n{own}\nend of {nav}"
    rows += [(40, None, None, "x"), (None, "http://a.example/n", "<p>short", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got[40] == "" and got[None] == "short"
    assert {i: got[i] for i in want} == want
    assert main_text(df.limit(0)).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.8
    acc = [0.95, 0.85, 0.7, 0.9]
    v = np.stack([np.where(rng.random(6000) < 0.2, 0, np.where(rng.random(6000) < a, 1, -1) * np.where(y, 1, -1)) for a in acc], axis=1)
    pat, n = np.unique(v, axis=0, return_counts=True)
    prior, p = weak.fit_accuracies(pat, n.astype(float))
    assert abs(prior - 0.8) < 0.03
    for i, a in enumerate(acc):
        assert abs(p[1, i, 2] / (p[1, i, 2] + p[1, i, 0]) - a) < 0.04


def test_scorer_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"]: r["kept"] for r in weak.classify(docs).collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    good = [x["doc_id"] for x in labels if x["quality"] and not x["toxic"]]
    bad = [x["doc_id"] for x in labels if not x["quality"]]
    assert sum(kept[i] for i in good) >= 0.97 * len(good)
    assert sum(not kept[i] for i in bad) >= 0.9 * len(bad)
    assert len(kept) == 1000


def test_weak_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "word " * 200_000, 0.0)], "doc_id long, text string, score double")
    got = weak.classify(df).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert weak.classify(df.limit(0)).count() == 0


def test_posterior_against_brute_force(spark):
    """The posteriors are those of EM over every row's votes, one by one; the scorer learns from a bounded sample."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9999, None), (9999, None), (None, "")], "doc_id long, text string"))
    rows = df.collect()
    v = np.array([weak.votes(r["text"].encode() if r["text"] else None)[0] for r in rows])
    prior, p = weak.fit_accuracies(v, np.ones(len(v)))
    want = sorted(zip((str(r["doc_id"]) for r in rows), weak.posterior(v, prior, p).round(6).tolist(), strict=True))
    got = sorted((str(r["doc_id"]), round(r["posterior"], 6)) for r in weak.classify(df).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6)


def test_query_against_structure(spark):
    """op5 on whole pages: all of them have articles, and their text is that of the articles' blocks."""
    from skyframe.llm.queries import op5_html

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op5_html(spark, "/root/testdata/sf0.01").collect()}
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for r in pages:
        text = "\n".join(kept(r["html"]))
        assert got[r["page_id"]] == (text, len(text))


def test_long_and_repeated_pages(spark):
    words = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "http://a/1", f"<article><p>{words}</article>"), (2, "http://a/2", f"<div>{words}</div>"), (2, "http://a/2", f"<div>{words}</div>"), (3, "http://b/1", f"<div>{words}</div>")]
    got = sorted((r["page_id"], r["n_chars"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, len(words)), (2, len(words)), (2, len(words)), (3, len(words))]


def test_streams_hold_all_tokens_of_every_page(spark, monkeypatch):
    """Before, the blocks of an article were no part of the streams: the arrays did not see that two pages of a host mirror one."""
    seen, covered = [], html.covered
    monkeypatch.setattr(html, "covered", lambda streams, *a: seen.append((streams, covered(streams, *a))) or seen[0][1])
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"http://{host}/{i}", f'<nav>a b</nav><article><p>{words}</p><div class="ad">buy</div></article>') for i, host in enumerate("xxy")]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(3), words)
    (streams, (found, _)), spans = seen[0], {}
    assert sorted((r["doc_key"], r["stream"].strip("\x1f ")) for r in streams.collect()) == sorted((i, s) for i in range(3) for s in ("a b buy", words))
    for r in ranges(found).collect():
        spans.setdefault(r["doc_key"], []).append((r["first"], r["last"]))
    assert {k: merged(v) for k, v in spans.items()} == {0: [(0, 21)], 1: [(0, 21)]}


def test_pages_are_shuffled_once(spark):
    """Before, pages were spooled, shuffled to meet the ranges, and all strings of all streams were shuffled beside them."""
    words = [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(40)]
    rows = [(i, f"http://a/{i}", f"<article><p>{w}</p></article>") for i, w in enumerate(words)]
    df = main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [r["text"] for r in sorted(df.collect())] == words
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    sent = []
    flush = spans._flusher(spans.Scheme("word", 8, 5, pages=True, order=html.host_order), 4)
    docs = [((i, 0), w.encode(), 0, 0) for i, w in enumerate(words[:4])]
    for state in (lambda own: np.ones(len(own), np.int64), lambda own: np.zeros(len(own), np.int64)):
        sent.append(sum(map(len, flush(list(docs), state).column(1).to_pylist())))
    assert sent[0] > 0 == sent[1]


def test_hot_owners_of_hosts(spark, monkeypatch):
    """Windows of hot owners go one by one, with the same answer."""
    monkeypatch.setattr(spans, "HOT", 3)
    monkeypatch.setattr(spans, "TOLD", 1)
    test_host_stage_against_brute_force(spark)
    test_host_boilerplate(spark)


def test_names_of_owners():
    rng = np.random.default_rng(5)
    for size in (0, 1, 3000):
        name = np.unique(rng.integers(0, 1 << spans.NAME, size, dtype=np.uint64))
        flag, heavy = rng.random(len(name)) < 0.2, np.zeros(min(2, len(name)), spans._HEAVY)
        got = spans._unpack_names(spans._pack_names(name, flag, heavy))
        assert all(np.array_equal(a, b) for a, b in zip(got, (name, flag, heavy), strict=True))
