import random

import corpus_pipeline
import pytest
import tiktoken

from skyframe.llm import bpe, common, langid, pii
from tests.conftest import SF
from tests.llm.test_decontam import brute
from tests.llm.test_nearcopies import grams, groups_of

P = pytest.importorskip("public_tokenizers")


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    left = {i: r["text"] for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.SURE}
    assert len(left) >= 0.98 * len(said)
    groups = groups_of({i: grams(t) for i, t in left.items()})
    left = {i: left[i] for i in left if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute(list(left.items()), items) if r[5]}
    assert bad
    m = pii.Masker(pii.KEY)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: lib.encode_ordinary(m.mask(t)[0]) for i, t in left.items() if i not in bad}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, ids in want.items():
        assert got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids)


def test_stages_keep_columns_and_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(i, f"the cat and the dog number {i} went home", "en", "s", 9, i) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "the dog and a cat", "en", None, 0, 0), (50, None, None, None, None, None), (51, "", "en", "s", 0, 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert None in ids, name
        if name == "language":
            assert 50 not in ids and 51 not in ids and len(ids) == 22
        if name == "near_duplicates":
            assert len(ids) == len(set(ids))


def test_shared_ids_and_clashing_columns(spark):
    """Rows with null or equal ids are judged by their texts, whatever the other columns are called."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    item = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][0]
    a, b, c, d = (text() for _ in range(4))
    bad = f"{text()} {item}"
    rows = [(None, a), (None, b), (None, bad), (5, c), (5, d), (5, bad + " x"), (6, a), (7, d), (8, None), (9, "")]
    names = ["_key", "_node", "_bad", "_said", "at", "node", "bad", "hash", "root", "stays", "n", "doc_key", "text_hash", "said", "lang_pred", "n_words", "body", "tie"]
    df = spark.createDataFrame([(*r, "en", 1, *(str(k) for k in range(len(names)))) for r in rows], f"doc_id long, text string, lang string, n_chars int, {', '.join(n + ' string' for n in names)}").repartition(3)
    near = corpus_pipeline.near_duplicates(spark, df, SF)
    assert near.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str)
    want = [(None, a), (None, b), (5, c), (5, d), (8, None)]
    assert [g for g in got if g in want] == sorted(want, key=str) and len(got) == 6 and (None, bad) in got
    clean = corpus_pipeline.decontamination(spark, df, SF)
    assert clean.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(((i, t) for i, t in rows if t is None or item not in t), key=str)
    for r in clean.collect() + near.collect():
        assert [r[n] for n in names] == [str(k) for k in range(len(names))]
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[3:]:
        out = stage(spark, df, SF)
        assert name == "tokens" or out.columns == df.columns
        out.collect()


def test_repeated_and_long_rows(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    t = " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    rows = [(1, long), (1, long), (2, long + " end"), (3, t), (3, t), (3, t), (4, t)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted((r["doc_id"], len(r["text"])) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == [(1, len(long)), (3, len(t))]
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, df, SF).count() == len(rows)


def test_heaps_are_trimmed_before_the_workers_fill(spark, monkeypatch):
    """Before, tokens began beside heaps as large as the stages before had made them."""
    calls = []
    monkeypatch.setattr(corpus_pipeline, "trim_heaps", lambda s: (calls.append(1), common.trim_heaps(s)))
    docs = spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string")
    assert corpus_pipeline.tokens(spark, docs, SF).first()["n_tokens"] > 0 and len(calls) == 1


def test_the_driver_is_trimmed_between_stages(spark, monkeypatch):
    """Before, what the exchanges of a stage had allocated outside of the heap stayed on the driver to the end."""
    calls = []
    monkeypatch.setattr(corpus_pipeline, "trim_driver", lambda s: calls.append(common.trim_driver(s)))
    docs = spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.tokens):
        assert stage(spark, docs, SF).count() == 1
    assert len(calls) == 3 and all("rim native heap" in c for c in calls)


def test_run_by_a_path_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "sf").symlink_to(SF)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    row = lambda r: (r["doc_id"], bytes(r["ids"]))
    got, want = (sorted(map(row, corpus_pipeline.run(spark, d).collect())) for d in ("viewfs://store/in/sf", SF))
    assert got == want and len(got) > 100
