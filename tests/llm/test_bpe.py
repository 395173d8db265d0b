import codecs
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken

from skyframe.llm import bpe
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def hard_texts():
    rng = random.Random(7)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "漢", "字", "🙂", "'s", "'ll", "--", "<|endoftext|>", "\x00", "ا", "ल", " ", "ZW", "%%%"]
    for n in (0, 1, 2, 5, 30, 300):
        for _ in range(40):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    yield "a" * 9000
    yield "漢字かな" * 3000
    yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    yield "=-" * 6000 + " " * 5000


def test_equals_the_library(lib):
    c = bpe.Codec(PATH, P.PATTERN)
    for t in [*hard_texts(), *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60]]:
        ids = np.frombuffer(c.encode(t), "<u4").tolist()
        assert ids == lib.encode_ordinary(t), t[:80]
        assert c.decode(ids) == t.encode()


def test_forgetting_and_draining_change_nothing(lib, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_STEPS", 50)
    monkeypatch.setattr(bpe, "KEEP_PIECES", 5)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 20)
    monkeypatch.setattr(bpe, "DRAIN", 8)
    c = bpe.Codec(PATH, P.PATTERN)
    for t in hard_texts():
        assert np.frombuffer(c.encode(t[:4000]), "<u4").tolist() == lib.encode_ordinary(t[:4000])


def test_utf8_stream_in_any_cuts():
    rng = random.Random(8)
    for _ in range(300):
        data = "aé漢🙂߿퟿\U0010ffff".encode() * 3 if rng.random() < 0.5 else bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(20))
        s, ref, got, want, at = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace"), "", "", 0
        while at < len(data):
            n = rng.randrange(1, 5)
            got += s.feed(data[at : at + n])
            want += ref.decode(data[at : at + n])
            at += n
        assert got + s.finish() == want + ref.decode(b"", True) == data.decode("utf-8", "replace")


def test_frame(spark, lib):
    df = spark.createDataFrame([(1, "Hello wörld", "x"), (2, None, "x"), (2, "", "x"), (None, "a" * 5000, "x")], "doc_id long, text string, ids string")
    for r in bpe.encode_decode(df, PATH, P.PATTERN).collect():
        assert bytes(r["ids"]) == np.array(lib.encode_ordinary(r["decoded"]), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["n_tokens"] * 4 == len(r["ids"])
    assert bpe.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_states_are_small():
    """Before, each live start of a state was a tuple of two numbers, about three times the memory."""
    c = bpe.Codec(PATH, P.PATTERN)
    for t in hard_texts():
        c.encode(t[:500])
    starts = [s for live in c.machine.states for s in live]
    assert len(starts) > 1000 and all(isinstance(s, int) for s in starts)


def test_workers_give_memory_back(monkeypatch):
    """Before, a reused worker kept what earlier operators had freed, beside the token tables."""
    import pyarrow as pa

    from skyframe.llm import common

    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    batch = pa.record_batch([pa.array([1, 2])], names=["x"])
    assert list(common.rows_of(iter([batch, batch.slice(0, 0)]), "x", keep=True)) == [(1,), (2,)] and len(calls) == 2


def test_a_transition_takes_few_bytes():
    """Before, a state was a dict and a transition a tuple: 180 bytes for each byte of these words, now 116."""
    c, rng = bpe.Codec(PATH, P.PATTERN), random.Random(9)
    words = [(" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))).encode() for _ in range(4000)]
    for w in words:  # what tokens may follow each other is known then
        c.machine.encode(w)
    c.machine._clear()
    tracemalloc.start()
    try:
        for w in words:
            c.machine.encode(w)
        assert tracemalloc.get_traced_memory()[0] < 150 * sum(map(len, words))
    finally:
        tracemalloc.stop()
