"""Dedup of repeated byte strings by prefix-free parsing.

The strings that have to be compared meet in buckets (see spans.py).  There
they are parsed: a rolling hash of TRIGGER bytes that falls in one residue
class ends a phrase, and the next phrase begins with the same bytes.  No
suffix of a phrase that is longer than a trigger begins another one, so the
order of the text's suffixes is that of the dictionary's suffixes, and where
these are equal that of the parse after them.  The suffix arrays of the
dictionary (the distinct phrases) and of the parse (their ranks) are built
apart and combined; equal neighbours in that order are equal strings, and the
first of them in the corpus stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, byte_hashes, fold, mix, prefix_ranks
from .spans import Scheme, rebuild

LENGTH = 100
#: Bytes of a trigger, and the mean number of bytes between triggers.
TRIGGER, PERIOD = 8, 32
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def phrases(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parse of strings buf[start:end] that lie one after another: begin and end of each phrase, and its string."""
    cut = np.zeros(len(buf), bool)
    if len(buf) >= TRIGGER:
        at = np.flatnonzero(mix(fold(byte_hashes(buf), TRIGGER)) % U64(PERIOD) == 0)
        cut[at[at + TRIGGER <= end[np.searchsorted(start, at, "right") - 1]]] = True
    cut[start] = True
    begin = np.flatnonzero(cut)
    string = np.searchsorted(start, begin, "right") - 1
    last = np.append(string[1:] != string[:-1], True)
    return begin, np.where(last, end[string], np.append(begin[1:], 0) + TRIGGER), string


def suffix_ranks(heap: bytes, at: np.ndarray, stop: np.ndarray, w: int) -> np.ndarray:
    """The suffix array of the dictionary, as ranks: of the suffixes heap[i:stop[i]], cut after w bytes, for i in at (other places hold nothing)."""
    buf = np.frombuffer(heap, np.uint8)
    need = np.zeros(len(buf), bool)
    need[at] = True
    at = np.flatnonzero(need)
    size = np.minimum(stop[at] - at, w)
    if not buf.all():  # shorter ones first, as zero bytes at the end are not compared
        by = np.argsort(size, kind="stable")
        at, size = at[by], size[by]
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(w, np.uint8)]), w)[at]
    rows[np.arange(w) >= size[:, None]] = 0
    order = np.argsort(rows.view(f"S{w}").ravel(), kind="stable")
    new = np.zeros(len(order), bool)
    new[1:] = (size[order[1:]] != size[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    out = np.empty(len(buf), np.int64)
    out[at[order]] = np.cumsum(new)
    return out


def prefix_free_order(strings: list[bytes], w: int, tags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of w bytes of strings (w bytes long at least) in the order of their suffixes, and the class of each of them.  tags have no part in it."""
    text = b"".join(strings)
    buf = np.frombuffer(text, np.uint8)
    size = np.array([len(s) for s in strings])
    end = np.cumsum(size)
    start = end - size
    begin, finish, string = phrases(buf, start, end)
    # the dictionary; a string's last phrase has no trigger at its end, and is told from an equal one that has
    last = np.append(string[1:] != string[:-1], True)
    known: dict[tuple[bytes, bool], int] = {}
    word = np.array([known.setdefault((text[a:b], z), len(known)) for a, b, z in zip(begin.tolist(), finish.tolist(), last.tolist(), strict=True)])
    lens = np.array([len(p) for p, _ in known])
    stop = np.cumsum(lens)
    base = stop - lens
    many = size - w + 1
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
    phrase = np.searchsorted(begin, at, "right") - 1
    head = base[word[phrase]] + at - begin[phrase]
    suffix = suffix_ranks(b"".join(p for p, _ in known), np.concatenate([head, base]), np.repeat(stop, lens), w)
    # the parse, as ranks of its suffixes, as far as w bytes reach
    reach = np.searchsorted(begin, np.minimum(begin + w, end[string])) - np.arange(len(begin))
    edge = np.searchsorted(string, np.arange(len(strings)), "right")
    after = prefix_ranks(suffix[base[word]], edge[string], int(reach.max()) + 1)
    # combined: the suffix of the phrase that a window begins in, then the parse after that phrase
    head = suffix[head]
    tail = np.where(last[phrase], 0, after[np.minimum(phrase + 1, len(after) - 1)] + 1)
    order = np.lexsort((tail, head))
    h, t, a = head[order], tail[order], at[order]
    same = np.zeros(len(order), bool)
    same[1:] = h[1:] == h[:-1]
    # of equal heads that end within the window, the rest of the window decides
    rest = np.flatnonzero(same & (np.append(0, t[1:] != t[:-1]) > 0) & (finish[phrase[order]] < a + w))
    view = np.lib.stride_tricks.sliding_window_view(buf, w)
    for k in range(0, len(rest), 1 << 16):
        r = rest[k : k + (1 << 16)]
        same[r] = (view[a[r]] == view[a[r - 1]]).all(axis=1)
    return order, np.cumsum(~same) - 1


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes;
    null without keep_text) and kept_sha256 for each row of docs.  A null or
    empty text has no bytes; texts shorter than `length` keep all.  A null
    doc_id counts as the smallest.  Rows that repeat a document (same id and
    text) are that document, each returned; of rows with one id and different
    texts, the one with the smaller hash comes first.  Other columns are ignored.
    """
    def make(doc_id: int | None, body: bytes, spans: list[tuple[int, int]]) -> tuple:
        at, parts = 0, []
        for a, b in spans:
            parts.append(body[at:a])
            at = b
        kept = b"".join([*parts, body[at:]])
        return doc_id, len(body), len(body) - len(kept), len(spans), kept if keep_text else None, hashlib.sha256(kept).hexdigest()

    out = rebuild(docs, Scheme("byte", length, min(gram, length), order=prefix_free_order), make, OUT, DDL, id_col, text_col)
    return out if keep_text else out.drop("kept")


#: The same over the table documents, whose ids are distinct, for DuckDB (strings of 100 bytes compared by 128 bits).
SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, md5(array_slice(b, i, i + 99)) AS win FROM (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 99, 0) + 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER d > 100, true) AS new FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
f AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM e),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS upto, string_agg(hex(array_slice(b, after, a - 1)), '' ORDER BY a) AS kept FROM f JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || hex(array_slice(b, coalesce(upto, 1), octet_length(b))))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
