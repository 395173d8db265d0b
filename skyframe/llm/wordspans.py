"""Substring dedup by super-k-mers of words.

Consecutive windows that share a minimiser (the smallest hash of a run of
words inside them) travel as one packed string to the minimiser's bucket,
where the windows are sorted and counted exactly.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import Scheme, rebuild

WINDOW = 20
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, minimiser: int = 4, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier in the corpus.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  Returns doc_id,
    n_words, n_removed, kept (kept words joined by a space; null without
    keep_text) and kept_sha256 for each row of docs.  Null and empty texts
    have no words; texts of fewer than `window` words keep all.  A null doc_id
    counts as the smallest.  Rows that repeat a document are that document,
    each returned; of rows with one id and different texts, the one with the
    smaller hash comes first.  Other columns are ignored.
    """
    def make(doc_id: int | None, body: bytes, spans: list[tuple[int, int]]) -> tuple:
        words = body.split()
        at, parts = 0, []
        for a, b in spans:
            parts += words[at:a]
            at = b
        parts += words[at:]
        kept = b" ".join(parts)
        return doc_id, len(words), len(words) - len(parts), kept if keep_text else None, hashlib.sha256(kept).hexdigest()

    out = rebuild(docs, Scheme("word", window, min(minimiser, window)), make, OUT, DDL, id_col, text_col)
    return out if keep_text else out.drop("kept")


#: The same over the table documents, whose ids are distinct, for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM u),
r AS (SELECT doc_id, i FROM g WHERE i + 19 <= n QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
k AS (SELECT u.doc_id, count(c.i) AS n_removed, string_agg(x, ' ' ORDER BY u.i) FILTER (c.i IS NULL) AS kept FROM u LEFT JOIN c USING (doc_id, i) GROUP BY u.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
