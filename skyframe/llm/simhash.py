"""SimHash near-dedup by deletion-variant signatures.

Two fingerprints that differ in at most d bits, cut into s > d / 2 segments,
have a segment that differs in at most one bit.  Each segment is indexed once
for each of its bits, with that bit made a wildcard: fingerprints that share
such a variant meet by equality, and only they are compared.  A variant that
many fingerprints have is cut again: of d + 1 pieces of two of them one is
equal, so they meet by the variant and a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, doc_key, mix, rows_of, spool
from .components import connected_components

WORDS, BITS = 4, 4


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = 42) -> int:
    """64 bits; bit b is 1 if set in over half of the XXH64 of the word shingles of the text in lower case (A-Z only).

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, fp) with the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, fps = [], [], []
        for doc_id, key, body in rows_of(batches, "doc_id", "doc_key", "body"):
            ids.append(doc_id)
            keys.append(key)
            fps.append(fingerprint(body, words))
            if len(ids) == 8192:
                yield batch(ids, keys, fps)
                ids, keys, fps = [], [], []
        if ids:
            yield batch(ids, keys, fps)

    def batch(ids, keys, fps):
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "doc_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, doc_key long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs in at most one bit."""
    s = bits // 2 + 1
    cuts = [64 * k // s for k in range(s + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Forest:
    """Links within a group that join what is not joined yet."""

    def __init__(self, fps: np.ndarray, bits: int):
        self.fps, self.bits, self.comp, self.links = fps, bits, np.arange(len(fps)), []

    def among(self, members: np.ndarray) -> None:
        for k, i in enumerate(members[:-1].tolist()):
            comp = self.comp[members]
            if k % 64 == 0 and (comp == comp[0]).all():
                return
            near = np.flatnonzero((np.bitwise_count(self.fps[members] ^ self.fps[i]) <= self.bits) & (comp != comp[k]))
            for j in members[near].tolist():
                a, b = self.comp[i], self.comp[j]
                if a != b:
                    self.links.append((i, j))
                    self.comp[self.comp == max(a, b)] = min(a, b)


#: Members of a variant that are compared with each other; more are cut again, by pieces of which one is equal.
DIRECT = 1024


def linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs of indices within `bits` of each other, as few as join the same members as all such pairs."""
    forest = _Forest(fps, bits)
    if len(fps) <= DIRECT:
        forest.among(np.arange(len(fps)))
        return forest.links
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(piece, kind="stable")
        edge = np.flatnonzero(np.diff(piece[order], prepend=~piece[order[:1]]))
        for p, q in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            if q - p > 1:
                forest.among(np.sort(order[p:q]))
    return forest.links


#: A variant is cut again from DIRECT fingerprints, and from this share of all variants (as a shift).
SHARE = 20


def _keys(fp: np.ndarray, bits: int) -> np.ndarray:
    """Every variant of every fingerprint: (variant, fingerprint)."""
    keys = []
    for k, (a, w) in enumerate(segments(bits)):
        seg = (fp >> np.uint64(a)) & np.uint64((1 << w) - 1)
        keys += [((seg & ~np.uint64(1 << b)) << np.uint64(12)) | np.uint64(k << 6 | b) for b in range(w)]
    return np.stack(keys)


def _shared(bits: int):
    """(key, n): variants that two fingerprints of a batch share, and how many do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, n = np.unique(_keys(fp, bits), return_counts=True) if len(fp) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

    return run


def _variants(bits: int, n_buckets: int, crowded: np.ndarray):
    """crowded: the variants that are cut again, sorted."""
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                rep = part.column(1).to_numpy(zero_copy_only=False)
                key = _keys(fp, bits).ravel()
                who = np.tile(np.arange(len(fp)), len(key) // max(1, len(fp)))
                again = np.isin(key, crowded) if len(crowded) else np.zeros(len(key), bool)
                if again.any():
                    pieces = [(fp[who[again]] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
                    more = [mix((p + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ mix(key[again] ^ np.uint64((k + 1) << 58))) for k, p in enumerate(pieces)]
                    who = np.concatenate([who[~again], *[who[again]] * len(pieces)])
                    key = np.concatenate([key[~again], *more])
                key = key.view(np.int64)
                home = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets)
                # one row for each bucket: a variant of 64-bit values costs no more than its bytes
                order = np.argsort(home, kind="stable")
                edge = np.flatnonzero(np.diff(home[order].astype(np.int64), prepend=-1))
                rows = [(int(home[o[0]]), key[o].tobytes(), fp[who[o]].tobytes(), rep[who[o]].tobytes()) for o in (order[p:q] for p, q in zip(edge.tolist(), np.append(edge, len(order))[1:].tolist(), strict=True))]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "keys", "fps", "reps"])

    return run


def _linker(bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        key, fp, rep = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.int64), ("fps", np.uint64), ("reps", np.int64)))
        order = np.lexsort((fp, key))
        key, fp, rep = key[order], fp[order], rep[order]
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(edge, len(key)))
        u, v = [], []
        wide = np.repeat(size, size) <= 8
        for d in range(1, 8):  # small groups: every pair at once
            near = np.flatnonzero((key[d:] == key[:-d]) & wide[d:] & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= bits))
            u.append(rep[near])
            v.append(rep[near + d])
        for at, n in zip(edge[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            links = np.array(linked(fp[at : at + n], bits), np.int64).reshape(-1, 2) + at
            u.append(rep[links[:, 0]])
            v.append(rep[links[:, 1]])
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def link(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links between the reps of distinct fingerprints (fp long, rep long) that join all within `bits` bits."""
    total = distinct.count()
    n = max(buckets(distinct.sparkSession, 2), total * 64 * 24 >> 25)
    counted = distinct.select("fp").mapInArrow(_shared(bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    crowded = counted.where(F.col("n") >= max(DIRECT, total * 64 >> SHARE)).select("key").collect()  # at most 2 ** SHARE
    crowds = np.sort(np.array([r[0] for r in crowded], np.int64).view(np.uint64))
    rows = distinct.select("fp", "rep").mapInArrow(_variants(bits, n, crowds), "bucket int, keys binary, fps binary, reps binary")
    return rows.groupBy("bucket").applyInArrow(_linker(bits), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id that links of at most `bits` differing
    bits reach, itself included.  Null, empty and blank texts have fingerprint
    zero and are linked like any other; a null doc_id stays null and counts as
    the smallest (its component_id is null).  Repeated rows share a component.
    Other columns are ignored.  An empty table gives an empty one.
    """
    marked = spool(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = spool(marked.groupBy("fp").agg(F.min("doc_key").alias("rep")), "simhash-distinct")
    roots = connected_components(link(distinct, bits), "simhash-links")
    named = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    out = marked.join(named, "fp")
    return out.select("doc_id", "doc_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("root") != F.lit(-(2**63)), F.col("root")).alias("component_id"))
