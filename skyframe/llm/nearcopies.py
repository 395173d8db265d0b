"""Near copies by exact Jaccard similarity of word shingles.

Links come from the fingerprints of op2 (simhash.py) and, for pairs at the
threshold, whose fingerprints differ in more bits, from MinHash bands too.  The
latter's signatures drop what is far from similar; what is left of both is
compared by the shingles themselves, pair by pair.  A pair at the threshold of 0.8 is missed by all bands with
probability (1 - 0.8**4)**24 = 3e-6.

No task holds a group of copies.  First the members of a band are paired with
its most central one (as far as they look alike), and these pairs are compared.
Where that leaves a group of candidates in several parts, the texts outside of
the largest part are compared with all others, block by block.  A band that
many texts share is dealt to parts, each with the band's most central member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, buckets, doc_key, fold, mix, rows_of, slice_hashes, small, spool, word_spans
from .components import connected_components
from .simhash import fingerprint, link

WORDS = 5
#: Similar: 5 * common >= 4 * all, that is a Jaccard similarity of 0.8 at least.
PART, WHOLE = 4, 5
BANDS, ROWS = 24, 4
#: Of the BANDS * ROWS minima, so many are equal if two texts are to be compared (0.8 expects 77, with a deviation of 4; fewer have a probability of 1e-6).
NEAR = 58
_RNG = np.random.default_rng(42)
_XOR, _MUL = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64), _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | U64(1)
_JOIN = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | U64(1)


def node(text_col: str = "text") -> Column:
    """A text, as 64 bits."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles in lower case (A-Z only).  Fewer words are one shingle, no words another."""
    data = np.frombuffer((text or b"").lower(), np.uint8)
    left, right = word_spans(data)
    if len(left) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(data.tobytes().split()), 42)], np.uint64)
    return np.unique(mix(fold(slice_hashes(data, left, right), words)))


def minima(h: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(low, ((h[None, at : at + 1024] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    return low


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["doc_key", "node", "keys", "sig", "fp"])

    for key, at, body in rows_of(batches, "doc_key", "node", "body"):
        low = minima(shingles(body))
        keys = mix((mix(low.reshape(BANDS, ROWS).copy()) * _JOIN).sum(axis=1, dtype=np.uint64))
        held.append((key, at, keys.tobytes(), (mix(low) >> U64(56)).astype(np.uint8).tobytes(), int(np.uint64(fingerprint(body)).view(np.int64))))
        if len(held) == 8192:
            yield batch()
            held = []
    if held:
        yield batch()


#: Members of a band that meet in one part; a band is crowded from so many, and this share of all texts (as a shift).
PART_SIZE, SHARE = 8192, 14


def _keys(batch: pa.RecordBatch, name: str = "keys") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), np.uint64).reshape(-1, BANDS)


def central(sig: np.ndarray) -> np.ndarray:
    """How central each signature is among these: the mean share that has the same minimum.  An original is most central among its copies."""
    place = sig.astype(np.int64) + 256 * np.arange(sig.shape[1])
    return np.bincount(place.ravel(), minlength=256 * sig.shape[1])[place].mean(axis=1) / len(sig)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, mid, score) of the bands that two texts of a batch share: how many do, and the most central of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        key = _keys(batch).ravel()
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(edge, len(key)))
        rows = []
        for at, many in zip(edge[n > 1].tolist(), n[n > 1].tolist(), strict=True):
            who = order[at : at + many] // BANDS
            score = central(sig[who]) if many > 2 else np.ones(many)
            best = int(np.lexsort((node[who], -score))[0])
            rows.append((int(key[at].view(np.int64)), many, int(node[who[best]]), float(score[best])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "n", "mid", "score"])


class Crowds:
    """Crowded bands: their keys, sorted, how many parts each has, and its most central text."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted((k & 0xFFFFFFFFFFFFFFFF, n, x) for k, n, x in rows)
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.parts = np.array([-(-r[1] // PART_SIZE) for r in rows], np.int64)
        self.mid = np.array([r[2] for r in rows], np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of crowded bands in key, and which they are."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == key)
        return places, at[places]

    def deal(self, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in key, key of the part): a member goes to the part of its hash, the most central one to all."""
        crowded, which = self.find(key)
        if not len(crowded):
            return np.arange(len(key)), key
        parts, everywhere = self.parts[which], node[crowded] == self.mid[which]
        many = np.ones(len(key), np.int64)
        many[crowded] = np.where(everywhere, parts, 1)
        first = np.zeros(len(key), np.int64)
        first[crowded] = np.where(everywhere, 0, (mix(node[crowded].astype(np.int64).view(np.uint64).copy()) % parts.astype(np.uint64)).astype(np.int64))
        place = np.repeat(np.arange(len(key)), many)
        part = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + first[place]
        inside = np.zeros(len(key), bool)
        inside[crowded] = True
        return place, np.where(inside[place], mix(key[place] ^ mix(part.astype(np.uint64) + U64(1))), key[place])


def _dealer(n_buckets: int, crowds: Crowds) -> Callable:
    """Members of bands by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node = np.repeat(part.column(part.schema.get_field_index("node")).to_numpy(zero_copy_only=False), BANDS)
                sig = np.frombuffer(b"".join(part.column(part.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                place, key = crowds.deal(_keys(part).ravel(), node)
                home = (key >> U64(33)) % U64(n_buckets)
                # one row for each bucket: a key of 64-bit values costs no more than its bytes
                order = np.argsort(home, kind="stable")
                edge = np.flatnonzero(np.diff(home[order].astype(np.int64), prepend=-1))
                rows = [(int(home[o[0]]), key[o].tobytes(), node[place[o]].tobytes(), sig[place[o] // BANDS].tobytes()) for o in (order[p:q] for p, q in zip(edge.tolist(), np.append(edge, len(order))[1:].tolist(), strict=True))]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 4))], names=["bucket", "keys", "nodes", "sigs"])

    return run


def _crowding(crowds: Crowds) -> Callable:
    """(u, v): each member of a crowded band and its most central one, whether they look alike or not: what may have links across parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places, which = crowds.find(_keys(batch).ravel())
                node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)[places // BANDS]
                pairs = np.unique(np.stack([node, crowds.mid[which]], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


DEALT = "bucket int, keys binary, nodes binary, sigs binary"


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """As few links as join the same members as all pairs for which near(i, others) holds, and the smallest member each reaches."""
    comp, links = np.arange(n), []
    for i in range(n - 1):
        rest = np.flatnonzero(comp != comp[i])
        if not len(rest):
            break
        rest = rest[rest > i]
        hit = rest[near(i, rest)] if len(rest) else rest
        if len(hit):
            joined, first = np.unique(comp[hit], return_index=True)
            links += [(i, j) for j in hit[first].tolist()]
            joined = np.append(joined, comp[i])
            comp[np.isin(comp, joined)] = joined.min()
    return links, comp


def _linker(group: pa.Table) -> pa.Table:
    """Links that join all members of a band that look alike, from the most central one on."""
    key, who, sig = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("sigs", np.uint8)))
    sig = sig.reshape(-1, BANDS * ROWS)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    u, v = [], []
    wide = np.repeat(size, size) <= 8
    for d in range(1, 8):  # small groups: every pair at once
        pair = np.flatnonzero((key[d:] == key[:-d]) & wide[d:])
        pair = pair[(sig[order[pair]] == sig[order[pair + d]]).sum(axis=1) >= NEAR]
        u.append(who[pair])
        v.append(who[pair + d])
    for at, n in zip(edge[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        own = sig[order[at : at + n]]
        by = np.lexsort((who[at : at + n], -central(own)))
        own = own[by]
        links = np.array(forest(n, lambda i, rest, own=own: (own[rest] == own[i]).sum(axis=1) >= NEAR)[0], np.int64).reshape(-1, 2)
        u.append(who[at + by[links[:, 0]]])
        v.append(who[at + by[links[:, 1]]])
    pairs = np.stack([np.concatenate(u), np.concatenate(v)], axis=1)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


#: Texts of a group of candidates that meet in one block, besides those outside of its largest part.
BLOCK_SIZE = 2000


def _joiner(group: pa.Table) -> pa.Table:
    """(u, v): similar texts of different parts, as many as join what is similar, of the blocks in a bucket."""
    by: dict[tuple[int, int], dict[int, tuple[int, bytes]]] = {}
    for croot, block, at, comp, body in zip(*(group.column(c).to_pylist() for c in ("croot", "block", "node", "comp", "body")), strict=True):
        by.setdefault((croot, block), {})[at] = (comp, body)
    out: list[tuple[int, int]] = []
    for members in by.values():
        names = sorted(members)
        _, comp, count = np.unique([members[x][0] for x in names], return_inverse=True, return_counts=True)
        if len(count) == 1:
            continue
        sets = [shingles(members[x][1]) for x in names]
        size = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(int(flat.max()) + 1, bool)
        for i in np.flatnonzero(comp != count.argmax()).tolist():
            mark[flat[start[i] : start[i + 1]]] = True
            common = np.add.reduceat(mark[flat], start[:-1], dtype=np.int64)
            mark[flat[start[i] : start[i + 1]]] = False
            hit = np.flatnonzero((WHOLE * common >= PART * (size + size[i] - common)) & (comp != comp[i]))
            joined, first = np.unique(comp[hit], return_index=True)
            out += [(names[i], names[j]) for j in hit[first].tolist()]
            comp[np.isin(comp, joined)] = comp[i]
    return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose texts are similar."""
    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for u, v, a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("u", "v", "body", "other")), strict=True):
            if u != last:  # pairs of one text follow each other
                last, held = u, shingles(a)
            other = shingles(b)
            common = len(np.intersect1d(held, other, assume_unique=True))
            if WHOLE * common >= PART * (len(held) + len(other) - common):
                out.append((u, v))
        yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links of op2 between texts (node, fp): those with one fingerprint and the smallest of them, and these within BITS differing bits."""
    prints = spool(distinct.groupBy("fp").agg(F.min("node").alias("rep")), "nearcopies-prints")
    same = distinct.join(prints, "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    return same.union(link(prints)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, doc_key, n, root) of every distinct pair of a text and a doc_key: n rows of docs have it.

    Texts have one root if pairs of a Jaccard similarity of 0.8 or more (5-word
    shingles, compared exactly) link them.  Texts without words are copies of
    each other.  A text is known by 64 bits of a hash.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_key(id_col).alias("doc_key"), node(text_col).alias("node"), F.col(text_col).cast("binary").alias("body"))
    marked = spool(rows.mapInArrow(_signed, "doc_key long, node long, keys binary, sig binary, fp long"), "nearcopies")
    # equal texts have equal signatures
    distinct = spool(marked.groupBy("node").agg(F.min("doc_key").alias("doc_key"), F.min("keys").alias("keys"), F.min("sig").alias("sig"), F.min("fp").alias("fp")), "nearcopies-distinct")
    total = distinct.count()
    n = max(buckets(spark, 2), total * BANDS * 112 >> 25)
    counted = distinct.mapInArrow(_shared, "key long, n long, mid long, score double").groupBy("key").agg(F.sum("n").alias("n"), F.max_by("mid", "score").alias("mid"))
    crowds = Crowds([tuple(r) for r in counted.where(F.col("n") >= max(PART_SIZE, total >> SHARE)).collect()])  # at most BANDS << SHARE
    dealt = distinct.select("node", "keys", "sig").mapInArrow(_dealer(n, crowds), DEALT)
    links = spool(dealt.groupBy("bucket").applyInArrow(_linker, "u long, v long").distinct(), "nearcopies-links")
    candidates = links.union(distinct.select("node", "keys").mapInArrow(_crowding(crowds), "u long, v long")) if len(crowds.keys) else links
    groups = connected_components(candidates, "nearcopies-links").select("node", F.col("root").alias("croot"))
    members = spool(distinct.select("node", "doc_key").join(groups, "node"), "nearcopies-members")
    printed = spool(fingerprint_links(distinct), "nearcopies-simhash")
    ends = printed.select(F.col("u").alias("node")).union(printed.select("v")).distinct()
    wanted = spool(members.select("node", "doc_key").union(distinct.select("node", "doc_key").join(ends, "node")).distinct(), "nearcopies-wanted")
    texts = spool(rows.join(small(wanted), ["node", "doc_key"]).select("node", "body"), "nearcopies-texts")

    both = links.union(printed).distinct().join(texts.select(F.col("node").alias("v"), F.col("body").alias("other")), "v")
    both = both.join(texts.select(F.col("node").alias("u"), "body"), "u").sortWithinPartitions("u")
    alike = spool(both.mapInArrow(_alike, "u long, v long").distinct(), "nearcopies-alike")
    roots = spool(connected_components(alike, "nearcopies-parts"), "nearcopies-roots")

    # groups that are still in parts
    state = members.join(roots, "node", "left").select("croot", "node", F.coalesce("root", "node").alias("comp"))
    parts = state.groupBy("croot", "comp").agg(F.count("*").alias("n"))
    whole = parts.groupBy("croot").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = F.ceil(F.col("n") / BLOCK_SIZE).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = state.join(whole, "croot").withColumn("block", F.explode(F.when(F.col("comp") == F.col("main.comp"), own).otherwise(F.sequence(F.lit(0), blocks - 1))))
    dealt = dealt.select("croot", "block", "node", "comp").join(texts, "node")
    found = dealt.groupBy(F.pmod(F.xxhash64("croot", "block"), F.lit(n)).alias("bucket")).applyInArrow(_joiner, "u long, v long")
    every = alike.union(spool(found, "nearcopies-cross"))
    roots = spool(connected_components(every, "nearcopies-parts"), "nearcopies-roots")
    out = marked.groupBy("node", "doc_key").agg(F.count("*").alias("n"))
    return out.join(roots, "node", "left").select("node", "doc_key", "n", F.coalesce("root", "node").alias("root"))
