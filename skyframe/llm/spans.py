"""Find windows (runs of bytes or words) that occur more than once in a corpus.

A window's owner is the smallest gram hash inside it, so equal windows have
equal owners.  Consecutive windows with one owner travel as one packed string
to the owner's bucket; there all strings of an owner meet and their windows are
compared exactly.  Strings that are equal within a map task travel once, and
for all but the first of them the answer is known at once, so a passage that
fills a third of the corpus reaches its bucket at most once from each flush.

A gram that many different texts contain would make one owner too large for a
task.  A census counts the windows of each owner first; the windows of hot
owners travel one by one, by a digest of their own, and so spread evenly.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buckets, byte_hashes, doc_key, fold, groups_of, mix, rows_of, slice_hashes, slide_min, spool, tie_of

TOP = U64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text hashed at once; bytes of text whose strings are packed together; windows in a string.
CHUNK, FLUSH, RUN = 1 << 20, 10 << 20, 4096
#: Bytes of text whose strings make one bucket, about.
BUCKET = 8 << 20
#: An owner is hot with this many windows, and this share of all of them (as a shift): so at most 2 ** 20 owners are hot.
HOT, SHARE = 200_000, 20
#: Windows of an owner in one flush that are counted: of fewer, no flush tells.
TOLD = 64
PACKED = "bucket int, packed binary"
COVERED = "doc_key long, tie long, first long, last long"


def sorted_order(strings: list[bytes], w: int, tags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of w words, each after its string's tag, in sorted order, and the class of each of them."""
    wins: list[bytes] = []
    for s, tag in zip(strings, tags, strict=True):
        parts = s.split(b" ")
        wins.extend(tag + b" ".join(parts[i : i + w]) for i in range(len(parts) - w + 1))
    order = sorted(range(len(wins)), key=wins.__getitem__)
    classes, k, last = np.empty(len(wins), np.int64), -1, None
    for i, j in enumerate(order):
        if wins[j] != last:
            last, k = wins[j], k + 1
        classes[i] = k
    return np.array(order, np.int64), classes


@dataclass(frozen=True)
class Scheme:
    """unit: 'byte' or 'word'; window and gram: their lengths in units.

    pages=False: a window counts where an equal one starts earlier (smaller
    doc_id, or the same document and an earlier start).  pages=True: it counts
    everywhere if it occurs in two different documents.  order: brings the
    windows of strings into an order in which equal ones are neighbours.
    """

    unit: str
    window: int
    gram: int
    pages: bool = False
    order: Callable = sorted_order


def normal_words(text: bytes) -> bytes:
    return b" ".join(text.split())


#: A document: its id and a hash of its text, for rows with one id and different texts.
Doc = tuple[int, int]


def _pieces(docs: list[tuple], scheme: Scheme) -> Iterator[list[tuple[Doc, int, bytes, int]]]:
    """Lists of (doc, first unit, bytes, salt) of about CHUNK bytes of (doc, text, salt and, if not 0, the text's first unit); a longer text is cut, with window - 1 units of overlap."""
    cut: list[tuple[Doc, int, bytes, int]] = []
    for doc, text, salt, *base in docs:
        first = base[0] if base else 0
        if len(text) <= CHUNK:
            cut.append((doc, first, text, salt))
        elif scheme.unit == "byte":
            cut.extend((doc, first + at, text[at : at + CHUNK + scheme.window - 1], salt) for at in range(0, max(1, len(text) - scheme.window + 1), CHUNK))
        else:
            words, step = text.split(b" "), CHUNK // 8
            cut.extend((doc, first + at, b" ".join(words[at : at + step + scheme.window - 1]), salt) for at in range(0, max(1, len(words) - scheme.window + 1), step))
    return groups_of(iter(cut), lambda p: len(p[2]) + 1, CHUNK)


@dataclass
class _Runs:
    """Runs of windows with one owner: columns, and the joined data with the word bounds in it (None for bytes)."""

    blob: bytes
    own: np.ndarray
    piece: np.ndarray
    first: np.ndarray  # window, in units of the joined data
    unit: np.ndarray  # the same within the piece
    n: np.ndarray
    begin: np.ndarray  # bytes of the joined data
    end: np.ndarray
    recurs: np.ndarray | None
    left: np.ndarray | None
    right: np.ndarray | None

    def where(self, some: np.ndarray) -> _Runs:
        """Some of the runs."""
        return replace(self, **{k: getattr(self, k)[some] for k in ("own", "piece", "first", "unit", "n", "begin", "end", "recurs")})

    def bounds(self, k: int, w: int) -> Iterator[tuple[int, int]]:
        """The bytes of each window of run k."""
        for u in range(int(self.first[k]), int(self.first[k] + self.n[k])):
            yield (u, u + w) if self.left is None else (int(self.left[u]), int(self.right[u + w - 1]))


def _runs(pieces: list[tuple[Doc, int, bytes, int]], scheme: Scheme, marked: bool = True) -> _Runs | None:
    """marked: also whether the owner occurs more than once in the run; no other run repeats a window of its own."""
    blob = b" ".join(p[2] for p in pieces)
    data = np.frombuffer(blob, np.uint8)
    lens = np.array([len(p[2]) for p in pieces], np.int64)
    at = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    if scheme.unit == "byte":
        units, left, right, base, width = byte_hashes(data), None, None, at, lens
    else:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = data != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        left, right = edge[::2], edge[1::2]
        units = slice_hashes(data, left, right)
        base = np.searchsorted(left, at)
        width = np.searchsorted(left, at + lens) - base
    w, g = scheme.window, scheme.gram
    if len(units) < w:
        return None
    v = mix(fold(units, g))
    for b, n in zip(base.tolist(), width.tolist(), strict=True):
        v[max(b, b + n - g + 1) : b + n] = TOP
    low = slide_min(v, w - g + 1)
    good = np.zeros(len(low), bool)
    for b, n in zip(base.tolist(), width.tolist(), strict=True):
        if n >= w:
            good[b : b + n - w + 1] = True
    idx = np.flatnonzero(good)
    if not len(idx):
        return None
    own = low[idx]
    new = np.ones(len(idx), bool)
    new[1:] = (own[1:] != own[:-1]) | (idx[1:] != idx[:-1] + 1)
    begins = np.flatnonzero(new)
    long = np.diff(np.append(begins, len(idx)))
    if long.max() > RUN:
        begins = np.concatenate([np.arange(b, b + n, RUN) for b, n in zip(begins.tolist(), long.tolist(), strict=True)])
        long = np.diff(np.append(begins, len(idx)))
    first = idx[begins]
    piece = np.searchsorted(base, first, "right") - 1
    while True:  # an empty piece shares its base with the next one
        wrong = first >= base[piece] + width[piece]
        if not wrong.any():
            break
        piece[wrong] -= 1
    last = first + long + w - 2
    recurs = None
    if marked:
        # the leftmost smallest gram of the first window and the rightmost one of the last; places break ties, for a few bits of the hash
        place, mask = np.arange(len(v), dtype=np.uint64), U64((1 << len(v).bit_length()) - 1)
        leftmost = slide_min(v & ~mask | place, w - g + 1)[first] & mask
        recurs = leftmost != mask - (slide_min(v & ~mask | (mask - place), w - g + 1)[first + long - 1] & mask)
    begin, end = (first, last + 1) if left is None else (left[first], right[last])
    salts = np.array([p[3] for p in pieces], np.int64).view(np.uint64)[piece]
    return _Runs(blob, mix(own[begins] ^ salts), piece, first, first - base[piece], long, begin, end, recurs, left, right)


def _census(scheme: Scheme) -> Callable:
    """(own, n, size): windows of the owners that have TOLD of them in a flush, counting equal strings once; own is null for all windows and bytes of the flush."""
    def flush(docs: list[tuple[Doc, bytes, int]]) -> pa.RecordBatch:
        own, name, n = [], [], []
        for pieces in _pieces(docs, scheme):
            r = _runs(pieces, scheme, marked=False)
            if r:
                own.append(r.own)
                name.append(slice_hashes(np.frombuffer(r.blob, np.uint8), r.begin, r.end) ^ r.own)
                n.append(r.n)
        told, many, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        if own:
            _, some = np.unique(np.concatenate(name), return_index=True)
            windows = np.concatenate(n)[some]
            told, at = np.unique(np.concatenate(own)[some], return_inverse=True)
            many, total = np.bincount(at, windows).astype(np.int64), int(windows.sum())
            told, many = told[many >= TOLD], many[many >= TOLD]
        ids = pa.array([None, *told.view(np.int64).tolist()], pa.int64())
        return pa.record_batch([ids, pa.array([total, *many.tolist()], pa.int64()), pa.array([sum(len(d[1]) for d in docs), *[0] * len(many)], pa.int64())], names=["own", "n", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(flush, groups_of(_rows(batches, scheme), lambda r: len(r[1]), FLUSH))

    return run


def _rows(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[tuple[Doc, bytes, int]]:
    clean = normal_words if scheme.unit == "word" else lambda t: t
    return (((d, e), clean(t), s) for d, e, t, s in rows_of(batches, "doc_key", "tie", "body", "salt") if t)


_HEAD = struct.Struct("<III")
#: Columns of strings (key, doc, tie, unit, windows, flag, bytes), of answered ranges (doc, tie, first, last), and of single windows (two parts of the digest, doc, tie, unit, flag).
_LAYOUT = (("<u4", "<i8", "<u4", "<i8", "<u2", "u1", "<u4"), ("<i8", "<u4", "<i8", "<i8"), ("<u8", "<u4", "<i8", "<u4", "<i8", "u1"))
#: Flags of a string: it occurs in two documents (pages only); its owner occurs in it more than once.
SHARED, RECURS = 1, 2


def _pack(strings: list[list], known: list[tuple], singles: list[list]) -> bytes:
    """strings: [key, doc, first unit, windows, flag, bytes]; known: (doc, first, last unit) that are answered; singles: [digest, doc, unit, flag]."""
    rows = (
        [(key, *doc, unit, n, flag, len(string)) for key, doc, unit, n, flag, string in strings],
        [(*doc, a, b) for doc, a, b in known],
        [(int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:12], "little"), *doc, unit, flag) for digest, doc, unit, flag in singles],
    )
    parts = [_HEAD.pack(*map(len, rows))]
    for part, kinds in zip(rows, _LAYOUT, strict=True):
        parts += [np.array([r[k] for r in part], kind).tobytes() for k, kind in enumerate(kinds)]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([*parts, *(s[5] for s in strings)]))


def _unpack(packed: bytes) -> tuple[list[list[np.ndarray]], memoryview]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    at, out = _HEAD.size, []
    for count, kinds in zip(_HEAD.unpack_from(raw), _LAYOUT, strict=True):
        out.append([])
        for kind in kinds:
            out[-1].append(np.frombuffer(raw, kind, count, at))
            at += out[-1][-1].nbytes
    return out, memoryview(raw)[at:]


def _flusher(scheme: Scheme, n_buckets: int) -> Callable:
    """Packs documents' strings by bucket; state(owners): 0 those that are left out, 2 hot ones, 1 all others."""
    w = scheme.window

    def flush(docs: list[tuple], state: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        docs.sort(key=lambda d: d[0])
        seen: dict[bytes | tuple, int] = {}
        strings: list[list] = []
        homes: list[int] = []
        twins: dict[int, list[tuple]] = {}
        known: list[tuple] = []
        single: dict[bytes, list] = {}  # digest: [digest, doc, unit, flag]

        def answered(doc: Doc, first: int, last: int) -> None:
            if known and known[-1][0] == doc and known[-1][1] <= first <= known[-1][2] + 1:
                known[-1] = (doc, known[-1][1], max(known[-1][2], last))
            else:
                known.append((doc, first, last))

        def alone(digest: bytes, doc: Doc, unit: int) -> None:
            """A window of a hot owner."""
            was = single.get(digest)
            if was is None:
                single[digest] = [digest, doc, unit, 0]
            elif scheme.pages:
                if was[1] != doc:
                    if not was[3]:
                        known.append((was[1], was[2], was[2] + w - 1))
                        was[3] = SHARED
                    answered(doc, unit, unit + w - 1)
                elif was[3]:
                    answered(doc, unit, unit + w - 1)
                else:  # again in one document: another row, as it may be shared elsewhere
                    single[digest + unit.to_bytes(8, "little")] = [digest, doc, unit, 0]
            elif was[1] != doc or was[2] != unit:
                answered(doc, unit, unit + w - 1)

        for pieces in _pieces(docs, scheme):
            r = _runs(pieces, scheme)
            if r is None:
                continue
            states = state(r.own)
            r, warm = r.where(states > 0), (states[states > 0] > 1).tolist()
            for k, (own, piece, unit, n, begin, end, recurs) in enumerate(zip(r.own.tolist(), r.piece.tolist(), r.unit.tolist(), r.n.tolist(), r.begin.tolist(), r.end.tolist(), r.recurs.tolist(), strict=True)):
                doc, unit = pieces[piece][0], pieces[piece][1] + unit
                key = own & 0xFFFFFFFF
                string = r.blob[begin:end]
                if warm[k] and scheme.pages:
                    for i, (a, b) in enumerate(r.bounds(k, w)):
                        alone(xxhash.xxh3_128_digest(r.blob[a:b], key), doc, unit + i)
                    continue
                tag = (key, string) if scheme.pages else string
                at = seen.setdefault(tag, len(strings))
                if at == len(strings):
                    strings.append([key, doc, unit, n, RECURS * recurs, string])
                    homes.append(-1 if warm[k] else (own >> 32) % n_buckets)
                    if warm[k]:
                        for i, (a, b) in enumerate(r.bounds(k, w)):
                            alone(xxhash.xxh3_128_digest(r.blob[a:b]), doc, unit + i)
                        strings[at][5] = b""  # kept for its place only
                    continue
                first = strings[at]
                if first[1] == doc and first[2] == unit:
                    continue  # a repeated row
                if not scheme.pages:
                    answered(doc, unit, unit + n + w - 2)
                else:
                    first[4] |= SHARED * (first[1] != doc)
                    twins.setdefault(at, []).append((doc, unit, n))
        for at, rest in twins.items():
            key, doc, unit, n, flag, string = strings[at]
            if flag & SHARED:
                known.extend((d, u, u + m + w - 2) for d, u, m in [(doc, unit, n), *rest])
            else:
                strings.extend([key, d, u, m, flag, string] for d, u, m in rest)
                homes.extend([homes[at]] * len(rest))
        by: dict[int, tuple[list, list, list]] = {}
        for home, s in zip(homes, strings, strict=True):
            if home >= 0:
                by.setdefault(home, ([], [], []))[0].append(s)
        for s in single.values():
            by.setdefault(int.from_bytes(s[0][12:], "little") % n_buckets, ([], [], []))[2].append(s)
        # what is answered goes to the document's bucket, and is spread so
        for home, k in zip(homes_of(np.array([k[0][0] for k in known], np.int64), np.array([k[0][1] for k in known], np.int64), n_buckets).tolist(), known, strict=True):
            by.setdefault(home, ([], [], []))[1].append(k)
        out = [(home, _pack(*rows)) for home, rows in by.items()]
        return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "packed"])

    return flush


def _packer(scheme: Scheme, n_buckets: int, hot: np.ndarray) -> Callable:
    """hot: the hot owners, sorted."""
    flush = _flusher(scheme, n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in groups_of(_rows(batches, scheme), lambda r: len(r[1]), FLUSH):
            yield flush(docs, lambda own: 1 + np.isin(own, hot) if len(hot) else np.ones(len(own), np.int64))

    return run


def homes_of(doc: np.ndarray, tie: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of documents."""
    h = (doc.astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15) + tie.astype(np.uint64)) * U64(0xD6E8FEB86659FD93)
    return (h >> U64(20) & U64(0x7FFFFFFF)).astype(np.int64) % n_buckets


#: Windows ordered at once.
SLAB = 80_000


def _resolver(scheme: Scheme, n_buckets: int) -> Callable:
    """Covered ranges of a bucket's packs, packed by the bucket of their document."""
    w = scheme.window

    def of_bucket(packs: list[bytes]) -> list[np.ndarray]:
        """Columns doc, tie, first, last of covered units."""
        parts = [_unpack(p) for p in packs]
        cols, answered, single = ([np.concatenate([p[0][part][k] for p in parts]) for k in range(len(kinds))] for part, kinds in enumerate(_LAYOUT))
        blobs = [p[1] for p in parts]
        out = [np.stack([c.astype(np.int64) for c in answered], axis=1)] if len(answered[0]) else []
        if len(single[0]):
            out += alone(*single)
        key, doc, tie, unit, n, flag, size = cols
        if not len(key):
            return out
        ends = [len(p[0][0][0]) for p in parts]
        pack = np.repeat(np.arange(len(ends)), ends)
        start = np.concatenate([np.concatenate([[0], np.cumsum(p[0][0][6].astype(np.int64))[:-1]]) if len(p[0][0][6]) else np.zeros(0, np.int64) for p in parts])
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero((count[where] > 1) | (flag > 0))
        if not len(some):
            return out
        some = some[np.lexsort((unit[some], tie[some], doc[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (doc[some][1:] != doc[some][:-1]) | (tie[some][1:] != tie[some][:-1])
        # documents as places in corpus order
        docs = np.stack([doc[some][new], tie[some][new].astype(np.int64)], axis=1)
        who_l, unit_l, n_l, flag_l = (np.cumsum(new) - 1).tolist(), unit[some].tolist(), n[some].tolist(), flag[some].tolist()
        found: list[tuple[int, int, int]] = []
        entries: dict[tuple[int, bytes], list[int]] = {}
        for i, (k, p, s, z) in enumerate(zip(key[some].tolist(), pack[some].tolist(), start[some].tolist(), size[some].tolist(), strict=True)):
            entries.setdefault((k, bytes(blobs[p][s : s + z])), []).append(i)
        cover = lambda i: found.append((who_l[i], unit_l[i], unit_l[i] + n_l[i] + w - 2))
        by: dict[int, list[tuple[int, bytes, bool, bytes]]] = {}
        for (k, string), who in entries.items():
            if scheme.pages:
                done = len({who_l[i] for i in who}) > 1 or any(flag_l[i] & SHARED for i in who)
                if done:
                    for i in who:
                        cover(i)
                    by.setdefault(k, []).append((who[0], string, True, b"%08x" % k))
                else:
                    by.setdefault(k, []).extend((i, string, False, b"%08x" % k) for i in who)
            else:
                a = who[0]
                for i in who[1:]:
                    if (who_l[i], unit_l[i]) != (who_l[a], unit_l[a]):
                        cover(i)
                by.setdefault(k, []).append((a, string, False, b""))
        ranges = [np.array(found, np.int64)] if found else []
        slab, total = [], 0
        for members in by.values():
            if len(members) > 1 or scheme.pages or flag_l[members[0][0]] & RECURS:
                slab.extend(members)
                total += sum(n_l[m[0]] for m in members)
            if total > SLAB:
                ranges += of_slab(slab, who_l, unit_l, n_l)
                slab, total = [], 0
        if slab:
            ranges += of_slab(slab, who_l, unit_l, n_l)
        if ranges:
            rows = np.concatenate(ranges)
            out.append(np.concatenate([docs[rows[:, 0]], rows[:, 1:]], axis=1))
        return out

    def alone(a, b, doc, tie, unit, flag) -> list[np.ndarray]:
        """Windows of hot owners: equal digests are equal windows."""
        order = np.lexsort((unit, tie, doc, b, a))
        a, b, doc, tie, unit, flag = (c[order] for c in (a, b, doc, tie, unit, flag))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if scheme.pages:
            edge = np.flatnonzero(new)
            other = np.zeros(len(a), bool)
            other[1:] = ~new[1:] & ((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))
            hit = np.logical_or.reduceat(other | (flag > 0), edge)[np.cumsum(new) - 1]
        else:
            at = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))  # the first of each class
            hit = (doc != doc[at]) | (tie != tie[at]) | (unit != unit[at])
        doc, tie, unit = doc[hit], tie[hit].astype(np.int64), unit[hit]
        return [np.stack([doc, tie, unit, unit + w - 1], axis=1)] if len(doc) else []

    def of_slab(slab, who_l, unit_l, n_l) -> list[np.ndarray]:
        slab = sorted(slab, key=lambda m: m[0])  # in corpus order
        order, classes = scheme.order([m[1] for m in slab], w, [m[3] for m in slab])
        many = np.array([n_l[m[0]] for m in slab], np.int64)
        owner = np.repeat(np.arange(len(slab)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        who = np.array([who_l[m[0]] for m in slab], np.int64)[owner]
        unit = np.array([unit_l[m[0]] for m in slab], np.int64)[owner] + step
        edge = np.flatnonzero(np.diff(classes, prepend=-1))
        if scheme.pages:
            d, done = who[order], np.array([m[2] for m in slab])[owner][order]
            wide = (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)) | np.logical_or.reduceat(done, edge)
            hit = order[wide[classes] & ~done]
        else:  # windows are numbered in corpus order: the smallest of a class starts earliest
            hit = order[order != np.minimum.reduceat(order, edge)[classes]]
        if not len(hit):
            return []
        hit.sort()
        who, unit = who[hit], unit[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (who[1:] != who[:-1]) | (unit[1:] > unit[:-1] + w)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(hit)) - 1
        return [np.stack([who[begin], unit[begin], unit[end] + w - 1], axis=1)]

    def table(group: pa.Table) -> pa.Table:
        out = of_bucket(group.column("packed").to_pylist())
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        home = homes_of(rows[:, 0], rows[:, 1], n_buckets)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], home))
        home, rows = home[order], rows[order]
        edge = np.flatnonzero(np.diff(home, prepend=-1))
        z = zstandard.ZstdCompressor(level=3)
        packs = [z.compress(np.ascontiguousarray(rows[p:q].T).tobytes()) for p, q in zip(edge.tolist(), np.append(edge, len(rows))[1:].tolist(), strict=True)]
        return pa.table([pa.array(home[edge], pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "packed"])

    return table


def _ranges(packed: bytes) -> np.ndarray:
    """Rows of doc, tie, first, last."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64).reshape(4, -1).T


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col).alias("doc_key"), tie_of(text_col).alias("tie"), F.col(text_col).cast("binary").alias("body"))


def covered(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text", salt_col: str | None = None) -> tuple[DataFrame, int]:
    """(bucket, packed): units of documents, ends included, that lie in a repeated window, by the document's bucket; ranges (see `ranges`) may overlap.  And the number of buckets.

    A document is a row's id and text (tie: 32 bits of a hash of the text, the
    order of rows with one id); rows that repeat a document are that document.
    A null id counts as the smallest id.  salt_col: only windows of documents
    with equal values of it are compared.
    """
    spark = docs.sparkSession
    salt = F.xxhash64(F.col(salt_col)) if salt_col else F.lit(0).cast("long")
    rows = docs.select(doc_key(id_col).alias("doc_key"), tie_of(text_col).alias("tie"), F.col(text_col).cast("binary").alias("body"), salt.alias("salt"))
    told = rows.mapInArrow(_census(scheme), "own long, n long, size long").groupBy("own").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    told = spool(told.where(F.col("own").isNull() | (F.col("n") >= HOT)), "census")
    total = told.where("own is null").first()
    windows, size = (total["n"], total["size"]) if total else (0, 0)
    hot = [r[0] for r in told.where(F.col("own").isNotNull() & (F.col("n") >= max(HOT, windows >> SHARE))).select("own").collect()]  # at most 2 ** SHARE
    n = max(buckets(spark, 4), size // BUCKET)
    packed = rows.mapInArrow(_packer(scheme, n, np.sort(np.array(hot, np.int64).view(np.uint64))), PACKED)
    return packed.groupBy("bucket").applyInArrow(_resolver(scheme, n), PACKED), n


#: Bits of an owner that are its name.
NAME = 40
_HEAVY = np.dtype([("at", "<u4"), ("n", "<u4")])


def _pack_names(name: np.ndarray, flag: np.ndarray, heavy: np.ndarray) -> bytes:
    """Sorted names, a flag for each, and the windows of some: planes of the bytes of their differences."""
    z = zstandard.ZstdCompressor(level=3)
    step = np.diff(name, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[: NAME // 8]
    parts = [z.compress(x) for x in (*(np.ascontiguousarray(p).tobytes() for p in step), np.packbits(flag).tobytes(), heavy.tobytes())]
    return struct.pack(f"<{1 + len(parts)}I", len(name), *map(len, parts)) + b"".join(parts)


def _unpack_names(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many = NAME // 8 + 2
    count, *sizes = struct.unpack_from(f"<{1 + many}I", packed)
    at, parts = 4 * (1 + many), []
    for size in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(packed[at : at + size]))
        at += size
    step = np.zeros((count, 8), np.uint8)
    for k, plane in enumerate(parts[:-2]):
        step[:, k] = np.frombuffer(plane, np.uint8)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), np.unpackbits(np.frombuffer(parts[-2], np.uint8), count=count).astype(bool), np.frombuffer(parts[-1], _HEAVY)


def _named_owners(scheme: Scheme, docs: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the owners in documents, whether two of these have them, and the windows of those with `least` windows."""
    own, who, n, ids = [], [], [], {}
    for pieces in _pieces(docs, scheme):
        r = _runs(pieces, scheme, marked=False)
        if r:
            own.append(r.own >> U64(64 - NAME))
            who.append(np.array([ids.setdefault(p[0], len(ids)) for p in pieces])[r.piece])
            n.append(r.n)
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, _HEAVY)
    own, who, n = map(np.concatenate, (own, who, n))
    order = np.argsort(own, kind="stable")
    own, who = own[order], who[order]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    many = np.add.reduceat(n[order], edge)
    at = np.flatnonzero(many >= least)
    heavy = np.empty(len(at), _HEAVY)
    heavy["at"], heavy["n"] = at, np.minimum(many[at], 2**32 - 1)
    return own[edge], np.minimum.reduceat(who, edge) != np.maximum.reduceat(who, edge), heavy


def shared(packs: DataFrame, n: int, docs_of: Callable[[bytes], list[tuple]], scheme: Scheme) -> DataFrame:
    """As `covered`, for pages=True and texts in n packs or sets of packs (bucket, packed), by homes_of(doc, tie): the texts stay there.

    docs_of(packed): (doc, text, salt, first unit) of each text.  Each bucket
    tells the names of its owners, 40 bits each; only strings of owners whose
    name two documents have travel.  No window that two documents have is lost
    so: its owner is in both.  A name that two owners share costs a string that
    the resolver finds to be alone.
    """
    lists = max(1, buckets(packs.sparkSession, 1), n // 4)
    hot_from, least = HOT, TOLD
    flush = _flusher(scheme, n)

    def texts(group: pa.Table) -> list[tuple]:
        return [d for packed in group.column("packed").to_pylist() for d in docs_of(packed) if d[1]]

    def tell(group: pa.Table) -> pa.Table:
        name, flag, heavy = _named_owners(scheme, texts(group), least)
        edge = np.searchsorted(name * U64(lists) >> U64(NAME), np.arange(lists + 1, dtype=np.uint64))
        out = []
        for k in range(lists):
            a, b = edge[k], edge[k + 1]
            if a < b:
                some = heavy[(heavy["at"] >= a) & (heavy["at"] < b)].copy()
                some["at"] -= np.uint32(a)
                out.append((k, group.column("bucket")[0].as_py(), _pack_names(name[a:b], flag[a:b], some)))
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "home", "packed"])

    def answer(group: pa.Table) -> pa.Table:
        homes = group.column("home").to_pylist()
        got = [_unpack_names(p) for p in group.column("packed").to_pylist()]
        name, flag = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        base = np.cumsum([0, *(len(g[0]) for g in got)])
        many = np.zeros(len(name), np.int64)
        for at, g in zip(base.tolist(), got, strict=False):
            many[at + g[2]["at"].astype(np.int64)] = g[2]["n"]
        order = np.argsort(name, kind="stable")
        new = np.ones(len(name), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        edge, kind = np.flatnonzero(new), np.cumsum(new) - 1
        two = (np.diff(np.append(edge, len(name))) > 1) | np.logical_or.reduceat(flag[order], edge)
        hot = np.add.reduceat(many[order], edge) >= hot_from
        two_of, hot_of = np.empty(len(name), bool), np.empty(len(name), bool)
        two_of[order], hot_of[order] = two[kind], hot[kind]
        out = []
        for home, a, b in zip(homes, base[:-1].tolist(), base[1:].tolist(), strict=True):
            some = two_of[a:b]
            if some.any():
                out.append((home, _pack_names(name[a:b][some], hot_of[a:b][some], np.zeros(0, _HEAVY))))
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), pa.binary()))], names=["bucket", "packed"])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [_unpack_names(p) for p in right.column("packed").to_pylist()]
        if not got:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "packed"])
        name, hot = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(name)
        name, hot = name[order], hot[order]

        def state(own: np.ndarray) -> np.ndarray:
            own = own >> U64(64 - NAME)
            at = np.minimum(np.searchsorted(name, own), len(name) - 1)
            return (name[at] == own) * (1 + hot[at])

        return pa.Table.from_batches([flush(texts(left), state)])

    told = packs.groupBy("bucket").applyInArrow(tell, "bucket int, home int, packed binary").groupBy("bucket").applyInArrow(answer, PACKED)
    strings = packs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(send, PACKED)
    return strings.groupBy("bucket").applyInArrow(_resolver(scheme, n), PACKED)


def ranges(found: DataFrame) -> DataFrame:
    """(doc_key, tie, first, last) of what `covered` found, a row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                rows = _ranges(packed)
                yield pa.record_batch([pa.array(rows[:, k]) for k in range(4)], names=["doc_key", "tie", "first", "last"])

    return found.select("packed").mapInArrow(run, COVERED)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges [first, last + 1) of ranges with their ends included; touching ones join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + 1)
        else:
            out.append([a, b + 1])
    return [(a, b) for a, b in out]


_ROW = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("null", "u1"), ("size", "<i8")])


def _text_packer(n_buckets: int) -> Callable:
    """Whole texts by bucket, compressed together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "doc_id", "doc_key", "tie", "body")
        for held in groups_of(rows, lambda r: len(r[3] or b"") + 32, FLUSH):
            by: dict[int, list[tuple]] = {}
            homes = homes_of(np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64), n_buckets)
            for home, (doc_id, key, tie, body) in zip(homes.tolist(), held, strict=True):
                by.setdefault(home, []).append((key, tie, doc_id is None, body or b""))
            z = zstandard.ZstdCompressor(level=3)
            packs = [z.compress(b"".join([struct.pack("<I", len(r)), np.array([(k, t, null, len(b)) for k, t, null, b in r], _ROW).tobytes(), *(x[3] for x in r)])) for r in by.values()]
            yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "packed"])

    return run


def rebuild(docs: DataFrame, scheme: Scheme, make: Callable[[int | None, bytes, list[tuple[int, int]]], tuple], out: pa.Schema, ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """make(id, text, disjoint covered ranges) of every row of docs, as rows of out.

    Texts travel once, compressed by bucket, and meet the ranges of their bucket.
    """
    found, n = covered(docs, scheme, id_col, text_col)
    texts = _named(docs, id_col, text_col).mapInArrow(_text_packer(n), PACKED)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for packed in right.column("packed").to_pylist():
            for d, t, a, b in _ranges(packed).tolist():
                spans.setdefault((d, t), []).append((a, b))
        made: list[tuple] = []
        for packed in left.column("packed").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(packed)
            (count,) = struct.unpack_from("<I", raw)
            rows = np.frombuffer(raw, _ROW, count, 4)
            at = 4 + rows.nbytes
            for doc, tie, null, size in rows.tolist():
                made.append(make(None if null else doc, raw[at : at + size], merged(spans.get((doc, tie), []))))
                at += size
        return pa.table([pa.array([m[k] for m in made], f.type) for k, f in enumerate(out)], schema=out)

    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(join, ddl)
