"""Byte-level BPE as a lazily determinised finite-state transducer.

After any prefix of a piece, the encoding of that prefix ends in one token,
and a token may follow another one exactly if the merges leave the two alone
side by side.  So a state is the set of live token starts: for each, the place
in the trie of token bytes that it has reached and the last token before it.
Reading a byte moves every place, keeps the one token that ends here and may
follow, and opens a start behind it.  States and transitions are built when
first met (and forgotten when too many).  A token is certain, and leaves, as
soon as every live start agrees on it: no start lives longer than the longest
token, which bounds the lookahead.

Decoding maps ids to bytes; Utf8Stream turns bytes that arrive in any cuts
into text, with a state machine for the character that a cut splits.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

NONE, TOP = -1, 1 << 60
#: Transitions and pieces kept by a process at most; beyond that they are forgotten and built again.
KEEP_STEPS, KEEP_PIECES, KEEP_PAIRS = 300_000, 500_000, 400_000
#: Bytes of a piece after which what is certain leaves.
DRAIN = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pieces by the merges that ranks stand for: the pair of smallest rank first, the leftmost first among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.trie: dict[int, int] = {}
        self.up: list[int] = [0]
        self.ends: list[int] = [NONE]
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        for token, rank in ranks.items():
            node = 0
            for b in token:
                k, above = node << 8 | b, node
                node = self.trie.setdefault(k, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(NONE)
                    self.up.append(above)
            self.ends[node] = rank
        self.inner = [False] * len(self.ends)
        for above in self.up:
            self.inner[above] = True
        self._pairs: dict[int, bool] = {}
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._clear()

    def _clear(self) -> None:
        first = self._start(0, NONE).to_bytes(8, sys.byteorder)
        #: A state is a number, the root's is 0, and known by its live starts of 8 bytes each.
        self.states: dict[bytes, int] = {first: 0}
        self.live: list[bytes] = [first]
        #: From state << 8 | byte to the next state << 32 | the last token of the prefix.  Nothing but numbers and bytes: an object for each would take twice the memory.
        self.steps: dict[int, int] = {}

    @staticmethod
    def _start(node: int, last: int) -> int:
        """A live start as one number, as states are kept by the hundred thousand: its place in the trie, and the last token before it."""
        return node << 32 | last + 1

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: merge the pair of smallest rank until none or `stop` parts are left."""
        parts = [bytes([b]) for b in data]
        while len(parts) > stop:
            best = min((self.ranks.get(a + b, TOP), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == TOP:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's right and left edge while it is merged: (bytes, rank of the merge that absorbs it), from the byte up.

        None if the merges of its bytes don't end in the token.
        """
        if token not in self._spines:
            sides: tuple[list, list] | None = ([], [])
            data = self.tokens[token]
            if self.merged(data) != [data]:
                sides = None
            else:
                for side in (0, 1):
                    part, absorbed = data, TOP
                    while True:
                        sides[side].append((part, absorbed))
                        if len(part) == 1:
                            break
                        absorbed = self.ranks[part]
                        part = self.merged(part, 2)[1 - side]
                        if len(part) > 1 and self.ranks[part] > absorbed:
                            raise ValueError("a token has a lower rank than one of its parts")
                    sides[side].reverse()
            self._spines[token] = sides
        return self._spines[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge crosses the edge between two tokens while each of them is merged."""
        key = (last + 1) << 32 | token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > KEEP_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stand_apart(last, token)
        return known

    def _stand_apart(self, last: int, token: int) -> bool:
        right = self._spine(token)
        if right is None or last == NONE:
            return right is not None
        a, b, rank = self._spine(last)[0], right[1], self.ranks.get
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            across = rank(x + y, TOP)
            if across < x_end and (across <= y_end and across < TOP):
                return False
            if x_end == y_end == TOP:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def _starts(self, state: int) -> memoryview:
        return memoryview(self.live[state]).cast("Q")

    def _grow(self, state: int, byte: int) -> int:
        """The transition that is missing."""
        live, token = array("Q"), NONE
        for start in self._starts(state):
            to, last = self.trie.get(start >> 32 << 8 | byte), (start & 0xFFFFFFFF) - 1
            if to is None:
                continue
            end = self.ends[to]
            if token == NONE and end != NONE and self._may_follow(last, end):
                token = end
            if self.inner[to]:
                live.append(self._start(to, last))
        if token == NONE:
            raise ValueError("no token ends here")
        live.append(self._start(0, token))
        key = live.tobytes()
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.live)
            self.live.append(key)
        step = self.steps[state << 8 | byte] = to << 32 | token
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.steps) > KEEP_STEPS:
            self._clear()
        if not piece:
            return []
        out: list[int] = []
        path: list[int] = []  # transitions after what has left
        state, last, known = 0, piece[-1], self.steps.get
        for byte in piece[:-1]:
            step = known(state << 8 | byte)
            if step is None:
                step = self._grow(state, byte)
            state = step >> 32
            path.append(step)
            if len(path) >= DRAIN:
                out += self._drain(state, path)
        step = known(state << 8 | last)
        token = self._last(state, last) if step is None else step & 0xFFFFFFFF
        out += self._back(path, len(path) + 1 - len(self.tokens[token]))
        out.append(token)
        return out

    def _last(self, state: int, byte: int) -> int:
        """The token that ends with the last byte of a piece: no state is built behind it, as few pieces go on from there."""
        trie, ends = self.trie, self.ends
        for start in self._starts(state):
            to = trie.get(start >> 32 << 8 | byte)
            if to is not None and ends[to] != NONE and self._may_follow((start & 0xFFFFFFFF) - 1, ends[to]):
                return ends[to]
        raise ValueError("no token ends here")

    def _back(self, path: list[int], at: int) -> list[int]:
        ids = []
        while at > 0:
            token = path[at - 1] & 0xFFFFFFFF
            ids.append(token)
            at -= len(self.tokens[token])
        ids.reverse()
        return ids

    def _drain(self, state: int, path: list[int]) -> list[int]:
        """What all live starts agree on leaves the path."""
        reach = {len(path)}
        for start in self._starts(state)[:-1]:
            node, at = start >> 32, len(path)
            while node:
                node, at = self.up[node], at - 1
            reach.add(at)
        while len(reach) > 1:  # walk the furthest start back until all meet
            at = max(reach)
            reach.discard(at)
            reach.add(at - len(self.tokens[path[at - 1] & 0xFFFFFFFF]))
        meet = reach.pop()
        ids = self._back(path, meet)
        del path[:meet]
        return ids


class _Pieces(dict):
    """Packed ids of the pieces met before; a long piece is not kept."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """A vocabulary with the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.packed = _Pieces(self.machine).__getitem__
        self.bytes_of = [self.machine.tokens.get(i, b"") for i in range(max(self.machine.tokens) + 1)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens are ordinary text."""
        return b"".join(map(self.packed, self.split(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Utf8Stream:
    """Text of bytes that arrive in any cuts.  The state is the bytes of the open character and how many it lacks."""

    def __init__(self):
        self.open, self.lacks = b"", 0

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        """The range of the byte after a lead byte (no overlong forms, surrogates or values past 10FFFF)."""
        return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))

    def feed(self, data: bytes) -> str:
        """All characters that are whole by now; wrong bytes become U+FFFD as bytes.decode('replace') has it."""
        data = self.open + data
        self.open, self.lacks = b"", 0
        for back in range(1, min(3, len(data)) + 1):  # the last lead byte, if its character is open
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            tail, low_high = data[len(data) - back + 1 :], self._second(lead)
            if self._need(lead) >= back and (not tail or low_high[0] <= tail[0] <= low_high[1]):
                self.open, self.lacks = data[-back:], self._need(lead) + 1 - back
            break
        return data[: len(data) - len(self.open)].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open, self.lacks = self.open, b"", 0
        return rest.decode("utf-8", "replace")


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Encode every text, then decode its ids.

    path: a rank file on every executor (or shipped with addFile).  Returns
    doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded
    (text) and decoded_sha256 (of the decoded bytes) for each row, nulls in ids
    and decoded without keep.  A null or empty text has no ids.  Ids repeat
    with repeated rows, null ids stay null, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        was = gc.isenabled()
        gc.disable()  # a large cache of what lives on makes each collection slow, and nothing here refers to itself
        try:
            yield from coded(c, batches)
        finally:
            if was:
                gc.enable()

    def coded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for doc_id, body in rows_of(batches, "doc_id", "body", keep=True):
            ids = c.encode((body or b"").decode("utf-8", "replace"))
            sha, stream, texts = hashlib.sha256(), Utf8Stream(), []
            for at in range(0, len(ids), 1 << 18):
                part = c.decode(np.frombuffer(ids, "<u4", min(1 << 16, (len(ids) - at) // 4), at).tolist())
                sha.update(part)
                if keep:
                    texts.append(stream.feed(part))
            text = "".join([*texts, stream.finish()]) if keep else None
            held.append((doc_id, len(ids) // 4, ids if keep else None, hashlib.sha256(ids).hexdigest(), text, sha.hexdigest()))
            size += len(ids) * 2 * keep + 200
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    out = rows.mapInArrow(run, DDL)
    return out if keep else out.drop("ids", "decoded")
