"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A BPE vocabulary whose merges are applied by rank has one valid last token for each prefix of a
piece: the longest entry that ends there and stays apart from the token before it when the two are
merged again. So a piece can be read byte by byte. A transducer state is the token before the
undecided bytes and those bytes; reading a byte extends them, and as soon as every way to continue
shares a token boundary, the tokens up to it are emitted. Undecided bytes are bounded by the longest
vocabulary entry. States and arcs are made when first met and kept.

Nulls: a null text counts as empty. Empty texts give no ids. Repeated rows give equal rows. Texts may
be of any length. Columns other than the id and the text are not read."""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm._shared import map_batches, texts_of


class Transducer:
    """Piece bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.starts = {b[:k] for b in ranks for k in range(1, len(b))}
        self._apart: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.names: dict[tuple[int, bytes, tuple[int, ...]], int] = {}
        self.nodes: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = []
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._node(-1, b"", (), (1,), (0,))

    def _node(self, before: int, undecided: bytes, last: tuple[int, ...], paths: tuple[int, ...], live: tuple[int, ...]) -> int:
        if live and live[0]:
            before = -1  # no entry can begin at the first undecided byte any more: what stands before is of no account
        key = (before, undecided, last)
        if (n := self.names.get(key)) is None:
            n = self.names[key] = len(self.nodes)
            self.nodes.append((before, undecided, last, paths, live))
            self.arcs.append({})
        return n

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition: merge the adjacent pair of least rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token of one byte is both of its own."""
        known = self._halves.get(token)
        if known is None:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged again.

        They don't if, among the parts that meet at their boundary while both are being built, some
        pair merges before the step that consumes it. The parts are found by undoing the later merge
        of the two, again and again."""
        known = self._apart.get((left, right))
        if known is not None:
            return known
        l, r, until, known = left, right, 1 << 60, True
        while True:
            if self.ranks.get(self.bytes_of[l] + self.bytes_of[r], 1 << 60) < until:
                known = False
                break
            if len(self.bytes_of[l]) == 1 and len(self.bytes_of[r]) == 1:
                break
            if len(self.bytes_of[r]) == 1 or l > r and len(self.bytes_of[l]) > 1:
                l, until = self._split(l)[1], l
            else:
                r, until = self._split(r)[0], r + 1
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        self._apart[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, old, last, paths, live = self.nodes[state]
        now = old + bytes((byte,))
        n = len(now)
        found, start, still, ranks, starts = -2, 0, [], self.ranks, self.starts
        for j in live:  # where an entry that is still open may have begun, the longest first
            suffix = now[j:]
            if found < 0 and suffix in ranks and ((prev := last[j - 1] if j else before) < 0 or self._stay(prev, ranks[suffix])):
                found, start = ranks[suffix], j
            if suffix in starts:
                still.append(j)
        mask = paths[start] | 1 << n if found >= 0 else 0  # bit k: a boundary after k bytes
        shared = mask or -1
        for j in still:
            shared &= paths[j]
        at = max(shared.bit_length() - 1, 0)
        if mask:
            still.append(n)
        if not at:
            return self._node(before, now, (*last, found), (*paths, mask), tuple(still)), ()
        tokens, masks = (*last, found), (*paths, mask)
        out: list[int] = []
        k = at
        while k > 0:
            out.append(tokens[k - 1])
            k -= len(self.bytes_of[tokens[k - 1]])
        out.reverse()
        inside = [masks[k + 1] >> at & 1 for k in range(at, n)]
        return self._node(out[-1], now[at:], tuple(tokens[at + i] if x else -2 for i, x in enumerate(inside)), (1, *(masks[at + 1 + i] >> at if x else 0 for i, x in enumerate(inside))), tuple(j - at for j in still)), tuple(out)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(self.nodes) > self.max_states:
            self._reset()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs[state].get(byte)
            if arc is None:
                arc = arcs[state][byte] = self._step(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        _, undecided, last, _, _ = self.nodes[state]
        rest, k = [], len(undecided)
        while k > 0:
            rest.append(last[k - 1])
            k -= len(self.bytes_of[last[k - 1]])
        return (*out, *reversed(rest))


class Utf8Stream:
    """Text from bytes that come in any portions: an incremental UTF-8 automaton.

    State: how many continuation bytes are due, and the range the next one must lie in. Malformed
    sequences give U+FFFD for each maximal valid part, as the Unicode standard recommends."""

    def __init__(self) -> None:
        self.due, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, portion: bytes) -> str:
        if not self.due:
            try:
                return portion.decode("utf-8")  # nothing pending and nothing cut: the common case
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for b in portion:
            if self.due:
                if self.low <= b <= self.high:
                    self.value, self.due, self.low, self.high = self.value << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        return "�" if self.due else ""


class Codec:
    """Whole texts to ids and back. Pieces of up to 48 characters are remembered, 300,000 at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.vocabulary = self.fst.bytes_of
        self.decimal = {i: str(i) for i in self.vocabulary}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, fst = self.known, self.fst
        out: list[tuple[int, ...]] = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = fst.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 48:
                    if len(known) >= 300_000:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode_stream(self, portions: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text as far as it is complete after each portion of ids."""
        stream = Utf8Stream()
        for ids in portions:
            yield stream.feed(self.decode_bytes(ids))
        yield stream.close()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: the transducer's many small objects hold none, and scanning them again and
    again would be most of the cost. Other kernels of the worker are not concerned."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def map_uncollected(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with uncollected():
            return kernel(batch)

    return map_batches(df, run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text. vocabulary: path of a rank file on every executor."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.encode(t) for t in texts_of(batch.column(1))], pa.list_(pa.int32()))], [id_col, "ids"])

    source = docs.select(id_col, text_col)
    return map_uncollected(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", portion: int = 4096) -> DataFrame:
    """(id, text): ids decoded in portions through the UTF-8 automaton. A null list counts as empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        texts = ["".join(c.decode_stream(ids[i : i + portion] for i in range(0, len(ids), portion))) for ids in (x or [] for x in batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return map_uncollected(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", portion: int = 65536) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, decoded_chars): each text encoded, its ids decoded in portions."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        counts, ids_sha, text_sha, chars = [], [], [], []
        for text in texts_of(batch.column(1)):
            ids = c.encode(text)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            digest, n = hashlib.sha256(), 0
            for part in c.decode_stream(ids[i : i + portion] for i in range(0, len(ids), portion)):
                digest.update(part.encode("utf-8"))
                n += len(part)
            text_sha.append(digest.hexdigest())
            chars.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(chars, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    source = docs.select(id_col, text_col)
    return map_uncollected(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
