"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Documents are tokenised once; only (id, piece, start, length, checksum) goes on. Pieces are dealt to
partitions, each packed by best-fit decreasing. Dual feasible functions give a lower bound of each
partition's number of sequences. Where the packing meets its bound it is final but for the emptiest
sequence, in which rounding loses up to one sequence a partition; where it doesn't, its sequences
are opened: all of them in the first three rounds, later those with room. Opened pieces are exchanged, that
is dealt anew to fewer and larger partitions and packed again, until each partition meets its bound, one has
taken all that is left, or a round at the largest size certifies nothing more.

Nulls: a null text counts as empty and still has its end token. A null id is kept as it is. Repeated
rows are packed like any others. Any length of text; documents longer than a sequence are cut.
Columns other than the id and the text are not read. An empty table gives no rows."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import cut, hold, map_batches, pieces_for, texts_of

#: Text of these characters alone needs no normaliser but lower(): all are composed, and letters below
#: U+0130 have lower cases of one letter that don't depend on what follows.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-į]*")


MOST_WORDS = 500_000  # remembered
PORTION = 1 << 18  # characters of texts whose words are looked up together


class PackedTokenizer:
    """Whole texts to packed ids. The tokenizer works on words that its own pattern splits off, so
    words can be remembered; texts with other than plain characters go through it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words: dict[str, bytes] = {}
        kinds = {k: "".join(re.escape(chr(i)) for i in range(0x130) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+").findall

    def learn(self, words: list[str]) -> None:
        """Words that the pattern splits off are encoded in one text, as each would be alone."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            cuts = (4 * np.searchsorted(word, np.arange(len(part) + 1))).tolist()
            if len(word) and word[-1] == len(part) - 1:
                self.words.update(zip(part, (ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
            else:  # a word came apart
                for w, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.words[w] = struct.pack(f"<{len(x.ids)}I", *x.ids)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Words new to several texts are
        encoded together."""
        split = [self.find(t.lower()) if PLAIN.fullmatch(t) else None for t in texts]
        new = set().union(*filter(None, split)).difference(self.words)
        if new:
            if len(self.words) + len(new) > MOST_WORDS:
                self.words.clear()
                new = set().union(*filter(None, split))
            self.learn(list(new))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join(map(self.words.__getitem__, words)))
        return out


@lru_cache(maxsize=1)
def packed_tokenizer(path: str) -> PackedTokenizer:
    return PackedTokenizer(path)


def portions(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and its end id, cut where longer than capacity."""
    end = struct.pack("<I", end_id)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hold("packing", packed_tokenizer.cache_clear)
        t = packed_tokenizer(tokenizer)
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(ids for part in portions(texts_of(batch.column(1))) for ids in t.packed(part)):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    source = docs.select(id_col, text_col)
    return map_batches(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs at least: the best of the dual feasible functions which, for a
    parameter a up to half the capacity, count items over capacity - a as whole bins, drop items under
    a and leave the others as they are; and of those that round items to multiples of capacity / k."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * size)
    a = np.arange(0, capacity // 2 + 1)
    large = count[-1] - count[capacity - a]
    middle = total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):  # x -> floor((k + 1) x) / k where that isn't whole, in 1 / k of a bin
        whole = (k + 1) * size % capacity == 0
        weight = np.where(whole, k * size / capacity, (k + 1) * size // capacity)
        best = max(best, int(np.ceil((n * weight).sum() / k - 1e-9)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, room left in each bin). The fullest bin with enough room
    is found in a bit set of the rooms that occur."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = there >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                there &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = rooms[b] = room - need
        by_room[left].append(b)
        there |= 1 << left
    return bins, offsets, np.array(rooms, np.int64)


ROW = "__packed_row"


def dealt(items: DataFrame, salt: int, parts: int) -> DataFrame:
    return items.withColumn("__part", F.pmod(F.xxhash64(ROW, F.lit(salt)), F.lit(parts)))


def packer(names: list[str], length_col: str, capacity: int, salt: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition; what its bound doesn't certify is not settled, unless this round is the last."""

    def one(group: pa.Table) -> pa.Table:
        part = group.column("__part")[0].as_py()
        lengths = group.column(length_col).to_numpy()
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        if last:
            opened = np.zeros(len(rooms), bool)
        elif len(rooms) <= lower_bound(lengths, capacity):
            opened = np.arange(len(rooms)) == int(rooms.argmax())
        else:
            opened = np.ones(len(rooms), bool) if salt < 3 else rooms > 0
        columns = [group.column(c) for c in names]
        return pa.table([*columns, pa.array((salt << 56) + (part << 32) + bins), pa.array(offsets), pa.array(~opened[bins])], [*names, "sequence_id", "offset", "settled"])

    return one


def pack(items: DataFrame, capacity: int, length_col: str = "length", per_partition: int = 8000, widest: int = 64000) -> DataFrame:
    """items with sequence_id and offset. Rows are dealt by a number of their own, so that equal rows and null
    ids spread; partitions grow up to `widest` items. Rounds end when nothing is left open, when one partition
    has taken all that is, or when a round at the widest settles nothing more."""
    schema = items.schema
    names = [*schema.names, ROW]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {ROW} long, sequence_id long, offset long, settled boolean"
    rest, done = cut(items.withColumn(ROW, F.monotonically_increasing_id())), []  # of the stored rows, so that it stays
    left = rest.count()
    parts, stuck, r = pieces_for(left, per_partition), False, 0
    while True:
        last = parts == 1 or stuck or r == 100
        packed = cut(dealt(rest, r, parts).groupBy("__part").applyInArrow(packer(names, length_col, capacity, r, last), out))
        done.append(packed.where("settled").drop("settled", ROW))
        if last:
            break
        rest, before = packed.where("not settled").select(*names), left
        left = rest.count()
        if not left:
            break
        stuck = left == before and parts <= pieces_for(left, widest)
        parts = max(pieces_for(left, widest), min(pieces_for(left, per_partition), parts // 2))
        r += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
