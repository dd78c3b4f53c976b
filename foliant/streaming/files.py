"""Streams of files, and of files that come in chunks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from foliant.functions import files
from foliant.functions.objects import to_json

CHUNK_EVENTS = "file_id string, seq long, kind string, obj_num long, gen int, prim_json string, payload binary, error string"


def whole_events(carry: bytes, done: bool) -> tuple[list[files.Event], bytes]:
    """Events that are whole in the bytes so far, and the bytes to wait for more with. Near the end of
    what has come nothing counts as whole, so that how a file is cut into chunks doesn't matter: an event
    is given only if another one, or the end of the file, follows it."""
    found = list(files.events(carry, whole=done))
    end = found.pop()
    if done:
        return found, carry[end.at :]
    held = found.pop() if found else None
    return found, carry[held.at if held else end.at :]


def chunked_events(chunks: DataFrame, most_carry: int = 64 << 20) -> DataFrame:
    """Parse events of a stream of rows (file_id string, chunk_no long, bytes binary, last boolean), chunks
    of a file in order of chunk_no. The bytes of an unfinished event are state, at most most_carry of
    them: beyond that the file ends with an error. The last chunk clears the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        carry, seq, seen, open_ = state.get if state.exists else (b"", 0, [], True)
        numbers = set(seen)
        rows = pd.concat(list(parts)).sort_values("chunk_no")
        done = bool(rows["last"].any())
        carry = bytes(carry) + b"".join(bytes(b) for b in rows["bytes"] if b is not None)
        found, carry = whole_events(carry, done)
        out = []

        def add(kind: str, e: files.Event | None = None, error: str | None = None) -> None:
            nonlocal seq
            out.append((key[0], seq, kind, e and e.number, e and e.generation, e and e.value and to_json(e.value), e and e.payload, error))
            seq += 1

        for e in found:
            if e.kind in ("xref", "startxref"):
                open_ = False
            elif open_ and e.kind in ("object", "stream"):
                if e.number in numbers:
                    continue
                numbers.add(e.number)
            add(e.kind, e, e.text if e.kind == "error" else None)
        if done:
            add("end", None, f"{len(carry)} bytes unparsed" if carry else None)
            if state.exists:
                state.remove()
        elif len(carry) > most_carry:
            add("error", None, "an event is larger than the state may be")
            state.update((b"", seq, sorted(numbers), open_))
        else:
            state.update((carry, seq, sorted(numbers), open_))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_EVENTS.split(", ")])

    return chunks.groupBy("file_id").applyInPandasWithState(step, CHUNK_EVENTS, "carry binary, seq long, seen array<long>, open boolean", "append", "NoTimeout")
