"""Digests whose state can be handed on, so that one stream can be digested by several tasks in turn.

hashlib can't do this. OpenSSL, which hashlib stands on, holds a digest's whole state in a plain structure without
pointers; its bytes are the state. Tasks must run on machines of one kind."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

import pyarrow as pa

#: OpenSSL's name, bytes of its structure (openssl/md5.h, openssl/sha.h)
KINDS = {"md5": ("MD5", 92), "sha1": ("SHA1", 96), "sha256": ("SHA256", 112), "sha512": ("SHA512", 216)}


@cache
def _calls(kind: str) -> tuple:
    import _hashlib

    name, library = KINDS[kind][0], ctypes.CDLL(_hashlib.__file__)  # looks in what hashlib is linked with, too
    begin, update, end = (getattr(library, f"{name}_{x}") for x in ("Init", "Update", "Final"))
    begin.argtypes, update.argtypes, end.argtypes = [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t], [ctypes.c_void_p, ctypes.c_void_p]
    return begin, update, end


class Digest:
    def __init__(self, kind: str, state: bytes | None = None):
        self.kind = kind
        begin, self._update, self._end = _calls(kind)
        self._held = ctypes.create_string_buffer(state or b"", KINDS[kind][1])
        if state is None:
            begin(self._held)

    def update(self, data: pa.Buffer) -> None:
        if data.size:
            self._update(self._held, data.address, data.size)

    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        held, out = ctypes.create_string_buffer(self.state(), len(self._held)), ctypes.create_string_buffer(hashlib.new(self.kind).digest_size)
        self._end(out, held)
        return out.raw.hex()


@cache
def handed_on(kind: str) -> bool:
    """Whether states can be handed on here: OpenSSL is there, and a digest taken up again is hashlib's."""
    try:
        first = Digest(kind)
        first.update(pa.py_buffer(bytes(range(200))))
        second = Digest(kind, first.state())
        second.update(pa.py_buffer(b"x" * 300))
        return second.hexdigest() == hashlib.new(kind, bytes(range(200)) + b"x" * 300).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False
