"""Page contents: tokens and text."""

from __future__ import annotations

import re
import unicodedata

_SKIP = re.compile(rb"(?:[ \n\r\t\f\x00]|%[^\n\r]*)*")
_WORD = re.compile(rb"[^ \n\r\t\f\x00/<>\[\](){}]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+(?:\.\d*)?|\.\d+)")
_STRAY = re.compile(rb"[)\]{}>]")
_ESCAPED_NAME = re.compile(r"#([0-9a-fA-F]{2})")
_JAVA_SPACE = "".join(map(chr, range(33)))


def tokens(data: bytes) -> list[tuple[str, object]]:
    """(kind, value): number, name, string, hex, array, dict, null, bool or op. A stray closing
    delimiter is passed over."""
    out: list[tuple[str, object]] = []
    stack: list[tuple[str, list]] = []
    at, n = _SKIP.match(data, 0).end(), len(data)
    while at < n:
        c = data[at : at + 1]
        token = None
        if stack and (stack[-1][0] == "array" and c == b"]" or stack[-1][0] == "dict" and data.startswith(b">>", at)):
            kind, items = stack.pop()
            at += 1 if kind == "array" else 2
            token = (kind, items) if kind == "array" else (kind, {items[i][1]: items[i + 1] for i in range(0, len(items) - 1, 2) if items[i][0] == "name"})
        elif c == b"[":
            stack.append(("array", []))
            at += 1
        elif data.startswith(b"<<", at):
            stack.append(("dict", []))
            at += 2
        elif c == b"(":
            depth, raw, at = 0, bytearray(), at + 1
            while at < n:
                b = data[at]
                if b == 0x5C:
                    raw += data[at + 1 : at + 2]  # the backslash goes, what follows stays
                    at += 2
                    continue
                at += 1
                if b == 0x29:
                    if not depth:
                        break
                    depth -= 1
                elif b == 0x28:
                    depth += 1
                raw.append(b)
            token = ("string", bytes(raw))
        elif c == b"<":
            end = data.find(b">", at)
            end = n if end < 0 else end
            digits = re.sub(rb"[^0-9a-fA-F]", b"", data[at + 1 : end])
            token, at = ("hex", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), end + 1
        elif c == b"/":
            m = _WORD.match(data, at + 1)
            end = m.end() if m else at + 1
            token, at = ("name", _ESCAPED_NAME.sub(lambda m: chr(int(m[1], 16)), data[at + 1 : end].decode("latin-1"))), end
        elif _STRAY.match(c):
            at += 1
        else:
            m = _NUMBER.match(data, at)
            if m:
                token, at = ("number", m.group().decode()), m.end()
            else:
                m = _WORD.match(data, at)
                word = m.group().decode("ascii", "replace")
                token, at = (("null", None) if word == "null" else ("bool", word == "true") if word in ("true", "false") else ("op", word)), m.end()
        if token is not None:
            (stack[-1][1] if stack else out).append(token)
        at = _SKIP.match(data, at).end()
    while stack:
        kind, items = stack.pop()
        (stack[-1][1] if stack else out).append((kind, items))
    return out


def printable(s: str) -> str:
    """A string for display: runs of line ends as one, other characters without a shape as question marks."""
    lines = re.split(r"[\r\n]+", s)
    return "\n".join("".join("?" if unicodedata.category(c)[0] == "C" else c for c in line) for line in lines)


def shown(token: tuple[str, object]) -> str:
    return token[1].decode("latin-1") if token[0] in ("string", "hex") else ""


def text(data: bytes) -> str:
    """The text that a page's content shows, lines and words parted by the operators that move."""
    buffer: list[str] = []
    end = ""

    def line() -> None:
        nonlocal end
        if buffer and end != "\n":
            buffer.append("\n")
            end = "\n"

    def emit(s: str) -> None:
        nonlocal end
        if s:
            if end and not end.isspace() and not s[0].isspace():
                buffer.append(" ")
            buffer.append(s)
            end = s[-1]

    operands: list[tuple[str, object]] = []
    for token in tokens(data):
        if token[0] != "op":
            operands.append(token)
            continue
        op = token[1]
        if op == "Tj" and operands:
            emit(shown(operands[-1]))
        elif op == "TJ" and operands and operands[-1][0] == "array":
            emit("".join(map(shown, operands[-1][1])))
        elif op in ("'", '"') and operands:
            line()
            emit(shown(operands[-1]))
        elif op in ("T*", "Tm"):
            line()
        elif op in ("Td", "TD") and operands and operands[-1][0] == "number" and float(operands[-1][1]) != 0:
            line()
        operands = []
    return "".join(buffer).strip(_JAVA_SPACE)
