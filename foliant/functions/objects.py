"""PDF values: parsing, writing, and their JSON form.

A value is a pair (kind, data): ("null", None), ("bool", b), ("num", text), ("name", text),
("str", raw bytes), ("hex", digit bytes), ("ref", (number, generation)), ("array", list of values),
("dict", dict of values in order). Numbers keep their text, strings their escapes, as nothing may be
lost between reading and writing.

In JSON, arrays, dictionaries, booleans and null are themselves, and other values are strings whose
first character tells the kind: "/" a name, "#" a number, "@" a reference ("@5 0"), "(" a string and
"<" a hexadecimal string, both in hexadecimal."""

from __future__ import annotations

import json
import re

Value = tuple

NULL: Value = ("null", None)
SPACE = re.compile(rb"[\t-\r\x1c-\x20]*")
BLANK = re.compile(rb"(?:[\t-\r\x1c-\x20]|%[^\r\n]*(?:\r\n|\r|\n))*")  # white space and comments
_TOKEN = re.compile(rb"(?P<name>/[^/<>\[\]( \r\n]*)|(?P<ref>\d+ \d+ R)|(?P<num>-?\d+(?:\.\d+)?)|(?P<word>null|true|false)|(?P<dict><<)|(?P<hex><[0-9a-fA-F]*>)|(?P<array>\[)|(?P<str>\()")
_PAREN = re.compile(rb"[^\\()]+|\\.?|[()]", re.S)


class Malformed(Exception):
    """Bytes that are no value; `short`: more bytes might make them one."""

    def __init__(self, message: str, short: bool = False):
        super().__init__(message)
        self.short = short


def skip(data: bytes, at: int) -> int:
    return SPACE.match(data, at).end()


def parse(data: bytes, at: int = 0) -> tuple[Value, int]:
    """The value at a place, and where it ends. Nesting is kept on a stack, not in recursion."""
    stack: list[tuple[str, object, str | None]] = []
    while True:
        at = skip(data, at)
        if stack:
            kind, items, key = stack[-1]
            if kind == "array" and data.startswith(b"]", at):
                stack.pop()
                value, at = ("array", items), at + 1
            elif kind == "dict" and key is None:
                if data.startswith(b">>", at):
                    stack.pop()
                    value, at = ("dict", items), at + 2
                else:
                    m = _TOKEN.match(data, at)
                    if not m or m.lastgroup != "name":
                        raise Malformed(f"no key at {at}", at >= len(data) - 1)
                    stack[-1] = (kind, items, m.group()[1:].decode("latin-1"))
                    at = m.end()
                    continue
            else:
                value = None
        else:
            value = None
        if value is None:
            m = _TOKEN.match(data, at)
            if not m:
                raise Malformed(f"no value at {at}", at >= len(data) - 1)
            kind, at = m.lastgroup, m.end()
            text = m.group()
            if kind in ("dict", "array"):
                stack.append((kind, {} if kind == "dict" else [], None))
                continue
            if kind == "name":
                value = ("name", text[1:].decode("latin-1"))
            elif kind == "ref":
                n, g, _ = text.split(b" ")
                value = ("ref", (int(n), int(g)))
            elif kind == "num":
                value = ("num", text.decode())
            elif kind == "word":
                value = NULL if text == b"null" else ("bool", text == b"true")
            elif kind == "hex":
                value = ("hex", text[1:-1])
            else:
                depth, start = 0, at
                for m in _PAREN.finditer(data, at):
                    c = m.group()
                    if c == b"(":
                        depth += 1
                    elif c == b")":
                        if not depth:
                            break
                        depth -= 1
                else:
                    raise Malformed(f"string without end at {start}", True)
                value, at = ("str", data[start : m.start()]), m.end()
        if not stack:
            return value, skip(data, at) if value[0] in ("name", "array", "dict") else at
        kind, items, key = stack[-1]
        if kind == "array":
            items.append(value)
        else:
            items[key] = value
            stack[-1] = (kind, items, None)


def write(value: Value) -> bytes:
    kind, x = value
    if kind == "null":
        return b"null"
    if kind == "bool":
        return b"true" if x else b"false"
    if kind == "num":
        return x.encode()
    if kind == "name":
        return b"/" + x.encode("latin-1")
    if kind == "ref":
        return b"%d %d R" % x
    if kind == "str":
        return b"(" + x + b")"
    if kind == "hex":
        return b"<" + x + b">"
    if kind == "array":
        return b"[" + b" ".join(map(write, x)) + b"]"
    return b"<<" + b" ".join(b"/" + k.encode("latin-1") + b" " + write(v) for k, v in x.items()) + b">>"


def _plain(value: Value) -> object:
    kind, x = value
    if kind in ("null", "bool"):
        return x
    if kind == "name":
        return "/" + x
    if kind == "num":
        return "#" + x
    if kind == "ref":
        return "@%d %d" % x
    if kind in ("str", "hex"):
        return ("(" if kind == "str" else "<") + x.hex()
    if kind == "array":
        return [_plain(v) for v in x]
    return {k: _plain(v) for k, v in x.items()}


def _value(x: object) -> Value:
    if x is None:
        return NULL
    if isinstance(x, bool):
        return ("bool", x)
    if isinstance(x, list):
        return ("array", [_value(v) for v in x])
    if isinstance(x, dict):
        return ("dict", {k: _value(v) for k, v in x.items()})
    tag, rest = x[:1], x[1:]
    if tag == "/":
        return ("name", rest)
    if tag == "#":
        return ("num", rest)
    if tag == "@":
        n, g = rest.split()
        return ("ref", (int(n), int(g)))
    if tag in "(<":
        return ("str" if tag == "(" else "hex", bytes.fromhex(rest))
    raise Malformed(f"no value: {x[:20]}")


def to_json(value: Value) -> str:
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> Value:
    return _value(json.loads(text))


def get(value: Value, *path: str) -> Value | None:
    """The value under a path of keys, or None."""
    for key in path:
        if value is None or value[0] != "dict":
            return None
        value = value[1].get(key)
    return value


def name_of(value: Value | None) -> str | None:
    return value[1] if value is not None and value[0] == "name" else None


def number_of(value: Value | None) -> int | None:
    return int(float(value[1])) if value is not None and value[0] == "num" else None


def name(x: str) -> Value:
    return ("name", x)


def num(x: object) -> Value:
    return ("num", str(x))


def ref(n: int, g: int = 0) -> Value:
    return ("ref", (n, g))


def array(*items: Value) -> Value:
    return ("array", list(items))


def dictionary(**items: Value) -> Value:
    return ("dict", items)


def text(x: bytes) -> Value:
    """A literal string that reads back as x in a page's content: parentheses and backslashes get a backslash."""
    return ("str", x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)"))


def updated(value: Value, **items: Value) -> Value:
    return ("dict", {**(value[1] if value[0] == "dict" else {}), **items})


def merged(old: Value, new: Value) -> Value:
    """new laid over old: dictionaries key by key; to an array others are appended, arrays element by element.
    Anything else that meets under one key can't be merged."""
    if old[0] == new[0] == "dict":
        return ("dict", {**old[1], **{k: merged(old[1][k], v) if k in old[1] else v for k, v in new[1].items()}})
    if old[0] == "array":
        return ("array", [*old[1], *(new[1] if new[0] == "array" else [new])])
    raise Malformed(f"can't merge {new[0]} into {old[0]}")


def collected_references(value: Value, *path: str) -> list[int] | None:
    """Numbers of the references in the array under a path; None where there is no array."""
    held = get(value, *path)
    return [v[1][0] for v in held[1] if v[0] == "ref"] if held is not None and held[0] == "array" else None


def numbers_at(value: Value, *path: str) -> list[float] | None:
    """The numbers in the array under a path; None where there is no array, or one with other elements."""
    held = get(value, *path)
    return [float(v[1]) for v in held[1]] if held is not None and held[0] == "array" and all(v[0] == "num" for v in held[1]) else None


def contains_name(value: Value, key: str, wanted: str) -> bool:
    """Whether a name, or one of an array, under the key is this one."""
    held = get(value, key)
    return held is not None and ("name", wanted) in (held[1] if held[0] == "array" else [held])


def is_type(value: Value, wanted: str) -> bool:
    return name_of(get(value, "Type")) == wanted


def with_element(value: Value, key: str, element: Value) -> Value:
    """The dictionary with one more element in the array under the key. A reference there becomes the first
    element; anything else is replaced."""
    held = get(value, key)
    before = held[1] if held is not None and held[0] == "array" else [held] if held is not None and held[0] == "ref" else []
    return updated(value, **{key: ("array", [*before, element])})


def with_entry(value: Value, key: str, inner: str, element: Value) -> Value:
    """The dictionary with an entry more in the one under the key; anything else there is replaced."""
    held = get(value, key)
    return updated(value, **{key: updated(held if held is not None else NULL, **{inner: element})})


def nodes(value: Value) -> list[tuple]:
    """(node, parent, key, place, kind, text, action, parent_key, parent_action) of all values within one,
    in order of reading.

    text: a scalar as in JSON, without its tag. action: OpenAction, AA or A, if the value stands under
    that key, or in an array there; else None."""
    out: list[tuple] = []
    stack = [(value, -1, None, 0, None, None, None)]
    while stack:
        v, parent, key, place, action, parent_key, parent_action = stack.pop()
        if key in ("OpenAction", "AA", "A"):
            action = key
        n = len(out)
        kind, x = v
        plain = None if kind in ("array", "dict", "null") else str(x).lower() if kind == "bool" else "%d %d" % x if kind == "ref" else x.hex() if kind in ("str", "hex") else x
        out.append((n, parent, key, place, kind, plain, action, parent_key, parent_action))
        if kind == "array":
            stack += [(w, n, None, i, action, key, None) for i, w in reversed(list(enumerate(x)))]
        elif kind == "dict":
            stack += [(w, n, k, i, None, key, action) for i, (k, w) in reversed(list(enumerate(x.items())))]
    return out
