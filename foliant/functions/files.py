"""Whole PDF files: reading to events and decoded objects, and writing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from foliant.functions import filters
from foliant.functions.objects import BLANK, Malformed, Value, get, name_of, num, number_of, parse, ref, skip, write

_VERSION = re.compile(rb"%PDF-(\d+)\.(\d+)[ \n\r\t]*")
_LINE = re.compile(rb"%([^\r\n]*)(\r\n|\r|\n)")
_OBJECT = re.compile(rb"[\t-\r\x1c-\x20]*(\d+) (\d+) obj")
_STARTXREF = re.compile(rb"startxref" + BLANK.pattern + rb"(\d+)" + BLANK.pattern + rb"%%EOF")
_ENTRY = re.compile(rb"(.{10}) (.{5}) ([nf])(?: \n|\r\n)", re.S)
_END = re.compile(BLANK.pattern + rb"endstream" + BLANK.pattern + rb"endobj" + BLANK.pattern)
_ENDOBJ = re.compile(rb"endobj" + BLANK.pattern)

#: The header that is written by default, with its marker of four bytes over 127.
HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"


@dataclass
class Event:
    """kind: version, comment, object, stream, xref, startxref, error, end."""

    kind: str
    number: int | None = None
    generation: int | None = None
    value: Value | None = None
    payload: bytes | None = None
    at: int = 0
    text: str | None = None
    tables: list = field(default_factory=list)


def _xref(data: bytes, at: int) -> tuple[list, Value, int, int] | None:
    """(tables, trailer, startxref, end) of a textual cross-reference section; None if it isn't whole."""
    at = BLANK.match(data, at + 4).end()
    tables = []
    while not data.startswith(b"trailer", at):
        line = re.compile(rb"(\d+)[\t-\r\x1c-\x20]+(\d+)(?:\r\n|\r|\n)").match(data, at)
        if not line:
            return None
        at, entries = line.end(), []
        for _ in range(int(line[2])):
            m = _ENTRY.match(data, at)
            if not m:
                return None
            entries.append((m[1].decode("latin-1"), m[2].decode("latin-1"), m[3] == b"n", None, None))
            at = m.end()
        if not entries:
            return None
        tables.append((int(line[1]), entries))
        at = skip(data, at)
    if not tables:
        return None
    try:
        trailer, at = parse(data, BLANK.match(data, at + 7).end())
    except Malformed:
        return None
    m = _STARTXREF.match(data, BLANK.match(data, at).end())
    if trailer[0] != "dict" or not m:
        return None
    return tables, trailer, int(m[1]), BLANK.match(data, m.end()).end()


def events(data: bytes, inline_max: int = 256 << 10, resolve_length: bool = False, at: int = 0, whole: bool = True) -> Iterator[Event]:
    """Events of a file in order. Bytes that begin no event end the reading silently, as those of a file
    that goes on elsewhere would; the last event, "end", tells where that was. A payload over inline_max
    that is cut off, or an object whose end is missing, is an error event."""
    n = len(data)
    lengths: dict[int, int] = {}
    if resolve_length:
        lengths = {int(m[1]): int(m[2]) for m in re.finditer(rb"(?:^|[\r\n])(\d+) 0 obj[\t-\r\x1c-\x20]*(\d+)[\t-\r\x1c-\x20]*endobj", data)}
    while at < n:
        c = data[at]
        if c in b" \n\r\t":
            at += 1
            continue
        if c == 0x25 and (m := _VERSION.match(data, at)):
            end, marker = m.end(), None
            if data[end : end + 1] == b"%" and data[end + 1 : end + 2] != b"%":
                line = _LINE.match(data, end)
                if not line:
                    break
                end, marker = line.end(), line[1]
            yield Event("version", int(m[1]), int(m[2]), payload=marker, at=at)
            at = end
        elif c == 0x25 and data[at + 1 : at + 2] != b"%":
            line = _LINE.match(data, at)
            if not line:
                break
            yield Event("comment", payload=line[1], at=at)
            at = line.end()
        elif data.startswith(b"xref", at):
            found = _xref(data, at)
            if not found:
                break
            yield Event("xref", value=found[1], at=at, tables=found[0], text=str(found[2]))
            at = found[3]
        elif m := _STARTXREF.match(data, at):
            yield Event("startxref", at=at, text=m[1].decode())
            at = BLANK.match(data, m.end()).end()
        elif m := _OBJECT.match(data, at):
            number, generation = int(m[1]), int(m[2])
            try:
                value, end = parse(data, BLANK.match(data, m.end()).end())
            except Malformed:
                break
            end = BLANK.match(data, end).end()
            start = re.compile(rb"stream(\r\n|\n)").match(data, end)
            if not start:
                m = _ENDOBJ.match(data, end)
                if not m:
                    if whole and n - end >= 6:
                        yield Event("error", number, generation, text="endobj missing", at=end)
                    break
                yield Event("object", number, generation, value, at=at)
                at = m.end()
                continue
            length = number_of(get(value, "Length"))
            if length is None and resolve_length and (r := get(value, "Length")) and r[0] == "ref":
                length = lengths.get(r[1][0])
            if length is None:
                break
            begin = start.end()
            m = _END.match(data, begin + length) if begin + length <= n else None
            if not m and (whole or begin + length <= n) and length <= inline_max:
                # the length is wrong: the payload goes as far as endstream, but for a line end before it
                found = data.find(b"endstream", begin)
                if found >= 0 and (m := _END.match(data, found)):
                    length = found - begin
                    line = re.compile(rb"\r?\n").search(data, max(begin, found - 2), found)
                    if line and line.end() == found:
                        length = line.start() - begin
            if not m:
                if begin + length > n:
                    if length > inline_max and whole:
                        yield Event("error", number, generation, text="file ends inside a stream", at=begin)
                elif whole and n - begin - length >= 16:
                    yield Event("error", number, generation, text="endstream missing", at=begin + length)
                break
            yield Event("stream", number, generation, value, data[begin : begin + length], at=at)
            at = m.end()
        else:
            break
    yield Event("end", at=at, text=str(n - at))


def without_repeats(stream: Iterator[Event]) -> Iterator[Event]:
    """Of objects with one number before the first cross-reference section, the first alone."""
    seen: set[int] | None = set()
    for e in stream:
        if e.kind in ("xref", "startxref"):
            seen = None
        elif seen is not None and e.kind in ("object", "stream") and e.number <= 0x7FFFFFFF:
            if e.number in seen:
                continue
            seen.add(e.number)
        yield e


def packed_objects(header: Value, data: bytes) -> list[tuple[int, Value]]:
    """(number, value) of the objects in an object stream: a list of numbers and offsets, then values."""
    pairs = re.compile(rb"[\t-\r\x1c-\x20]*(\d+)[\t-\r\x1c-\x20]+(\d+)")
    count = number_of(get(header, "N"))
    at, numbers = 0, []
    while (m := pairs.match(data, at)) and (count is None or len(numbers) < count):
        numbers.append(int(m[1]))
        at = m.end()
    out = []
    for n in numbers:
        value, at = parse(data, at)
        out.append((n, value))
    return out


def xref_stream(header: Value, data: bytes) -> list[tuple[int, list]]:
    """Tables of a cross-reference stream, in the order of its index. A width of 0 for the kind means kind 1."""
    def numbers(key: str) -> list[int] | None:
        v = get(header, key)
        return [number_of(x) for x in v[1]] if v is not None and v[0] == "array" else None

    widths, size = numbers("W"), number_of(get(header, "Size"))
    index = numbers("Index") or [0, size or 0]
    if not widths or len(widths) != 3 or None in widths or len(index) % 2:
        raise Malformed("cross-reference stream without widths")
    total = sum(index[1::2])
    if total * sum(widths) != len(data):
        raise Malformed(f"cross-reference stream of {len(data)} bytes for {total} entries")
    out, at = [], 0
    for first, count in zip(index[::2], index[1::2], strict=True):
        entries = []
        for _ in range(count):
            f = []
            for w in widths:
                f.append(int.from_bytes(data[at : at + w], "big") if w else None)
                at += w
            kind, a, b = 1 if f[0] is None else f[0], f[1] or 0, f[2] or 0
            if kind == 2:
                entries.append((None, None, True, a, b))
            else:
                entries.append((f"{a:010d}", f"{b:05d}", kind == 1, None, None))
        out.append((first, entries))
    return out


#: Keys of a cross-reference stream that say how it is stored.
STORAGE_KEYS = ("W", "Index", "Filter", "Length", "Type", "Size", "Prev")


@dataclass
class Decoded:
    objects: list[tuple[int, int, Value, bytes | None]]  # number, generation, value, raw payload
    xrefs: list[tuple[list, Value, int | None]]  # tables, trailer, size
    version: str | None
    trailer: Value | None
    size: int | None
    root: int | None
    unparsed: int
    error: str | None


def decode(data: bytes, **options) -> Decoded:
    """Objects with those of object streams, cross-reference sections textual and in streams, and the
    merged trailer: greatest size, later entries win, the root of the first section."""
    objects, textual, inner, version, error, unparsed = [], [], [], None, None, 0
    for e in without_repeats(events(data, **options)):
        if e.kind == "version":
            version = version or f"{e.number}.{e.generation}"
        elif e.kind == "xref":
            textual.append((e.tables, e.value, number_of(get(e.value, "Size"))))
        elif e.kind == "object":
            objects.append((e.number, e.generation, e.value, None))
        elif e.kind == "error":
            error = e.text
        elif e.kind == "end":
            unparsed = len(data) - e.at
        elif e.kind == "stream":
            kind = name_of(get(e.value, "Type"))
            try:
                if kind == "ObjStm":
                    objects += [(n, 0, v, None) for n, v in packed_objects(e.value, filters.decoded(e.value, e.payload))]
                elif kind == "XRef":
                    tables = xref_stream(e.value, filters.decoded(e.value, e.payload))
                    inner.append((tables, ("dict", {k: v for k, v in e.value[1].items() if k not in STORAGE_KEYS}), number_of(get(e.value, "Size"))))
                else:
                    objects.append((e.number, e.generation, e.value, e.payload))
            except Malformed as problem:
                error = f"object {e.number}: {problem}"
                break
    xrefs = textual + inner
    trailer, size, root = None, None, None
    if xrefs:
        entries: dict[str, Value] = {}
        for _, t, _ in xrefs:
            entries |= t[1]
        trailer = ("dict", {k: v for k, v in entries.items() if k not in ("Prev", "DecodeParms")})
        size = max((s for *_, s in xrefs if s is not None), default=None)
        first = get(xrefs[0][1], "Root")
        root = first[1][0] if first is not None and first[0] == "ref" else None
    return Decoded(objects, xrefs, version, trailer, size, root, unparsed, error)


def object_bytes(number: int, generation: int, value: Value, payload: bytes | None) -> bytes:
    if payload is None:
        return b"%d %d obj\n%s\nendobj\n" % (number, generation, write(value))
    value = ("dict", {**value[1], "Length": num(len(payload))})
    return b"%d %d obj\n%s\nstream\n%s\nendstream\nendobj\n" % (number, generation, write(value), payload)


def xref_bytes(places: dict[int, tuple[int, int]], trailer: Value, startxref: int) -> bytes:
    """The cross-reference section for {number: (offset, generation)}. Numbers that no object has are free."""
    top = max(places)
    free = [n for n in range(top + 1) if n not in places]
    following = dict(zip(free, [*free[1:], 0], strict=True))
    lines = [b"xref\n0 %d\n" % (top + 1)]
    for n in range(top + 1):
        lines.append(b"%010d %05d n \n" % places[n] if n in places else b"%010d %05d f \n" % (following[n], 65535 if n == 0 else 0))
    trailer = ("dict", {**trailer[1], "Size": num(top + 1)})
    return b"".join(lines) + b"trailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (write(trailer), startxref)


def build(objects: list[tuple[int, int, Value, bytes | None]], trailer: Value, header: bytes = HEADER) -> bytes:
    """A file of the given objects; of those with one number the last counts in the cross-reference section."""
    out, at, places = [header], len(header), {}
    for number, generation, value, payload in objects:
        raw = object_bytes(number, generation, value, payload)
        places[number] = (at, generation)
        out.append(raw)
        at += len(raw)
    return b"".join(out) + xref_bytes(places, trailer, at)


def linearization(length: int, first_object: int, first_end: int, pages: int, main_xref: int, hints: tuple[int, int] = (0, 0)) -> Value:
    """The dictionary at the start of a linearised file."""
    return ("dict", {"Linearized": num(1), "L": num(length), "H": ("array", [num(hints[0]), num(hints[1])]), "O": num(first_object), "E": num(first_end), "N": num(pages), "T": num(main_xref)})


def tiff_header(width: int, height: int, size: int, group: int) -> bytes:
    """A little-endian TIFF header for one strip of CCITT fax data: eight entries and no further directory."""
    import struct

    entries = [(256, 4, width), (257, 4, height), (258, 3, 1), (259, 3, group), (262, 3, 0), (273, 4, 8 + 2 + 8 * 12 + 4), (278, 4, height), (279, 4, size)]
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)


def simple_page(content: bytes, number_of_pages: int = 1, extra: dict[str, Value] | None = None, catalog: dict[str, Value] | None = None, font: str = "Helvetica") -> list[tuple[int, int, Value, bytes | None]]:
    """Objects of a file with one page that shows the given content."""
    page = {"Type": ("name", "Page"), "Parent": ref(2), "MediaBox": ("array", [num(0), num(0), num(612), num(792)]), "Contents": ("array", [ref(4)]), **(extra or {})}
    return [
        (1, 0, ("dict", {"Type": ("name", "Catalog"), "Pages": ref(2), **(catalog or {})}), None),
        (2, 0, ("dict", {"Type": ("name", "Pages"), "Kids": ("array", [ref(3)]), "Count": num(number_of_pages)}), None),
        (3, 0, ("dict", page), None),
        (4, 0, ("dict", {"Length": num(len(content))}), content),
        (5, 0, ("dict", {"Type": ("name", "Font"), "Subtype": ("name", "Type1"), "BaseFont": ("name", font)}), None),
    ]
