"""Byte-level kernels: values, filters, chunking, contents, rows, files."""

import base64
import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from foliant.functions import contents, fastcdc, files, filters, rowcodec
from foliant.functions import objects as o
from foliant.streaming.files import whole_events

scalars = st.one_of(st.just(o.NULL), st.booleans().map(lambda b: ("bool", b)), st.integers(-(10**20), 10**20).map(o.num), st.sampled_from(["A", "Type", "x#20y", ""]).map(o.name), st.binary(max_size=8).map(o.text), st.binary(max_size=4).map(lambda b: ("hex", b.hex().encode())), st.tuples(st.integers(0, 99), st.integers(0, 9)).map(lambda r: ("ref", r)))
values = st.recursive(scalars, lambda v: st.one_of(st.lists(v, max_size=4).map(lambda x: ("array", x)), st.dictionaries(st.sampled_from(["B", "A", "Kids"]), v, max_size=3).map(lambda x: ("dict", x))), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_values_round_trip(v):
    assert o.parse(o.write(v) + b" ")[0] == v
    assert o.from_json(o.to_json(v)) == v


def test_values_keep_order_and_text():
    v, end = o.parse(b"<</Zeta 1.50/Alpha[1 0 R(a\\)b)<4F>]/N null>> rest")
    assert list(v[1]) == ["Zeta", "Alpha", "N"] and v[1]["Zeta"] == ("num", "1.50")
    assert v[1]["Alpha"][1] == [("ref", (1, 0)), ("str", b"a\\)b"), ("hex", b"4F")]
    with pytest.raises(o.Malformed):
        o.parse(b"<</A")
    assert o.merged(o.array(o.num(1)), o.array(o.num(2))) == o.array(o.num(1), o.num(2))
    assert o.merged(o.array(o.num(1)), o.num(2)) == o.array(o.num(1), o.num(2))
    assert o.merged(o.dictionary(A=o.dictionary(B=o.num(1))), o.dictionary(A=o.dictionary(C=o.num(2)))) == o.dictionary(A=o.dictionary(B=o.num(1), C=o.num(2)))
    for new in (o.num(2), o.dictionary()):
        with pytest.raises(o.Malformed):
            o.merged(o.num(1), new)


def test_accessors_and_updates():
    v = o.dictionary(Type=o.name("Page"), Kids=o.array(o.ref(4), o.num(1), o.ref(5)), Box=o.array(o.num(0), o.num("1.5")), One=o.ref(9))
    assert o.collected_references(v, "Kids") == [4, 5] and o.collected_references(v, "One") is None and o.collected_references(v, "No") is None
    assert o.numbers_at(v, "Box") == [0.0, 1.5] and o.numbers_at(v, "Kids") is None
    assert o.is_type(v, "Page") and o.contains_name(v, "Type", "Page") and not o.contains_name(v, "Kids", "Page")
    assert o.contains_name(o.dictionary(Filter=o.array(o.name("A"), o.name("B"))), "Filter", "B")
    assert o.get(o.with_element(v, "One", o.ref(1)), "One") == o.array(o.ref(9), o.ref(1))
    assert o.get(o.with_element(v, "New", o.ref(1)), "New") == o.array(o.ref(1))
    assert o.get(o.with_entry(o.with_entry(v, "R", "a", o.num(1)), "R", "b", o.num(2)), "R") == o.dictionary(a=o.num(1), b=o.num(2))
    assert contents.printable("a\r\n\nb\x00 c\t") == "a\nb? c?"


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 5, b"aaaa" * 300])
def test_filters_alone_and_chained(data):
    runs = b"".join(bytes((len(p) - 1,)) + p for p in (data[i : i + 128] for i in range(0, len(data), 128))) + b"\x80"
    cases = {"FlateDecode": zlib.compress(data), "ASCIIHexDecode": data.hex().encode() + b">", "ASCII85Decode": base64.a85encode(data) + b"~>", "RunLengthDecode": runs}
    for name, coded in cases.items():
        assert filters.decoded(o.dictionary(Filter=o.name(name)), coded) == data
    chain = o.dictionary(Filter=o.array(o.name("ASCIIHexDecode"), o.name("FlateDecode")))
    assert filters.decoded(chain, zlib.compress(data).hex().encode()) == data
    assert filters.decoded(o.dictionary(Filter=o.name("DCTDecode")), data) == data
    with pytest.raises(o.Malformed):
        filters.decoded(o.dictionary(Filter=o.name("Unknown")), data)
    header, packed = filters.deflated(o.dictionary(DP=o.NULL), data)
    assert filters.decoded(header, packed) == data and "DP" not in header[1]


def test_run_length_repeats_and_lzw():
    assert filters.run_length(bytes([255]) + b"x" + bytes([2]) + b"abc" + bytes([128]) + b"zz") == b"xxabc"
    assert filters.lzw(bytes.fromhex("800b6050220c0c8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("colors", [1, 3])
def test_png_predictors(kind, colors):
    rng, width, rows = random.Random(kind), 5 * colors, []
    plain = [bytes(rng.randrange(256) for _ in range(width)) for _ in range(4)]
    for y, row in enumerate(plain):
        up, out = plain[y - 1] if y else bytes(width), bytearray([kind])
        for x, v in enumerate(row):
            a, b, c = row[x - colors] if x >= colors else 0, up[x], up[x - colors] if x >= colors else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][kind]
            out.append(v - guess & 255)
        rows.append(bytes(out))
    parms = o.dictionary(Predictor=o.num(15), Colors=o.num(colors), Columns=o.num(5))
    assert filters.unpredicted(b"".join(rows), parms) == b"".join(plain)


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_tiff_predictor(bits):
    rng = random.Random(bits)
    columns, top = 8, (1 << bits) - 1
    x = [rng.randint(0, top) for _ in range(columns)]
    pack = lambda s: int("".join(f"{v:0{bits}b}" for v in s), 2).to_bytes(columns * bits // 8, "big")
    diffs = [x[0]] + [x[i] - x[i - 1] & top for i in range(1, columns)]
    parms = o.dictionary(Predictor=o.num(2), Columns=o.num(columns), BitsPerComponent=o.num(bits))
    assert filters.unpredicted(pack(diffs), parms) == pack(x)


def java_bytes(seed, n):
    state, out = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, bytearray()
    while len(out) < n:
        state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        out += struct.pack("<I", state >> 16)
    return bytes(out[:n])


def lengths(ends):
    return [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_chunking_goldens():
    assert hashlib.sha256(b"".join(int(g).to_bytes(8, "big") for g in fastcdc.GEAR)).hexdigest() == "695ac010d8f5079217de40f07577679492dc6b851c30aa3087ae4e61b9e2eb73"
    six = java_bytes(6, 262144)
    want = [6516, 18040, 16659, 17765, 18163, 16436, 20335, 21456, 11534, 32704, 10958, 23615, 12107, 27109, 8747]
    assert lengths(fastcdc.cuts(six)) == want
    assert lengths(fastcdc.cuts(six[:1024] + b"\x42" + six[1024:])) == [6517, *want[1:]]
    assert lengths(fastcdc.cuts(bytes(200000))) == [65536, 65536, 65536, 3392]
    assert lengths(fastcdc.cuts(java_bytes(7, 131072)))[:6] == [15146, 17232, 25164, 18838, 25054, 20174]
    small = lengths(fastcdc.cuts(java_bytes(1, 10240), 64, 256, 1024))
    assert small[:6] == [259, 307, 210, 287, 274, 274] and small[-2:] == [362, 1] and sum(small) == 10240
    assert fastcdc.cuts(b"") == []
    with pytest.raises(ValueError):
        fastcdc.cuts(b"x", 64, 100, 1024)


def test_contents():
    assert contents.text(b"BT\n  /F1 24 Tf\n  50 750 Td\n  (Hello World) Tj\nET") == "Hello World"
    assert contents.text(b"(a) Tj (b) Tj T* [(c) 12 (d)] TJ 0 5 Td (e) Tj 3 0 Td (f) Tj (x\\)y) ' ") == "a b\ncd\ne f\nx)y"
    kinds = [k for k, _ in contents.tokens(b") ] > } { << /A 1 /B [true null] >> <4 1> /x#41 - +.5 % c\n q")]
    assert kinds == ["dict", "hex", "name", "op", "number", "op"]
    assert dict(contents.tokens(b"/x#41 <4 1>"))["name"] == "xA"


def test_row_codec():
    shape = T.StructType([T.StructField(n, T.StructType([T.StructField(f, T.DoubleType()) for f in fs])) for n, fs in (("circle", ["r"]), ("rectangle", ["w", "h"]))])
    raw = rowcodec.encode({"circle": None, "rectangle": {"w": 1.0, "h": 2.0}}, T.StructType([T.StructField("s", shape, False, {"variant": True})]).fields[0].dataType, variant=True)
    assert len(raw) == 1 + 2 * 9  # a tag, and two nullable doubles
    person = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType(), False), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("shape", shape, False, {"variant": True})])
    row = {"name": None, "age": 7, "tags": ["a", None], "m": {"k": 1}, "shape": {"circle": {"r": 2.5}, "rectangle": None}}
    assert rowcodec.decode(rowcodec.encode(row, person), person)[0] == row
    assert rowcodec.encode(1, T.IntegerType()) == b"\0\0\0\1"


def hello():
    return files.build(files.simple_page(b"BT (Hello World) Tj ET"), o.dictionary(Root=o.ref(1)))


def test_file_round_trip_and_offsets():
    d = files.decode(hello())
    assert [x[0] for x in d.objects] == [1, 2, 3, 4, 5] and d.root == 1 and d.size == 6 and not d.unparsed and d.error is None
    for n, (at, _, used, _, _) in enumerate(d.xrefs[0][0][0][1]):
        if used:
            assert hello()[int(at) :].startswith(b"%d 0 obj" % n)


def test_malformed_tails_and_lengths():
    raw = hello()
    cut_short = raw[: raw.index(b"5 0 obj") + 9]
    d = files.decode(cut_short)
    assert [x[0] for x in d.objects] == [1, 2, 3, 4] and d.unparsed == 9 and d.trailer is None
    indirect = raw.replace(b"/Length 22", b"/Length 5 0 R").replace(o.write(files.simple_page(b"")[4][2]), b"22")
    assert len(files.decode(indirect).objects) == 3
    assert len(files.decode(indirect, resolve_length=True).objects) == 5
    broken = raw.replace(b"endstream", b"endstraem")
    assert files.decode(broken).error == "endstream missing"


def test_repeats_count_before_the_first_section_only():
    page = files.simple_page(b"")
    raw = files.build([*page, page[4]], o.dictionary(Root=o.ref(1))) + files.object_bytes(*page[4])
    assert [x[0] for x in files.decode(raw).objects] == [1, 2, 3, 4, 5, 5]


def test_xref_streams():
    header = o.dictionary(W=o.array(o.num(0), o.num(2), o.num(1)), Size=o.num(9), Index=o.array(o.num(1), o.num(1), o.num(7), o.num(2)))
    tables = files.xref_stream(header, bytes([0, 5, 0, 0, 6, 1, 0, 7, 0]))
    assert [(first, [e[0] for e in es]) for first, es in tables] == [(1, ["0000000005"]), (7, ["0000000006", "0000000007"])]
    with pytest.raises(o.Malformed):
        files.xref_stream(header, b"123")


@pytest.mark.parametrize("size", [1, 7, 64, 4096, 1 << 20])
def test_chunked_reading_equals_whole_reading(size):
    raw, carry, got = hello(), b"", []
    for i in range(0, len(raw), size):
        events, carry = whole_events(carry + raw[i : i + size], i + size >= len(raw))
        got += [(e.kind, e.number, e.payload) for e in events]
    assert got == [(e.kind, e.number, e.payload) for e in files.events(raw)][:-1] and carry == b""


def test_linearization_and_tiff():
    assert o.get(files.linearization(100, 3, 50, 1, 80), "O") == o.num(3)
    assert files.tiff_header(10, 20, 99, 4)[:4] == b"II*\0" and len(files.tiff_header(10, 20, 99, 4)) == 110
