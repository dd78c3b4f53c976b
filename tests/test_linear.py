"""Linearised files: where everything stands, and that nothing is lost."""

import re

from foliant.functions import files
from foliant.functions import objects as o
from foliant.operators import decode, linear


def book(pages, gap=0):
    """A file of pages with a shared font, a nested page tree and an object that nothing refers to."""
    out = [(1, 0, o.dictionary(Type=o.name("Catalog"), Pages=o.ref(2)), None)]
    kids = [10 + gap + 3 * k for k in range(pages)]
    out.append((2, 0, o.dictionary(Type=o.name("Pages"), Kids=o.array(o.ref(3)), Count=o.num(pages)), None))
    out.append((3, 0, o.dictionary(Type=o.name("Pages"), Parent=o.ref(2), Kids=o.array(*map(o.ref, kids)), Count=o.num(pages)), None))
    out.append((4, 0, o.dictionary(Type=o.name("Font"), BaseFont=o.name("F")), None))
    out.append((5, 0, o.dictionary(Author=o.text(b'"@4 0"')), None))
    for n in reversed(kids):  # the first page comes last in the file
        text = b"BT (page %d) Tj ET" % n * (50 if n % 2 else 1)
        box = o.array(*map(o.num, (0, 0, 9, 9)))
        page = o.dictionary(Type=o.name("Page"), Parent=o.ref(3), MediaBox=box, Contents=o.array(o.ref(n + 1)), Resources=o.dictionary(Font=o.dictionary(F=o.ref(4))), Annots=o.array(o.ref(n + 2)))
        out += [(n, 0, page, None), (n + 1, 0, o.dictionary(Length=o.num(len(text))), text), (n + 2, 0, o.dictionary(P=o.ref(n)), None)]
    return out


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["file_id"], r["off"])):
        held = out.setdefault(r["file_id"], b"")
        assert len(held) == r["off"], "gaps or overlaps"
        out[r["file_id"]] = held + bytes(r["bytes"])
    return out


def test_linearised_files(spark, monkeypatch):
    monkeypatch.setattr(linear, "ENTRIES", 7)
    trailer = o.dictionary(Root=o.ref(1), Info=o.ref(5))
    held = {1: book(1), 2: book(30), 3: book(3, gap=1000), 4: [*book(2), (4, 0, o.dictionary(Type=o.name("Font"), BaseFont=o.name("G")), None)]}
    made = [(i, files.build(x, trailer)) for i, x in held.items()] + [(9, files.build([(1, 0, o.dictionary(Type=o.name("Catalog")), None)], trailer)), (10, b"")]
    old = spark.createDataFrame(made, "file_id long, content binary")
    got = whole(linear.linearized(decode.decoded_df(old), decode.meta_df(old)).collect())
    assert set(got) == set(held)
    for i, data in got.items():
        d = files.decode(data)
        last = {n: (v, p) for n, _, v, p in files.decode(dict(made)[i]).objects}
        plain = lambda x: {n: (o.to_json(v), p) for n, (v, p) in x.items()}
        found = {n: (v, p) for n, _, v, p in d.objects if o.get(v, "Linearized") is None}
        assert plain(found) == plain(last) and d.error is None and d.unparsed == 0
        (own, spoken) = next((n, v) for n, _, v, _ in d.objects if o.get(v, "Linearized") is not None)
        number = lambda k: o.number_of(o.get(spoken, k))
        first = min(n for n in last if n >= 10)
        assert own == max(last) + 1 and number("L") == len(data) and number("O") == first and data.startswith(b"xref\n0 ", number("T"))
        assert number("N") == sum(o.name_of(o.get(v, "Type")) == "Page" for v, _ in last.values())
        ahead = {int(m[1]) for m in re.finditer(rb"(?m)^(\d+) 0 obj$", data[: number("E")])}
        assert ahead == {own, 1, 4, first, first + 1, first + 2}  # without the tree, other pages and what they show
        assert data[int(data.rsplit(b"startxref\n", 1)[1].split()[0]) :].startswith(b"xref\n")
        for section, (tables, _, _) in enumerate(d.xrefs):
            for start, entries in tables:
                for k, (offset, _, used, _, _) in enumerate(entries):
                    assert not used or data.startswith(b"%d 0 obj" % (start + k), int(offset)), section
    new = spark.createDataFrame(list(got.items()), "file_id long, content binary")
    decoded = decode.decoded_df(new)
    assert decode.without_linearization(decoded).count() == decoded.count() - len(got)
    sections = {(r["xref_no"], r["obj_num"]) for r in decode.xref_entries_df(new, last_first=True).where("file_id = 1 and xref_no = 1").collect()}
    assert {n for _, n in sections} == {1, 4, 10, 11, 12, 13}
