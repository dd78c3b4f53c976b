"""What the objects of one file say about it: its faults, its page tree, its text, facts for policies."""

from __future__ import annotations

from collections.abc import Iterator

from foliant.functions import contents, files, filters
from foliant.functions.objects import Malformed, Value, get, name_of, nodes

#: Actions that are dangerous by default.
DANGEROUS = ("Launch", "SubmitForm", "ImportData", "RichMedia", "GoToE", "GoToR")

Objects = dict[int, tuple[Value, bytes | None]]
Fault = tuple[str, int | None, int | None]


def by_number(objects: list[tuple[int, int, Value, bytes | None]]) -> Objects:
    """The last object of each number."""
    return {n: (v, p) for n, _, v, p in objects}


def reference(value: Value | None) -> int | None:
    return value[1][0] if value is not None and value[0] == "ref" else None


def references(value: Value | None) -> list[int]:
    """Numbers of the references in an array; of other values none."""
    return [v[1][0] for v in value[1] if v[0] == "ref"] if value is not None and value[0] == "array" else []


def broken_streams(objects: list[tuple[int, int, Value, bytes | None]]) -> list[int]:
    """Numbers of contents whose filters fail."""
    out = []
    for n, _, v, p in objects:
        if p is not None:
            try:
                filters.decoded(v, p)
            except Malformed:
                out.append(n)
    return out


def content_faults(objects: Objects, single: bool = False) -> Iterator[Fault]:
    """References under Contents to objects that are missing or have no stream. Lists of references are
    followed to their end; one met again on its own path is ContentTooDeep."""
    for owner, (value, _) in objects.items():
        held = get(value, "Contents")
        own = reference(held)
        ways = [(t, ()) for t in ([own] if single and own is not None else references(held))][::-1]
        while ways:
            target, path = ways.pop()
            if target in path:
                yield "ContentTooDeep", owner, target
            elif target not in objects:
                yield "ContentMissing", owner, target
            else:
                v, payload = objects[target]
                if payload is None and v[0] == "array" and v[1] and v[1][0][0] == "ref":
                    ways += [(t, (*path, target)) for t in reversed(references(v))]
                elif payload is None:
                    yield "ContentStreamMissing", owner, target


def page_tree(objects: Objects, root: int | None, depth: int = 16) -> Iterator[tuple[int, int | None, int, str]]:
    """(node, parent, level, kind) of all nodes reached from the root's Pages; kind: pages, page, invalid,
    missing, or cycle for a node that is its own ancestor or deeper than `depth`."""
    top = reference(get(objects[root][0], "Pages")) if root in objects else None
    ways: list[tuple[int, int | None, tuple[int, ...]]] = [] if top is None else [(top, None, ())]
    while ways:
        node, parent, path = ways.pop()
        if node in path or len(path) > depth:
            yield node, parent, len(path), "cycle"
            continue
        value = objects[node][0] if node in objects else None
        kind = "missing" if value is None else {"Pages": "pages", "Page": "page"}.get(name_of(get(value, "Type")) or "", "invalid")
        yield node, parent, len(path), kind
        if kind == "pages":
            ways += [(k, node, (*path, node)) for k in reversed(references(get(value, "Kids")))]


def page_faults(objects: Objects, root: int | None) -> Iterator[Fault]:
    if root is None:
        yield "NoRoot", None, None
    elif root not in objects:
        yield "NoCatalog", None, root
    elif (top := reference(get(objects[root][0], "Pages"))) is None:
        yield "NoPagesInCatalog", None, None
    elif top not in objects:
        yield "NoPageRoot", None, top
    elif name_of(get(objects[top][0], "Type")) == "Page":
        yield "NoPages", None, top
    else:
        for node, parent, level, kind in page_tree(objects, root):
            if kind == "missing" and level:
                yield "PageMissing", parent, node
            elif kind == "invalid":
                yield "InvalidPageTreeObject", parent, node
            elif kind == "cycle":
                yield "PageTreeCycle", parent, node


def assembly_faults(objects: list[tuple[int, int, Value, bytes | None]], xrefs: int) -> list[Fault]:
    """Why no document can be made of the objects; without any, streams that can't be decoded."""
    if not objects:
        return [("NoObjs", None, None)]
    return [("NoXrefs", None, None)] if not xrefs else [("BrokenStream", n, None) for n in broken_streams(objects)]


def faults(objects: list[tuple[int, int, Value, bytes | None]], xrefs: int, root: int | None, single: bool = False) -> list[Fault]:
    """Every fault of a file. Objects whose stream is broken count as missing."""
    found = assembly_faults(objects, xrefs)
    if found and found[0][0] in ("NoObjs", "NoXrefs"):
        return found
    broken = {n for _, n, _ in found}
    whole = by_number([o for o in objects if o[3] is None or o[0] not in broken])
    return [*found, *content_faults(whole, single), *page_faults(whole, root)]


def differences(old: Objects, new: Objects) -> list[tuple[str, int]]:
    """Objects that the new version lacks, adds, or robbed of their stream."""
    out = []
    for n in sorted(old.keys() | new.keys()):
        if n not in new:
            out.append(("ObjectMissing", n))
        elif n not in old:
            out.append(("ObjectAdded", n))
        elif old[n][1] is not None and new[n][1] is None:
            out.append(("DeletedStream", n))
    return out


def compared(old: files.Decoded, new: files.Decoded) -> list[tuple[str, int | None, str | None]]:
    """(kind, number, detail): what keeps either version from being assembled; or else broken streams and faults
    of the new version, and the differences."""
    found = [("Assembly", None, f[0]) for d in (old, new) for f in assembly_faults(d.objects, len(d.xrefs)) if f[0] in ("NoObjs", "NoXrefs")]
    if found:
        return found
    of_new = faults(new.objects, len(new.xrefs), new.root)
    out = [("Assembly", f[1], f[0]) if f[0] == "BrokenStream" else ("Validation", f[1], f[0]) for f in of_new]
    keep = lambda d: by_number([o for o in d.objects if o[0] not in set(broken_streams(d.objects))])
    return out + [(kind, n, None) for kind, n in differences(keep(old), keep(new))]


def page_texts(objects: list[tuple[int, int, Value, bytes | None]]) -> list[tuple[int, int, str]]:
    """(number, place, text) of each page: the contents it refers to, in order, decoded (raw where that fails)
    and read. References that lead to no stream are passed over."""
    held = {n: (v, p) for n, _, v, p in objects if p is not None}
    out = []
    for place, (number, _, value, payload) in enumerate(objects):
        if payload is None and name_of(get(value, "Type")) == "Page":
            own = reference(get(value, "Contents"))
            parts = []
            for n in [own] if own is not None else references(get(value, "Contents")):
                if n in held:
                    try:
                        parts.append(filters.decoded(*held[n]) + b"\n")
                    except Malformed:
                        parts.append(held[n][1] + b"\n")
            out.append((number, place, contents.text(b"".join(parts))))
    return out


def pages_of(objects: Objects) -> list[int]:
    """Numbers of the pages, in the order of the first Pages node that has kids."""
    for value, payload in objects.values():
        if payload is None and name_of(get(value, "Type")) == "Pages" and (kids := references(get(value, "Kids"))):
            return kids
    return []


def facts(objects: Objects, trailer: Value | None) -> dict:
    """What policies ask of a file. actions: dictionaries that hold S, JS or URI, with the key they stand under."""
    out: dict = {k: [] for k in ("actions", "named_scripts", "embedded", "attachments", "font_uses", "descendants")}
    fonts, dangerous = set(), set()
    flags = dict.fromkeys(("has_javascript", "has_embedded_file", "has_file_attachment", "has_external_uri", "has_encrypt"), False)
    for number, value in [(0, trailer)] * (trailer is not None) + [(n, v) for n, (v, _) in objects.items()]:
        actions: dict[int, dict] = {}
        for _, parent, key, _, kind, text, _, parent_key, parent_action in nodes(value):
            if key in ("S", "JS", "URI") and parent >= 0:
                a = actions.setdefault(parent, {"obj_num": number, "under": parent_action, "s": None, "has_s": False, "has_js": False, "uri": None})
                a["has_s"] |= key == "S"
                a["has_js"] |= key == "JS"
                if key == "S" and kind == "name":
                    a["s"] = text
                elif key == "URI" and kind == "str":
                    a["uri"] = bytes.fromhex(text).decode("latin-1")
            flags["has_javascript"] |= key == "JS" or (key == "JavaScript" and parent_key == "Names")
            if key == "S" and kind == "name" and parent_action is not None:
                flags["has_javascript"] |= text == "JavaScript"
                flags["has_external_uri"] |= text == "URI"
                if text in DANGEROUS:
                    dangerous.add(text)
            elif key == "JavaScript" and parent_key == "Names":
                out["named_scripts"].append(number)
            elif key == "BaseFont" and kind == "name":
                fonts.add(text)
                if number:
                    out["font_uses"].append({"obj_num": number, "font": text})
            elif key == "Type" and text == "EmbeddedFile":
                flags["has_embedded_file"] = True
                if number and parent == 0 and kind == "name":
                    out["embedded"].append(number)
            elif key == "Subtype" and text == "FileAttachment":
                flags["has_file_attachment"] = True
                if number and parent == 0 and kind == "name":
                    out["attachments"].append(number)
            elif key is None and parent_key == "DescendantFonts" and kind == "ref" and number:
                out["descendants"].append(int(text.split()[0]))
            elif key == "Encrypt" and not number and parent == 0:
                flags["has_encrypt"] = True
        out["actions"] += actions.values()
    return {"fonts": sorted(fonts), "dangerous_actions": sorted(dangerous), "object_count": len(objects), **flags, **out}
