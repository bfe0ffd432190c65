"""DOCX and XLSX with the standard library: traversal into segments, admission checks, and rewriting of texts.

Order of a DOCX: paragraphs of the body, then those in its tables, then headers and footers, footnotes,
endnotes, comments. A table's paragraphs come after all paragraphs of the body, and every cell once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from maskloom.sources.text import scanned

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Admission limits of archives, and what makes one inadmissible.
MAX_MEMBERS, MAX_UNPACKED, MAX_RATIO = 5_000, 250 << 20, 200
ACTIVE = re.compile(r"(?:^|/)(?:vbaProject\.bin|activeX/|embeddings/|macrosheets/|media/|ctrlProps/|externalLinks/)|_xmlsignatures/", re.I)


def parsed(raw: bytes) -> ET.Element:
    """XML without entity declarations, which could expand without bound."""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document type declarations are refused")
    return ET.fromstring(raw)


def refused(raw: bytes, formulas: bool = True) -> str | None:
    """Why an archive is not admitted, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = z.infolist()
            names = [m.filename for m in members]
            if len(members) > MAX_MEMBERS:
                return "too many members"
            if sum(m.file_size for m in members) > MAX_UNPACKED:
                return "too large when unpacked"
            if any(m.file_size > MAX_RATIO * max(1, m.compress_size) for m in members):
                return "suspicious compression"
            if len(set(names)) != len(names):
                return "a member twice"
            if any(n.startswith(("/", "\\")) or ".." in n.split("/") or ":" in n for n in names):
                return "a member outside the archive"
            if bad := next((n for n in names if ACTIVE.search(n)), None):
                return f"not supported: {bad}"
            for n in names:
                if n.endswith(".rels") and any(e.get("TargetMode") == "External" and not (e.get("Type") or "").endswith("/hyperlink") for e in parsed(z.read(n)).iter()):
                    return "an external relationship"
                if formulas and re.match(r"xl/worksheets/[^/]+\.xml$", n) and parsed(z.read(n)).find(f".//{S}f") is not None:
                    return "a formula"
            if "word/document.xml" in names:
                return unsupported(parsed(z.read("word/document.xml")))
    except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError) as e:
        return f"not readable: {e}"
    return None


def unsupported(body: ET.Element) -> str | None:
    """Constructs whose text the traversal would miss."""
    for tag, why in (("ins", "tracked changes"), ("del", "tracked changes"), ("txbxContent", "a text box"), ("sdt", "a content control"), ("altChunk", "an embedded document")):
        if body.find(f".//{W}{tag}") is not None:
            return why
    return None


def _text(p: ET.Element) -> str:
    out: list[str] = []
    skipped: set[ET.Element] = set()
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tabs":
            skipped |= set(e)  # stops of tabs are a format
        elif e.tag in (f"{W}tab", f"{W}br") and e not in skipped:
            out.append("\t" if e.tag.endswith("tab") else "\n")
    return "".join(out)


def _body_paragraphs(body: ET.Element) -> Iterator[ET.Element]:
    yield from (e for e in body if e.tag == f"{W}p")

    def cells(table: ET.Element) -> Iterator[ET.Element]:
        for row in table.findall(f"{W}tr"):
            for cell in row.findall(f"{W}tc"):
                yield from (e for e in cell if e.tag == f"{W}p")
                for inner in cell.findall(f"{W}tbl"):
                    yield from cells(inner)

    for table in body.findall(f"{W}tbl"):
        yield from cells(table)


def docx_parts(names: list[str]) -> list[str]:
    """Parts with text in the order of traversal."""
    kinds = ("header", "footer", "footnotes", "endnotes", "comments")
    return ["word/document.xml", *(n for k in kinds for n in sorted(names) if re.fullmatch(rf"word/{k}\d*\.xml", n))]


def _paragraphs(root: ET.Element) -> Iterator[ET.Element]:
    body = root.find(f"{W}body")
    yield from _body_paragraphs(body) if body is not None else (e for e in root.iter(f"{W}p"))


def docx_texts(raw: bytes) -> Iterator[str]:
    if why := refused(raw):
        raise ValueError(why)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for part in docx_parts(z.namelist()):
            for p in _paragraphs(parsed(z.read(part))):
                yield _text(p)


def xlsx_cells(raw: bytes) -> Iterator[tuple[str, str, str]]:
    """(sheet part, cell, text) of cells to look at: strings, and numbers of ten digits or more; truth values never."""
    yield from ((s.part, s.name, s.text) for s in _xlsx_slots(_Archive(raw)))


def cell_admitted(value: str) -> bool:
    """A number is looked at if its text has ten digits or more."""
    return sum(ch.isdigit() for ch in value) >= 10


def docx_segments(files: DataFrame) -> DataFrame:
    return scanned(files, docx_texts)


def xlsx_segments(files: DataFrame) -> DataFrame:
    def texts(raw: bytes) -> Iterator[str]:
        if why := refused(raw):
            raise ValueError(why)
        yield from (t for _, _, t in xlsx_cells(raw))

    return scanned(files, texts)


class _Archive:
    """Members of an archive, parsed where they are asked for; those that were written are put back."""

    def __init__(self, raw: bytes):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            self.members = {n: z.read(n) for n in z.namelist()}
        self.trees: dict[str, ET.Element] = {}

    def tree(self, name: str) -> ET.Element:
        if name not in self.trees:
            self.trees[name] = parsed(self.members[name])
        return self.trees[name]

    def packed(self, changed: set[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, raw in self.members.items():
                if n in changed:
                    raw = ET.tostring(self.trees[n], encoding="UTF-8", xml_declaration=True)
                z.writestr(n, blanked(raw) if n in ("docProps/core.xml", "docProps/app.xml") else raw)
        return out.getvalue()


@dataclass
class Slot:
    """A place that holds one segment's text, and how to put another text there."""

    part: str
    name: str
    text: str
    put: Callable[[str], None]


_TOKENS = re.compile(r"\w+|\W")


def _changes(old: str, new: str) -> list[tuple[int, int, str]]:
    """(start, stop, put) that turn old into new, word by word."""
    left, right = _TOKENS.findall(old), _TOKENS.findall(new)
    at = [0]
    for t in left:
        at.append(at[-1] + len(t))
    codes = SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
    return [(at[a], at[z], "".join(right[b:y])) for tag, a, z, b, y in codes if tag != "equal"]


def _put(p: ET.Element, new: str) -> None:
    """A paragraph's text replaced. Only what changes is touched: the first piece of text that a change meets takes what is put in,
    further ones lose their part, tabs and breaks inside it go; formats and everything else stay."""
    parent = {child: e for e in p.iter() for child in e}
    pieces, at = [], 0  # element, start, stop
    for e in p.iter():
        if e.tag in (f"{W}t", f"{W}tab", f"{W}br") and not (e.tag == f"{W}tab" and parent[e].tag == f"{W}tabs"):
            size = len(e.text or "") if e.tag == f"{W}t" else 1
            pieces.append((e, at, at + size))
            at += size
    texts = [x for x in pieces if x[0].tag == f"{W}t"]
    if not texts:
        return
    for start, stop, put in reversed(_changes(_text(p), new)):  # from the end, so that earlier places stay where they are
        met = [x for x in pieces if x[1] < stop and start < x[2]]
        host = next((x for x in met if x[0].tag == f"{W}t"), None)
        host = host or next((x for x in reversed(texts) if x[1] <= start), texts[0])
        for e, a, z in met:
            if e.tag != f"{W}t":
                parent[e].remove(e)
            elif e is not host[0]:
                e.text = e.text[: max(start - a, 0)] + e.text[min(stop, z) - a :]
        e, a, z = host
        cut = min(max(start - a, 0), z - a)
        e.text = (e.text or "")[:cut] + put + (e.text or "")[max(cut, min(stop, z) - a) :]
        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _docx_slots(archive: _Archive) -> Iterator[Slot]:
    for part in docx_parts(list(archive.members)):
        for p in _paragraphs(archive.tree(part)):
            yield Slot(part, "", _text(p), lambda new, p=p: _put(p, new))


def _without_children(c: ET.Element, new: str) -> None:
    for e in list(c):
        c.remove(e)
    c.set("t", "inlineStr")
    ET.SubElement(ET.SubElement(c, f"{S}is"), f"{S}t").text = new


def _texts_set(c: ET.Element, new: str) -> None:
    for k, t in enumerate(c.iter(f"{S}t")):
        t.text = "" if k else new


def _xlsx_slots(archive: _Archive, max_cells: int = 1_000_000) -> Iterator[Slot]:
    names = list(archive.members)
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in archive.tree("xl/sharedStrings.xml").findall(f"{S}si")] if "xl/sharedStrings.xml" in names else []
    for part in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        root = archive.tree(part)
        for k, c in enumerate(root.iter(f"{S}c")):
            if k >= max_cells:
                raise ValueError(f"more than {max_cells} cells")
            kind, value = c.get("t", "n"), c.findtext(f"{S}v")
            text = None
            if kind == "s" and value is not None:
                text = shared[int(value)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif kind in ("n", "str") and value and (kind == "str" or cell_admitted(value)):
                text = value
            if text is not None:
                yield Slot(part, c.get("r", ""), text, lambda new, c=c: _without_children(c, new))
        head = root.find(f"{S}headerFooter")
        for e in head if head is not None else ():
            if e.text:
                yield Slot(part, e.tag.rpartition("}")[2], e.text, lambda new, e=e: setattr(e, "text", new))
    for part in sorted(n for n in names if re.fullmatch(r"xl/comments[^/]*\.xml", n)):
        root = archive.tree(part)
        for a in root.iter(f"{S}author"):
            if a.text:
                yield Slot(part, "author", a.text, lambda new, a=a: setattr(a, "text", new))
        for c in root.iter(f"{S}comment"):
            yield Slot(part, c.get("ref", ""), "".join(t.text or "" for t in c.iter(f"{S}t")), lambda new, c=c: _texts_set(c, new))


def _rewritten(archive: _Archive, slots: list[Slot], new: list[str]) -> set[str]:
    changed = set()
    for slot, text in zip(slots, new, strict=True):
        if text != slot.text:
            slot.put(text)
            changed.add(slot.part)
    return changed


def docx_changed(raw: bytes, change: Callable[[list[str]], list[str]]) -> bytes:
    """The document with its paragraphs, in the order of traversal, changed together; properties and authors of comments blanked."""
    if why := refused(raw):
        raise ValueError(why)
    archive = _Archive(raw)
    slots = list(_docx_slots(archive))
    changed = _rewritten(archive, slots, change([s.text for s in slots]))
    for part in docx_parts(list(archive.members)):
        for e in archive.tree(part).iter(f"{W}comment"):
            for a in ("author", "initials"):
                if e.get(W + a):
                    e.set(W + a, "")
                    changed.add(part)
    return archive.packed(changed)


def xlsx_changed(raw: bytes, change: Callable[[list[str]], list[str]]) -> bytes:
    """The workbook with its texts, in the order of traversal, changed together. Strings move into their cells, so that the shared
    table keeps none of the old ones; sheets get generic names, names that are defined go, properties and authors are blanked."""
    if why := refused(raw):
        raise ValueError(why)
    archive = _Archive(raw)
    slots = list(_xlsx_slots(archive))
    new = ["" if s.name == "author" else t for s, t in zip(slots, change([s.text for s in slots]), strict=True)]
    changed = _rewritten(archive, slots, new)
    if "xl/sharedStrings.xml" in archive.members:
        shared = archive.tree("xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared.findall(f"{S}si")]
        for part in sorted(n for n in archive.members if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for c in archive.tree(part).iter(f"{S}c"):
                if c.get("t") == "s" and c.findtext(f"{S}v") is not None:
                    _without_children(c, strings[int(c.findtext(f"{S}v"))])
                    changed.add(part)
        for si in list(shared):
            shared.remove(si)
        for a in ("count", "uniqueCount"):
            shared.set(a, "0")
        changed.add("xl/sharedStrings.xml")
    if "xl/workbook.xml" in archive.members:
        book = archive.tree("xl/workbook.xml")
        for k, sheet in enumerate(book.iter(f"{S}sheet"), 1):
            sheet.set("name", f"Sheet{k}")
        for e in [e for e in book if e.tag == f"{S}definedNames"]:
            book.remove(e)
        changed.add("xl/workbook.xml")
    return archive.packed(changed)


def docx_rewritten(raw: bytes, change: Callable[[str], str]) -> bytes:
    """The document with ``change`` applied to its paragraphs in the order of traversal, properties blanked."""
    return docx_changed(raw, lambda texts: [change(t) for t in texts])


def blanked(raw: bytes) -> bytes:
    """Document properties that can name people or firms, emptied."""
    root = parsed(raw)
    for e in root.iter():
        if e.tag.rpartition("}")[2] in ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "Company", "Manager", "HyperlinkBase"):
            e.text = ""
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)
