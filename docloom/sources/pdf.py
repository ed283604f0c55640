"""A small reader of PDF bytes: pages in order, their text, and why a file cannot be read.

It knows plain and Flate-coded streams, object streams, page trees and the text operators of fonts with a byte encoding;
other filters and fonts with maps of their own give no text, so such pages count as thin and are left to OCR.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"(<<.*?>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document(NamedTuple):
    status: str  # processing, password_required or failed
    error: str | None
    pages: list[str]


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPE.sub(lambda m: PLAIN.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else m[1]), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _decoded(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in m[1]:
        return zlib.decompressobj().decompress(m[2])
    return b"" if b"/Filter" in m[1] else m[2]


def page_text(content: bytes) -> str:
    """The strings that a content stream shows; moves to another line are line ends."""
    out: list[str] = []
    stack: list[bytes] = []
    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[" or t == b"]" or re.fullmatch(rb"[-+.\d]+", t):
            stack.append(t)
            continue
        if t in (b"T*", b"Tm", b"TD", b"'", b'"') or t == b"Td" and stack[-1:] != [b"0"]:
            out.append("\n")
        if t in (b"Tj", b"TJ", b"'", b'"'):
            for s in stack:
                if s[:1] in b"(<":
                    out.append(_string(s))
                elif t == b"TJ" and re.fullmatch(rb"-\d+(?:\.\d*)?", s) and float(s) < -200:
                    out.append(" ")
        stack = []
    return "".join(out).strip("\n")


def read(data: bytes | None) -> Document:
    """The document of a file's bytes; never raises."""
    if not data:
        return Document("failed", "empty file", [])
    if b"%PDF-" not in data[:1024]:
        return Document("failed", "not a PDF", [])
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
        return Document("password_required", None, [])
    try:
        objects = {int(n): body for n, body in OBJECT.findall(data)}
        for body in list(objects.values()):
            if b"/ObjStm" in body[:300]:
                inner = _decoded(body)
                first = int(re.search(rb"/First\s+(\d+)", body)[1])
                numbers = list(map(int, inner[:first].split()))
                places = [*numbers[1::2], len(inner) - first]
                for k, n in enumerate(numbers[::2]):
                    objects.setdefault(n, inner[first + places[k] : first + places[k + 1]])
        roots = [int(m[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))]
        if not roots:
            return Document("failed", "no page tree", [])
        pages, todo, met = [], [roots[-1]], set()
        while todo:
            n = todo.pop()
            if n in met:
                continue
            met.add(n)
            body = objects[n]
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                todo += [int(x) for x in REF.findall(kids[1])][::-1]
                continue
            found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
            pages.append(page_text(b"\n".join(_decoded(objects[int(x)]) for x in REF.findall(found[1]))) if found else "")
    except (KeyError, ValueError, TypeError, IndexError, zlib.error) as e:
        return Document("failed", f"{type(e).__name__}: damaged file", [])
    return Document("processing", None, pages) if pages else Document("failed", "no pages", [])


def write(pages: list[str]) -> bytes:
    """A plain PDF of text pages, for round trips."""

    def content(text: str) -> bytes:
        lines = [b"(" + x.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b") Tj T*" for x in text.split("\n")]
        return zlib.compress(b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"\n".join(lines) + b"\nET")

    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages)))), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, t in enumerate(pages):
        c = content(t)
        bodies += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(c), c)]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))
