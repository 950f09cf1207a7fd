"""Parsers in Python: JSON, mail, RTF, Office archives, books. ``parse`` never raises: it returns pages or an error."""

from __future__ import annotations

import email
import email.policy
import io
import json
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree as ET

BLANKS = " \t\n\x0b\f\r\x85\xa0           \u2028\u2029   "
Page = tuple[str | None, str]  # label, text
#: An archive member that unpacks to more is refused.
MOST_BYTES = 1 << 30


def _text(data: bytes) -> str:
    return data.decode("utf-8")


# ---- markup, JSON --------------------------------------------------------------------------------------------------


def html_text(s: str) -> str:
    """The Python twin of functions.text.html_text, for markup inside other files."""
    for tag in ("script", "style", "noscript"):
        s = re.sub(f"(?is)<{tag}[^>]*>.*?</{tag}>", "\n", s)
    s = re.sub(r"(?i)<br\s*/?>", "\n", s)
    s = re.sub("(?i)</(?:h[1-6]|div|p|tr|li)>", "\n", s)
    s = re.sub("<[^>]+>", " ", s)
    s = re.sub("\n{3,}", "\n\n", re.sub("[\\t ]+\n", "\n", s))
    for name, sign in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        s = s.replace(f"&{name};", sign)
    return s.strip(BLANKS)


MAX_DEPTH = 12


def _number(v) -> str:
    return json.dumps(v) if not isinstance(v, float) or v != int(v) or abs(v) >= 1e16 else repr(v)


def flatten(v, depth: int = 0) -> str:
    """``k: v`` lines in the order of keys; lists by line; nulls and empties vanish; deep objects as indented JSON."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, (bool, int, float)):
        return json.dumps(v) if isinstance(v, bool) else _number(v)
    if isinstance(v, list):
        return "\n".join(s for s in (flatten(x, depth + 1) for x in v) if s)
    if depth >= MAX_DEPTH:
        return json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False)
    lines = []
    for k in sorted(v):
        inner = flatten(v[k], depth + 1)
        if inner:
            lines.append(f"{k}:\n{inner}" if "\n" in inner else f"{k}: {inner}")
    return "\n".join(lines)


def parse_json(data: bytes) -> list[Page]:
    v = json.loads(_text(data))
    return [(None, flatten(v) if isinstance(v, (dict, list)) else json.dumps(v, indent=2, ensure_ascii=False))]


def _scalar(v) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, (dict, list)):
        return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    return "null" if v is None else _number(v) if isinstance(v, float) else json.dumps(v)


def parse_ndjson(data: bytes) -> list[Page]:
    out = []
    for line in _text(data).split("\n"):
        line = line.strip(BLANKS)
        if not line:
            continue
        try:
            v = json.loads(line)
        except ValueError:
            out.append(line)
            continue
        out.append(" | ".join(f"{k}: {_scalar(v[k])}" for k in sorted(v)) if isinstance(v, dict) else _scalar(v))
    return [(None, "\n".join(out))]


# ---- RTF -----------------------------------------------------------------------------------------------------------

_RTF = re.compile(r"\\(?:([A-Za-z]+)|(.)|$)[0-9-]* ?|[{}]|[^\\{}]+", re.S)
_RTF_SIGNS = {"par": "\n", "line": "\n", "tab": "\t"}


def parse_rtf(data: bytes) -> list[Page]:
    """Control words and braces go; paragraphs, lines and tabs stay."""
    out = []
    for m in _RTF.finditer(_text(data)):
        s = m[0]
        if s[0] == "\\":
            out.append(_RTF_SIGNS.get(m[1] or "", ""))
        elif s not in "{}":
            out.append("".join(c for c in s if c >= " " and not "\x7f" <= c < "\xa0"))
    return [(None, re.sub("[ \\t]+\n", "\n", "".join(out).strip(BLANKS)))]


# ---- mail ----------------------------------------------------------------------------------------------------------


def _body(m: email.message.EmailMessage) -> str:
    part = m.get_body(preferencelist=("plain", "html"))
    if part is None:
        return ""
    try:
        text = part.get_content()
    except (LookupError, UnicodeError):
        text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    text = str(text).replace("\r\n", "\n")
    return html_text(text) if part.get_content_type() == "text/html" else text.strip(BLANKS)


def _message(data: bytes, names: tuple[str, ...]) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{n}: {m[n]}" for n in m.keys() if n in names]
    return ("\n".join(head) + "\n\n" if head else "") + _body(m)


def parse_eml(data: bytes) -> list[Page]:
    """Headers that readers want, then the plain or else the HTML part, decoded as the message's own headers say."""
    return [(None, _message(data, ("Subject", "From", "To", "Date")).strip(BLANKS))]


def parse_mbox(data: bytes) -> list[Page]:
    """All messages of a box on one page."""
    parts = [p for p in re.split(rb"(?m)^(?=From )", data) if p.strip()]
    parts = [re.sub(rb"\AFrom [^\n]*\n?", b"", p) for p in parts]
    return [(None, "\n\n---\n\n".join(_message(p, ("Subject", "From")).strip(BLANKS) for p in parts))]


class _Compound:
    """Just enough of compound files to read streams by name."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not a compound file")
        self.data = data
        self.size, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir, self.cutoff = struct.unpack_from("<I", data, 44)[0], *struct.unpack_from("<I4xI", data, 48)
        first_mini, _, first_difat, n_difat = struct.unpack_from("<4I", data, 60)
        difat = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_difat, 10_000)):
            block = struct.unpack_from(f"<{self.size // 4}I", self._sector(first_difat))
            difat += block[:-1]
            first_difat = block[-1]
        self.fat = [x for s in difat[:n_fat] if s < 0xFFFFFFFA for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = self._chain(first_dir)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries), 128)]
        raw = self._chain(first_mini) if first_mini < 0xFFFFFFFA else b""
        self.minifat = struct.unpack(f"<{len(raw) // 4}I", raw)
        root = self.entries[0]
        self.ministream = self._chain(struct.unpack_from("<I", root, 116)[0])

    def _sector(self, s: int) -> bytes:
        at = (s + 1) * self.size
        return self.data[at : at + self.size]

    def _chain(self, s: int) -> bytes:
        out, seen = [], 0
        while s < 0xFFFFFFFA and s < len(self.fat) and seen <= len(self.fat):
            out.append(self._sector(s))
            s, seen = self.fat[s], seen + 1
        return b"".join(out)

    def read(self, name: str) -> bytes | None:
        for e in self.entries:
            n = struct.unpack_from("<H", e, 64)[0]
            if n > 2 and e[: n - 2].decode("utf-16-le", "replace") == name:
                start, size = struct.unpack_from("<II", e, 116)
                if size >= self.cutoff:
                    return self._chain(start)[:size]
                out, s = [], start
                while s < 0xFFFFFFFA and s < len(self.minifat) and len(out) <= len(self.minifat):
                    out.append(self.ministream[s * self.mini : (s + 1) * self.mini])
                    s = self.minifat[s]
                return b"".join(out)[:size]
        return None


def parse_msg(data: bytes) -> list[Page]:
    """Subject, sender and body of a message file."""
    f = _Compound(data)

    def prop(tag: str) -> str:
        wide, narrow = f.read(f"__substg1.0_{tag}001F"), f.read(f"__substg1.0_{tag}001E")
        return (wide.decode("utf-16-le", "replace") if wide is not None else (narrow or b"").decode("utf-8", "replace")).strip("\0")

    subject, sender, address, body = prop("0037"), prop("0042"), prop("0076"), prop("1000")
    if not body:
        markup = f.read("__substg1.0_10130102") or b""
        body = html_text(markup.decode("utf-8", "replace") or prop("1013"))
    head = [f"Subject: {subject}"] * bool(subject) + [f"From: {sender or address}"] * bool(sender or address)
    if not head and not body:
        raise ValueError("no message properties")
    return [("message", "\n".join(head) + "\n\n" + body.strip(BLANKS))]


# ---- Office archives -----------------------------------------------------------------------------------------------


def _open(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is too large")
    return z.read(name)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def ooxml_text(xml: bytes) -> str:
    """Runs of text with tabs, breaks and a line by paragraph."""
    out: list[str] = []
    for event, e in ET.iterparse(io.BytesIO(xml), ("start", "end")):
        name = _local(e.tag)
        if event == "start":
            if name == "p" and out and out[-1] != "\n":
                out.append("\n")
        elif name == "t":
            out.append(e.text or "")
        elif name == "tab" and not list(e):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        if event == "end" and name == "p":
            e.clear()
    return "".join(out)


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def parse_docx(data: bytes) -> list[Page]:
    with _open(data) as z:
        names = z.namelist()
        parts = [ooxml_text(_member(z, "word/document.xml"))]
        parts += [ooxml_text(_member(z, n)) for n in sorted(n for n in names if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))]
    return [(None, "\n\n".join(t for t in (p.strip(BLANKS) for p in parts) if t))]


def parse_pptx(data: bytes) -> list[Page]:
    with _open(data) as z:
        slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        return [(posixpath.basename(n)[:-4], ooxml_text(_member(z, n)).strip(BLANKS)) for n in slides]


def cell_text(v: str, kind: str | None, shared: list[str]) -> str:
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "true" if v == "1" else "false"
    if kind in ("str", "inlineStr", "e"):
        return v
    try:
        x = float(v)
    except ValueError:
        return v
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def markdown_rows(rows: list[list[str]]) -> str:
    """Pipe rows with one rule after the first; blank rows are left out."""
    lines = []
    for row in rows:
        if not any(c.strip() for c in row):
            continue
        lines.append("| " + " | ".join(c.replace("\n", " ") for c in row) + " |")
        if len(lines) == 1:
            lines.append("|" + "---|" * len(row))
    return "\n".join(lines)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[Page]:
    with _open(data) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(_member(z, "xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(_member(z, "xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        book = ET.fromstring(_member(z, "xl/workbook.xml"))
        pages = []
        for k, sheet in enumerate(s for s in book.iter() if _local(s.tag) == "sheet"):
            rid = next((v for a, v in sheet.attrib.items() if _local(a) == "id"), None)
            target = (rels.get(rid) or f"worksheets/sheet{k + 1}.xml").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            rows = []
            for _, e in ET.iterparse(io.BytesIO(_member(z, path))):
                if _local(e.tag) != "row":
                    continue
                row: list[str] = []
                for c in e:
                    v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                    at = _column(c.get("r", "")) if c.get("r") else len(row)
                    row += [""] * (at - len(row)) + [cell_text(v, c.get("t"), shared) if v else ""]
                rows.append(row)
                e.clear()
            wide = max(map(len, rows), default=0)
            pages.append((sheet.get("name"), markdown_rows([r + [""] * (wide - len(r)) for r in rows])))
    return pages


def parse_odf(data: bytes) -> list[Page]:
    """Text of paragraphs and headings, blanks, tabs and breaks of an OpenDocument body."""
    with _open(data) as z:
        root = ET.fromstring(_member(z, "content.xml"))
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = _local(e.tag)
        if name == "s":
            out.append(" " * int(next((v for a, v in e.attrib.items() if _local(a) == "c"), "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        out.append((e.text or "") if name in ("p", "h", "span", "a") else "")
        for c in e:
            walk(c)
            if name in ("p", "h", "span", "a"):
                out.append(c.tail or "")
        if name in ("p", "h"):
            out.append("\n")

    walk(root)
    return [(None, "".join(out).strip(BLANKS))]


def parse_epub(data: bytes) -> list[Page]:
    with _open(data) as z:
        names = sorted(n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))
        if not names:
            raise ValueError("no chapters")
        return [(f"chapter{k + 1}", html_text(_member(z, n).decode("utf-8", "replace"))) for k, n in enumerate(names)]


def parse_xls(data: bytes) -> list[Page]:
    try:
        import xlrd
    except ImportError:
        raise ValueError("no reader for .xls is installed") from None
    book = xlrd.open_workbook(file_contents=data)
    fmt = lambda c: str(int(c.value)) if c.ctype == 2 and c.value == int(c.value) else str(c.value)
    return [(s.name, markdown_rows([[fmt(c) for c in s.row(i)] for i in range(s.nrows)])) for s in book.sheets()]


PARSERS = {
    "json": parse_json, "ndjson": parse_ndjson, "rtf": parse_rtf, "eml": parse_eml, "mbox": parse_mbox, "msg": parse_msg, "docx": parse_docx, "pptx": parse_pptx,
    "xlsx": parse_xlsx, "xls": parse_xls, "odt": parse_odf, "ods": parse_odf, "odp": parse_odf, "epub": parse_epub,
}


def parse(ext: str, data: bytes) -> tuple[list[Page], str | None]:
    try:
        pages = PARSERS[ext](data)
        return (pages, None) if pages else ([], f"{ext.upper()}: no pages")
    except KeyError as e:
        return [], f"{ext.upper()}: missing {e}"
    except Exception as e:  # whatever a damaged file makes a parser raise is that file's error page
        return [], f"{ext.upper()}: {type(e).__name__}: {e}"[:500]


def expand_zip(data: bytes) -> list[tuple[str, bytes | None, str | None]]:
    """(member path, content, error) of the supported members, one level deep; members that leave the archive are skipped."""
    from folioflow.sources.formats import is_supported

    out: list[tuple[str, bytes | None, str | None]] = []
    with _open(data) as z:
        for info in z.infolist():
            name = info.filename
            ext = posixpath.splitext(name)[1][1:].lower()
            if info.is_dir() or ".." in name or ext == "zip" or not is_supported(ext):
                continue
            if info.file_size > MOST_BYTES:
                out.append((name, None, "member is too large"))
                continue
            try:
                out.append((name, z.read(info), None))
            except Exception as e:
                out.append((name, None, f"{type(e).__name__}: {e}"))
    return out

