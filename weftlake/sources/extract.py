"""File bytes to text and metadata, by MIME type; everything here uses the standard library."""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import unicodedata
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from email import policy
from email.parser import BytesParser
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

from weftlake.functions.text import BREAKS, ENTITIES, LEVELS, TIMESTAMPS


class ExtractionError(ValueError):
    """A file that can't be read as its type."""


class UnsupportedType(ExtractionError):
    """No extractor for a MIME type."""


@dataclass(frozen=True)
class Options:
    """What to keep of a document's structure."""

    tables: bool = True
    headings: bool = False
    lists: bool = False
    code: bool = False
    formatting: bool = False
    metadata: bool = False
    append_metadata: bool = False
    table_format: str = "plain"  # markdown, csv or plain
    heading_format: str = "plain"  # markdown or plain
    depth: int = 0
    max_depth: int = 3
    max_total: int = 100 << 20
    attachments: bool = True
    max_attachment: int = 10 << 20


PRESETS = {
    "plain_text": Options(),
    "structure_preserving": Options(headings=True, lists=True, code=True, formatting=True),
    "markdown": Options(headings=True, lists=True, code=True, formatting=True, table_format="markdown", heading_format="markdown"),
}


@dataclass
class Extracted:
    text: str
    metadata: dict = field(default_factory=dict)


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def strict(data: bytes, what: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ExtractionError(f"invalid UTF-8 in {what}: {e}") from e


#: All of category Cc but tab and line ends.
_CONTROLS = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def clean(text: str) -> str:
    """Composed, without control characters but tab and line ends, white space squashed, empty lines dropped."""
    text = _CONTROLS.sub("", unicodedata.normalize("NFC", text))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


class _Node:
    __slots__ = ("tag", "items")

    def __init__(self, tag: str):
        self.tag, self.items = tag, []

    def find(self, *tags) -> Iterator[_Node]:
        """Nodes of some tags below this one in document order, at any depth."""
        left = self.items[::-1]
        while left:
            x = left.pop()
            if type(x) is _Node:
                if x.tag in tags:
                    yield x
                left += x.items[::-1]

    def strings(self) -> list[str]:
        """Texts below this one in document order, at any depth."""
        out, left = [], self.items[::-1]
        while left:
            x = left.pop()
            if type(x) is _Node:
                left += x.items[::-1]
            else:
                out.append(x)
        return out


#: Elements without content, elements that close an open one of their kind, elements that are skipped, and elements that stand on lines of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = {"table", "ul", "ol", "div", "section", "article", "body"}
SKIPPED = {"script", "style", "noscript", "iframe", "svg", "head"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote"}


#: Tags without attributes, as most are: no need to look for any. Elements whose content some versions of the parser read in their own way.
_BARE, _BARE_END, _BARE_TAG = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile("</([a-zA-Z][a-zA-Z0-9]*)>"), re.compile("<(/?[a-zA-Z][a-zA-Z0-9]*)>")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]

    def read(self, source: str) -> _Node:
        """The tree of a whole page."""
        parts = _BARE_TAG.split(source)  # text, tag, text, tag, ..., text
        if 2 * source.count("<") + 1 == len(parts) and self.plain(parts):
            self.bare(parts)
        else:
            self.feed(source)
            self.close()
        return self.root

    def plain(self, parts: list[str]) -> bool:
        """Whether all versions of the parser read these parts in the same way: what is read in its own way holds no tag and no reference."""
        tags = [t.lower() for t in parts[1::2]]
        return RAW.isdisjoint(tags) or all(t not in RAW or t != "plaintext" and tags[k + 1 : k + 2] == ["/" + t] and "&" not in parts[2 * k + 2] for k, t in enumerate(tags))

    def bare(self, parts: list[str]) -> None:
        """What the parser does for tags that are all bare, without its search for what comes next."""
        tag = False
        for x in parts:
            if tag:
                x = x.lower()
                if x[0] == "/":
                    self.handle_endtag(x[1:])
                else:
                    self.handle_starttag(x, ())
            elif x:
                self.open[-1].items.append(unescape(x) if "&" in x else x)
            tag = not tag

    def updatepos(self, i, j):
        return j  # lines aren't counted: no one asks where the parser is

    def parse_starttag(self, i):
        if (m := _BARE.match(self.rawdata, i)) and (tag := m[1].lower()) not in RAW:
            self.lasttag = tag
            self.handle_starttag(tag, [])
            return m.end()
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        if self.cdata_elem is None and (m := _BARE_END.match(self.rawdata, i)):
            self.handle_endtag(m[1].lower())
            return m.end()
        return super().parse_endtag(i)

    def handle_starttag(self, tag, attrs):
        stack = self.open
        if tag in CLOSES:
            closes = CLOSES[tag]
            while len(stack) > 1 and stack[-1].tag in closes:
                stack.pop()
        node = _Node(tag)
        stack[-1].items.append(node)
        if tag not in VOID:
            stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(_Node(tag))

    def handle_endtag(self, tag):
        if len(self.open) > 1 and self.open[-1].tag == tag:  # as in most pages
            self.open.pop()
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in SCOPES and tag not in SCOPES:
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


class _Writer:
    """Text that is put together piece by piece, with an eye on its last character."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def put(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last = s[-1]

    def fresh_line(self, n: int = 1) -> None:
        if self.last and self.last != "\n":
            self.put("\n" * n)

    def word(self, s: str) -> None:
        if self.last and self.last not in "\n ":
            self.put(" ")
        self.put(s)

    def text(self) -> str:
        return "".join(self.parts)


def render_table(rows: list[list[str]], form: str) -> str:
    if form == "markdown":
        lines = ["| " + " | ".join(r) + " |" if r else "|" for r in rows]
        lines[1:1] = ["|" + " --- |" * len(rows[0])]
        return "\n".join(lines) + "\n"
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
        return out.getvalue()
    return "".join("\t".join(r) + "\n" for r in rows)


class _Renderer:
    """Writes a tree as text.

    A tag's rule gives the steps that stand for it: strings, nodes, and actions
    on the innermost writer. Steps wait on a stack, so that any depth is borne.
    """

    def __init__(self, o: Options):
        self.o, self.writers, self.rules = o, [_Writer()], _rules(o)

    def render(self, root: _Node) -> str:
        steps, rules, writers = root.items[::-1], self.rules, self.writers
        while steps:
            x = steps.pop()
            if type(x) is _Node:
                rule = rules.get(x.tag)
                steps += (rule(self, x) if rule else x.items)[::-1]
            elif type(x) is not str:
                x()
            elif x := x.strip():
                writers[-1].word(x)
        return writers[-1].text()

    def nothing(self, node: _Node) -> list:
        return []

    def line_end(self, node: _Node) -> list:
        return [self.raw("\n")]

    def raw(self, s: str) -> Callable[[], None]:
        return lambda: self.writers[-1].put(s)

    def fresh(self, n: int = 1) -> Callable[[], None]:
        return lambda: self.writers[-1].fresh_line(n)

    def block(self, node: _Node) -> list:
        return [self.fresh(), *node.items, self.fresh()]

    def heading(self, node: _Node) -> list:
        mark = "#" * int(node.tag[1]) + " " if self.o.heading_format == "markdown" else ""
        return [self.fresh(2), self.raw(mark), *node.items, self.raw("\n\n")]

    def table(self, node: _Node) -> list:
        cells = [[" ".join(c.strings()).strip() for c in row.find("td", "th")] for row in node.find("tr")]
        return [self.fresh(), self.raw(render_table(cells, self.o.table_format) if cells else ""), self.raw("\n")]

    def listing(self, node: _Node) -> list:
        steps = [self.fresh()]
        for k, item in enumerate(node.find("li"), 1):
            steps += [lambda: self.writers.append(_Writer()), *item.items, self.entry(f"{k}. " if node.tag == "ol" else "- ")]
        return [*steps, self.raw("\n")]

    def entry(self, mark: str) -> Callable[[], None]:
        def close() -> None:
            body = self.writers.pop().text().strip()
            self.writers[-1].put(f"{mark}{body}\n")

        return close

    def code(self, node: _Node) -> list:
        return [self.fresh(), self.raw("```\n" + "".join(node.strings())), self.fresh(), self.raw("```\n")]


@lru_cache
def _rules(o: Options) -> dict[str, Callable[[_Renderer, _Node], list]]:
    """Rules by tag, made once for some options."""
    rules = dict.fromkeys(BLOCKS, _Renderer.block) | {"br": _Renderer.line_end}
    if o.headings:
        rules |= {f"h{k}": _Renderer.heading for k in range(1, 7)}
    if o.tables:
        rules["table"] = _Renderer.table
    if o.lists:
        rules |= {"ul": _Renderer.listing, "ol": _Renderer.listing}
    if o.code:
        rules |= {"pre": _Renderer.code, "code": _Renderer.code}
    return rules | dict.fromkeys(SKIPPED, _Renderer.nothing)


def html(data: bytes, o: Options = Options()) -> Extracted:
    root = _Tree().read(strict(data, "HTML"))
    return Extracted(_Renderer(o).render(next(root.find("body"), root)).strip())


def xml(data: bytes, o: Options = Options()) -> Extracted:
    """Trimmed character data, one after the other."""
    out: list[str] = []
    p = expat.ParserCreate()
    p.buffer_text = True
    p.CharacterDataHandler = lambda s: out.append(s.strip())
    p.StartElementHandler = p.CommentHandler = lambda *_: None  # ends a run of character data
    p.EndElementHandler = p.ProcessingInstructionHandler = lambda *_: None
    try:
        p.Parse(strict(data, "XML").encode(), True)
    except expat.ExpatError as e:
        if not out:
            raise ExtractionError(f"XML: {e}") from e
    return Extracted("".join(out))


def _strings(value, path: str, o: Options):
    """(path, text) of what a JSON value says: strings, and other scalars if formatting is kept."""
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _strings(value[k], f"{path}.{k}" if path else k, o)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _strings(v, f"{path}[{i}]", o)
    elif isinstance(value, str):
        if value.strip():
            yield path, f"{path}: {value}" if o.formatting and path else value
    elif value is not None and o.formatting and path:
        yield path, f"{path}: {json.dumps(value)}"


def json_text(data: bytes, o: Options = Options()) -> Extracted:
    try:
        value = json.loads(strict(data, "JSON"))
    except ValueError as e:
        raise ExtractionError(f"invalid JSON: {e}") from e
    found = list(_strings(value, "", o))
    return Extracted("\n".join(t for _, t in found), {"format": "json", "paths": [p for p, _ in found if p], "is_array": isinstance(value, list), "is_object": isinstance(value, dict)})


def ndjson(data: bytes, o: Options = Options()) -> Extracted:
    records, paths, n = [], set(), 0
    for line in strict(data, "NDJSON").split("\n"):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError:
            continue  # other lines still count
        found = list(_strings(value, f"[{n}]", o))
        if found:
            records.append(" ".join(t for _, t in found))
        paths |= {p for p, _ in found}
        n += 1
    return Extracted("\n".join(records), {"format": "ndjson", "record_count": n, "unique_paths": sorted(paths)})


_ITEM = re.compile(r"(?:[-*+] |\d*\. )(.*)", re.S)


def markdown(data: bytes, o: Options = Options()) -> Extracted:
    text = strict(data, "Markdown")
    out: list[str] = []
    heads: list[dict] = []
    fence = ""
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.lstrip()
        if line[:3] in ("```", "~~~") and (not fence or line.startswith(fence)):
            fence = "" if fence else line[:3]
            out += [line] * o.code
        elif fence:
            out += [line] * o.code
        elif (m := re.match(r"(#{1,6})(?!#)(.*)", line)) and (title := m[2].strip()):
            heads.append({"level": len(m[1]), "text": title, "line": number})
            out.append(line if o.headings else title)
        elif m := _ITEM.fullmatch(bare):
            if o.lists:
                out.append(line)
            elif m[1].strip():
                out.append(m[1].strip())
        elif bare.startswith(">"):
            out.append(line if o.formatting else bare.lstrip(">").strip())
        elif re.fullmatch(r"(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,}", bare.strip()):
            out += [line] * o.formatting
        else:
            out.append(line)
    meta = {"format": "markdown", "heading_count": len(heads), "has_code_blocks": "```" in text or "~~~" in text, "has_tables": any("|--" in x for x in text.splitlines()), "headings": heads}
    return Extracted("\n".join(out), meta)


_TIMES = [re.compile(p) for p in TIMESTAMPS]
_LEVEL = re.compile(LEVELS)


def is_log(text: str) -> bool:
    first = text.splitlines()[:10]
    return bool(first) and sum(any(p.match(x.strip()) for p in _TIMES) for x in first) / len(first) > 0.3


def log(data: bytes, o: Options = Options()) -> Extracted:
    lines = strict(data, "log file").splitlines()
    out: list[str] = []
    levels: Counter = Counter()
    kinds = []
    for line in lines:
        bare = line.strip()
        if not bare:
            out += [""] * o.formatting
            continue
        kind = next((i for i, p in enumerate(_TIMES) if p.match(bare)), None)
        if kind is not None:
            kinds.append(kind)
        if m := _LEVEL.search(bare):
            levels[m[1].upper()] += 1
        out.append(line if o.formatting else " ".join(bare.split()))
    form = f"pattern_{kinds[0]}" if kinds else None
    return Extracted("\n".join(out), {"format": "log", "entry_count": len(kinds), "line_count": len(lines), "detected_format": form, "log_levels": dict(levels), "has_timestamps": bool(kinds)})


def mail_html(source: str) -> str:
    for tag in ("script", "style"):
        source = re.sub(rf"(?is)<{tag}[^>]*>.*?</{tag}>", "", source)
    for a, b in BREAKS:
        source = source.replace(a, b)
    source = re.sub(r"<[^>]+>", "", source)
    for a, b in ENTITIES:
        source = source.replace(a, b)
    return "\n".join(x for x in map(str.strip, source.splitlines()) if x)


#: Attachments that are never read, and those that are read as text.
SKIPPED_ATTACHMENTS = set("exe dll so dylib bin zip tar gz rar 7z png jpg jpeg gif bmp ico mp3 mp4 avi mov".split())
READ_ATTACHMENTS = {"text/plain", "text/html", "text/csv"}


#: Longest header that is kept after it was parsed.
KEPT_HEADER = 1000
_header = lru_cache(256)(policy.default.header_fetch_parse)


class _Once(policy.EmailPolicy):
    """The default policy, but a header isn't parsed again each time that it is asked for."""

    def header_fetch_parse(self, name, value):
        return _header(name, value) if type(value) is str and len(value) <= KEPT_HEADER else super().header_fetch_parse(name, value)


def email(data: bytes, o: Options = Options()) -> Extracted:
    m = BytesParser(policy=_Once()).parsebytes(data)
    if not m.keys():
        raise ExtractionError("not an email message")
    head = lambda k: str(m[k] or "")
    people = lambda k: [a.addr_spec for a in m[k].addresses] if m[k] else []
    date = m["Date"].datetime.isoformat() if m["Date"] and getattr(m["Date"], "datetime", None) else ""
    said = {"Subject": head("Subject"), "From": next(iter(people("From")), ""), "To": ", ".join(people("To")), "Date": date}
    parts = [f"{k}: {v}" for k, v in said.items() if v] + [""]
    attached: list[tuple[str, str, bytes]] = []

    def visit(part) -> None:
        kind = part.get_content_type()
        if kind == "message/rfc822":
            inner = part.get_payload(0)
            if inner["Subject"]:
                parts.append(f"\n--- Forwarded Message ---\nSubject: {inner['Subject']}")
            parts.extend(p.get_content() for p in inner.walk() if p.get_content_type() == "text/plain")
        elif part.is_multipart():
            for p in part.iter_parts():
                visit(p)
        elif part.is_attachment() or part.get_content_maintype() != "text":
            name = part.get_filename() or "attachment"
            body = part.get_payload(decode=True) or b""
            if o.attachments and len(body) <= o.max_attachment and name.rpartition(".")[2].lower() not in SKIPPED_ATTACHMENTS:
                attached.append((name, kind, body))
        else:
            parts.append(mail_html(part.get_content()) if kind == "text/html" else part.get_content())

    visit(m)
    text = "\n".join(parts)
    read = [f"[{n}]\n{mail_html(decode(b)) if k == 'text/html' else decode(b)}" for n, k, b in attached if k in READ_ATTACHMENTS]
    if read:
        text += "\n\n--- Attachments ---\n" + "\n\n".join(read)
    meta = {"format": "email", **{k.lower(): v for k, v in said.items()}, "attachment_count": len(attached), "attachments": [{"filename": n, "content_type": k, "size": len(b)} for n, k, b in attached], "message_id": head("Message-ID").strip("<>")}
    return Extracted(text, meta)


def _open_zip(data: bytes, what: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractionError(f"{what}: {e}") from e


#: Fixed layouts: an archive's end, an entry of its directory and the header of a member, each without names.
ZIP_END, ZIP_ENTRY, ZIP_HEADER = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def _directory(data: bytes) -> dict[str, tuple] | None:
    """(offset, end, method, CRC, packed size, size) of an archive's members by name; None if it is unlike most and zipfile has to read it."""
    end = len(data) - ZIP_END.size
    if end < 0:
        return None
    sig, *disks, n, total, size, at, comment = ZIP_END.unpack_from(data, end)
    if sig != b"PK\5\6" or any(disks) or n != total or comment or at + size != end or data[max(0, end - 20) : end].startswith(b"PK\6\7"):
        return None
    found, stop, before = {}, at, -1
    while at + ZIP_ENTRY.size <= end:
        sig, _, need, flags, method, _, _, crc, packed, size, named, extra, said, _, _, _, offset = ZIP_ENTRY.unpack_from(data, at)
        name = data[at + ZIP_ENTRY.size : at + ZIP_ENTRY.size + named]
        if sig != b"PK\1\2" or need & 255 > 20 or flags & ~0x80E or method not in (0, 8) or extra or said or offset <= before or not name.isascii() or b"\0" in name or name.decode() in found:
            return None
        found[name.decode()] = [offset, stop, method, crc, packed, size]
        at, before = at + ZIP_ENTRY.size + named, offset
    members = list(found.values())
    for m, following in zip(members, members[1:]):
        m[1] = following[0]
    return found if at == end else None


class _Parts:
    """Members of an archive in memory, read at once by their places; whatever is unlike most archives is left to zipfile."""

    def __init__(self, data: bytes, what: str):
        self.data, self.what, self.found = data, what, _directory(data)
        self.zip = None if self.found is not None else _open_zip(data, what)

    def namelist(self) -> list[str]:
        return self.zip.namelist() if self.found is None else list(self.found)

    def read(self, name: str) -> bytes:
        body = self.member(name) if self.found and name in self.found else None
        if body is None:
            self.zip = self.zip or _open_zip(self.data, self.what)
            return self.zip.read(name)
        return body

    def member(self, name: str) -> bytes | None:
        """A member whose header, sizes and checksum agree; else None."""
        offset, end, method, crc, packed, size = self.found[name]
        at = offset + ZIP_HEADER.size
        if at > end:
            return None
        sig, *_, named, extra = ZIP_HEADER.unpack_from(self.data, offset)
        start = at + named + extra
        if sig != b"PK\3\4" or self.data[at : at + named] != name.encode() or start + packed > end:
            return None
        body = self.data[start : start + packed]
        if method:
            inflate = zlib.decompressobj(-15)
            try:
                body = inflate.decompress(body, size + 1)  # one byte more tells that the size is wrong
            except zlib.error:
                return None
            if not inflate.eof or inflate.unused_data:
                return None
        return body if len(body) == size and zlib.crc32(body) == crc else None


def _xml_text(source: bytes, texts: set[str], breaks: set[str], tabs: set[str] = frozenset(), per_text: str = "") -> str:
    """Text of an XML part's elements in the order of their ends, at any depth."""
    out, left = [], [ElementTree.fromstring(source)]
    while left:  # elements before what they hold, from the last to the first: their ends backwards
        e = left.pop()
        name = e.tag.rpartition("}")[2]
        if name in breaks:
            out.append("\n")
        if name in tabs:
            out.append("\t")
        if name in texts and e.text:
            out.append(e.text + per_text)
        left += e
    return "".join(out[::-1])


def _core(z: _Parts, name: str) -> dict:
    """Metadata of an office file: the named part's simple elements."""
    if name not in z.namelist():
        return {}
    try:
        return {e.tag.rpartition("}")[2]: e.text.strip() for e in ElementTree.fromstring(z.read(name)).iter() if e.text and e.text.strip()}
    except ElementTree.ParseError:
        return {}


def _office(pick: Callable[[str], bool], texts: set[str], breaks: set[str], per_text: str = "", first: bool = False):
    def run(data: bytes, o: Options = Options()) -> Extracted:
        z = _Parts(data, "office file")
        names = [n for n in z.namelist() if pick(n)]
        if len(names) > 1:
            names.sort(key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        if not names:
            raise ExtractionError("office file: no content part")
        try:
            text = "".join(_xml_text(z.read(n), texts, breaks, {"tab"}, per_text) for n in (names[:1] if first else names))
        except ElementTree.ParseError as e:
            raise ExtractionError(f"office file: {e}") from e
        return Extracted(text, {"format": "office", **_core(z, "docProps/core.xml")})

    return run


docx = _office(lambda n: n.endswith("document.xml"), {"t"}, {"p", "br"}, first=True)
xlsx = _office(lambda n: n == "xl/sharedStrings.xml" or n.startswith(("xl/charts/", "xl/worksheets/")) and n.endswith(".xml"), {"t"}, set(), "\n")
pptx = _office(lambda n: n.startswith("ppt/slides") and n.endswith(".xml"), {"t"}, {"p"})


def opendocument(data: bytes, o: Options = Options()) -> Extracted:
    """All text of content.xml, a line for each paragraph or heading."""
    z = _Parts(data, "OpenDocument file")
    if "content.xml" not in z.namelist():
        raise ExtractionError("OpenDocument file: no content.xml")
    out: list[str] = []

    def visit(e) -> None:
        name = e.tag.rpartition("}")[2]
        out.append(e.text or "")
        if name == "s":
            out.append(" ")
        elif name in ("tab", "table-cell"):
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        for c in e:
            visit(c)
            out.append(c.tail or "")
        if name in ("p", "h"):
            out.append("\n")

    body = ElementTree.fromstring(z.read("content.xml"))
    visit(next((e for e in body.iter() if e.tag.endswith("}body")), body))
    return Extracted("".join(out), {"format": "opendocument", **_core(z, "meta.xml")})


def epub(data: bytes, o: Options = Options()) -> Extracted:
    """The spine's pages in reading order, and the package's metadata."""
    z = _Parts(data, "EPUB")
    names = set(z.namelist())
    package = None
    if "META-INF/container.xml" in names:
        root = next((e for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile")), None)
        package = root.get("full-path") if root is not None else None
    if package not in names:
        raise ExtractionError("EPUB: no package document")
    tree = ElementTree.fromstring(z.read(package))
    base = package.rpartition("/")[0]
    files = {e.get("id"): (f"{base}/" if base else "") + e.get("href", "") for e in tree.iter() if e.tag.endswith("}item")}
    pages = [files.get(e.get("idref")) for e in tree.iter() if e.tag.endswith("}itemref")]
    meta = {e.tag.rpartition("}")[2]: e.text.strip() for e in tree.iter() if "purl.org/dc" in e.tag and e.text}
    texts = [" ".join(html(z.read(p)).text.split()) for p in pages if p in names]
    return Extracted("\n\n".join(t for t in texts if t), {"format": "epub", "pages": len(pages), **meta})


#: RTF groups without text of the document, and control words that stand for characters.
RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "themedata", "datastore", "listtable", "listoverridetable", "rsidtbl", "generator"}
RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "\t", "row": "\n"}
_RTF = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def rtf(data: bytes, o: Options = Options()) -> Extracted:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ExtractionError("not an RTF file")
    m = re.search(rb"\\ansicpg(\d+)", data)
    page = f"cp{m[1].decode()}" if m else "cp1252"
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, uc, hold = False, 1, 0
    for t in _RTF.finditer(data):
        word, arg, hexed, symbol, brace, plain = t.groups()
        if brace == b"{":
            stack.append((skip, uc))
        elif brace == b"}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif word:
            w = word.decode()
            if w in RTF_SKIPPED:
                skip = True
            elif w == "uc":
                uc = int(arg or 1)
            elif w == "u" and not skip:
                out.append(chr(int(arg) % 65536))
                hold = uc
            elif not skip and w in RTF_CHARS:
                out.append(RTF_CHARS[w])
        elif symbol == b"*":
            skip = True
        elif skip:
            continue
        elif hexed:
            if hold:
                hold -= 1
            else:
                out.append(bytes.fromhex(hexed.decode()).decode(page, "replace"))
        elif symbol:
            out.append({b"~": "\u00a0", b"_": "-", b"-": ""}.get(symbol, symbol.decode("latin-1")))
        elif plain:
            s = plain.decode(page, "replace")
            out.append(s[hold:])
            hold = max(0, hold - len(s))
    info = {k.decode(): v.decode(page, "replace").strip() for k, v in re.findall(rb"\{\\(title|author|subject|keywords) ([^{}]*)\}", data)}
    return Extracted("".join(out), {"format": "rtf", "font_count": len(re.findall(rb"\{\\f\d+", data)), "charset": page, **info})


def legacy_office(data: bytes, o: Options = Options()) -> Extracted:
    """OLE files: runs of printable characters, in one or two bytes each; records are not parsed."""
    if not data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise ExtractionError("not an OLE file")
    wide = [x.decode("utf-16-le") for x in re.findall(rb"(?:[\x20-\x7e\r\n\t]\x00){6,}", data)]
    narrow = [x.decode("ascii") for x in re.findall(rb"[\x20-\x7e\r\n\t]{12,}", data)]
    return Extracted("\n".join(x.replace("\r", "\n").strip() for x in wide + narrow), {"format": "ole"})


#: Types by extension, and members of archives that are skipped.
TYPES = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "json": "application/json", "ndjson": "application/x-ndjson", "jsonl": "application/x-ndjson", "xml": "application/xml",
    "html": "text/html", "htm": "text/html", "csv": "text/csv", "log": "text/x-log", "eml": "message/rfc822", "rtf": "application/rtf", "epub": "application/epub+zip", "pdf": "application/pdf",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "gzip": "application/gzip",
}
SKIPPED_MEMBERS = set("exe dll so dylib bin obj o a png jpg jpeg gif ico bmp webp svg mp3 mp4 wav avi mov mkv flv wmv".split())
OCTETS = "application/octet-stream"


def guess_type(name: str) -> str:
    return TYPES.get(name.rpartition(".")[2].lower(), OCTETS)


def likely_text(data: bytes) -> bool:
    head = data[:1024]
    return bool(head) and sum(0x21 <= b <= 0x7E or b in b" \t\n\x0c\r" for b in head) / len(head) > 0.9


def members(data: bytes, kind: str, o: Options = Options()):
    """(path, text or None, error or None) of an archive's files; what comes after the size limit is left out."""
    if o.depth >= o.max_depth:
        raise ExtractionError(f"archives nest deeper than {o.max_depth}")
    total, inside = 0, replace(o, depth=o.depth + 1, append_metadata=False)

    def files():
        if kind == "zip":
            z = _open_zip(data, "ZIP")
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, lambda n, i=i: z.open(i).read(n)
        else:
            import tarfile

            with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                for i in tar:
                    if i.isfile():
                        yield i.name, lambda n, i=i: tar.extractfile(i).read(n)

    for path, read in files():
        if path.rpartition(".")[2].lower() in SKIPPED_MEMBERS:
            continue
        try:
            body = read(o.max_total - total + 1)  # one byte more tells that the limit is passed
        except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error) as e:
            yield path, None, str(e)
            continue
        total += len(body)
        if total > o.max_total:
            return
        mime = guess_type(path)
        try:
            if mime == OCTETS:
                if not likely_text(body):
                    raise UnsupportedType(f"unsupported type of {path}")
                mime = "text/plain"
            yield path, extract(mime, body, inside).text, None
        except ExtractionError as e:
            yield path, None, str(e)


def archive(kind: str):
    def run(data: bytes, o: Options = Options()) -> Extracted:
        found = list(members(data, kind, o))
        good = [(p, t) for p, t, e in found if e is None]
        meta = {"format": kind, "file_count": len(good), "failed_count": len(found) - len(good), "failed": [{"path": p, "error": e} for p, _, e in found if e]}
        return Extracted("\n\n".join(f"--- {p} ---\n{t}" for p, t in good), meta)

    return run


def gz(data: bytes, o: Options = Options()) -> Extracted:
    """A compressed tar archive, or else one compressed file."""
    import gzip
    import tarfile

    try:
        return archive("tar")(data, o)
    except tarfile.TarError:
        pass
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            body = f.read(o.max_total + 1)[: o.max_total]
    except (OSError, EOFError, zlib.error) as e:
        raise ExtractionError(f"gzip: {e}") from e
    return Extracted(decode(body), {"format": "gzip"})


def plain(data: bytes, o: Options = Options()) -> Extracted:
    text = decode(data)
    return log(text.encode(), o) if is_log(text) else Extracted(text)


def pdf(data: bytes, o: Options = Options()) -> Extracted:
    try:
        import pypdf
    except ModuleNotFoundError as e:
        raise UnsupportedType("PDF needs the optional package pypdf") from e
    r = pypdf.PdfReader(io.BytesIO(data))
    return Extracted("\n".join(p.extract_text() or "" for p in r.pages), {"format": "pdf", "page_count": len(r.pages), **{k.lstrip("/").lower(): str(v) for k, v in (r.metadata or {}).items()}})


EXTRACTORS: dict[str, Callable[[bytes, Options], Extracted]] = {
    "text/plain": plain,
    "text/csv": lambda d, o: Extracted(decode(d)),
    "text/html": html,
    "application/xhtml+xml": html,
    "text/xml": xml,
    "application/xml": xml,
    "application/json": json_text,
    "application/x-ndjson": ndjson,
    "text/markdown": markdown,
    "text/x-log": log,
    "message/rfc822": email,
    "application/pdf": pdf,
    "application/rtf": rtf,
    "text/rtf": rtf,
    "application/epub+zip": epub,
    "application/zip": archive("zip"),
    "application/gzip": gz,
    **{TYPES[k]: docx for k in ("docx",)},
    **{TYPES[k]: xlsx for k in ("xlsx",)},
    **{TYPES[k]: pptx for k in ("pptx",)},
    **{TYPES[k]: opendocument for k in ("odt", "ods", "odp")},
    **{TYPES[k]: legacy_office for k in ("doc", "xls", "ppt")},
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template": docx,
    "application/vnd.ms-word.document.macroenabled.12": docx,
}


def _title(key: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in key.replace("_", " ").split())


def _say(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "Yes" if v else "No"
    if isinstance(v, dict):
        inner = ", ".join(f"{k}: {s}" for k in sorted(v) if (s := _say(v[k])))
        return f"{{ {inner} }}" if inner else ""
    if isinstance(v, (list, tuple)):
        return ", ".join(s for s in map(_say, v) if s)
    return str(v)


def with_metadata(text: str, metadata: dict) -> str:
    """The text with what its metadata says below it."""
    said = [f"- {_title(k)}: {s}" for k in sorted(metadata) if (s := _say(metadata[k]))]
    return "\n".join([text, "\n---\nDocument Metadata:\n", *said]) if said else text


def extract(mime: str, data: bytes, o: Options = Options()) -> Extracted:
    """Cleaned text and metadata of a file; UnsupportedType if there is no extractor for its type."""
    f = EXTRACTORS.get(mime.partition(";")[0].strip().lower())
    if f is None:
        raise UnsupportedType(f"unsupported type {mime}")
    try:
        out = f(data, o)
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"{mime}: {e}") from e
    text = clean(out.text)
    return Extracted(with_metadata(text, out.metadata) if o.append_metadata else text, out.metadata if o.metadata else {})
