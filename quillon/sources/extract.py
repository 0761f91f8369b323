"""Text of one file as blocks: what a document reader runs for each file, format by format. Small helpers without state."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from html.entities import html5

#: Named entities that are read; titles that say less than the file's name; elements of a page that are not text; those that end a paragraph.
ENTITIES = "amp lt gt quot apos nbsp laquo raquo rsquo lsquo ldquo rdquo hellip ndash mdash euro eacute egrave ecirc agrave acirc ccedil ocirc ucirc ugrave icirc iuml euml oelig Eacute Egrave Agrave Ccedil".split()
JUNK_TITLE = re.compile(r"^(microsoft|untitled|sans titre)|\.(docx?|pdf|odt)$", re.IGNORECASE)
HIDDEN = "script|style|noscript|svg|template|head"
ENDS = "p div li tr table section article blockquote pre ul ol dd dt header footer main aside figcaption".split()
KINDS = {"pdf": "pdf", "md": "md", "markdown": "md", "txt": "txt", "docx": "docx", "htm": "html", "html": "html"}

ENTITY = re.compile(r"&(#x[0-9a-f]+|#[0-9]+|[a-z]+);", re.IGNORECASE)
PIECE = re.compile(rf"<!--.*?-->|<({HIDDEN})\b.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b[^>]*>|<[^>]+>", re.IGNORECASE | re.DOTALL)
BLANK = re.compile(r"\n\s*\n")
HASHES = re.compile(r"#{1,6}\s")
#: What Markdown marks become, in this order.
MARKS = [
    (re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""),
    (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"^\s*(?:[-*+]|[0-9]+\.)\s+", re.MULTILINE), "• "),
    (re.compile(r"^\s*>\s?", re.MULTILINE), ""),
    (re.compile(r"[*_`~]{1,3}([^*_`~]+)[*_`~]{1,3}"), r"\1"),
    (re.compile(r"^```.*$", re.MULTILINE), ""),
]

Blocks = list[tuple[str, bool, bool]]


class Refused(Exception):
    """A file that gives no text; kind is ``unsupported``, ``damaged``, ``too large`` or ``retry``."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def tidy(text: str) -> str:
    return re.sub("[ \t\xa0]+", " ", text).strip()


def unescaped(text: str) -> str:
    """Entities by number and the named ones of the list as characters; others stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if not name.startswith("#"):
            return html5[f"{name};"] if name in ENTITIES else m[0]
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return ENTITY.sub(one, text)


def decoded(content: bytes) -> str:
    """Strict UTF-8 without its mark, else Windows-1252."""
    try:
        return content.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in content)


def like_heading(text: str) -> bool:
    return "\n" not in text and len(text) <= 80 and any(map(str.isalpha, text)) and text[-1] not in ".,;:!?…)" and (text[0] in "0123456789" or unicodedata.category(text[0]) == "Lu")


def paragraphs(text: str) -> Blocks:
    """(text, heading, guessed) of what stands between blank lines; lone numbers are left out, a short line alone may be a heading."""
    out = []
    for part in map(str.strip, BLANK.split(text)):
        if part and not re.fullmatch("[0-9]+", part):
            guess = like_heading(part)
            out.append((tidy(part if guess else part.replace("\n", " ")), guess, guess))
    return out


def markdown(text: str) -> tuple[str, Blocks]:
    """Title, the first heading of one #, and blocks; a paragraph's headings stand before the rest of it."""
    title, out = "", []
    for part in BLANK.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        rest = []
        for line in part.split("\n"):
            if not HASHES.match(line):
                rest.append(line)
                continue
            heading = tidy(re.sub(r"\s*#+\s*$", "", re.sub(r"^#+\s*", "", line)))
            title = title or (heading if line[1] != "#" else "")
            out.append((heading, True, False))
        body = "\n".join(rest)
        for pattern, to in MARKS:
            body = pattern.sub(to, body)
        if body.strip():
            out.append((tidy(body.strip().replace("\n", " ")), False, False))
    return title, out


def page(source: str) -> tuple[str, Blocks]:
    """Title and blocks of a page in one pass over its tags; a heading that is never closed is text."""
    found = re.search(r"<title[^>]*>(.*?)</title>", source, re.IGNORECASE | re.DOTALL)
    title = re.sub(r"<[^>]+>", "", tidy(unescaped(found[1]))) if found else ""
    out, held, heading, at = [], [], None, 0

    def flush() -> None:
        for part in BLANK.split(unescaped("".join(held))):
            if text := tidy(part.replace("\n", " ")):
                out.append((text, False, False))
        held.clear()

    for m in PIECE.finditer(source):
        held.append(source[at : m.start()])
        at, name = m.end(), (m[3] or "").lower()
        level = len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if level and not m[2] and heading is None:
            flush()
            heading = len(out)
        elif level and m[2] and heading is not None:
            if text := tidy(unescaped(" ".join("".join(held).split()))):
                out.append((text, True, False))
            held.clear()
            heading = None
        elif heading is not None:
            held.append(" ")
        elif m[2]:
            held.append("\n\n" if name in ENDS else " ")
        else:
            held.append({"br": "\n", "li": "• "}.get(name, " "))
    held.append(source[at:])
    flush()
    return title, out


def word(content: bytes, largest: int) -> tuple[str, Blocks]:
    """Title and paragraphs of a DOCX file; a style named after headings makes one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if archive.getinfo("word/document.xml").file_size > largest:
                raise Refused("too large", "word/document.xml")
            xml = archive.read("word/document.xml").decode("utf-8", "replace")
            core = archive.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in archive.namelist() else ""
    except (zipfile.BadZipFile, KeyError, OSError, EOFError) as e:
        raise Refused("damaged", f"no readable word/document.xml ({type(e).__name__})") from e
    named = re.search(r"(?s)<dc:title>(.*?)</dc:title>", core)
    out = []
    for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", xml):
        runs = re.finditer(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:(?:tab|br)/>", p)
        if text := tidy(unescaped("".join(" " if m[1] is None else m[1] for m in runs))):
            style = re.search(r'<w:pStyle w:val="([^"]+)"', p)
            out.append((text, bool(style and re.search("heading|titre|title", style[1], re.IGNORECASE)), False))
    return tidy(unescaped(named[1])) if named else "", out


def readable(path: str) -> str:
    """A title from a file's name."""
    return re.sub("_+", " ", re.sub(r"(?<=.)\.[^.]*$", "", path.rpartition("/")[2])).strip()


def kind_of(path: str) -> str | None:
    return KINDS.get(path.rpartition("/")[2].lower().rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


def text_of(path: str, content: bytes, largest: int) -> tuple[str, Blocks]:
    """Title and blocks of a file by its kind; Refused where there is none. PDF is not read here."""
    kind = kind_of(path)
    if kind == "docx":
        title, out = word(content, largest)
    elif kind == "html":
        title, out = page(decoded(content))
    elif kind == "md":
        title, out = markdown(decoded(content))
    elif kind == "txt":
        title, out = "", paragraphs(decoded(content).replace("\r\n", "\n").replace("\r", "\n"))
    else:
        raise Refused("unsupported", f"format not supported ({kind or 'unknown'})")
    return title if title and not JUNK_TITLE.search(title) else readable(path), out
