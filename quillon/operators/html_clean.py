"""A white-list cleaner for HTML fragments: tags are read one by one against a stack, in Arrow batches, never by replacing patterns.

What is not on the list goes: a tag's marks, or with some tags all they hold. Tags are balanced, links and pictures rewritten or
dropped, and the text is kept by section for the search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import ship

# The tags that stay with their attributes; tags that go with all they hold; tags that end a paragraph of text; what
# a numeric or named attribute may say; entities known by name; kinds of picture files.
ALLOWED = {
    "h2": [], "h3": [], "h4": [], "p": [], "ul": [], "ol": ["start"], "li": [], "blockquote": [], "pre": [], "code": [], "table": [], "thead": [], "tbody": [], "tfoot": [], "tr": [],
    "th": ["colspan", "rowspan", "scope"], "td": ["colspan", "rowspan"], "figure": [], "figcaption": [], "img": ["src", "alt", "width", "height"], "a": ["href", "title"], "strong": [], "em": [],
}
WITH_CONTENT = ["script", "style", "iframe", "object", "embed", "noscript", "template", "svg", "math", "title", "textarea", "select", "head"]
BLOCKS = ["h2", "h3", "h4", "p", "ul", "ol", "li", "blockquote", "pre", "table", "tr", "figure", "figcaption"]
VALUES = {"width": r"\d{1,4}", "height": r"\d{1,4}", "colspan": r"\d{1,3}", "rowspan": r"\d{1,3}", "start": r"\d{1,6}", "scope": "row|col|rowgroup|colgroup"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}
PICTURE = r"[a-z0-9][a-z0-9._-]*\.(svg|png|jpe?g|webp|gif)"

#: Rows that are Python objects at a time, in and out.
LOT = 64

TAG = re.compile(r"""</?(?P<name>[A-Za-z][A-Za-z0-9-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
PAIR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z]+);", re.IGNORECASE)


@dataclass(frozen=True)
class Site:
    """Where the fragments come from and where they are shown: links below ``home`` to a known article become ``articles``/category/slug,
    pictures assets/slug/file become ``assets``/slug/file."""

    home: str = "https://example.org/blog/"
    articles: str = "/articles"
    assets: str = "/assets"


@dataclass
class Cleaned:
    html: list[str] = field(default_factory=list)
    sections: list[list[str]] = field(default_factory=lambda: [["", ""]])
    images: list[str] = field(default_factory=list)
    rejected: dict[str, None] = field(default_factory=dict)


def decoded(text: str) -> str:
    """Entities by number and the few by name as characters; others stay."""

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if not name.startswith("#"):
            return ENTITIES.get(name, m[0])
        n = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else ""

    return ENTITY.sub(one, text)


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of each piece: text, open, close; comments and declarations are left out, a lone < is text."""
    at = 0
    while at < len(html):
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            yield "text", "", html[at:end]
            at = end
            continue
        if m := TAG.match(html, at):
            yield "close" if html[at + 1] == "/" else "open", m["name"].lower(), m["rest"]
            at = m.end()
            continue
        marks = [("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">")]
        end = next((e + len(b) for a, b in marks if html.startswith(a, at) and (e := html.find(b, at + len(a))) >= 0), 0)
        if not end:
            yield "text", "", "<"
        at = end or at + 1


def link(href: str, site: Site, articles: dict[str, str]) -> tuple[str, bool] | None:
    """(target, whether it leaves the site) of a link; None for what is neither a place in the page nor http, https or mailto."""
    plain = re.sub("[\x00-\x20\x7f]", "", href)
    if plain.startswith("#") or not plain:
        return (plain, False) if plain else None
    try:
        whole = urljoin(site.home, plain)
        parts = urlsplit(whole)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return None
    if parts.scheme not in ("http", "https", "mailto") or (parts.scheme != "mailto" and not host):
        return None
    home = urlsplit(site.home)
    if host == (home.hostname or "").removeprefix("www.") and parts.path.startswith(home.path):
        slug = re.sub(r"\.html?$", "", parts.path.rstrip("/").rpartition("/")[2])
        if slug in articles:
            return f"{site.articles}/{articles[slug]}/{slug}{'#' + parts.fragment if parts.fragment else ''}", False
    if parts.scheme != "mailto" and not parts.path:
        whole = parts._replace(path="/").geturl()
    return whole, True


def picture(src: str, slug: str, site: Site, assets: set[str]) -> str | None:
    """Where a picture of the article's own is shown; None for any other."""
    parts = src.strip().removeprefix("./").split("/")
    if len(parts) != 3 or parts[0] != "assets" or parts[1] != slug or not re.fullmatch(PICTURE, parts[2], re.IGNORECASE) or "/".join(parts[1:]) not in assets:
        return None
    return f"{site.assets}/{slug}/{parts[2]}"


class Cleaner:
    """One fragment: clean() reads its pieces with a stack of open tags."""

    def __init__(self, slug: str, articles: dict[str, str], assets: set[str], site: Site):
        self.slug, self.articles, self.assets, self.site = slug, articles, assets, site
        self.out, self.stack, self.heading = Cleaned(), [], None

    def say(self, text: str) -> None:
        if self.heading is None:
            self.out.sections[-1][1] += text
        else:
            self.heading += text

    def pop(self) -> str:
        """Close the innermost tag; the end of a heading of the second level begins a section."""
        name = self.stack.pop()
        self.out.html.append(f"</{name}>")
        if name == "h2" and self.heading is not None:
            self.out.sections.append([" ".join(self.heading.split()), ""])
            self.heading = None
        return name

    def close(self, name: str) -> None:
        """Close all tags up to the innermost ``name``; without one nothing happens."""
        if name in self.stack:
            closed = None
            while closed != name:
                closed = self.pop()
                if closed in BLOCKS:
                    self.say("\n\n")

    def open(self, name: str, rest: str) -> None:
        if name in BLOCKS and "p" in self.stack:  # a block ends an open paragraph
            while self.pop() != "p":
                pass
            self.say("\n\n")
        kept, outside = {}, False
        for m in PAIR.finditer(rest):
            key, value = m[1].lower(), decoded(re.sub("^[\"']|[\"']$", "", m[2] or ""))
            if key not in ALLOWED[name]:
                if not key.startswith("data-"):
                    self.out.rejected[f"{name}@{key}"] = None
            elif key in VALUES and not re.fullmatch(VALUES[key], value):
                pass
            elif name == "a" and key == "href":
                if found := link(value, self.site, self.articles):
                    kept[key], outside = found[0], found[1]
                else:
                    self.out.rejected[f"href {value[:40]}"] = None
            elif name == "img" and key == "src":
                shown = picture(value, self.slug, self.site, self.assets)
                if not shown:
                    self.out.rejected[f"img {value[:60]}"] = None
                    return
                self.out.images.append(shown)
                kept[key] = shown
            else:
                kept[key] = value
        if name == "img" and "src" not in kept:
            return
        marks = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in kept.items())
        self.out.html.append(f"<{name}{marks}{' target="_blank" rel="noopener noreferrer" data-external="1"' if outside else ''}>")
        if name == "img":
            return
        if name in BLOCKS:
            self.say("\n\n")
        if name == "h2":
            self.heading = ""
        if name in ("td", "th"):
            self.say(" ")
        self.stack.append(name)

    def clean(self, html: str) -> Cleaned:
        skipped, depth = None, 0
        for kind, name, rest in events(html):
            empty = rest.endswith("/")
            if skipped:
                if name == skipped and kind != "text":
                    depth += -1 if kind == "close" else 0 if empty else 1
                skipped = skipped if depth else None
            elif kind == "text":
                self.out.html.append(rest.replace("<", "&lt;").replace(">", "&gt;"))
                self.say(decoded(rest))
            elif name in WITH_CONTENT:
                self.out.rejected[name] = None
                if kind == "open" and not empty:
                    skipped, depth = name, 1
            elif name not in ALLOWED:
                self.out.rejected[name] = None
                if name in ("br", "div"):
                    self.say("\n\n")
            elif kind == "open":
                self.open(name, rest)
            elif name != "img":
                self.close(name)
        while self.stack:
            self.pop()
        tidy = lambda x: re.sub("\n{3,}", "\n\n", re.sub(" *\n *", "\n", re.sub("[ \t\xa0]+", " ", x))).strip()
        self.out.sections = [s for s in ([title, tidy(text)] for title, text in self.out.sections) if any(s)]
        return self.out


SCHEMA = "html string, sections array<struct<title: string, text: string>>, images array<string>, rejected array<string>"


def known_links(df: DataFrame, key: str, html: str, articles: DataFrame) -> DataFrame:
    """(key, articles map<slug, category>): those of articles (slug, category) that a fragment may link to, by the last part of each
    target; a join, so the list of articles may grow."""
    targets = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    slug = F.regexp_replace(F.regexp_extract("target", r"([^/#?]+)/*(?:[#?].*)?$", 1), r"\.html?$", "")
    each = df.select(key, F.explode(F.array_distinct(targets)).alias("target")).select(key, slug.alias("slug")).distinct()
    return each.join(articles, "slug").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("slug", "category"))).alias("articles"))


def cleaned(df: DataFrame, key: str, html: str, slug: str, articles: DataFrame, assets: str | None = None, site: Site = Site()) -> DataFrame:
    """(key, html, sections, images, rejected) of every row: key must be unique; ``assets`` is a column array<string> of slug/file.

    A null fragment is empty; slugs of articles must be unique."""
    rows = df.select(key, F.coalesce(html, F.lit("")).alias("html"), F.col(slug).cast("string").alias("slug"), (F.col(assets) if assets else F.expr("cast(array() as array<string>)")).alias("assets"))
    rows = rows.join(known_links(df, key, html, articles), key, "left").select(key, "html", "slug", "assets", F.map_entries("articles").alias("articles"))
    name, kind = key, dict(df.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for batch in (whole.slice(k, LOT) for whole in batches for k in range(0, whole.num_rows, LOT)):
            found = []
            for body, own, files, known in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                found.append(Cleaner(own or "", {x["key"]: x["value"] for x in known or []}, set(files or []), site).clean(body))
            sections = pa.array([[{"title": t, "text": x} for t, x in c.sections] for c in found], pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())])))
            lists = [pa.array([list(x) for x in cells], pa.list_(pa.string())) for cells in ([c.images for c in found], [c.rejected for c in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(c.html) for c in found], pa.string()), sections, *lists], [name, "html", "sections", "images", "rejected"])

    ship(df.sparkSession)
    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
