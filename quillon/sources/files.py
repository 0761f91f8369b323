"""Files and catalogues as DataFrames: registries with hashes, texts by format, archives, pipe tables, XML entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship

# Extensions that are read, by kind.
KINDS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "docx": "docx", "htm": "html", "html": "html"}
LARGEST = 64 << 20
#: Where Windows-1252 differs from Latin-1, from Python's own codec; Spark does not decode that page by name.
PAIRS = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
CONTROLS, WINDOWS = ("".join(p[k] for p in PAIRS if p[1]) for k in (0, 1))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime, hash, kind, status, content) of all files under a folder; hidden ones are left out, unknown kinds have status ``ignored``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext)
    shown = files.where(~F.col("path").rlike("/\\.[^/]*$"))
    shown = shown.withColumn("kind", F.when(ext.isin(*KINDS), kind))
    return shown.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "kind", F.when(F.col("kind").isNull(), "ignored").otherwise("waiting").alias("status"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text: strict UTF-8 without its mark, else Windows-1252."""
    raw = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    latin = F.translate(F.decode(raw, "ISO-8859-1"), CONTROLS, WINDOWS)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(latin)


def readable_name(path: Column) -> Column:
    """A title from a file's name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "([^/]+?)(\\.[A-Za-z0-9]+)?$", 1), "[_-]+", " "), " +", " "))


def markdown_text(text: Column) -> Column:
    """Markdown without images, links, bullets, quotes, emphasis and fences; headings keep their #."""
    for rule, to in ((r"(?m)^```.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"(?m)^\s*>\s?", ""), (r"[*_`]{1,3}([^*_`\n]+)[*_`]{1,3}", "$1")):
        text = F.regexp_replace(text, rule, to)
    return text


def book_pages(books: DataFrame) -> DataFrame:
    """(book_id, page, text, cuts) of books (book_id, text) with pages between form feeds: an empty last page is dropped, words cut
    at line ends are joined and kept in ``cuts``, unreadable marks become an ellipsis, blanks are collapsed."""
    parts = F.split("text", "\\f")
    pages = F.when(~F.element_at(parts, -1).rlike("\\S"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = books.select("book_id", F.posexplode(pages).alias("pos", "t"))
    cut = r"(\p{L}+)-\n\s*(\p{Ll}\p{L}*)"
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", cut, "$1$2"), "�+", " … "), "[ \\t]+", " "))
    return rows.select("book_id", (F.col("pos") + 1).alias("page"), text.alias("text"), F.regexp_replace(F.array_join(F.regexp_extract_all("t", F.lit(cut), F.lit(0)), "|"), "\\n\\s*", "").alias("cuts"))


def docx_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, block, heading) of the paragraphs of DOCX files (path, content); a damaged file gives no rows."""

    def run(batches):
        import html
        import io
        import re
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        if archive.getinfo("word/document.xml").file_size > LARGEST:
                            continue
                        xml = archive.read("word/document.xml").decode("utf-8")
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
                    continue
                for pos, p in enumerate(re.findall(r"(?s)<w:p[ >].*?</w:p>", xml)):
                    text = html.unescape("".join(re.findall(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>", p))).strip()
                    if text:
                        rows.append((path, pos, text, bool(re.search(r'<w:pStyle w:val="(?:Heading|Titre|Title)', p))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["path", "pos", "block", "heading"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, pos int, block string, heading boolean")


def tar_entries(files: DataFrame) -> DataFrame:
    """(path, name, size, content) of the regular files in .tar.gz archives; links and other kinds of entries are an error."""

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    for x in archive:
                        if x.isdir():
                            continue
                        if not x.isfile() or x.size > LARGEST or x.name.startswith("/") or ".." in x.name.split("/"):
                            raise ValueError(f"{path}: entry {x.name!r} is not allowed")
                        rows.append((path, x.name, x.size, archive.extractfile(x).read()))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "name", "size", "content"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, name string, size long, content binary")


def pipe_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of values between bars; # begins a comment, - alone is null."""
    return spark.read.csv(path, sep="|", comment="#", nullValue="-", schema=", ".join(f"{n} string" for n in names), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def xml_entries(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row for each element of an XML file, such as catalogue entries; attributes are columns that begin with _."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def probe_lines(spark: SparkSession, path: str) -> DataFrame:
    """(network, channel) from a scan's text: 2.4 GHz lines of the form ``freq: 2412``."""
    f = F.regexp_extract("value", "freq:\\s*(\\d+)", 1).try_cast("int")
    return spark.read.text(path).select(f.alias("network")).where("network between 2412 and 2472").select("network", ((F.col("network") - 2407) / 5).cast("int").alias("channel"))
