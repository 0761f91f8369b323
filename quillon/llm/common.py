"""What the training-data operators share: stage tables, word splitting, tokenizers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship, table

#: Word separators: space and the five ASCII controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def make_dir(spark: SparkSession, path: str) -> None:
    """Create a folder in whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_at_exit, spark, path)
    return path


def stage(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    at_once: rows that a task holds at most while it writes or reads, for tables with rows of megabytes; by default a row group of
    Parquet, which has at least 100 rows.

    The shuffle files of the job that wrote it are released at its end; release() deletes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    spark.conf.set(CLEANUP, "true")  # for all later jobs of the session: results are in tables, so no shuffle is read twice
    writer = df.write.option("parquet.block.row.count.limit", str(at_once)) if at_once else df.write
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._quillon_path = path
    return found


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, most: int = 8 << 20):
    """Batches for Python workers of at most about ``most`` bytes while jobs run in it; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(*frames: DataFrame) -> None:
    """Delete the tables of stage() that no DataFrame to come will read."""
    for df in frames:
        if path := getattr(df, "_quillon_path", None):
            remove(df.sparkSession, path)


def free(df: DataFrame, name: str) -> str:
    """name, with an underscore for each time that df has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def words(text):
    """Column: the words of a text, in order; null counts as empty. Native."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: (node, label), label the smallest node reachable.

    Alternates the large-star and small-star steps, each a group-by and a join that Spark can split when a node is hot, and
    writes every round to the shared folder. Nodes without an edge are not returned. O(log^2 n) rounds.
    """
    tell = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    before, told = None, tell(now)
    while told != before and told[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(lower.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, told = told, tell(now)
    return now.union(now.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("node"), F.col("b").alias("label"))


class WordIds:
    """Token ids of whole texts by the tokenizers library, with the ids of each distinct word kept.

    For a vocabulary that lower-cases, splits a text by SPLIT and ends each part's last token with END (read from its file; with any
    other one each text goes to the library whole), a text's ids are the ids of its parts in order. Words are split into their parts
    here, and parts not seen before are encoded in one call, where END tells them apart. The library's default holds for its added
    tokens: a literal one, <|endoftext|> say, becomes its own id, wherever it stands in a word. A word that has one, is longer than
    LONG bytes or has characters outside a range where Python and the library surely agree sends its whole text to the library. The
    kept words and parts are bounded in number.
    """

    # How the vocabulary's file says that it normalises and splits, and the mark of a last token.
    NORMAL = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    #: SPLIT for lower-cased words without odd characters, and those: all but letters, digits and punctuation whose classes and
    #: lower case are plain; no combining marks, no super- or subscripts.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[\W_]+")
    ODD = re.compile("[^\\x21-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u017e\\u2010-\\u2027]")
    #: Words and parts kept, bytes of a word, texts learnt at a time.
    KEEP, LONG, LOT = 900_000, 256, 64

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.parts = Tokenizer.from_file(path), {}, {}
        told = json.loads(self.tokenizer.to_str())
        normal, pre, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told["model"]
        split, *rest = pre.get("pretokenizers") or [{}]
        self.known = (
            [x["type"] for x in normal.get("normalizers", [])] == self.NORMAL
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": self.SPLIT}, "Removed", True)
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and (model["type"], model.get("end_of_word_suffix"), told.get("post_processor")) == ("BPE", self.END, None)
        )
        self.added = [x["content"] for x in told["added_tokens"]]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(self.END)]] = True

    def encoded(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of words; None for a word that only the library may split."""
        import numpy as np

        for kept in (self.kept, self.parts):
            if len(kept) > self.KEEP:  # frequent words come early, so the first half stays
                first = list(islice(kept.items(), self.KEEP // 2))
                kept.clear()
                kept.update(first)
        kept, parts = self.kept, self.parts
        whole = b" ".join(words).decode()
        if self.ODD.search(whole.replace(" ", "")) or any(x in whole for x in self.added):
            plain = []
            for word, text in zip(words, whole.split(" "), strict=True):
                if self.ODD.search(text) or any(x in text for x in self.added):
                    kept[word] = None
                else:
                    plain.append(word)
            words, whole = plain, b" ".join(plain).decode()
        lower = whole.lower().split(" ") if words else []
        own = [x if x in parts or x.isalpha() else self.PARTS.findall(x) for x in lower]
        new = {x for x in own if x.__class__ is str}.union(*(x for x in own if x.__class__ is list))
        new = [x for x in new if x not in parts]
        if new:
            ids = self.encoded(" ".join(new))
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
            parts.update(zip(new, [ids[i:j] for i, j in zip([0, *cuts], cuts)], strict=True))
        kept.update(zip(words, [parts[x] if x.__class__ is str else b"".join([parts[y] for y in x]) for x in own], strict=True))

    def texts(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each UTF-8 text (None: empty) as little-endian unsigned 32-bit integers; what is new is learnt for LOT texts at a time."""
        get = self.kept.__getitem__
        for begin in range(0, len(texts), self.LOT):
            lot = [((text or b""), (text or b"").split()) for text in texts[begin : begin + self.LOT]]
            if self.known:
                new = [x for x in set().union(*(words for _, words in lot)) if x not in self.kept and len(x) <= self.LONG]
                if new:
                    self.learn(new)
            for text, words in lot:
                try:
                    if words and (not self.known or b"\x0b" in text or b"\x0c" in text):
                        raise KeyError
                    yield b"".join(map(get, words))
                except (KeyError, TypeError):
                    yield self.encoded(text.decode())


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The process's own WordIds of a vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def vocabulary() -> str:
    """Path of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
