"""The folder data source as a table and as a stream, stops and restarts included; the extractors' rules."""

from __future__ import annotations

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators.snapshots import Store
from quillon.operators.text_units import format_blocks
from quillon.sources import extract
from quillon.sources import folder as fd
from quillon.streaming import watch


def docx(*paragraphs, title="") -> bytes:
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f'<w:p ><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{t}</w:p>' for s, t in paragraphs) + "</w:document>")
        if title:
            z.writestr("docProps/core.xml", f"<dc:title>{title}</dc:title>")
    return made.getvalue()


def put(root, path, content, age=100):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(content if isinstance(content, bytes) else content.encode())
    then = time.time() - age
    os.utime(file, (then, then))
    return file


def load(spark, folder, **options):
    fd.register(spark)
    return spark.read.format(fd.NAME).options(**options).load(str(folder))


def test_formats(spark, tmp_path):
    root = tmp_path / "docs"
    put(root, "a/Mon_plan.2.txt", "Titre court\n\nUn texte qui finit\npar un point.\n\n12\n".encode("cp1252") + b"\n\ncaf\xe9.")
    put(root, "b.MD", "\ufeffintro\n# Le titre #\n- un [lien](x) **fort**\n> dit\n\n```py\ncode\n```\n## Deux\n")
    put(root, "c.html", "<head><title>Untitled 1</title></head><style>x{}</style><h1>Un <b>titre</b>&nbsp;!</h1><p>Bon&eacute; &copy; &#233;<br>suite</p><ul><li>un<li>deux</ul><script>if (a<b) '</p>'</script>fin<h2>ouvert")
    put(root, "d.docx", docx(("Titre1", "<w:r><w:t>Un &amp; deux</w:t></w:r>"), ("", '<w:r><w:t xml:space="preserve">corps</w:t><w:tab/><w:t>x</w:t></w:r>'), ("", ""), title="Le plan"))
    put(root, "e.docx", b"no zip")
    put(root, "f.pdf", b"%PDF")
    put(root, "g", b"?")
    put(root, "empty.txt", b"")
    put(root, ".hidden/x.txt", "x")
    put(root, ".x.txt", "x")
    (root / "link.txt").symlink_to(root / "b.MD")
    found = {r.path: r for r in load(spark, root).collect()}
    assert sorted(found) == ["a/Mon_plan.2.txt", "b.MD", "c.html", "d.docx", "e.docx", "empty.txt", "f.pdf", "g"]
    shown = lambda p: [(b.text, b.heading) for b in found[p].blocks]
    assert found["a/Mon_plan.2.txt"].title == "Mon plan.2"
    assert shown("a/Mon_plan.2.txt") == [("Titre court", True), ("Un texte qui finit par un point.", False), ("café.", False)]
    assert found["b.MD"].title == "Le titre"
    assert shown("b.MD") == [("Le titre", True), ("intro • un lien fort dit", False), ("Deux", True), ("py code", False)]
    assert found["c.html"].title == "c"
    assert shown("c.html") == [("Un titre !", True), ("Boné &copy; é suite", False), ("• un• deux", False), ("fin", False), ("ouvert", False)]
    assert (found["d.docx"].title, shown("d.docx")) == ("Le plan", [("Un & deux", True), ("corps x", False)])
    assert {p: r.error.kind for p, r in found.items() if r.error} == {"e.docx": "damaged", "f.pdf": "unsupported", "g": "unsupported"}
    assert found["empty.txt"].blocks == [] and found["g"].hash is None and found["e.docx"].hash
    small = load(spark, root, bytes="1")
    assert small.rdd.getNumPartitions() == 8 and small.count() == 8
    names = load(spark, root, content="false")
    assert {(r.path, r.hash) for r in names.collect()} == {(p, None) for p in found}


def test_unreadable_and_empty(spark, tmp_path, monkeypatch):
    assert load(spark, tmp_path).count() == 0
    assert load(spark, tmp_path / "none").count() == 0
    lot = fd.Lot(str(tmp_path), [("gone.txt", 3, 1), ("big.txt", fd.LARGEST + 1, 1)])
    assert [r[-1][0] for r in fd.rows(lot)] == ["retry", "too large"]
    with pytest.raises(Exception, match="needs the path"):
        spark.read.format(fd.NAME).load().count()


def state(store):
    return sorted((r.path, [b.text for b in r.blocks or []], r.error.kind if r.error else None) for r in watch.files(store.snapshot()).collect())


def watched(spark, root, store, tmp_path, name="w"):
    assert watch.watching(spark, str(root), store, name, f"{tmp_path}/ck-{name}", once=True).awaitTermination(120)


def test_stream_over_stops(spark, tmp_path):
    root, store = tmp_path / "docs", Store(spark, str(tmp_path / "store"))
    put(root, "a.txt", "un.")
    put(root, "b.txt", "deux.", age=50)
    put(root, "late.txt", "en cours.", age=-3600)  # still being written
    watched(spark, root, store, tmp_path)
    assert state(store) == [("a.txt", ["un."], None), ("b.txt", ["deux."], None)]
    put(root, "a.txt", "un de plus.", age=40)
    put(root, "c.pdf", b"%PDF", age=40)
    commit = store._commit

    def dies(*args):
        raise RuntimeError("killed before the change is named")

    store._commit = dies
    with pytest.raises(Exception, match="killed before"):
        watched(spark, root, store, tmp_path)
    store._commit = commit
    assert state(store) == [("a.txt", ["un."], None), ("b.txt", ["deux."], None)]

    def dies_after(*args):
        commit(*args)
        raise RuntimeError("killed after the change is named")

    store._commit = dies_after
    with pytest.raises(Exception, match="killed after"):
        watched(spark, root, store, tmp_path)
    store._commit = commit
    version = store.snapshot().version
    watched(spark, root, store, tmp_path)  # Spark gives the same batch again
    assert store.snapshot().version == version
    want = [("a.txt", ["un de plus."], None), ("b.txt", ["deux."], None), ("c.pdf", [], "unsupported")]
    assert state(store) == want
    assert store.snapshot().table("files").count() == 4
    watch.compact(store)
    assert state(store) == want and store.snapshot().table("files").count() == 3
    assert [tuple(r)[:3] for r in watch.blocks(store.snapshot()).orderBy("path", "pos").collect()] == [("a.txt", 0, "un de plus."), ("b.txt", 0, "deux.")]


def test_sweep(spark, tmp_path):
    root, store = tmp_path / "docs", Store(spark, str(tmp_path / "store"))
    put(root, "a.txt", "un.")
    gone = put(root, "b.txt", "deux.")
    watch.sweep(spark, str(root), store)
    assert state(store) == [("a.txt", ["un."], None), ("b.txt", ["deux."], None)]
    version = store.snapshot().version
    assert watch.sweep(spark, str(root), store).version == version
    gone.unlink()
    put(root, "old.txt", "vieux.", age=10**6)
    put(root, "a.txt", "un de plus.", age=70)
    watch.sweep(spark, str(root), store)
    assert state(store) == [("a.txt", ["un de plus."], None), ("old.txt", ["vieux."], None)]
    put(root, "b.txt", "revenu.")
    watch.sweep(spark, str(root), store)
    assert [s for s in state(store) if s[0] == "b.txt"] == [("b.txt", ["revenu."], None)]


def test_format_blocks(spark):
    df = spark.createDataFrame([(1, "Tête\n\ncorps."), (2, None), (None, ""), (None, "x.")], "k int, body string")
    assert sorted((tuple(r) for r in format_blocks(df, "k", "body", "txt").collect()), key=str) == [(1, 0, "Tête", True, True), (1, 1, "corps.", False, False), (None, 0, "x.", False, False)]
    assert [r.heading for r in format_blocks(df.select(F.lit(1).alias("k"), F.lit("# a\nb").alias("body")).limit(1), "k", "body", "md").orderBy("pos").collect()] == [True, False]
    assert extract.page("x" * 200_000 + "</p>y")[1][-1][0] == "y"
