"""Readers on small files written by the tests."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from quillon.operators.text_units import pack_blocks
from quillon.sources import files as fs


def test_registry_and_decoding(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Mon_fichier-2.txt").write_bytes("café …".encode("cp1252"))
    (tmp_path / "b.md").write_text("﻿# Titre\n- un [lien](x) **fort**\n> dit\n")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / ".hidden.txt").write_text("x")
    df = fs.registry(spark, str(tmp_path))
    rows = {r["path"].rpartition("/")[2]: r for r in df.select("path", "kind", "status", fs.readable_name(F.col("path")).alias("title"), fs.markdown_text(fs.decoded(F.col("content"))).alias("text")).collect()}
    assert set(rows) == {"Mon_fichier-2.txt", "b.md", "c.jpg"}
    assert rows["Mon_fichier-2.txt"]["text"] == "café …" and rows["Mon_fichier-2.txt"]["title"] == "Mon fichier 2"
    assert rows["b.md"]["text"] == "# Titre\nun lien fort\ndit\n"
    assert (rows["c.jpg"]["kind"], rows["c.jpg"]["status"]) == (None, "ignored")


def test_book_pages(spark):
    books = spark.createDataFrame([(1, "un exem-\nple  de\ftexte �� fin\f\n")], "book_id int, text string")
    assert [tuple(r) for r in fs.book_pages(books).orderBy("page").collect()] == [(1, 1, "un exemple de", "exem-ple"), (1, 2, "texte … fin", "")]


def test_archives(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p w:a="1"><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Un &amp; deux</w:t></w:r></w:p><w:p ><w:r><w:t xml:space="preserve">corps</w:t></w:r></w:p></w:document>')
    docs = spark.createDataFrame([("x.docx", bytearray(made.getvalue())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    assert [tuple(r)[2:] for r in fs.docx_blocks(docs).orderBy("pos").collect()] == [("Un & deux", True), ("corps", False)]
    made = io.BytesIO()
    with tarfile.open(fileobj=made, mode="w:gz") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    tars = spark.createDataFrame([("x.tar.gz", bytearray(made.getvalue()))], "path string, content binary")
    assert [(r["name"], r["size"], bytes(r["content"])) for r in fs.tar_entries(tars).collect()] == [("d/a.txt", 3, b"abc")]


def test_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# note\nid1|nom|-|libellé\n")
    assert [tuple(r) for r in fs.pipe_table(spark, str(tmp_path / "p.txt"), ["id", "name", "variant", "label"]).collect()] == [("id1", "nom", None, "libellé")]
    (tmp_path / "o.xml").write_text("<feed><entry k='1'><name>a</name><size>3</size></entry><entry k='2'><name>b</name></entry></feed>")
    got = fs.xml_entries(spark, str(tmp_path / "o.xml"), "entry", "_k int, name string, size long").orderBy("_k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 3), (2, "b", None)]
    (tmp_path / "s.txt").write_text("BSS x\n\tfreq: 2412\n\tfreq: 5180\n\tfreq: 2437\n")
    assert sorted(r["channel"] for r in fs.probe_lines(spark, str(tmp_path / "s.txt")).collect()) == [1, 6]


def test_pack_blocks():
    found = pack_blocks([("Titre", True), ("a" * 1500, False), ("b" * 400, False), ("Suite", True), ("c " * 60, False)])
    assert [s for s, _ in found] == ["Titre", "Titre", "Suite"]
    assert all(-(-len(t) // 4) <= 400 for _, t in found)
