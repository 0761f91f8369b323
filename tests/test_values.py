"""Canonical JSON, typed fields and French order."""

from pyspark.sql import functions as F

from quillon.functions import values as vl


def test_canonical_json(spark):
    same = ['{"b": [1, {"y": 2, "x": null}], "a": "é\\"q"}', ' {"a":"é\\"q","b":[1,{"x":null,"y":2}]}']
    rows = [(k, t) for k, t in enumerate([*same, '{"a": 1}', '{"a": 2}', "no json", None, '{"a":1,"a":2}', "[]", '"x"', '{"b": [{"x": null, "y": 2}, 1], "a": "é\\"q"}'])]
    found = {r.k: r.c for r in spark.createDataFrame(rows, "k int, t string").select("k", vl.canonical_json(F.col("t")).alias("c")).collect()}
    assert found[0] == found[1] == '{"a":"é\\"q","b":[1,{"x":null,"y":2}]}' and found[2] != found[3] and found[9] != found[0]
    assert [found[k] for k in (4, 5, 6)] == [None] * 3 and (found[7], found[8]) == ("[]", '"x"')


def test_typed_fields(spark):
    rows = [(1, '{"t": "  title "}'), (2, '{"t": 5}'), (3, '{"t": ""}'), (4, "{}"), (5, '{"t": {"x": 1}}'), (6, "[")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", vl.text_field(F.try_parse_json("t"), "$.t", 4).alias("v"))
    assert {r.k: r.v for r in df.collect()} == {1: "titl", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_french_order(spark):
    names = ["Zèbre", "école", "Ecole", "eau", "Éclair", "abri", "Abri", "ecole", "œuf", "oeil"]
    found = [r.n for r in spark.createDataFrame([(x,) for x in names], "n string").orderBy(vl.in_language(F.col("n"), "fr")).collect()]
    assert found == ["abri", "Abri", "eau", "Éclair", "ecole", "Ecole", "école", "oeil", "œuf", "Zèbre"]
