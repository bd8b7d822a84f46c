"""What the rows of the similarity join carry."""

from __future__ import annotations

from tenderlake.operators import similar


def test_grams_travel_as_numbers(spark):
    texts = spark.createDataFrame([("abab",), ("abc",), ("xbc",), ("a",)], "texto string")
    found = similar._ordered_grams(texts)
    assert found.schema["grams"].dataType.simpleString() == "array<bigint>"
    grams = {r.texto: r.grams for r in found.collect()}
    assert set(grams) == {"abab", "abc", "xbc"}
    # Once: ab2, ba1, xb1; twice: ab1, bc1. Equal counts come in the order of the texts.
    ab2, ba1, ab1 = grams["abab"]
    xb1, bc1 = grams["xbc"]
    assert ab2 < ba1 < xb1 < ab1 < bc1 and grams["abc"] == [ab1, bc1]


def test_classes_are_named_after_the_join(spark):
    rows = [("R", 2020, 100.0, "abcdefghijklmnop"), ("R", 2020, 100.0, "abcdefghijklmnox"), ("R", 2020, 101.0, "zz")]
    contracts = spark.createDataFrame(rows, "ccaa string, year bigint, importe double, objeto string")
    classes = similar.subject_classes(contracts)
    # A class name is found from the class alone, so candidates need not carry it.
    (pair,) = similar.similar_pairs(classes).collect()
    names = {r.texto: r.clase for r in classes.collect()}
    assert sorted((pair.a, pair.b)) == sorted((names["abcdefghijklmnop"], names["abcdefghijklmnox"])) and pair.distancia == 1
