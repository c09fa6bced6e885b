"""Suffix rules compare endings, without a pattern for each token."""

from pyspark.sql import functions as F

from citesift.functions.text import suffix_rules

FORMS = {
    "studies": "study", "ties": "tie", "dishes": "dish", "boxes": "box", "axes": "axe", "zes": "zes", "masses": "mass",
    "mass": "mass", "virus": "virus", "basis": "basis", "gas": "gas", "cells": "cell", "going": "going", "testing": "test",
    "used": "used", "tested": "test", "s": "s", "ing": "ing", "": "", "größen": "größen", None: None,
}


def test_endings(spark):
    rows = spark.createDataFrame([(w,) for w in FORMS], "w string").select("w", suffix_rules(F.col("w")).alias("form"))
    assert {r["w"]: r["form"] for r in rows.collect()} == FORMS
    assert "rlike" not in rows._jdf.queryExecution().analyzed().toString().lower()
