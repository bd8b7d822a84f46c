"""Transforms of mappings work out each text once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import mapping as M


@pytest.mark.parametrize("name,work", [("amount", "regexp_replace("), ("nif_seudonimizar", "regexp_replace("), ("date_iso", "split(")])
def test_values_are_worked_out_once(spark, name, work):
    df = spark.createDataFrame([("1.234,5",)], "x string").select(M.transforms("s")[name](F.col("x")).alias("y"))
    # Dates have one split for each order of their parts.
    assert df._jdf.queryExecution().analyzed().toString().count(work) == (2 if work == "split(" else 1)
