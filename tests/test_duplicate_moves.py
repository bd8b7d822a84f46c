"""What moves where duplicates are looked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.operators.duplicates import duplicate_groups, merged_contracts
from tenderlake.operators.linked import sharing

SCHEMA = (
    "source string, entry_id string, source_file_hash string, updated string, estado string, id_origen string, org_id string, "
    "cpv string, adj_id string, fecha_adjudicacion string, importe double, objeto string, organo_nombre string, "
    "tipo_contrato string, territorio_code string, adjudicatario_nombre string"
)


def test_numbers_of_records_that_share_a_key(spark):
    rows = [(0, "a", 1), (1, "a", None), (2, "b", 2), (3, None, 2), (4, None, None), (5, "c", 3), (6, "1", 4), (7, "d", 1)]
    df = spark.createDataFrame(rows, "n bigint, x string, y int")
    found = lambda **more: {r.n for r in sharing(df, "n", [("x",), ("y",)], **more).collect()}
    assert found() == {0, 1, 2, 3, 7}
    assert found(crowd=2) >= {0, 1, 2, 3, 7} and 4 not in found(crowd=2)
    both = {r.n for r in sharing(df, "n", [("x", "y")]).collect()}
    assert both == set()


def test_rows_without_partner_stay_where_they_are(spark):
    rows = spark.range(40).select(*[
        (F.concat(F.lit("e"), F.col("id")) if name == "entry_id" else
         F.concat(F.lit("x"), F.when(F.col("id") < 4, F.col("id") % 2).otherwise(F.col("id"))) if name == "id_origen" else
         F.lit("1") if kind == "string" else F.col("id").cast(kind)).alias(name)
        for name, kind in (c.split() for c in SCHEMA.split(", "))
    ])
    grouped = duplicate_groups(rows, [("id_origen", "org_id")])
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join LeftOuter, (_n#") == 1  # of the rows with a partner alone
    found = grouped.collect()
    assert sorted(r.dup_rows for r in found) == [1] * 36 + [2] * 4
    assert {len(r.dup_group_id) for r in found} == {64} and len({r.dup_group_id for r in found}) == 38
    assert merged_contracts(grouped).count() == 38
    digest = spark.range(1).select(F.sha2(F.lit("1|e9|1"), 256)).first()[0]
    assert [r.dup_group_id for r in found if r.entry_id == "e9"] == [digest]
