from __future__ import annotations

import random
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tenderlake.operators.outliers import price_outliers
from tenderlake.operators.quantiles import exact_median


def medians(spark, rows, **options):
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    return {r.g: (r.n, r.median) for r in exact_median(df, ["g"], "v", **options).collect()}


def test_against_statistics_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(9, 2)) for _ in range(4001)] + [("hot", 9.25)] * 2001
    rows += [(f"g{rng.randint(0, 40)}", rng.choice([rng.gauss(0, 5), 3.0, -1.5])) for _ in range(2000)]
    rows += [("one", -2.5), ("two", 1.0), ("two", 4.0), ("nulls", None), ("same", 7.0), ("same", 7.0)]
    expected: dict[str, list[float]] = {}
    for g, v in rows:
        if v is not None:
            expected.setdefault(g, []).append(v)
    got = medians(spark, rows)
    assert got == {g: (len(v), statistics.median(v)) for g, v in expected.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=40), st.sampled_from([1 / 1024, 0.5, 100.0]))
def test_any_values_and_widths(spark, values, width):
    got = medians(spark, [("g", v) for v in values], width=width)
    assert got["g"] == (len(values), statistics.median(values))


def test_outlier_scores_by_hand(spark):
    import math

    rng = random.Random(11)
    amounts = [round(rng.lognormvariate(8, 1), 2) for _ in range(60)] + [9e6]
    rows = [
        (str(i), "s", "f", 2020, "R", "obj", "org", "sup", a, "45000000", "1", False, "link")
        for i, a in enumerate(amounts)
    ] + [("small-group", "s", "f", 2020, "R", "o", "o", "s", 1e9, "10000000", "2", False, "l"),
         ("no-amount", "s", "f", 2020, "R", "o", "o", "s", 0.0, "45000000", "1", False, "l")]
    df = spark.createDataFrame(rows, (
        "id_origen string, source string, source_file string, year int, ccaa string, objeto string, "
        "organo_nombre string, adjudicatario_nombre string, importe double, cpv string, "
        "tipo_contrato string, es_acuerdo_marco boolean, link_detalle string"))
    top = price_outliers(df, limit=100).collect()
    logs = [math.log(a) for a in amounts]
    med = statistics.median(logs)
    mad = statistics.median(abs(x - med) for x in logs)
    assert len(top) == len(amounts) and top[0].importe == 9e6 and top[0].peers == 61
    assert top[0].score == round((math.log(9e6) - med) / (1.4826 * mad), 2)
    assert top[0].importe_mediano_peer == round(math.exp(med), 2)
    cheap = price_outliers(df, limit=1, cheapest=True).first()
    assert cheap.importe == min(amounts)
