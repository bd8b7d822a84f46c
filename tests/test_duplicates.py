"""Duplicate groups, merged rows and similar subjects against plain searches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import similar
from tenderlake.operators.duplicates import MERGED_FIELDS, duplicate_groups, merged_contracts
from tenderlake.operators.linked import key_links, linked_groups

COLUMNS = (
    "source string, entry_id string, source_file_hash string, updated string, estado string, id_origen string, "
    "org_id string, cpv string, adj_id string, fecha_adjudicacion string, importe double, objeto string, "
    "organo_nombre string, tipo_contrato string, territorio_code string, adjudicatario_nombre string, root string"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def contracts(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], COLUMNS)


def row(key, source="contratos_menores", **more):
    return {"source": source, "entry_id": f"e{key}", "source_file_hash": "h", "updated": "2020-01-01", "estado": "RES"} | more


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_groups_of_links(spark):
    g = random.Random(4)
    pairs = [(g.randrange(300), g.randrange(300)) for _ in range(190)]
    pairs += [(1000 + k, 1001 + k) for k in range(25)]  # a long chain
    pairs += [(2000, 2001 + k) for k in range(80)] + [(5, 5)]
    g.shuffle(pairs)
    got = linked_groups(spark.createDataFrame(pairs + [(None, 3), (4, None)], "a int, b int"))
    assert {r.record: r.root for r in got.collect()} == roots([p for p in pairs if p[0] != p[1]])
    assert linked_groups(spark.createDataFrame([], "a int, b int")).count() == 0


def test_alternative_keys(spark):
    g = random.Random(7)
    rows = []
    for k in range(250):
        more = {
            "id_origen": g.choice([None, f"x{g.randrange(150)}"]), "org_id": g.choice(["o1", "o2", "o3", None]),
            "cpv": g.choice(["45", "46"]), "adj_id": g.choice([None, "s1", "s2", "s3"]), "importe": float(g.randrange(1, 12)),
            "fecha_adjudicacion": f"2020-01-{g.randrange(1, 9):02d}", "updated": g.choice([None, "2020-01-01", "2021-02-03"]),
            "estado": g.choice(["RES", "ANUL", None]), "objeto": g.choice([None, f"t{k}"]),
        }
        rows.append(row(k, g.choice(["contratos_menores", "perfil_contratante", "agregaciones", "otra"]), **more))
    rows += [rows[3], row("z", cpv=None, org_id="o9"), row("zz", cpv=None, org_id="o9")]
    record = lambda r: "|".join(r[c] or "" for c in ("source", "entry_id", "source_file_hash"))
    keys = [("id_origen", "org_id"), ("cpv", "org_id", "adj_id", "fecha_adjudicacion", "importe")]
    pairs = [(record(r), record(r)) for r in rows]
    for key in keys:
        first = {}
        for r in rows:
            value = tuple(r.get(c) for c in key)
            if None not in value:
                pairs.append((record(r), first.setdefault(value, record(r))))
    root = roots(pairs)
    rank = {"perfil_contratante": 4, "agregaciones": 3, "contratos_menores": 2}
    status = {"RES": 6, "ANUL": 1}

    def standing(r):
        return (rank.get(r["source"], 0), r["updated"] or "", status.get(r["estado"], 0), r["entry_id"])

    best, members = {}, {}
    for r in rows:
        group = root[record(r)]
        members.setdefault(group, {})[record(r)] = r
        if group not in best or standing(r) > standing(best[group]):
            best[group] = r
    grouped = duplicate_groups(contracts(spark, rows))
    found = grouped.collect()
    assert len(found) == len(rows) and grouped.columns[: len(NAMES)] == NAMES
    names = {}
    for r in found:
        group = root[record(r)]
        assert names.setdefault(group, r.dup_group_id) == r.dup_group_id
        assert r.dup_rows == len(members[group])
        assert r.is_canonical == (record(r) == record(best[group]))
    assert len(set(names.values())) == len(members) > 60
    assert max(len(m) for m in members.values()) > 3

    merged = {r.dup_group_id: r for r in merged_contracts(grouped).collect()}
    assert set(merged) == set(names.values())
    for group, of in members.items():
        got = merged[names[group]]
        for field in MERGED_FIELDS:
            having = [r for r in of.values() if r.get(field) is not None]
            want = max(having, key=standing) if having else {}
            assert got[field] == want.get(field) and got[f"{field}_fuente"] == (want["source"] if want else None)
        assert got.fuentes == len({r["source"] for r in of.values()})


def test_no_contracts(spark):
    none = contracts(spark, [])
    grouped = duplicate_groups(none)
    assert grouped.count() == 0 and merged_contracts(grouped).count() == 0
    assert similar.similar_groups(similar_rows(spark, [])).count() == 0


def test_hot_key_is_split(spark):
    """A key that three quarters of the records share is dealt to several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).select(
            F.concat(F.lit("r"), F.sha2(F.col("id").cast("string"), 256)).alias("record"),
            F.when(F.col("id") % 4 < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        ).repartition(16)
        links = key_links(rows, "record", [("key",)])
        assert len(links.collect()) == 45_000 - 1
        assert "skew=true" in links._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- similar subjects


def similar_rows(spark, rows):
    schema = "ccaa string, year bigint, importe double, objeto string, registros string, near string"
    return spark.createDataFrame([(*r, "x", "x") for r in rows], schema)


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, old = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(old[j] + 1, line[-1] + 1, old[j - 1] + (x != y)))
    return line[-1]


def subjects(n, seed):
    g = random.Random(seed)
    base = ["suministro de material de oficina", "obras de reforma del colegio", "aaaaaaaaaaaaaaaa", "abababababababab",
            "servicio de limpieza de edificios", "servicio de limpieza viaria", "ab", "a", "mantenimiento"]
    rows = []
    for _ in range(n):
        text = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 2, 3, 5])):
            at = g.randrange(len(text) + 1)
            text[at : at + g.randrange(2)] = g.choice(["", "x", "é", "de"])
        rows.append(("".join(text), g.choice(["Norte", "Sur"]), 2020, g.choice([100.0, 105.0, 118.0, 500.0])))
    return [(c, y, a, t) for t, c, y, a in rows]


@pytest.mark.parametrize("percent,hot", [(85, 200), (85, 0), (84, 3), (90, 1)])
def test_similar_pairs(spark, percent, hot):
    rows = subjects(160, percent + hot)
    classes = similar.subject_classes(similar_rows(spark, rows)).collect()
    want = set()
    for a in classes:
        for b in classes:
            if a.clase < b.clase and (a.ccaa, a.year) == (b.ccaa, b.year) and abs(a.tramo - b.tramo) <= 1:
                d = distance(a.texto, b.texto)
                if 100 * d <= (100 - percent) * max(len(a.texto), len(b.texto)):
                    want.add((a.clase, b.clase, d))
    got = similar.similar_pairs(similar.subject_classes(similar_rows(spark, rows)), percent, hot).collect()
    assert len(got) == len(set(got)) and len(want) > 10
    assert {tuple(r) for r in got} == want


def test_similar_groups(spark):
    rows = subjects(80, 3) + [
        (None, 2020, 100.0, "sin region"), ("Norte", None, 100.0, "sin año"), ("Norte", 2020, None, "x"),
        ("Norte", 2020, -5.0, "x"), ("Norte", 2020, 100.0, None), ("Norte", 2020, 100.0, " -- "),
        ("Norte", 2020, 100.0, "Obras de Reforma del COLEGIO."), ("Norte", 2020, 100.0, "obras de reformá del colegio"),
        ("Norte", 2020, 100.0, "texto muy largo " * 120), ("Norte", 2020, 109.0, "texto muy largo " * 119),
    ]
    df = similar_rows(spark, rows)
    found = similar.similar_groups(df).collect()
    assert len(found) == len(rows)
    left_out = [r for r in found if r.clase is None]
    assert len(left_out) == 6 and all(r.n_enlaces is None and r.grupo_difuso is None for r in left_out)
    pairs = [(r.a, r.b) for r in similar.similar_pairs(similar.subject_classes(df)).collect()]
    sizes = {}
    for r in found:
        sizes[r.clase] = sizes.get(r.clase, 0) + 1
    root = roots(pairs + [(c, c) for c in sizes if c])
    for r in found:
        if r.clase:
            near = sum(sizes[b if a == r.clase else a] for a, b in pairs if r.clase in (a, b))
            assert (r.n_enlaces, r.grupo_difuso) == (near + sizes[r.clase] - 1, root[r.clase])
    same = [r.clase for r in found if r.objeto and "olegio" in r.objeto.lower() and r.importe == 100 and r.ccaa == "Norte"]
    assert same.count(max(same, key=same.count)) >= 2
    long = [r for r in found if r.objeto and r.objeto.startswith("texto")]
    assert len({r.grupo_difuso for r in long}) == 1


def test_texts_must_have_enough_grams(spark):
    with pytest.raises(ValueError, match="too few"):
        similar.similar_pairs(similar.subject_classes(similar_rows(spark, [])), percent=50)


def test_rounds_and_links_carry_numbers(spark, monkeypatch):
    """Record keys are long texts; only rows of groups carry them between tasks, not each link."""
    from tenderlake.operators import duplicates, linked

    rows = contracts(spark, [row("a", id_origen="1", org_id="o"), row("b", id_origen="1", org_id="o"), row("c")] * 2)
    kinds = []
    monkeypatch.setattr(duplicates, "linked_groups", lambda links: kinds.append(links.dtypes) or linked_groups(links))
    monkeypatch.setattr(linked, "_state", lambda edges, state=linked._state: kinds.append(edges.dtypes) or state(edges))
    found = duplicate_groups(rows).collect()
    assert {(r.entry_id, r.dup_rows, r.is_canonical) for r in found} == {("ea", 2, False), ("eb", 2, True), ("ec", 1, True)}
    pairs = [("x", "y"), ("z", "y"), ("u", "v")]
    groups = linked.linked_groups(spark.createDataFrame(pairs, "a string, b string"))
    assert {tuple(r) for r in groups.collect()} == {("x", "x"), ("y", "x"), ("z", "x"), ("u", "u"), ("v", "u")}
    assert {kind for pair in kinds for _, kind in pair} == {"bigint"}
