"""Order tables read as a procurement ledger.

Maps ``lineitem``/``orders`` and their dimensions to the Bronze columns, so that every analysis
runs unchanged on ordinary order data: an order line is a record, the return flag its feed, the
customer's nation the buyer, the supplier the supplier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderlake import schema as S
from tenderlake.functions.contract import lookup, with_derived
from tenderlake.functions.text import record_year
from tenderlake.operators.canonical import canonical_made
from tenderlake.session import enough_partitions, run_folder, scratch, small_methods
from tenderlake.sources.tables import contracts_of, read_silver, write_silver

YEAR_SHIFT = 21
REVIEW_ABOVE = 100_000.0
SOURCE_OF_FLAG = {"N": "contratos_menores", "R": "perfil_contratante", "A": "agregaciones"}
# Nation key -> territory code: one region each, then the special cases of the code list.
TERRITORY_OF_NATION = {
    **{key: f"{code}0" for key, code in enumerate(S.REGION_BY_NUTS2)},
    19: "ES7",
    20: "ES709",
    21: "PT170",
}
HIERARCHY_OF_SEGMENT = {
    "AUTOMOBILE": "Ministerio > Administración General del Estado > Sector Público",
    "BUILDING": "Consejería > Comunidades y Ciudades Autónomas > Sector Público",
    "FURNITURE": "Ayuntamiento > ENTIDADES LOCALES > Sector Público",
    "HOUSEHOLD": "Universidades",
}


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the order tables; its footer is read for the schema only the first time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of one split as a partition for each core; larger tables stay as their files are read.

    Tables that fit into one split would otherwise be worked on by one core. The shuffle that this
    costs is bounded by ``spark.sql.files.maxPartitionBytes``.
    """
    spark = scan.sparkSession
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return scan.repartition(spark.sparkContext.defaultParallelism) if size <= split else scan


_TWO_DIGITS = "array(" + ", ".join(f"'-{n:02d}'" for n in range(32)) + ")"  # "-00" to "-31"


def shifted_date(ts: Column) -> Column:
    """ISO date text moved into the analysis years. Months and days are taken from a list, as
    ``date_format`` is many times slower."""
    day, two = ts.cast("date"), F.expr(_TWO_DIGITS)
    return F.concat(_shifted_year(ts).cast("string"), F.get(two, F.month(day)), F.get(two, F.dayofmonth(day)))


def _shifted_year(ts: Column) -> Column:
    return F.year(ts) + YEAR_SHIFT


def cents(c: Column) -> Column:
    """``round(c * 100)`` of a double as a whole number.

    Spark rounds doubles by way of decimal texts. Below 2^52 halves are doubles themselves, so the whole
    part and the rest tell the same.
    """
    exact = c * 100
    size = F.abs(exact)
    whole = F.floor(size)
    near = whole + F.when(size - whole >= 0.5, 1).otherwise(0)
    signed = F.when(exact < 0, -near).otherwise(near)
    return F.when(size < F.lit(float(1 << 52)), signed).otherwise(F.round(exact).cast("bigint"))


# What the Bronze columns are made of, as rows move: numbers first, then texts, of which the short ones first.
_LINE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_shipdate", "o_orderdate", "first_priority", "p_size", "p_retailprice", "n_nationkey",
    "l_returnflag", "l_linestatus", "o_orderstatus", "p_type", "c_mktsegment", "n_name", "p_brand", "p_name", "s_name",
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with what hangs on them. Dimensions are broadcast by Catalyst where their size allows."""
    small_methods(spark)
    lineitem = read_table(spark, sf_dir, "lineitem")
    enough_partitions(lineitem)
    # Orders are widened first, so that their lines move once for all that hangs on the order but the names.
    orders = (
        read_table(spark, sf_dir, "orders")
        .withColumns({
            "first_priority": F.col("o_orderpriority").startswith("1"), "o_orderdate": F.col("o_orderdate").cast("date"),
        })
        .join(read_table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    )
    lines = (
        spread(lineitem)
        .withColumn("l_shipdate", F.col("l_shipdate").cast("date"))  # narrower than its time
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(read_table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(read_table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(read_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    )
    return lines.select(*_LINE)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as Bronze rows."""
    return as_bronze(order_lines(spark, sf_dir)).select(*S.BRONZE_SCHEMA.names)


def as_bronze(lines: DataFrame) -> DataFrame:
    """Order lines with the Bronze columns beside their own."""
    status, qty, price = F.col("o_orderstatus"), F.col("l_quantity"), F.col("l_extendedprice")
    done, pending = status.isin("F", "O"), status == "P"
    source = lookup(SOURCE_OF_FLAG, F.col("l_returnflag"))
    buyer = F.when(
        F.col("n_nationkey") < 24,
        F.concat(F.lit("P"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0"), F.lit("X")),
    )
    supplier = F.concat(F.lit("B"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    brand = F.substring("p_brand", 7, 9)
    file_name = F.concat(source, F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".atom"))
    updated = shifted_date(F.col("l_shipdate"))
    awarded_on = F.when(done, shifted_date(F.col("o_orderdate")))
    # The first four characters of a date are its year where that has four digits.
    shipped = _shifted_year(F.col("l_shipdate"))
    year = F.when(shipped.between(1000, 9999), shipped.cast("bigint")).otherwise(record_year(updated, awarded_on))
    columns = {
        "entry_id": F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
            cents(qty), cents(price), cents(F.col("l_tax")), cents(F.col("l_discount")),
        ),
        "link_detalle": F.concat_ws("/", F.lit("https://example.org"), "l_orderkey", "l_linenumber"),
        "title": name,
        "updated": updated,
        "sum_importe": F.when(pending & (qty >= 5) & (qty < 15), price),
        "id_origen": F.when(F.col("p_size") < 50, F.concat_ws("-", "l_orderkey", "l_linenumber")),
        "estado": F.when(status == "F", "RES")
        .when((status == "O") & (F.col("l_linestatus") == "O"), "adj")
        .when(status == "O", "ADJ")
        .when(qty < 5, "ANUL")
        .when(qty < 15, "EV")
        .when(qty < 20, "PRE")
        .when(qty < 22, "SUSP")
        .otherwise("PUB"),
        "organo_nombre": F.col("n_name"),
        "organo_id": F.when(~F.col("first_priority"), buyer),
        "organo_nif": buyer,
        "admin_hierarchy": lookup(HIERARCHY_OF_SEGMENT, F.col("c_mktsegment")),
        "objeto": F.when(name.contains("widget"), F.concat(F.lit("Acuerdo Marco de "), name)).when(
            ~name.contains("ring"), name
        ),
        "tipo_contrato": F.when(F.col("p_type") == "LARGE", "3")
        .when(F.col("p_type").isin("SMALL", "MEDIUM"), "1")
        .when(F.col("p_type") != "PROMO", "2"),
        "importe_sin_iva": F.when(qty >= 3, price),
        "importe_total_con_iva": F.when(pending & (qty >= 15), F.col("p_retailprice")),
        "cpv": F.when(brand != "25", F.concat(F.lpad(brand, 2, "0"), F.lpad(size, 2, "0"), F.lit("0000"))),
        "territorio_nombre": F.col("n_name"),
        "territorio_code": lookup(TERRITORY_OF_NATION, F.col("n_nationkey")),
        "n_resultados": F.when(done, 1).otherwise(0),
        "fecha_adjudicacion": awarded_on,
        "adjudicatario_nombre": F.when(done, F.col("s_name")),
        "adjudicatario_id": F.when(done & (F.col("l_tax") > 0), supplier),
        "adjudicatario_nif": F.when(done & (F.col("l_discount") > 0), supplier),
        "importe_adjudicado": F.when(done, price),
        "source": source,
        "source_file": file_name,
        "source_file_hash": F.sha2(file_name, 256),
        "year": year,
    }
    missing = F.lit(None)
    return lines.select("*", *[
        columns.get(f.name, missing).cast(f.dataType).alias(f.name) for f in S.BRONZE_SCHEMA.fields
    ])


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(ledger(spark, sf_dir), REVIEW_ABOVE)


def canonical_base(spark: SparkSession, sf_dir: str, *, keep_null_keys: bool = False) -> DataFrame:
    chosen = canonical_made(order_lines(spark, sf_dir), as_bronze, keep_null_keys=keep_null_keys)
    return with_derived(chosen, REVIEW_ABOVE)


_SILVER: dict[tuple[str, str], str] = {}


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical contracts of the ledger, written once per session to shared storage.

    Deduplication is the one heavy shuffle; the analyses then scan only the Parquet columns and
    row groups they need.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SILVER:
        path = run_folder(spark, f"silver-{uuid.uuid4().hex}")
        with scratch(spark):
            write_silver(canonical_base(spark, sf_dir), path)
        _SILVER[key] = path
    return read_silver(spark, _SILVER[key])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts_of(silver(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files the ledger rows name, one copy per year folder."""
    return (
        ledger(spark, sf_dir)
        .groupBy("source", F.col("source_file").alias("basename"), F.col("year").alias("year_folder"))
        .agg(F.round(F.count("*") / 1000, 2).alias("size_mb"))
        .select(
            "source", "basename", "year_folder",
            F.concat_ws("/", "source", F.col("year_folder").cast("string"), "basename").alias("relpath"),
            "size_mb",
        )
    )


def _span(first: int, last: int) -> tuple[Column, Column]:
    return F.lit(first).cast("bigint"), F.lit(last).cast("bigint")


def _named_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under a free spelling of the region they stand for."""
    spelled = {
        key: name.upper() if key % 2 else name
        for key, name in enumerate(S.REGION_BY_NUTS2.values())
    }
    aliases = {official: alias for alias, official in S.REGION_ALIASES.items()}
    spelled = {key: aliases.get(S.REGION_BY_NUTS2[code], spelled[key]) for key, code in enumerate(S.REGION_BY_NUTS2)}
    return read_table(spark, sf_dir, "nation").select(
        "n_nationkey", F.coalesce(lookup(spelled, F.col("n_nationkey")), F.col("n_name")).alias("nombre")
    )


def named_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation as its population, a little more each year."""
    counts = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    years = F.explode(F.sequence(*_span(2012, 2025)))
    return (
        counts.join(_named_regions(spark, sf_dir), F.expr("c_nationkey = n_nationkey"))
        .select("nombre", "n", years.alias("year"))
        .withColumn("poblacion", F.col("n") + (F.col("year") - 2012) * 10)
        .select("nombre", "year", "poblacion")
    )


def central_government(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One party per order year."""
    year = (F.year("o_orderdate") + YEAR_SHIFT).cast("bigint")
    years = read_table(spark, sf_dir, "orders").groupBy(year.alias("year")).agg(F.count("*").alias("n"))
    return years.select(
        "year", F.when(F.col("year") <= 2018, "PP").otherwise("PSOE").alias("partido_central")
    )


def regional_governments(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.explode(F.sequence(*_span(2012, 2026)))
    party = F.element_at(
        F.array(F.lit("PP"), F.lit("PSOE"), F.lit("PNV")),
        ((F.col("n_nationkey") + F.col("year")) % 3 + 1).cast("int"),
    )
    return (
        _named_regions(spark, sf_dir)
        .select("n_nationkey", "nombre", years.alias("year"))
        .select("nombre", "year", party.alias("partido_ccaa"))
    )


def _tag(name: str, content: Column, attributes: str = "") -> Column:
    """XML element, or NULL when the content is NULL."""
    return F.concat(F.lit(f"<{name}{attributes}>"), content.cast("string"), F.lit(f"</{name}>"))


def _element(name: str, *children: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.concat_ws("", *children), F.lit(f"</{name}>"))


def _identifier(scheme: str, value: Column) -> Column:
    return _tag("cac:PartyIdentification", _tag("cbc:ID", value, f' schemeName="{scheme}"'))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written out as feed entries (column ``fragment``), one to three lots per award.

    Third lots sit one level deeper than the others and carry an unreadable amount.
    """
    rows = ledger(spark, sf_dir)
    key = F.split("entry_id", "-")
    line, qty = key[1].cast("int"), (key[5].cast("bigint") / 100).cast("string")
    col = F.col
    blank = F.lit("")
    summary = F.concat(
        F.lit("Id licitación: "), col("id_origen"), F.lit("; Órgano de Contratación: "), col("organo_nombre"),
        F.lit("; Importe: "), F.coalesce(col("importe_sin_iva").cast("string"), blank),
        F.lit(" EUR; Estado: "), col("estado"),
    )
    parents = F.aggregate(
        F.reverse(F.split("admin_hierarchy", " > ")),
        blank,
        lambda inner, name: F.concat(
            F.lit("<ext:ParentLocatedParty><cac:PartyName><cbc:Name>"), name,
            F.lit("</cbc:Name></cac:PartyName>"), inner, F.lit("</ext:ParentLocatedParty>"),
        ),
    )
    buyer = _element(
        "ext:LocatedContractingParty",
        _tag("cbc:ContractingPartyTypeCode", line),
        _tag("cbc:ActivityCode", F.when(line % 2 == 1, line % 4)),
        _element(
            "cac:Party",
            _identifier("DIR3", col("organo_nif")),
            _identifier("NIF", col("organo_id")),
            _identifier("ID_PLATAFORMA", F.concat(F.lit("PLAT-"), col("source"))),
            _identifier("ID_OC_PLAT", F.when(line % 5 == 0, F.concat(F.lit("OC-"), col("source")))),
            _tag("cac:PartyName", _tag("cbc:Name", col("organo_nombre"))),
            _element(
                "cac:PostalAddress",
                _tag("cbc:CityName", F.concat(F.lit("Ciudad de "), col("organo_nombre"))),
                _tag("cbc:PostalZone", F.concat(F.lit("2"), F.substring("updated", 1, 4))),
            ),
        ),
        parents,
    )
    project = _element(
        "cac:ProcurementProject",
        _tag("cbc:Name", col("objeto")),
        _tag("cbc:TypeCode", col("tipo_contrato")),
        _tag("cbc:SubTypeCode", F.concat(col("tipo_contrato"), F.lit("0"))),
        _element(
            "cac:BudgetAmount",
            _tag("cbc:EstimatedOverallContractAmount", col("importe_adjudicado")),
            _tag("cbc:TotalAmount", col("importe_total_con_iva"), ' currencyID="EUR"'),
            _tag("cbc:TaxExclusiveAmount", col("importe_sin_iva")),
        ),
        _element("cac:RequiredCommodityClassification", _tag("cbc:ItemClassificationCode", col("cpv"))),
        _element(
            "cac:RealizedLocation",
            _tag("cbc:CountrySubentity", col("territorio_nombre")),
            _tag("cbc:CountrySubentityCode", col("territorio_code")),
        ),
    )

    def lot(date: Column, winner: Column, payable: Column, untaxed: Column, code: Column) -> Column:
        amounts = _element(
            "cac:LegalMonetaryTotal", _tag("cbc:PayableAmount", payable), _tag("cbc:TaxExclusiveAmount", untaxed)
        )
        return _element(
            "cac:TenderResult",
            _tag("cbc:ResultCode", code), _tag("cbc:AwardDate", date), winner, _element("cac:AwardedTenderedProject", amounts),
        )

    none = F.lit(None).cast("string")
    winner = _element(
        "cac:WinningParty",
        _identifier("OTROS", col("adjudicatario_id")),
        _identifier("NIF", col("adjudicatario_nif")),
        _tag("cac:PartyName", _tag("cbc:Name", col("adjudicatario_nombre"))),
    )
    awarded = col("n_resultados") == 1
    first_date = F.when(line % 2 == 0, col("fecha_adjudicacion"))
    lots = [
        F.when(awarded, lot(first_date, winner, col("importe_adjudicado").cast("string"), none, line + 7)),
        F.when(awarded & (line % 3 > 0), lot(col("fecha_adjudicacion"), blank, qty, qty, none)),
        F.when(awarded & (line % 3 > 1), _element("ext:Lots", lot(none, blank, F.lit("n/a"), none, none))),
    ]
    folder = _element(
        "ext:ContractFolderStatus",
        _tag("cbc:ContractFolderID", col("id_origen")),
        _tag("ext:ContractFolderStatusCode", col("estado"), ' languageID="es"'),
        buyer, project, *lots,
    )
    link = F.concat(F.lit('<link href="'), col("link_detalle"), F.lit('?a=1&amp;b=2"/>'))
    return rows.select(
        _element(
            "entry",
            _tag("id", col("entry_id")), link, _tag("summary", summary, ' type="text"'),
            _tag("title", col("title")), _tag("updated", col("updated")), folder,
        ).alias("fragment")
    )
