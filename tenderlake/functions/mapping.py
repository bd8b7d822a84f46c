"""Field mappings by source and period, compiled to column expressions.

A rule says that, for a source and a span of years, a target field is taken from a column through a
transform. For each target the first rule whose source and years fit a row wins. Rules are checked
when they are compiled: unknown transforms and columns, spans that end before they start, rules
that earlier ones leave nothing to, and years that a source covers but no rule does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.contract import lookup
from tenderlake.functions.text import lenient_double, trim
from tenderlake.schema import INE_OF_NUTS2, LAST_YEAR

OPEN_END = 9999


@dataclass(frozen=True)
class Rule:
    """``field`` of rows of ``source`` in the years ``first`` to ``last`` is ``transform(column)``."""

    source: str
    first: int
    last: int
    field: str
    column: str
    transform: str = "trim"


class MappingProblem(ValueError):
    """A rule table that cannot mean what it says."""


def rules_of(mapping: Mapping) -> list[Rule]:
    """Rules from a mapping document: ``source`` and ``periods``, each with ``from``, ``to`` and
    ``fields`` of ``{target: {from, transform}}``, in their order."""
    return [
        Rule(mapping["source"], int(period["from"]), int(period.get("to", OPEN_END)), field, how["from"], how.get("transform", "trim"))
        for period in mapping["periods"]
        for field, how in period["fields"].items()
    ]


# ---- transforms


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value worked out once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    """As ``clean``, which names its trimmed text twice."""
    return bound(trim(c), lambda text: F.when(text != "", text))


def tax_id(c: Column) -> Column:
    """Upper case without blanks and signs."""
    return bound(F.regexp_replace(F.upper(c), "[^0-9A-Z]", ""), lambda text: F.when(text != "", text))


def of_person(nif: Column) -> Column:
    """Whether a normalised tax id is that of a natural person: eight digits, or X, Y, Z, K, L, M with
    seven, and a letter."""
    return nif.rlike("^([0-9]{8}|[XYZKLM][0-9]{7})[A-Z]$")


def pseudonym(nif: Column, salt: str) -> Column:
    """Tax ids of natural persons replaced by a salted hash; those of companies stay."""

    def hidden(nif: Column) -> Column:
        return F.concat(F.lit("P-"), F.substring(F.sha2(F.concat(F.lit(salt), nif), 256), 1, 32))

    return bound(nif, lambda n: F.when(of_person(n), hidden(n)).otherwise(n))


def iso_date(c: Column) -> Column:
    """ISO date of a date or time stamp text, year or day first; NULL for other texts and days that
    do not exist."""

    def date(y: Column, m: Column, d: Column) -> Column:
        joined = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return bound(joined, lambda text: F.when(text.try_cast("date").isNotNull(), text))

    def of_parts(text: Column, year: int, day: int) -> Column:
        parts = F.split(F.regexp_extract(text, r"^[0-9/-]+", 0), "[-/]")
        return bound(parts, lambda p: date(F.get(p, F.lit(year)), F.get(p, F.lit(1)), F.get(p, F.lit(day))))

    def of(text: Column) -> Column:
        return (
            F.when(text.rlike(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?$"), of_parts(text, 0, 2))
            .when(text.rlike(r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?:[T ].*)?$"), of_parts(text, 2, 0))
            .when(text.rlike(r"^\d{8}$"), date(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        )

    return bound(trim(c), of)


def amount(c: Column) -> Column:
    """Number from a numeric column, or from text with a decimal comma or point; points that can only
    mark thousands are left out ("1.234" has a decimal point, "1.234.567" and "1.234,5" have none)."""

    def plain(text: Column) -> Column:
        comma = text.rlike(r"^[+-]?\d{1,3}(\.\d{3})*,\d+$|^[+-]?\d+,\d+$")
        marked = text.rlike(r"^[+-]?\d{1,3}(\.\d{3}){2,}$")
        return (
            F.when(comma, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(marked, F.replace(text, F.lit("."), F.lit("")))
            .otherwise(text)
        )

    text = F.regexp_replace(c.cast("string"), "[\\s€]|EUR", "")
    return bound(bound(text, plain), lenient_double)


def ine_region(nuts: Column) -> Column:
    """INE number of the region that a NUTS code lies in; NULL for other codes."""
    return lookup(INE_OF_NUTS2, F.substring(F.upper(trimmed(nuts)), 1, 4))


def transforms(salt: str) -> dict[str, Callable[[Column], Column]]:
    """What rules may name; ``salt`` goes into pseudonyms."""
    text = lambda c: c.cast("string")
    return {
        "trim": lambda c: trimmed(text(c)),
        "amount": amount,
        "date_iso": lambda c: iso_date(text(c)),
        "nif": lambda c: tax_id(text(c)),
        "nif_seudonimizar": lambda c: pseudonym(tax_id(text(c)), salt),
        "nuts_to_ine": lambda c: ine_region(text(c)),
    }


# ---- compiling


def check_rules(
    rules: Sequence[Rule], columns: Iterable[str], coverage: Mapping[str, int], last_year: int = LAST_YEAR
) -> None:
    """Raise a MappingProblem that names every fault of a rule table.

    ``coverage`` has the first year of each source; from then to ``last_year`` each field that a source
    maps at all must have a rule.
    """
    columns, known, faults = set(columns), transforms(""), []
    taken: dict[tuple[str, str], set[int]] = {}
    for n, r in enumerate(rules, 1):
        here = f"rule {n} ({r.source} {r.first}-{r.last} {r.field})"
        if r.transform not in known:
            faults.append(f"{here}: unknown transform {r.transform}")
        if r.column not in columns:
            faults.append(f"{here}: no column {r.column}")
        if r.first > r.last:
            faults.append(f"{here}: ends before it starts")
            continue
        years = set(range(max(r.first, coverage.get(r.source, r.first)), min(r.last, last_year) + 1))
        before = taken.setdefault((r.source, r.field), set())
        if years and years <= before:
            faults.append(f"{here}: earlier rules leave nothing to it")
        before |= years
    for (source, field), years in taken.items():
        missing = [y for y in range(coverage.get(source, min(years, default=last_year)), last_year + 1) if y not in years]
        if missing:
            faults.append(f"{source} {field}: no rule for {', '.join(map(str, missing))}")
    if faults:
        raise MappingProblem("; ".join(faults))


def compile_rules(
    rules: Sequence[Rule], salt: str, source: Column | None = None, year: Column | None = None
) -> dict[str, Column]:
    """One expression for each target field. Rows that no rule fits get NULL."""
    source, year = F.col("source") if source is None else source, F.col("year") if year is None else year
    known = transforms(salt)
    out: dict[str, Column] = {}
    for field in dict.fromkeys(r.field for r in rules):
        chain = None
        for r in (r for r in rules if r.field == field):
            fits = (source == r.source) & year.between(r.first, r.last)
            value = known[r.transform](F.col(r.column))
            chain = F.when(fits, value) if chain is None else chain.when(fits, value)
        out[field] = chain
    return out


def rule_of_period(rules: Sequence[Rule], source: Column | None = None, year: Column | None = None) -> Column:
    """Version of the mapping that a row falls under: source and first year of its first fitting rule."""
    source, year = F.col("source") if source is None else source, F.col("year") if year is None else year
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        chain = chain.when((source == r.source) & year.between(r.first, r.last), F.lit(f"{r.source}@{r.first}"))
    return chain


def mapped(rows: DataFrame, rules: Sequence[Rule], salt: str, coverage: Mapping[str, int]) -> DataFrame:
    """Rows in the canonical model: ``source``, ``year``, ``schema_version``, the target fields, and
    ``attributes``, a JSON object of the row's filled columns that no rule of its source reads."""
    check_rules(rules, rows.columns, coverage)
    read = {s: {r.column for r in rules if r.source == s} for s in {r.source for r in rules}}

    def kept(s: str) -> Column:
        rest = [F.col(c).cast("string").alias(c) for c in rows.columns if c not in read[s] | {"source", "year"}]
        return F.to_json(F.struct(*rest)) if rest else F.lit("{}")

    attributes = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in sorted(read):
        attributes = attributes.when(F.col("source") == s, kept(s))
    fields = compile_rules(rules, salt)
    return rows.select(
        "source", "year", rule_of_period(rules).alias("schema_version"),
        *[c.alias(name) for name, c in fields.items()], attributes.alias("attributes"),
    )
