"""Text helpers: trimming, accent folding, lenient numbers, summary digest, years."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, so that trimming agrees with a Unicode-aware strip.
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def clean(c: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(trim(c), F.lit(""))


@cache
def _fold_table(form: str) -> tuple[str, str]:
    """Characters and their base letters, plus combining marks (which translate away)."""
    base: dict[str, str] = {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code)
        kept = [p for p in unicodedata.normalize(form, ch) if not unicodedata.combining(p)]
        if len(kept) == 1 and kept[0] != ch:
            base[ch] = kept[0]
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(base) + marks, "".join(base.values())


def fold_accents(c: Column) -> Column:
    """Text without diacritics."""
    return F.translate(c, *_fold_table("NFD"))


def fold_name(c: Column) -> Column:
    """Comparison form of a name: ASCII letters only, lower case, trimmed."""
    ascii_only = F.regexp_replace(F.translate(c, *_fold_table("NFKD")), r"[^\x00-\x7F]", "")
    return F.btrim(F.lower(ascii_only), F.lit(_SPACES))


# Decimal notation only; Java's own parser would also take suffixes such as "1d".
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def lenient_double(c: Column) -> Column:
    """Number with inner spaces allowed; anything else is NULL."""
    digits = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(digits.rlike(_NUMBER), digits.try_cast("double"))


# The labels of an entry summary after its identifier, in their order. Accented letters
# may be damaged, so any word character stands for them.
_SUMMARY_LABELS = (r"\wrgano de Contrataci\wn", "Importe", "Estado")
_EUROS = r"^([-\d.,]*)\s*EUR$"


def summary_digest(summary: Column) -> dict[str, Column]:
    """The four values of a summary such as "Id x: 1; <buyer label>: b; Importe: 2 EUR; Estado: RES".

    It is cut at each semicolon that a label follows, so values may hold semicolons of their own. Unless
    all four parts are there in order, each on one line, there is no digest.
    """
    parts = F.split(summary, rf"(?U);\s*(?=(?:{'|'.join(_SUMMARY_LABELS)}):)")
    named = F.size(parts) == 4
    values = [F.regexp_extract(F.get(parts, F.lit(0)), r"(?Us)Id\s+\w+:(.*)$", 1)]
    named = named & F.get(parts, F.lit(0)).rlike(r"(?U)Id\s+\w+:")
    for n, label in enumerate(_SUMMARY_LABELS, 1):
        part = F.get(parts, F.lit(n))
        named = named & part.rlike(rf"(?U)^{label}:")
        values.append(F.regexp_replace(part, r"^[^:]*:", ""))
    key, buyer, amount, status = (clean(v) for v in values)
    amount = F.regexp_extract(F.coalesce(amount, F.lit("")), _EUROS, 1)
    stated = F.coalesce(clean(values[2]), F.lit("")).rlike(_EUROS)
    one_line = ~F.concat_ws("", key, buyer, status).contains("\n")
    whole = named & stated & one_line & status.isNotNull()
    return {
        "sum_id": F.when(whole, key), "sum_organo": F.when(whole, buyer),
        "sum_importe": F.when(whole, lenient_double(amount)), "sum_estado": F.when(whole, status),
    }


def leading_year(c: Column) -> Column:
    """First four characters as a year when all are digits."""
    head = F.substring(c, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("bigint"))


def record_year(updated: Column, award_date: Column) -> Column:
    return F.coalesce(leading_year(updated), leading_year(award_date))


def plain_path(metadata_path: Column) -> Column:
    """File path as stored; Spark's metadata column URL-encodes it."""
    return F.url_decode(F.replace(metadata_path, F.lit("+"), F.lit("%2B")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder_year(path: Column) -> Column:
    """Numeric name of the folder that directly holds the file, else NULL."""
    folder = F.regexp_extract(path, r"([^/]*)/[^/]+$", 1)
    return F.when(folder.rlike("^[0-9]+$"), folder.try_cast("bigint"))
