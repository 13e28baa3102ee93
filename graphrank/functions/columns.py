"""Column resolution and scalar expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.schemas import NODE_TYPE_NAMES, SYMMETRIC_RELATIONS

# --- fixed values: patterns of identifiers
GENE_ID_PATTERN = "(ENSG[0-9]{11})"
SAFE_NAME_PATTERN = "^[A-Za-z][A-Za-z0-9_]*$"
# --- fixed values: spellings of the three annotation namespaces; anything else is BP
NAMESPACE_SPELLINGS = {
    "BP": ("p", "bp", "biological_process"),
    "MF": ("f", "mf", "molecular_function"),
    "CC": ("c", "cc", "cellular_component"),
}
# --- fixed values: order in which label columns are tried
LABEL_COLUMNS = ("symbol", "label", "name", "node_label")


def optional_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First of ``candidates`` that ``df`` has, or None. Decided on the schema, no job runs."""
    present = set(df.columns)
    return next((name for name in candidates if name in present), None)


def first_present_column(df: DataFrame, candidates: Sequence[str]) -> str:
    name = optional_column(df, candidates)
    if name is None:
        raise KeyError(f"no column of {list(candidates)} among {df.columns}")
    return name


def ensure_columns(df: DataFrame, columns: Iterable[str]) -> None:
    absent = [name for name in columns if name not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")


def is_missing(c: Column, floating: bool = False) -> Column:
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def gene_id(c: Column) -> Column:
    """Versionless gene id found anywhere in the text, else null."""
    return F.nullif(F.regexp_extract(c.cast("string"), GENE_ID_PATTERN, 1), F.lit(""))


def identifiers(c: Column) -> Column:
    """Array of ids in a text that separates them by ``;``, ``,`` or ``|``."""
    parts = F.transform(F.split(c.cast("string"), "[;,|]"), lambda p: F.trim(p))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def numeric(c: Column, default: float = 0.0) -> Column:
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float(default))).otherwise(value)


def go_namespace(c: Column) -> Column:
    text = F.lower(c.cast("string"))
    return (
        F.when(text.isin(*NAMESPACE_SPELLINGS["MF"]), "MF")
        .when(text.isin(*NAMESPACE_SPELLINGS["CC"]), "CC")
        .otherwise("BP")
    )


def parse_vector(c: Column) -> Column:
    """Vector written as ``[1,2]``, ``1,2`` or ``1 2``; null for missing or blank text."""
    text = F.trim(c)
    body = F.regexp_replace(text, r"^\[(.*)\]$", "$1")
    pieces = F.when(body.contains(","), F.split(body, ",")).otherwise(F.split(body, " "))
    numbers = F.transform(
        F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""),
        lambda p: p.cast("double"),
    )
    return F.when(text != "", numbers)


def sigmoid(c: Column) -> Column:
    """Logistic function that never raises e to a large positive power."""
    decay = F.exp(-F.abs(c))
    return F.when(c >= 0, 1.0 / (1.0 + decay)).otherwise(decay / (1.0 + decay))


def information_content(given: Column, count: Column, total: Column) -> Column:
    share = count.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    derived = F.when(count > 0, -F.log(share))
    return F.coalesce(F.when(~F.isnan(given), given), derived, F.lit(0.0))


def is_safe_name(c: Column) -> Column:
    return F.coalesce(c.rlike(SAFE_NAME_PATTERN), F.lit(False))


def unsafe_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that cannot be a label or relation name."""
    return df.where(~is_safe_name(F.col(column))).select(column).distinct()


def relation_key(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws("__", src, rel, dst)


def reverse_name(relation: Column) -> Column:
    return F.concat(F.lit("rev_"), relation)


def has_reverse(relation: Column) -> Column:
    return ~relation.isin(*SYMMETRIC_RELATIONS)


def type_name(c: Column) -> Column:
    """Lower-snake node type; unknown types are lower-cased."""
    mapped = F.lower(c)
    for label, name in NODE_TYPE_NAMES.items():
        mapped = F.when(c == label, name).otherwise(mapped)
    return mapped


def display_label(df: DataFrame, id_column: str = "node_id") -> Column:
    present = [F.col(name).cast("string") for name in LABEL_COLUMNS if name in df.columns]
    return F.coalesce(*present, F.col(id_column))


def fingerprint_bits(c: Column, width: int = 2048, hashes: int = 32) -> Column:
    """Sorted distinct set bits of a salted-hash fingerprint (sparse form)."""
    text = F.coalesce(F.nullif(c, F.lit("")), F.lit("missing"))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(hashes - 1)),
        lambda salt: first_bytes_mod(
            F.sha2(F.concat(salt.cast("string"), F.lit(":"), text), 256), width
        ),
    )
    return F.array_sort(F.array_distinct(bits))


def first_bytes_mod(hex_digest: Column, modulus: int) -> Column:
    """First eight bytes of a hex digest, big-endian, modulo ``modulus``, in long arithmetic."""
    low = F.conv(F.substring(hex_digest, 9, 8), 16, 10).cast("bigint")
    m = F.lit(modulus).cast("bigint")
    if (1 << 32) % modulus == 0:  # the first four bytes add nothing, and the digest is not computed for them
        return low % m
    high = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")
    return ((high % m) * F.lit((1 << 32) % modulus).cast("bigint") + low % m) % m
