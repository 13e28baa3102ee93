"""Vector expressions and hashed text vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.functions.columns import first_bytes_mod

# white space of any script, and the four ASCII separators that also split words
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, 0.0).otherwise(dot(a, b) / scale)


def pair_features(head: Column, tail: Column) -> Column:
    """``[h, t, |h-t|, h*t]`` cut to the shorter of the two widths."""
    width = F.least(F.size(head), F.size(tail))
    h, t = F.slice(head, F.lit(1), width), F.slice(tail, F.lit(1), width)
    return F.concat(
        h,
        t,
        F.zip_with(h, t, lambda x, y: F.abs(x - y)),
        F.zip_with(h, t, lambda x, y: x * y),
    )


def tokens(text: Column) -> Column:
    """Lower-cased words, underscores read as blanks; a text without words is one token."""
    words = F.filter(
        F.split(F.translate(F.lower(text), "_", " "), _BLANKS), lambda w: w != ""
    )
    whole = F.array(F.coalesce(F.nullif(text, F.lit("")), F.lit("missing")))
    return F.when(F.size(words) > 0, words).otherwise(whole)


def hashed_components(
    df: DataFrame, id_column: str, text: Column, dim: int = 64, signed: bool = True
) -> DataFrame:
    """Non-zero components ``(id, idx, value)`` of the normalised hashed vector of each text.

    Each word adds +-1 to one component. Words are exploded and summed with a
    map-side combine, so a long text is at most ``dim`` rows per task after it.
    """
    word = df.select(F.col(id_column), F.explode(tokens(text)).alias("_word"))
    digest = word.select(id_column, F.sha2(F.col("_word"), 256).alias("_sha"))
    odd = F.conv(F.substring("_sha", 17, 2), 16, 10).cast("int") % 2 == 1
    sign = F.when(odd, -1).otherwise(1) if signed else F.lit(1)
    summed = (
        digest.select(id_column, first_bytes_mod(F.col("_sha"), dim).alias("idx"), sign.alias("_s"))
        .groupBy(id_column, "idx")
        .agg(F.sum("_s").alias("_sum"))
    )
    lengths = summed.groupBy(id_column).agg(
        F.sqrt(F.sum(F.col("_sum") * F.col("_sum")).cast("double")).alias("_norm")
    )
    return (
        summed.where(F.col("_sum") != 0)
        .join(lengths, id_column)
        .select(id_column, "idx", (F.col("_sum") / F.col("_norm")).alias("value"))
    )


def hashed_vectors(
    df: DataFrame, id_column: str, text: Column, dim: int = 64, signed: bool = True
) -> DataFrame:
    """Dense hashed vector ``(id, vector array<double>)`` of each text."""
    keyed = df.select(F.col(id_column), text.alias("_text"))
    word = keyed.select(id_column, F.explode(tokens(F.col("_text"))).alias("_word"))
    digest = word.select(id_column, F.sha2(F.col("_word"), 256).alias("_sha"))
    odd = F.conv(F.substring("_sha", 17, 2), 16, 10).cast("int") % 2 == 1
    sign = F.when(odd, -1.0).otherwise(1.0) if signed else F.lit(1.0)
    placed = digest.select(
        id_column, first_bytes_mod(F.col("_sha"), dim).alias("_idx"), sign.alias("_s")
    )
    # one conditional sum per component: a single aggregation, and rows stay numeric
    sums = placed.groupBy(id_column).agg(
        *[
            F.sum(F.when(F.col("_idx") == i, F.col("_s")).otherwise(0.0)).alias(f"_v{i}")
            for i in range(dim)
        ]
    )
    raw = F.array(*[F.col(f"_v{i}") for i in range(dim)])
    return sums.select(id_column, raw.alias("_raw")).select(id_column, unit(F.col("_raw")).alias("vector"))


def unit(v: Column) -> Column:
    # the length is bound to a name, or it would be computed again for every component
    scaled = F.transform(F.array(norm(v)), lambda length: F.when(length == 0.0, v).otherwise(F.transform(v, lambda x: x / length)))
    return scaled[0]


def id_vector(node_id: Column, dim: int = 16) -> Column:
    """Hashed vector of a short id, computed inside the row (no shuffle)."""
    words = tokens(node_id)
    placed = F.transform(
        words,
        lambda w: F.struct(
            first_bytes_mod(F.sha2(w, 256), dim).alias("i"),
            F.when(F.conv(F.substring(F.sha2(w, 256), 17, 2), 16, 10).cast("int") % 2 == 1, -1.0)
            .otherwise(1.0)
            .alias("s"),
        ),
    )
    # the words are bound to a name, or their digests would be computed again for every component
    raw = F.transform(F.array(placed), lambda known: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: F.aggregate(
            F.filter(known, lambda p: p["i"] == d), F.lit(0.0), lambda acc, p: acc + p["s"]
        ),
    ))[0]
    return unit(raw)


def with_node_features(
    df: DataFrame, id_column: str, features: DataFrame | None, out: str, dim: int = 16
) -> DataFrame:
    """Add the given vector of each node, or its hashed id where none is given."""
    fallback = id_vector(F.col(id_column), dim)
    if features is None:
        return df.withColumn(out, fallback)
    given = features.select(F.col("node_id").alias(id_column), F.col("vector").alias("_given"))
    return df.join(given, id_column, "left").withColumn(
        out, F.coalesce(F.col("_given"), fallback)
    ).drop("_given")
