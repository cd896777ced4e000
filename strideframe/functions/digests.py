"""Digests of id sets and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def membership_digest(ids: Column) -> Column:
    """SHA-256 over the compact JSON array of sorted distinct ids (aggregate expression).

    The hashed bytes are the id list itself, so a group must be a set of ids that fits a
    row; for tables use `content_digest`, which never gathers rows.
    """
    listed = F.array_join(F.sort_array(F.collect_set(ids.cast("string"))), '","')
    return F.sha2(F.concat(F.lit('["'), listed, F.lit('"]')), 256)


def row_text(*columns: Column) -> Column:
    """Unambiguous text of a row: length-prefixed fields, `-` for NULL."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws(",", *parts)


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-row digest independent of row order, sensitive to values, types and duplicates.

    Each row becomes two 60-bit numbers; their exact sums and the row count are combined, so the
    job is one map-side aggregate with a constant-size shuffle.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    header = ";".join(f"{c}:{fields[c]}" for c in columns)
    text = row_text(*[F.col(f"`{c}`") for c in columns])
    hashed = df.select(F.md5(text).alias("h")).select(
        F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(20,0)").alias("a"),
        F.conv(F.substring("h", 17, 15), 16, 10).cast("decimal(20,0)").alias("b"))
    sums = hashed.agg(F.count("*").alias("n_rows"),
                      F.coalesce(F.sum("a"), F.lit(0).cast("decimal(30,0)")).alias("a"),
                      F.coalesce(F.sum("b"), F.lit(0).cast("decimal(30,0)")).alias("b"))
    body = F.concat_ws("|", F.lit(header), F.col("n_rows").cast("string"),
                       F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select("n_rows", F.sha2(body, 256).alias("digest"))


def set_digest(ids: Column) -> Column:
    """Order-free digest of an id set of any size (aggregate over distinct ids).

    Exact sums of two md5 numbers per id, so partial aggregates combine and nothing is gathered.
    """
    return numbers_digest(id_numbers(ids))


def id_numbers(ids: Column) -> Column:
    """The two 60-bit md5 numbers of an id, each as its upper and lower 30 bits: what a set digest adds up."""
    half = lambda start, size: F.conv(F.substring(F.md5(ids.cast("string")), start, size), 16, 10).cast("bigint")
    parts = []
    for name, start in (("a", 1), ("b", 17)):
        number = half(start, 15)
        parts += [F.shiftright(number, 30).alias(f"{name}_high"), number.bitwiseAND(F.lit((1 << 30) - 1)).alias(f"{name}_low")]
    return F.struct(*parts)


def numbers_digest(numbers: Column) -> Column:
    """`set_digest` from `id_numbers`, which a table may hold so that repeated ids are hashed once.

    Halves are added as integers (exact to 2^33 ids, beyond which the sum raises) and put together once per group.
    """
    whole = lambda c: (F.sum(numbers[f"{c}_high"]).cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)")
                       + F.sum(numbers[f"{c}_low"]).cast("decimal(20,0)")).cast("decimal(30,0)")
    return F.struct(F.count(F.lit(1)).alias("n"), whole("a").alias("a"), whole("b").alias("b"))


def digest_text(n: Column, a: Column, b: Column) -> Column:
    """Hex digest of set sums; the sums of a difference of sets are the differences of the sums."""
    zero = F.lit(0).cast("decimal(30,0)")
    return F.sha2(F.concat_ws("|", n.cast("string"), F.coalesce(a, zero).cast("decimal(30,0)").cast("string"),
                              F.coalesce(b, zero).cast("decimal(30,0)").cast("string")), 256)
