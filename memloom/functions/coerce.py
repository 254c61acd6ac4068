"""Coercions of loosely typed values: lenient, auditing and strict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nonnegative_int(c: Column) -> Column:
    """Lenient: unparsable or negative is 0; a text with a fraction does not parse."""
    return F.greatest(F.coalesce(c.try_cast("bigint"), F.lit(0)), F.lit(0))


def nonnegative_double(c: Column) -> Column:
    """Lenient: unparsable or negative is 0; NaN and infinity pass."""
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def audited_double(c: Column) -> Column:
    """STRUCT(value, issue): non-finite, unparsable and negative values are 0 and named."""
    d = c.try_cast("double")
    issue = (
        F.when(c.isNull(), "missing").when(d.isNull(), "unparsable").when(F.isnan(d) | (F.abs(d) == float("inf")), "not finite").when(d < 0, "negative")
    )
    return F.struct(F.when(issue.isNull(), d).otherwise(0.0).alias("value"), issue.alias("issue"))


def audited_int(c: Column) -> Column:
    """As ``audited_double``; a fraction is cut off and named."""
    d = audited_double(c)
    issue = F.when(d["issue"].isNull() & (d["value"] != F.floor(d["value"])), "fraction").otherwise(d["issue"])
    return F.struct(F.floor(d["value"]).cast("bigint").alias("value"), issue.alias("issue"))


def as_bool(c: Column) -> Column:
    """Lenient: true for true and for the texts 1, true, yes, on; null is false. Numbers go by ``number_as_bool``, where any but 0 is true."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce(t.isin("1", "true", "yes", "on"), F.lit(False))


def variant_as_bool(v: Column) -> Column:
    """Lenient truth of a VARIANT: a boolean as it is, a number unless it is 0 (2 is true), the texts 1, true, yes, on ("2" is not)."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    is_number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(F.when(is_number, (number != 0) | F.isnan(number)).when(kind.isin("BOOLEAN", "STRING"), as_bool(F.try_variant_get(v, "$", "string"))), F.lit(False))


def strict_nonnegative_int(c: Column) -> Column:
    """Error for null, text that is no whole number, and negative numbers."""
    n = F.regexp_extract(F.trim(c.cast("string")), r"^([+-]?\d+)$", 1).try_cast("bigint")
    return F.when(n >= 0, n).otherwise(F.raise_error(F.concat(F.lit("no whole number from 0: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("bigint"))


def number_as_bool(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def strict_bool(c: Column) -> Column:
    """Error outside true, false, yes, no, 1, 0, on, off."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))))


def present_bool(present: Column, value: Column, otherwise: Column) -> Column:
    """A flag that counts if its key is present, be it null; else ``otherwise``."""
    return F.when(present, as_bool(value)).otherwise(otherwise)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def number_list(values: Column) -> Column:
    """The parsable entries of a list of texts, as doubles."""
    return F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def at(values: Column, index: Column | int) -> Column:
    """Entry at a 0-based index as text, empty if there is none."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.coalesce(F.get(values, i).cast("string"), F.lit(""))
