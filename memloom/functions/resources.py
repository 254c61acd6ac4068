"""Token prices and the affine latency proxy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memloom.functions.coerce import nonnegative_int

#: Raw cost is tokens times the price of a million; divided once.
RAW_TO_USD = 1e6


def affine_latency(profile: str, calls: Column, tokens_in: Column, tokens_out: Column, images: Column) -> Column:
    """calls * base + in * a + out * b + images * c, by the columns of ``profile``."""
    p = lambda n: F.col(f"{profile}.{n}")
    return (
        calls * p("latency_base_seconds")
        + tokens_in * p("latency_input_seconds_per_token")
        + tokens_out * p("latency_output_seconds_per_token")
        + images * p("latency_image_seconds")
    )


def raw_cost(profile: str, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.col(f"{profile}.input_price_per_million_usd") + tokens_out * F.col(f"{profile}.output_price_per_million_usd")


def reported_or_priced(reported_usd: Column, priced_raw: Column) -> Column:
    """The provider's own cost where there is one, else the priced tokens."""
    return F.coalesce(F.greatest(reported_usd, F.lit(0.0)) * RAW_TO_USD, priced_raw)


def usage_tokens(prompt: Column, inputs: Column, completion: Column, outputs: Column, total: Column) -> Column:
    """STRUCT(input, output, total): the first non-zero of two spellings; the total falls back on the sum."""
    first = lambda a, b: nonnegative_int(F.coalesce(F.nullif(a, F.lit(0)), b))
    i, o = first(prompt, inputs), first(completion, outputs)
    return F.struct(i.alias("input"), o.alias("output"), F.coalesce(F.nullif(nonnegative_int(total), F.lit(0)), i + o).alias("total"))


def resource_reward(value: Column, eligible: Column) -> Column:
    """Minus the value in single precision; 0 where it is not eligible."""
    return F.when(eligible, -value.cast("float")).otherwise(F.lit(0.0).cast("float"))


def latency_stage(c: Column) -> Column:
    return c.try_cast("int")


def interval_steps(steps: Column, fraction: Column) -> Column:
    return F.greatest(F.ceil(steps * fraction), F.lit(1))


def guarded(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.when(F.coalesce(denominator, F.lit(0)) == 0, 0.0).otherwise(numerator / denominator)
