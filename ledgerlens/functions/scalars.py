"""Scalar expressions over transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import ROUND_AMOUNTS


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def parse_timestamp(c: Column) -> Column:
    """Unix seconds as a UTC timestamp; the epoch where they can't be read."""
    return F.timestamp_seconds(safe_int(c))


def direction(src: Column, dst: Column, wallet: Column, internal: Column) -> Column:
    """A transfer to oneself is incoming."""
    return F.when(internal, "INTERNAL").when(dst == wallet, "INCOMING").when(src == wallet, "OUTGOING").otherwise("INTERNAL")


def tx_type(contract: Column, data: Column) -> Column:
    return F.when(F.coalesce(contract, F.lit("")) != "", "TOKEN_TRANSFER").when(~F.coalesce(data, F.lit("")).isin("0x", "0x0", ""), "CONTRACT_CALL").otherwise("TRANSFER")


def selector(data: Column) -> Column:
    """First four bytes of calldata in lower case, without 0x; null if there aren't as many."""
    low = F.lower(data)
    begin = F.when(low.startswith("0x"), 3).otherwise(1)
    return F.when(F.length(low) >= begin + 7, F.substring(low, begin, F.lit(8)))


def stripped_selector(data: Column, mode: str = "lstrip") -> Column:
    """The selector as cash-out rules read it: ``lstrip`` drops all leading 0 and x, ``strict`` only the prefix."""
    if mode == "strict":
        return F.coalesce(selector(data), F.lit(""))
    hex_ = F.ltrim(F.lower(data), F.lit("0x"))
    return F.when(F.length(hex_) >= 8, F.substring(hex_, 1, 8)).otherwise("")


def prefix(data: Column) -> Column:
    return F.lower(F.substring(data, 1, 10))


def abi_address(data: Column) -> Column:
    """The first address argument of a call; null if the data are too short."""
    hex_ = F.replace(F.lower(data), F.lit("0x"), F.lit(""))
    return F.when(F.length(hex_) >= 72, F.concat(F.lit("0x"), F.substring(hex_, 33, 40)))


def chunks(data: Column, size: int = 8) -> Column:
    """Distinct whole chunks of calldata."""
    hex_ = F.replace(F.lower(data), F.lit("0x"), F.lit(""))
    n = F.floor(F.length(hex_) / size).cast("int")
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(hex_, i * size + 1, F.lit(size))))).otherwise(F.expr("cast(array() AS array<string>)"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets held as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def is_round_half(amount: Column) -> Column:
    return F.round(amount % F.lit(0.5), 6) == 0


def round_amount(amount: Column) -> Column:
    """The listed round amount that lies within one part in ten thousand; null if none does."""
    near = reduce(lambda later, x: F.when(F.abs(amount - x) / x <= 1e-4, F.lit(x)).otherwise(later), reversed(ROUND_AMOUNTS), F.lit(None).cast("double"))
    return F.when(amount >= 0.01, near)


def is_address(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))


def is_tx_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[0-9a-fA-F]{64}$"), F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def short_label(address: Column) -> Column:
    return F.concat(F.substring(address, 1, 6), F.lit("…"), F.right(address, F.lit(4)))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def value_layer(value: Column, largest: Column) -> Column:
    return F.when(value <= 1e-9, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(value) / F.log1p(largest)))


def recency_layer(ts: Column, as_of: int) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), (F.lit(as_of) - ts) / 86400.0) / 90.0)


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    """A text of at most ``most`` characters; what is cut off is marked by the suffix, if it fits."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - len(suffix))), F.lit(suffix[:most])))


def masked(key: Column) -> Column:
    """A key for logs: its first and last four characters, or none of one that has no more than these."""
    return F.when(F.length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4))))
