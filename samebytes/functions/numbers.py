"""retry delays, JSON options, byte text and I/O budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samebytes.functions.common import col

MIB = 1024 * 1024


def retry_delay_seconds(failures: Column | str, base: int, largest: int) -> Column:
    """doubling from `base`, at most ten times, never above `largest`."""
    power = F.least(F.greatest(col(failures) - 1, F.lit(0)), F.lit(10)).cast("int")
    factor = F.call_function("shiftleft", F.lit(1).cast("bigint"), power)
    return F.least(F.lit(base).cast("bigint") * factor, F.lit(largest).cast("bigint"))


def payload_uint(payload: Column | str, key: str) -> Column:
    """an unsigned JSON integer; negative, fractional, textual or absent gives NULL."""
    value = F.variant_get(_json(payload), f"$.{key}", "variant")
    text = F.when(F.schema_of_variant(value) == "BIGINT", F.to_json(value))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def payload_string(payload: Column | str, key: str) -> Column:
    """a JSON string; any other type gives NULL."""
    value = F.variant_get(_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def payload_string_list(payload: Column | str, key: str) -> Column:
    """`struct(names, error)`; absent and null mean no list and no error."""
    value = F.variant_get(_json(payload), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    empty = kind.isNull() | (kind == "VOID")
    items = F.try_variant_get(value, "$", "array<variant>")
    fits = F.forall(items, lambda item: F.schema_of_variant(item) == "STRING")
    error = (
        F.when(empty, F.lit(None).cast("string"))
        .when(items.isNull(), F.lit("not_an_array"))
        .when(~F.coalesce(fits, F.lit(False)), F.lit("not_strings"))
    )
    names = F.when(~empty & error.isNull(), F.transform(items, lambda item: item.cast("string")))
    return F.struct(names.alias("names"), error.alias("error"))


def _json(payload: Column | str) -> Column:
    return F.try_parse_json(col(payload))


def format_bytes(size: Column | str) -> Column:
    """B, KiB without decimals, MiB and up with one; halves round up."""
    size = col(size).cast("double")
    text = F.format_string("%.0f B", size)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        pattern = f"%.{0 if power == 1 else 1}f {unit}"
        scaled = F.format_string(pattern, size / F.lit(float(1024**power)))
        text = F.when(size >= float(1024**power), scaled).otherwise(text)
    return text


def io_budget_ms(size: Column | str, mib_per_second: int) -> Column:
    """milliseconds a read may take, at least 1; nothing to read or no limit costs 0.

    Whole seconds and the rest are computed apart, so no size overflows.
    """
    if mib_per_second <= 0:
        return F.lit(0).cast("bigint")
    size = col(size).cast("bigint")
    rate = F.lit(mib_per_second * MIB).cast("bigint")
    whole = F.call_function("div", size, rate) * 1000
    rest = F.call_function("div", (size % rate) * 1000 + rate - 1, rate)
    return F.when(size <= 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(whole + rest, F.lit(1).cast("bigint"))
    )
