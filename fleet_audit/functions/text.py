"""Column expressions on text: globs, sizes, numbers for display, document references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIZES = {unit: 1024**power for power, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB"))}
_JVM_SIZES = {unit: 1024**power for power, unit in enumerate(("", "K", "M", "G", "T"))}
_DURATIONS_MS = {"ns": 1e-6, "us": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}

_NUMBER = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]{0,2})\s*$"
_FACTOR = "decimal(22,6)"


def _unit_table() -> dict[str, tuple[str, str | None, float]]:
    """Unit text -> kind, name of the resulting unit, factor. JVM units have a prefix."""
    return {
        "": ("number", None, 1),
        "%": ("percent", "share", 0.01),
        **{unit: ("size", "bytes", factor) for unit, factor in _SIZES.items()},
        **{unit: ("duration", "ms", factor) for unit, factor in _DURATIONS_MS.items()},
        **{f"jvm {unit}": ("size", "bytes", factor) for unit, factor in _JVM_SIZES.items()},
    }


def glob_regex(globs) -> str:
    """One case-insensitive regular expression that matches any of the globs, whole key."""
    parts = [".*".join(re.escape(piece) for piece in glob.split("*")) for glob in globs]
    return "(?is)^(?:" + "|".join(parts) + ")$"


def whole_match_regex(patterns) -> str:
    """One case-insensitive regular expression that matches any pattern, whole text."""
    return r"(?is)^\s*(?:" + "|".join(patterns) + r")\s*$"


def normalized(entries: DataFrame, jvm: Column, raw: str = "raw") -> DataFrame:
    """Add ``kind, num, unit`` of a raw setting.

    Sizes become bytes (binary multiples), durations milliseconds, percentages a
    share, booleans 1 or 0. ``jvm`` is true where one-letter size suffixes are meant.
    A sign and any number of digits are accepted, rounded to six decimals; a number that
    is too large to be held is text. Units are looked up in a constant map, in steps, so
    that the generated code stays short.
    """
    units = F.create_map(*[
        item
        for unit, (kind, name, factor) in _unit_table().items()
        for item in (F.lit(unit), F.struct(
            F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("unit"),
            F.lit(format(factor, "f")).cast(_FACTOR).alias("factor")))
    ])
    unit, flag = F.regexp_extract(raw, _NUMBER, 2), F.lower(F.trim(raw))
    return (
        entries.withColumns({
            "_number": F.regexp_extract(raw, _NUMBER, 1).try_cast("decimal(30,6)"),
            "_unit": F.when(jvm, F.concat(F.lit("jvm "), F.upper(unit))).otherwise(unit),
            "_flag": F.when(flag.isin("true", "false"), flag),
        })
        .withColumn("_found", F.when(
            F.col("_number").isNotNull() & F.col("_flag").isNull(),
            F.coalesce(F.try_element_at(units, F.col("_unit")), F.try_element_at(units, F.upper("_unit")))))
        .withColumn("_scaled", (F.col("_number").cast("decimal(30,6)") * F.col("_found.factor").cast("decimal(22,6)")).try_cast("decimal(38,6)"))
        .withColumn("_found", F.when(F.col("_scaled").isNotNull(), F.col("_found")))
        .select(
            *entries.columns,
            F.when(F.col("_flag").isNotNull(), "boolean").otherwise(F.coalesce("_found.kind", F.lit("text"))).alias("kind"),
            F.when(F.col("_flag").isNotNull(), (F.col("_flag") == "true").cast("decimal(38,6)"))
            .otherwise(F.col("_scaled")).alias("num"),
            F.col("_found.unit").alias("unit"),
        )
    )


def _amount(text: Column, factors: dict[str, float]) -> Column:
    """A number with a unit in the smallest one; a number without is taken as it stands, other text is NULL."""
    unit = F.regexp_extract(text, _NUMBER, 2)
    known = F.create_map(*[F.lit(x) for unit_name, factor in factors.items() for x in (unit_name, float(factor))])
    factor = F.when(unit == "", 1.0).otherwise(F.try_element_at(known, unit))
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double") * factor


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as ``1.20m``, ``15.00ms`` or ``3ns``; null where it is none."""
    return _amount(text, _DURATIONS_MS)


def data_bytes(text: Column) -> Column:
    """Bytes of an amount of data such as ``1.5GB`` or ``10kB``, in binary multiples; null where it is none."""
    return _amount(F.upper(text), _SIZES)


def plain_number(value: Column) -> Column:
    """A number with at most two decimals and no trailing zeros."""
    hundredths = F.floor(value * 100 + 0.5).cast("bigint")
    text = F.concat(
        F.when(hundredths < 0, "-").otherwise(""),
        F.floor(F.abs(hundredths) / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((F.abs(hundredths) % 100).cast("string"), 2, "0"),
    )
    return F.regexp_replace(text, r"\.?0+$", "")


def human_bytes(value: Column) -> Column:
    """Bytes in the largest binary unit not above the value, such as ``24GB``."""
    number = value.cast("double")
    chain = None
    for unit, factor in reversed(_SIZES.items()):
        branch = F.concat(plain_number(number / factor), F.lit(unit))
        if unit == "B":
            return chain.otherwise(branch)
        chain = F.when(number >= factor, branch) if chain is None else chain.when(number >= factor, branch)


def ratio_text(value: Column) -> Column:
    """A ratio for display, such as ``5.25x``."""
    return F.concat(plain_number(value), F.lit("x"))


def doc_parts(source: Column) -> dict[str, Column]:
    """Split a one-line document reference, such as ``Guide p.14``, into text and page."""
    page = F.regexp_extract(source, r"\s+p\.\s*(\d{1,9})\s*$", 1)
    return {
        "source": F.regexp_replace(source, r"\s+p\.\s*\d{1,9}\s*$", ""),
        "page": page.try_cast("int"),
    }


def limit_parts(text: Column) -> tuple[Column, Column]:
    """Comparison sign and number of the first limit in a text; a percentage is a share."""
    pattern = r"(<=|>=|<|>|=)?\s*((?:(?<![\w.])[+-])?\d+(?:\.\d+)?)\s*(%?)"
    number = F.regexp_extract(text, pattern, 2).try_cast("double")
    share = F.regexp_extract(text, pattern, 3) == "%"
    return (
        F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")),
        F.when(share, number / 100).otherwise(number),
    )
