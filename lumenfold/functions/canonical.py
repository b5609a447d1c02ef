"""Canonical JSON of any column: keys in order at every depth, no blanks, the same text as `storage.canonical_json`.

Structs, maps and arrays are walked by their types at plan time, so the text
is made by built-in expressions alone. A VARIANT keeps its fields in order by
itself; its numbers are spelled as variants spell them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.hashing import json_string

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def canonical(col: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of type ``kind``; null is ``null``.

    Decimals, dates and timestamps (by the session's time zone) stand as
    strings; maps need keys of text; binary columns have no JSON and raise.
    """
    return F.coalesce(_text(col, kind), F.lit("null"))


def _text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return _string(col)
    if isinstance(kind, (T.BooleanType, *_WHOLE)):
        return col.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return json_float(col.cast("double"))
    if isinstance(kind, (T.DecimalType, T.DateType)):
        return _string(col.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _string(F.regexp_replace(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "\\.000000$", ""))
    if isinstance(kind, T.ArrayType):
        items = F.transform(col, lambda x: canonical(x, kind.elementType))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("maps need keys of text to be written as JSON")
        pairs = F.transform(F.array_sort(F.map_keys(col)), lambda k: F.concat(_string(k), F.lit(":"), canonical(F.element_at(col, k), kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(_quoted(f.name) + ":"), canonical(col.getField(f.name), f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    if isinstance(kind, T.VariantType):
        return F.to_json(col)
    raise TypeError(f"{kind.simpleString()} has no canonical JSON")


def _quoted(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def _string(col: Column) -> Column:
    return F.when(col.isNotNull(), json_string(col))


def json_float(value: Column) -> Column:
    """A double as the shortest decimal that gives it back: positional from 1e-4 up to below 1e16, else with an exponent of two digits or more.

    Java before 19 writes a digit too many now and then; fewer are taken where
    they give the value back. Of several shortest texts of one value, which
    differ in the last of 16 or 17 digits, it may then not be Python's.
    """

    def shorter(digits: int) -> Callable[[Column], Column]:
        """A text with more digits than these, with just these where they give the value back."""

        def of(t: Column) -> Column:
            long = F.length(F.regexp_replace(t, r"E.*|\.", "")) > digits
            return F.when(long, _let(_rounded(value, digits), lambda f: F.when(f.cast("double") == F.abs(value), f).otherwise(t))).otherwise(t)

        return of

    def parts(t: Column) -> Column:
        mantissa = F.regexp_replace(F.regexp_extract(t, r"^([0-9.]+)", 1), r"\.0$", "")
        power = F.coalesce(F.nullif(F.regexp_extract(t, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
        return _let(F.struct(mantissa.alias("mantissa"), power.alias("power")), lambda m: F.struct(F.regexp_extract(m["mantissa"], r"^(\d+)", 1).alias("whole"), F.regexp_extract(m["mantissa"], r"\.(\d+)$", 1).alias("fraction"), m["power"].alias("power")))

    def placed(p: Column) -> Column:
        """struct(digits, first): digits without zeros at the ends, and the power of ten of the first."""
        every = F.concat(p["whole"], p["fraction"])
        return _let(F.struct(every.alias("every"), F.regexp_replace(every, "^0+", "").alias("bare")), lambda e: F.struct(F.regexp_replace(e["bare"], "0+$", "").alias("digits"), (F.length(p["whole"]) - 1 - (F.length(e["every"]) - F.length(e["bare"])) + p["power"]).alias("first")))

    def spelled(p: Column) -> Column:
        digits, first = p["digits"], p["first"]
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -first - 1), digits)
        middle = F.concat(F.substring(F.rpad(digits, first + 1, "0"), F.lit(1), first + 1), F.lit("."), F.when(n > first + 1, F.substring(digits, first + 2, n)).otherwise("0"))
        scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(first < 0, "-").otherwise("+"), F.lpad(F.abs(first).cast("string"), F.greatest(F.lit(2), F.length(F.abs(first).cast("string"))), F.lit("0")))
        return F.when(digits == "", "0.0").when(first < -4, scientific).when(first < 0, small).when(first < 16, middle).otherwise(scientific)

    def signed(own: Column) -> Column:
        whole = _let(_let(_let(_let(_let(F.regexp_replace(own, "^-", ""), shorter(17)), shorter(16)), parts), placed), spelled)
        plain = F.length(own) <= 17  # at most 16 digits: spelled as here already, where no zero is at the end
        return F.when(plain & own.rlike(_PLAIN), own).otherwise(F.concat(F.when(own.startswith("-"), "-").otherwise(""), whole))

    special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity")
    return F.when(value.isNotNull(), F.coalesce(special, _let(value.cast("string"), signed)))


#: Positional numbers without needless zeros.
_PLAIN = r"^-?(?:0|[1-9]\d*)\.(?:0|\d*[1-9])$"


def _rounded(value: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits - 1}e", F.abs(value)), r"e\+?", "E")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def canonical_row(schema: T.StructType) -> Column:
    """All columns of a table as one canonical JSON object."""
    return canonical(F.struct(*[F.col(f"`{f.name}`") for f in schema]), schema)


def canonical_hash(*cols: tuple[Column, T.DataType]) -> Column:
    """SHA-256 of the canonical JSON array of columns of any types."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[canonical(c, k) for c, k in cols]), F.lit("]")), 256)
