"""Field types: each is a pair of Column functions, parse (text to value, null
where it can't) and show (value to text), and a Spark type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NULLS = ("", "-", "null", "none", "nil", "n/a", "na")
_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
DATE, DATETIME = "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss"


@dataclass(frozen=True)
class NumberLocale:
    """Marks of numbers; the default is that of programs."""

    decimal: str = "."
    thousands: str = ""

    def plain(self, c: Column) -> Column:
        if self.thousands:
            c = F.replace(c, F.lit(self.thousands), F.lit(""))
        return F.replace(c, F.lit(self.decimal), F.lit(".")) if self.decimal != "." else c


PLAIN = NumberLocale()


@dataclass(frozen=True)
class Field:
    name: str
    spark: str
    parse: Callable[[Column], Column]
    show: Callable[[Column], Column]
    null_tokens: bool = True
    sql: str = "TEXT"
    django: str = "TextField"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_null(c: Column) -> Column:
    return c.isNull() | c.rlike(rf"(?i)^\s*(?:{'|'.join(NULLS)})\s*$")


def _guarded(c: Column, pattern: str, value: Column) -> Column:
    """No pattern fits a null token, so these are null as well."""
    return F.when(c.rlike(pattern), value)


def parse_bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False)


def parse_integer(c: Column, locale: NumberLocale = PLAIN, kind: str = "bigint") -> Column:
    p = locale.plain(c)
    return _guarded(p, rf"^\s*[+-]?{_DIGITS}\s*$", F.replace(stripped(p), F.lit("_"), F.lit("")).try_cast(kind))


def parse_float(c: Column, locale: NumberLocale = PLAIN) -> Column:
    p = locale.plain(c)
    return _guarded(p, rf"^\s*[+-]?(?:{_NUMBER}|(?i:inf|infinity|nan))\s*$", F.replace(stripped(p), F.lit("_"), F.lit("")).try_cast("double"))


def parse_decimal(c: Column, locale: NumberLocale = PLAIN, scale: int = 6) -> Column:
    p = locale.plain(c)
    return _guarded(p, rf"^\s*[+-]?{_NUMBER}\s*$", F.replace(stripped(p), F.lit("_"), F.lit("")).try_cast(f"decimal(38,{scale})"))


def parse_percent(c: Column, locale: NumberLocale = PLAIN, scale: int = 6) -> Column:
    p = F.replace(locale.plain(c), F.lit("%"), F.lit(""))
    return F.when(c.contains("%"), (parse_decimal(p, PLAIN, scale) / 100).cast(f"decimal(38,{scale + 2})"))


def parse_date(c: Column) -> Column:
    return _guarded(c, r"^\d{4}-\d{1,2}-\d{1,2}$", c.try_cast("date"))


def parse_datetime(c: Column) -> Column:
    return _guarded(c, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$", c.try_cast("timestamp_ntz"))


def parse_email(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]+$"), c)


def parse_uuid(c: Column) -> Column:
    bare = F.lower(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(F.length(c).isin(32, 36) & bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def parse_json(c: Column) -> Column:
    return F.when(~is_null(c) & F.try_parse_json(c).isNotNull(), c)


def parse_binary(c: Column) -> Column:
    return F.try_to_binary(c, F.lit("base64"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def show_percent(c: Column, places: int = 2) -> Column:
    return F.coalesce(F.concat(F.round(c * 100, places).cast(f"decimal(38,{places})").cast("string"), F.lit("%")), F.lit(""))


def show_datetime(c: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(c, DATETIME), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"^\.000000$", "")), F.lit(""))


def show_number(c: Column, locale: NumberLocale, places: int = 2) -> Column:
    """With the marks of a locale."""
    return F.translate(F.format_number(c, places), ",.", (locale.thousands or "\x00") + locale.decimal) if locale.thousands else F.replace(F.replace(F.format_number(c, places), F.lit(","), F.lit("")), F.lit("."), F.lit(locale.decimal))


FIELDS = {
    f.name: f
    for f in (
        Field("bool", "boolean", parse_bool, _text, sql="BOOLEAN", django="BooleanField"),
        Field("integer", "bigint", parse_integer, _text, sql="BIGINT", django="IntegerField"),
        Field("big_integer", "decimal(38,0)", lambda c: parse_integer(c, kind="decimal(38,0)"), _text, sql="NUMERIC", django="DecimalField"),
        Field("float", "double", parse_float, _text, sql="FLOAT", django="FloatField"),
        Field("decimal", "decimal(38,6)", parse_decimal, _text, sql="NUMERIC", django="DecimalField"),
        Field("percent", "decimal(38,8)", parse_percent, show_percent, sql="FLOAT", django="DecimalField"),
        Field("datetime", "timestamp_ntz", parse_datetime, show_datetime, sql="DATETIME", django="DateTimeField"),
        Field("date", "date", parse_date, lambda c: F.coalesce(F.date_format(c, DATE), F.lit("")), sql="DATE", django="DateField"),
        Field("json", "string", parse_json, _text, django="JSONField"),
        Field("email", "string", parse_email, _text, django="EmailField"),
        Field("uuid", "string", parse_uuid, _text, django="UUIDField"),
        Field("text", "string", lambda c: c, _text, null_tokens=False),
        Field("binary", "binary", parse_binary, lambda c: F.coalesce(F.base64(c), F.lit("")), sql="BLOB", django="BinaryField"),
    )
}
DEFAULT = ("bool", "integer", "big_integer", "float", "decimal", "percent", "datetime", "date", "json", "text")
ALL = ("bool", "integer", "big_integer", "float", "datetime", "date", "decimal", "percent", "json", "email", "uuid", "text")


def register(field: Field) -> None:
    """A type of one's own, by name."""
    FIELDS[field.name] = field


def field_of(spark_type: str) -> Field:
    """The field of a Spark type."""
    for names, field in ((("boolean",), "bool"), (("tinyint", "smallint", "int", "bigint"), "integer"), (("float", "double"), "float"), (("date",), "date"), (("binary",), "binary")):
        if spark_type in names:
            return FIELDS[field]
    return FIELDS["decimal" if spark_type.startswith("decimal") else "datetime" if spark_type.startswith("timestamp") else "text"]
