"""Column encodings of dates and coded strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "2010-07-19 00:00:00"


def epoch_seconds(c: Column, epoch: str = EPOCH) -> Column:
    """Seconds since the epoch, session time zone UTC."""
    return F.unix_timestamp(c.cast("timestamp")) - F.unix_timestamp(F.lit(epoch).cast("timestamp"))


def phonetic_to_int(c: Column) -> Column:
    """A letter and digits, such as B52: the letter's place from A = 0, then the digits. Anything else is null."""
    letters = F.regexp_extract(c, r"^([A-Z])[0-9]*$", 1)
    digits = F.regexp_extract(c, r"^[A-Z]([0-9]*)$", 1)
    return F.when(letters != "", F.concat((F.ascii(letters) - 65).cast("string"), digits).cast("bigint"))


def series_years_to_int(c: Column) -> Column:
    """first-last as eight digits; an unknown first year is 1000, an unknown last 9999; other text is 0."""
    pattern = r"^(\d{4}|\?{4})-(\d{4}|\?{4})$"
    first, last = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    year = lambda y, unknown: F.when(y == "????", unknown).otherwise(y)
    return F.when(c.isNull(), None).when(first == "", 0).otherwise(F.concat(year(first, "1000"), year(last, "9999")).cast("bigint"))


def roman_to_int(c: Column) -> Column:
    """Roman numerals by the subtractive rule; digits pass through."""
    value = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in pair]), x), F.lit(0))
    numbers = F.transform(F.split(F.upper(c), ""), value)
    after = F.concat(F.slice(numbers, 2, 1000), F.array(F.lit(0)))
    signed = F.zip_with(numbers, after, lambda a, b: F.when(a < b, -a).otherwise(a))
    total = F.aggregate(signed, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(F.upper(c).rlike("^[IVXLCDM]+$"), total)


def dates_to_seconds(df: DataFrame, epoch: str = EPOCH) -> DataFrame:
    """Every date and timestamp column as seconds since the epoch: a projection, the source stays as it is."""
    moments = [f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    return df.withColumns({c: epoch_seconds(F.col(c), epoch) for c in moments})
