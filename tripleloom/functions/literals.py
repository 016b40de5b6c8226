"""Datatypes and lexical forms of literals, and catalog column metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import CATALOG_TYPE, XSD, XSD_LOCAL_BY_TYPE
from .text import first_nonempty


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def xsd_datatype(type_name: Column) -> Column:
    """XSD datatype of a declared type; what is missing or unknown is a string."""
    local = _lookup(XSD_LOCAL_BY_TYPE, F.upper(type_name))
    return F.concat(F.lit(XSD), F.coalesce(local, F.lit("string")))


def catalog_type(type_name: Column) -> Column:
    """Catalog JSON type of an upper-case declared type, null if not supported."""
    return _lookup(CATALOG_TYPE, type_name)


def lexical_form(value: Column, data_type: T.DataType) -> Column:
    """Text of a value as an RDF literal of its natural datatype."""
    if isinstance(data_type, T.StringType):
        return value
    text = value.cast("string")
    if isinstance(data_type, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(data_type, T.TimestampNTZType):
        # date_format would read the value in the session time zone; the cast does not.
        joined = F.replace(text, F.lit(" "), F.lit("T"))
        fraction = F.rpad(F.substring_index(joined, ".", -1), 6, "0")
        return F.when(
            joined.contains("."), F.concat(F.substring_index(joined, ".", 1), F.lit("."), fraction)
        ).otherwise(F.concat(joined, F.lit(".000000")))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return (
            F.when(text == "Infinity", F.lit("INF")).when(text == "-Infinity", F.lit("-INF")).otherwise(text)
        )
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    return text


_WHOLE = {XSD + "integer": "decimal(38,0)", XSD + "long": "long", XSD + "int": "int", XSD + "short": "short", XSD + "byte": "byte"}


def may_lack_form(data_type: T.DataType, datatype: str | None) -> bool:
    """Whether some values of a type are no literals of a datatype."""
    fractional = isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType))
    to_whole = datatype in _WHOLE and fractional
    return to_whole or (datatype == XSD + "decimal" and fractional) or (datatype == XSD + "boolean" and isinstance(data_type, T.IntegralType))


def lexical_by_datatype(value: Column, data_type: T.DataType, datatype: str | None) -> Column:
    """Text of a value as a literal of a declared datatype; null where the value has no such form.

    Texts are taken as they are. Numbers declared whole lose an empty fraction, and are no such literal with another
    one; times become days and days the times they begin at; other types keep the text of their own type.
    """
    text = lexical_form(value, data_type)
    fractional = isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType))
    if datatype in _WHOLE and fractional:
        whole = value.try_cast(_WHOLE[datatype])
        return F.when(whole.try_cast(data_type) == value, whole.cast("string"))
    if datatype == XSD + "decimal" and isinstance(data_type, (T.DoubleType, T.FloatType)):
        digits = value.try_cast("decimal(38,12)")
        return F.when(digits.try_cast(data_type) == value, F.regexp_replace(digits.cast("string"), r"\.?0+$", ""))
    if datatype == XSD + "date" and isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("date").cast("string")
    if datatype == XSD + "dateTime" and isinstance(data_type, T.DateType):
        return F.concat(value.cast("string"), F.lit("T00:00:00.000000"))
    if datatype == XSD + "boolean" and isinstance(data_type, T.IntegralType):
        return F.when(value.isin(0, 1), (value == 1).cast("string"))
    return text


def column_annotation(name: Column, type_name: Column, comment: Column) -> Column:
    """``name:TYPE:comment``, leaving out the parts that are empty."""
    return F.concat_ws(
        ":",
        F.nullif(name, F.lit("")),
        F.upper(F.coalesce(first_nonempty(type_name), F.lit("STRING"))),
        F.nullif(comment, F.lit("")),
    )


def type_json(name: Column, json_type: Column) -> Column:
    """Spark's JSON form of a nullable field without metadata."""
    return F.to_json(
        F.struct(
            name.alias("name"),
            json_type.alias("type"),
            F.lit(True).alias("nullable"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
    )
