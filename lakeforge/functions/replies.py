"""Strict decoding of JSON replies as column expressions.

A document is parsed as a map from key to VARIANT, which keeps all keys in their order, also those that occur twice or differ in case.
Text behind it would be skipped by the parser, so it is parsed as the first of two elements of an array, the other of which
has a key that depends on the text: only if the array has just these two, the text is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EXTERNAL = "array<struct<name:string,type:string>>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def allow_repeated_keys(spark: SparkSession) -> None:
    """For the session: of equal keys within an object of a list, the last counts (else it would be an error)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _kind(value: Column) -> Column:
    """STRING, ARRAY.., OBJECT.., VOID for null, and others."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _values(entries: Column, key: str) -> Column:
    """The values of a key in their order, whatever its case."""
    return F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == key), lambda e: e["value"])


def _strings(values: Column) -> Column:
    return F.forall(values, lambda v: _kind(v).isin("STRING", "VOID"))


def _last(values: Column) -> Column:
    """The last string; '' if there is none, for null leaves a field as it is."""
    told = F.filter(values, lambda v: _kind(v) == "STRING")
    return F.coalesce(F.try_element_at(told, F.lit(-1)).cast("string"), F.lit(""))


def _items(value: Column) -> Column:
    return F.when(_kind(value).startswith("ARRAY"), F.coalesce(value.cast("array<variant>"), F.array().cast("array<variant>")))


def _fields(item: Column) -> Column:
    """Entries of an object, in the order of their keys' bytes; none for null."""
    return F.when(_kind(item).startswith("OBJECT"), F.map_entries(item.cast("map<string,variant>"))).when(_kind(item) == "VOID", F.array().cast("array<struct<key:string,value:variant>>"))


def _good(item: Column) -> Column:
    fields = _fields(item)
    return F.coalesce(_strings(_values(fields, "name")) & _strings(_values(fields, "type")), F.lit(False))


def reply(text: Column) -> Column:
    """struct<ok, summary, external> of one JSON document: keys without regard to case, later ones win, null leaves a field as it
    is (a list empty), unknown keys are skipped; another type, or anything behind the document, makes ok false."""
    second = F.md5(text)
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(',{"'), second, F.lit('":0}]')), "array<map<string,variant>>", _STRICT)
    one = F.coalesce((F.size(parsed) == 2) & F.map_contains_key(F.try_element_at(parsed, F.lit(2)), second), F.lit(False))
    entries = F.coalesce(F.map_entries(F.try_element_at(parsed, F.lit(1))), F.array().cast("array<struct<key:string,value:variant>>"))
    summaries, lists = _values(entries, "summary"), _values(entries, "external")
    shaped = F.forall(lists, lambda v: (_kind(v) == "VOID") | F.coalesce(F.forall(_items(v), _good), F.lit(False)))
    ok = F.coalesce(one & _strings(summaries) & shaped, F.lit(False))
    item = lambda x: F.struct(_last(_values(_fields(x), "name")).alias("name"), _last(_values(_fields(x), "type")).alias("type"))
    external = F.coalesce(F.transform(_items(F.try_element_at(lists, F.lit(-1))), item), F.array().cast(EXTERNAL))
    return F.struct(ok.alias("ok"), F.when(ok, _last(summaries)).otherwise("").alias("summary"), F.when(ok, external).otherwise(F.array().cast(EXTERNAL)).alias("external"))


def envelope(body: Column) -> Column:
    """response of the first JSON value of a body: '' where it has none, null where the body can't be read or response isn't a string."""
    parsed = F.from_json(body, "map<string,variant>", _STRICT)
    values = _values(F.map_entries(parsed), "response")
    last = F.try_element_at(values, F.lit(-1))
    told = F.when(F.size(values) == 0, F.lit("")).when(_kind(last) == "VOID", F.lit("")).when(_kind(last) == "STRING", last.cast("string"))
    return F.when(F.regexp_like(body, F.lit(r"^\s*null(?![A-Za-z0-9_])")), F.lit("")).when(F.regexp_like(body, F.lit(r"^\s*\{")), told)
