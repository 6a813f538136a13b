"""Verdict columns: labels and types from a classifier's JSON answers, and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import BENIGN, CORE, FULL, UNDETERMINED, canonical, text


def _keys(body: Column) -> Column:
    return F.json_object_keys(body)


def _get(body: Column, key: str) -> Column:
    return F.get_json_object(body, f"$['{key}']")


def _str(body: Column, key: str) -> Column:
    """The value as text; a null that is present reads None."""
    return F.when(F.array_contains(_keys(body), key), F.coalesce(_get(body, key), F.lit("None")))


def label(body) -> Column:
    """Classification, else Detected Category, else the error, else Undetermined; by presence of the key."""
    b = F.col(body) if isinstance(body, str) else body
    return F.coalesce(_str(b, "Classification"), _str(b, "Detected Category"), F.concat(F.lit("Error: "), _str(b, "error")), F.lit(UNDETERMINED))


def kind(body) -> Column:
    """The first malware type that is not null, of three spellings; empty without."""
    b = F.col(body) if isinstance(body, str) else body
    return F.coalesce(_get(b, "Malware Type"), _get(b, "Malware_Type"), _get(b, "malware_type"), F.lit(""))


def kind_or_list(body) -> Column:
    """The first type that is not blank of two spellings; of a list, of its first item that has one."""
    b = F.col(body) if isinstance(body, str) else body
    schema = "array<struct<`Malware Type`:string,`Malware_Type`:string>>"
    own = lambda x: F.coalesce(F.nullif(x["Malware Type"], F.lit("")), F.nullif(x["Malware_Type"], F.lit("")))
    alone = F.coalesce(F.nullif(_get(b, "Malware Type"), F.lit("")), F.nullif(_get(b, "Malware_Type"), F.lit("")))
    items = F.filter(F.transform(F.from_json(b, schema), own), lambda x: x.isNotNull())
    return F.coalesce(F.when(F.ltrim(b).startswith("["), F.get(items, 0)).otherwise(alone), F.lit(""))


def step_one(category) -> Column:
    """The first step's category as a state: Malicious becomes Core, what is unknown Undetermined."""
    x = text(category)
    return F.when(x.isin(BENIGN, UNDETERMINED), x).when(x == "Malicious", CORE).otherwise(UNDETERMINED)


def step_two(classification) -> Column:
    """The second step's classification as a state."""
    x = canonical(classification)
    return F.when(x.isin(BENIGN, UNDETERMINED, CORE, FULL), x).otherwise(UNDETERMINED)


def safe(body) -> Column:
    """The body if it is a JSON object; else an error object that holds it."""
    b = F.col(body) if isinstance(body, str) else body
    ok = F.try_parse_json(b).isNotNull() & F.ltrim(b).startswith("{")
    return F.when(ok, b).otherwise(F.to_json(F.struct(F.lit("invalid_json").alias("error"), b.alias("raw_response"))))
