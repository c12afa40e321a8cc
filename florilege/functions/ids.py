"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public namespace of URLs for version 5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(url: Column, index: Column) -> Column:
    """Id of a chunk of a page."""
    return uuid5(F.concat(F.coalesce(url, F.lit("")), F.lit("#"), index.cast("string")))


def joined_id(prefix: str, *parts: Column) -> Column:
    """Id of a record made of several fields."""
    return F.concat(F.lit(prefix + "::"), F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])))
