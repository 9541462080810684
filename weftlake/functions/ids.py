"""Deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of chunk ids.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 digits with version and variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(dataset: Column, item: Column, index: Column) -> Column:
    return uuid5(F.concat(F.lit("ed-"), dataset.cast("string"), F.lit("-item-"), item.cast("string"), F.lit("-chunk-"), index.cast("string")))
