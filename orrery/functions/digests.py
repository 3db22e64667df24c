"""Digests of ids as other tools write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ids_sha256(ids: Column) -> Column:
    """SHA-256, in lowercase hex, of an array of longs as little-endian 64-bit integers, in the array's order."""

    def little_endian(x: Column) -> Column:
        digits = F.lpad(F.hex(x), 16, "0")
        return F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)])

    return F.sha2(F.unhex(F.array_join(F.transform(ids, little_endian), "")), 256)


def ids_sha256_sql(ids: str) -> str:
    """The same in SQL, for a list of BIGINT that are not negative."""
    digits = "lpad(lower(to_hex(x)), 16, '0')"
    turned = " || ".join(f"substr({digits}, {k}, 2)" for k in range(15, 0, -2))
    return f"sha256(unhex(list_aggregate(list_transform({ids}, lambda x: {turned}), 'string_agg', '')))"
