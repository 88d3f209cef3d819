"""Reproducible randomness: everything random is a hash of a key and a seed text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column | str, salt: Column | str) -> Column:
    """md5 of ``key-salt`` as 32 hex digits; its text order is a random order of the keys.

    A plain string ``salt`` is the salt itself; pass a Column for a per-row salt.
    """
    key = F.col(key) if isinstance(key, str) else key
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat(key.cast("string"), F.lit("-"), salt.cast("string")))


def hex_number(text: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of ``text`` from 1-based ``start`` as a bigint."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def uniform(key: Column | str, salt: Column | str) -> Column:
    """A double in [0, 1) from the first 8 hex digits of the digest."""
    return hex_number(digest(key, salt), 1, 8).cast("double") / F.lit(4294967296.0)


def fold(key: Column | str, salt: Column | str, k: int) -> Column:
    """Fold number 0..k-1 of a key."""
    return F.pmod(hex_number(digest(key, salt), 1, 8), F.lit(k)).cast("int")
