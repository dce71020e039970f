"""Hosts and paths of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, up to ? or #; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^?#]*)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Path from the host's end up to ? or #; empty where there is none."""
    return F.regexp_extract(_after_scheme(url), r"^[^/]*((?s).*)$", 1)
