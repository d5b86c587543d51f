"""Small value conversions: times, addresses, names and log paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identities that never name a remote node.
LOOPBACKS = ("", "127.0.0.1", "localhost", "0.0.0.0")


def iso_time(epoch_s: Column) -> Column:
    """Epoch seconds as ISO text with a trailing Z; microseconds only when present."""
    at = F.timestamp_micros(F.round(epoch_s.cast("double") * 1e6).cast("long"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.unix_micros(at) % 1_000_000 == 0, whole).otherwise(exact), F.lit("Z"))


def url_host(url: Column) -> Column:
    """Host of a URL, trimmed and lower-case; empty when absent or malformed."""
    return F.coalesce(F.trim(F.lower(F.try_parse_url(url, F.lit("HOST")))), F.lit(""))


def node_identifiers(expected_ip: Column, url: Column) -> Column:
    """Distinct addresses of a configured node, loopbacks left out."""
    both = F.array(F.coalesce(expected_ip, F.lit("")), url_host(url))
    return F.array_except(both, F.array(*[F.lit(v) for v in LOOPBACKS]))


def is_ip_like(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def node_display_name(name: Column, ip: Column, alias: Column) -> Column:
    """Trimmed name, else ip; an address-like name is replaced by the alias if any."""
    ip = F.trim(F.coalesce(ip, F.lit("")))
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    shown = F.when(trimmed == "", ip).otherwise(trimmed)
    plain = (shown != "") & ~is_ip_like(shown)
    return F.when(plain, shown).otherwise(F.coalesce(alias, shown))


def log_filename(path: Column) -> Column:
    """The part after the first ``/logs/``, else the path without leading slashes."""
    at = F.instr(path, "/logs/")
    return F.when(at > 0, F.substr(path, at + F.lit(len("/logs/")))).otherwise(
        F.regexp_replace(path, "^/+", "")
    )


def usage_node_ip(keys: Column) -> Column:
    """Address from the first resource key holding ``node:``; ``unknown`` without one."""
    named = F.get(F.filter(keys, lambda k: F.contains(k, F.lit("node:"))), F.lit(0))
    return F.coalesce(F.split_part(named, F.lit(":"), F.lit(2)), F.lit("unknown"))
