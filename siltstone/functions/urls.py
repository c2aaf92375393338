"""URL columns: canonical form, origin, guard verdicts, unwrapping and tracking parameters.

One regular expression takes a URL apart, so malformed URLs give nulls or verdicts and never raise.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: scheme, user info, host, port, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    """Lower-cased, without a trailing dot."""
    return F.regexp_replace(F.lower(part(url, 3)), r"\.$", "")


def _port(url: Column) -> Column:
    scheme, port = F.lower(part(url, 1)), part(url, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))


def origin(url: Column) -> Column:
    """scheme://host[:port]; null for anything but http and https."""
    scheme = F.lower(part(url, 1))
    return F.when(scheme.isin("http", "https") & (host(url) != ""), F.concat(scheme, F.lit("://"), host(url), _port(url)))


def canonical(url: Column) -> Column:
    """Origin, path (at least /) and query; the fragment goes. Null for anything but http and https."""
    path = F.when(part(url, 5) == "", F.lit("/")).otherwise(part(url, 5))
    return F.concat(origin(url), path, part(url, 6))


def without_tracking(url: Column) -> Column:
    """The URL without tracking parameters and fragment; other parameters keep their order."""
    kept = F.filter(F.split(F.regexp_replace(part(url, 6), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), query)


def unwrapped(url: Column, parameter: str = "uddg") -> Column:
    """The target that a redirect link carries in a parameter, or the URL itself."""
    raw = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(raw == "", url).otherwise(F.try_url_decode(raw))


def guard(url: Column, internal: tuple[str, ...] = ("localhost", "local", "internal", "lan", "home", "corp")) -> Column:
    """The first reason against fetching a URL, in a fixed order; null if there is none."""
    scheme, h, port = F.lower(part(url, 1)), host(url), part(url, 4)
    rules = [
        (part(url, 1) == "", "invalid_url"),
        (~scheme.isin("http", "https"), "scheme_not_allowed"),
        (F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)", 1) != "", "credentials_not_allowed"),
        (h == "", "missing_host"),
        (h.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"), "ip_literal_not_allowed"),
        (~h.contains(".") | F.regexp_extract(h, r"([^.]*)$", 1).isin(*internal), "internal_host_not_allowed"),
        (~port.isin("", "80", "443"), "port_not_allowed"),
    ]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0]))


def global_addresses(addresses: Column) -> Column:
    """Are all IPv4 addresses of a non-empty list outside the private, loopback, link-local, shared and reserved ranges?"""
    private = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\."
    return (F.size(addresses) > 0) & F.forall(addresses, lambda a: a.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~a.rlike(private))


def _user(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)", 1)


def within_origin(url: Column, allowed: Column) -> Column:
    """The first reason against a URL where one origin is allowed, in a fixed order; null if there is none."""
    scheme, port = F.lower(part(url, 1)), part(url, 4)
    c = F.when(scheme == "", "invalid_url").when(~scheme.isin("http", "https"), "scheme_denied").when(_user(url) != "", "credentials_denied").when(~port.isin("", "80", "443"), "port_denied")
    c = c.when(host(url).rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"), "ip_literal_denied")
    return c.when(F.concat(scheme, F.lit("://"), host(url), _port(url)) != allowed, "origin_denied")


def fits_rule(url: Column, scheme: Column, path: Column, query: Column) -> Column:
    """Has a URL the scheme, exactly the query, and a path that the pattern matches whole? False without a rule."""
    whole = F.concat(F.lit("^("), path, F.lit(")$"))
    return F.coalesce((F.lower(part(url, 1)) == scheme) & F.regexp_like(part(url, 5), whole) & (F.regexp_replace(part(url, 6), r"^\?", "") == query), F.lit(False))


def variations(name: Column, suffixes: tuple[str, ...] = (".com", ".io", "-app.com")) -> Column:
    """Domains that a name may stand under."""
    return F.array(*[F.concat(F.lower(name), F.lit(x)) for x in suffixes])


@F.pandas_udf(T.BooleanType())
def all_global(addresses: pd.Series) -> pd.Series:
    """Is there an address, and is each, of either version, a public one? What is no address isn't."""

    def is_global(a) -> bool:
        try:
            return ipaddress.ip_address(a).is_global
        except ValueError:
            return False

    return addresses.map(lambda own: own is not None and len(own) > 0 and all(map(is_global, own))).astype(bool)
