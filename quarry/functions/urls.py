"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "mc_cid", "mc_eid", "igshid"]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# What ``normalize`` leaves as it is: most URLs, and one look tells.
_NORMAL = r"^[a-z][a-z0-9+.\-]*://[a-z0-9.\-]+/[!\x22$->@-~]*[!\x22$-.0->@-~]\z"


def is_absolute(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#\s]+)?[^\s]+$")), F.lit(False))


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without the port that the scheme implies."""
    host = F.lower(_part(url, 2))
    return (
        F.when(scheme(url) == "http", F.regexp_replace(host, ":80?$|:$", ""))
        .when(scheme(url) == "https", F.regexp_replace(host, ":443$|:$", ""))
        .otherwise(host)
    )


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path_and_query(url: Column) -> Column:
    path = _part(url, 3)
    return F.concat(F.when(path == "", "/").otherwise(path), _part(url, 4))


def normalize(url: Column) -> Column:
    """Without tracking parameters, fragment and closing slash; other parameters keep order and spelling; what is no URL with an authority stays as it is."""
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path == "", "/").otherwise(path)
    raw = F.regexp_replace(_part(url, 4), r"^\?", "")

    def key(p: Column) -> Column:
        name = F.element_at(F.split(p, "=", 2), 1)
        return F.lower(F.coalesce(F.try_url_decode(name), name))

    kept = F.filter(F.split(raw, "&"), lambda p: (p != "") & ~key(p).isin(TRACKING))
    query = F.array_join(kept, "&")
    clean = F.concat(origin(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.rlike(url, F.lit(_NORMAL)), url).when(F.rlike(url, F.lit(_PARTS)), clean).otherwise(url)


def visited_key(url: Column, normalized: bool = True) -> Column:
    """What a visited set compares: case is ignored, in the path too."""
    return F.lower(normalize(url) if normalized else url)


def cache_name(url: Column) -> Column:
    """The file name of a cached response."""
    return F.concat(F.upper(F.sha2(url, 256)), F.lit(".html"))
