"""URLs as column expressions, by anchored patterns (``parse_url`` gives up on non-ASCII paths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host and port, as written; ``''`` for a url without ``//``."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def base_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _bare_path(url: Column) -> Column:
    bare = F.regexp_replace(path(url), r"/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def crawl_normal(url: Column) -> Column:
    """For crawling: no fragment, no trailing slash, query and host as written."""
    q = query(url)
    return F.concat(base_url(url), _bare_path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def export_normal(url: Column) -> Column:
    """For inventories: host in lower case, no trailing slash, neither query nor fragment."""
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), _bare_path(url))


def domain(text: Column) -> Column:
    """A typed-in domain: host name in lower case without ``www.``, port or scheme; null if nothing is left."""
    trimmed = F.trim(text)
    with_scheme = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(with_scheme), r"^.*@", ""), r":\d*$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def resolved(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``; dot segments of a relative one are resolved, however many there are."""
    root = base_url(base)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    relative = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, F.when(relative.rlike(r"^[^?#]*/\.\.?(?:/|[?#]|$)"), _without_dots(relative)).otherwise(relative)))
    )


def _without_dots(relative: Column) -> Column:
    """A path (with query or fragment) without dot segments: two dots take the segment before with them."""
    own = F.regexp_extract(relative, r"^([^?#]*)", 1)
    parts = F.split(F.regexp_replace(own, "^/", ""), "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", back).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    left = F.aggregate(parts, none, step)
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", "..") & (F.size(left) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(left, "/"), closed, F.regexp_extract(relative, r"^[^?#]*(.*)$", 1))


def is_private_host(url: Column) -> Column:
    """Whether the url names the local machine or a private address literally; no name is looked up."""
    host = F.lower(F.regexp_replace(netloc(url), r":\d*$", ""))
    private = r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|\[::1\]|\[f[cd][0-9a-f:]*\]|\[fe80[0-9a-f:]*\])$"
    return (host == "") | host.rlike(private)
