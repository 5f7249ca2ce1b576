"""URL columns: all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.schema import LIST_TYPES

_LISTS = "|".join(name for name, _, _ in LIST_TYPES)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Without query and tracking suffix, ending in a slash."""
    bare = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), r"/ref=.*$", "/")
    return F.when(bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


#: The two forms of a ranked list's path (fixed values).
CHART_PATHS = (rf"/gp/(?:{_LISTS})/([a-z][a-z0-9-]+)", r"/zg(?:bs|ns)/([a-z][a-z0-9-]+)")


def chart_slug(url: Column) -> Column:
    """Category slug of a ranked-list URL in either of its two forms; null if it is neither."""
    return F.coalesce(*[_found(url, path) for path in CHART_PATHS])


def path_slug(url: Column) -> Column:
    """The second path segment after ``gp``; '' if there is none."""
    parts = F.split(url, "/")
    at = F.array_position(parts, "gp")
    return F.when(at > 0, F.coalesce(F.try_element_at(parts, (at + 2).cast("int")), F.lit(""))).otherwise(F.lit(""))


def list_slug(url: Column, list_type: str = "new-releases") -> Column:
    """Slug of the URL of one list; null for others."""
    return _found(url, rf"/gp/{list_type}/([^/]+)/")


def list_of(url: Column) -> Column:
    """The ranked list a URL belongs to; null for others."""
    return _found(url, rf"/gp/({_LISTS})(?:/|$)")


def path_node_id(url: Column) -> Column:
    """First number of three or more digits that begins a path segment."""
    return _found(url, r"/(\d{3,})")


def query_node_id(url: Column) -> Column:
    """Number of the query parameter ``node``."""
    return _found(url, r"node=(\d+)")


def item_id(url: Column) -> Column:
    """Ten-character item id of a detail URL."""
    return _found(url, r"/dp/([A-Z0-9]{10})")


def absolute_url(domain: Column, href: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(domain, href)).otherwise(href)


def chart_url(domain: Column, list_type: Column, slug: Column, node_id: Column, page: Column | None = None) -> Column:
    parts = [domain, F.lit("/gp/"), list_type, F.lit("/"), slug, F.lit("/"), node_id, F.lit("/")]
    return F.concat(*parts) if page is None else F.concat(*parts, F.lit("?pg="), page.cast("string"))


def search_url(domain: Column, node_id: Column, page: Column) -> Column:
    """Newest-first search of a node; the first page has no page parameter."""
    first = F.concat(domain, F.lit("/s?rh=n%3A"), node_id, F.lit("&s=date-desc-rank"))
    return F.when(page > 1, F.concat(first, F.lit("&page="), page.cast("string"))).otherwise(first)


def item_url(domain: Column, asin: Column) -> Column:
    return F.concat(domain, F.lit("/dp/"), asin)


def slug_name(slug: Column) -> Column:
    """A display name made from a slug."""
    return F.initcap(F.translate(slug, "-", " "))


def is_number(text: Column) -> Column:
    """Digits only: decides between a match by id and a match by URL."""
    return F.coalesce(text.rlike(r"^[0-9]+$"), F.lit(False))


def first_items(html: Column, n: int | None) -> Column:
    """The first ``n`` distinct item ids of a page in order, all of them for None."""
    items = F.array_distinct(F.regexp_extract_all(html, F.lit(r"/dp/([A-Z0-9]{10})"), F.lit(1)))
    return items if n is None else F.slice(items, 1, n)
