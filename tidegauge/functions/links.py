"""Deep links as column functions; blank where a part is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(site: Column) -> Column:
    """The site with a scheme and without slashes at its end; blank stays blank."""
    bare = F.regexp_replace(F.trim(site), "/+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def encoded(text: Column) -> Column:
    """Percent encoding, with spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def _at(site: Column, *path) -> Column:
    o, parts = origin(site), [F.lit(p) if isinstance(p, str) else p.cast("string") for p in path]
    return F.when(o == "", "").otherwise(F.coalesce(F.concat(o, *parts), F.lit("")))


def issue_url(site: Column, key: Column) -> Column:
    return _at(site, "/browse/", encoded(key))


def board_url(site: Column, board_id: Column) -> Column:
    return _at(site, "/secure/RapidBoard.jspa?rapidView=", board_id)


def sprint_report_url(site: Column, board_id: Column, sprint_id: Column) -> Column:
    return _at(site, "/secure/RapidBoard.jspa?rapidView=", board_id, "&view=reporting&chart=sprintRetrospective&sprint=", sprint_id)


def search_url(site: Column, jql: Column) -> Column:
    return _at(site, "/issues/?jql=", encoded(jql))


def keys_query(keys: Column, most: int = 60) -> Column:
    """A search for the listed keys; blank for none. The limit is of the address' length."""
    return F.when(F.size(keys) > 0, F.concat(F.lit("key in ("), F.array_join(F.slice(keys, 1, most), ","), F.lit(") order by rank"))).otherwise("")


def wiki_search_url(site: Column, text: Column) -> Column:
    return _at(site, "/wiki/search?text=", encoded(text))


def wiki_space_url(site: Column, space: Column) -> Column:
    return _at(site, "/wiki/spaces/", encoded(F.nullif(space, F.lit(""))))


def wiki_page_url(site: Column, link: Column) -> Column:
    """A page's address from the link that a search gives: whole, below /wiki, or bare."""
    base, path = F.regexp_replace(site, "/+$", ""), F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))
    return F.when(F.coalesce(link, F.lit("")) == "", F.concat(base, F.lit("/wiki"))).when(link.rlike("(?i)^https?://"), link).when(path.startswith("/wiki/"), F.concat(base, path)).otherwise(F.concat(base, F.lit("/wiki"), path))


def forge_origin(web_url: Column) -> Column:
    return F.regexp_extract(F.coalesce(web_url, F.lit("")), "(?i)^(https?://[^/]+)", 1)


def forge_url(base: Column, path: Column) -> Column:
    """A group or project of the forge."""
    return F.when(base == "", "").otherwise(F.coalesce(F.concat(base, F.lit("/"), F.regexp_replace(path, "^/+", "")), F.lit("")))


def forge_merge_requests_url(base: Column, group: Column, state: str = "merged") -> Column:
    path = F.regexp_replace(group, "^/+", "")
    return F.when(base == "", "").otherwise(F.concat(base, F.lit("/groups/"), path, F.lit(f"/-/merge_requests?state={state}&sort=updated_desc")))
