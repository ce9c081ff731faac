"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Platforms and the hosts that belong to them, with all their subdomains (fixed values).
PLATFORMS = (
    ("x/twitter", ("x.com", "twitter.com")),
    ("youtube", ("youtube.com", "youtube-nocookie.com", "youtu.be")),
    ("meta", ("facebook.com", "instagram.com")),
    ("threads", ("threads.com", "threads.net")),
)
#: Query keys that only track, besides ``utm_*`` (fixed values).
TRACKING = ("fbclid", "feature", "pp", "si", "t", "xmt")


def with_scheme(url: Column) -> Column:
    bare = F.trim(F.coalesce(url, F.lit("")))
    return F.when((bare == "") | F.contains(bare, F.lit("://")), bare).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(bare, "^/+", ""))
    )


def _netloc(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[^:/?#]+://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host in lower case, without a port."""
    return F.split(F.lower(_netloc(url)), ":")[0]


def platform(url: Column) -> Column:
    """The platform whose host, or a subdomain of it, the URL has; else empty."""
    name = host(url)
    found = F.lit("")
    for label, domains in reversed(PLATFORMS):
        own = F.lit(False)
        for domain in domains:
            own = own | (name == domain) | name.endswith("." + domain)
        found = F.when(own, label).otherwise(found)
    return found


def clean(url: Column) -> Column:
    """A canonical URL: a scheme, no fragment, no tracking keys; video pages keep their id only.

    Kept parameters stay as they are written, in order of their key's first place, as a parsed and
    rebuilt query has them; values are not escaped anew.
    """
    full = with_scheme(url)
    scheme = F.lower(F.regexp_extract(full, r"^([^:/?#]+)://", 1))
    netloc, path = _netloc(url), F.regexp_extract(full, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.split(p, "=")[0])
    equal = lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))
    kept = F.filter(pairs, lambda p: ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    names = F.array_distinct(F.transform(kept, lambda p: F.split(p, "=")[0]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: F.split(p, "=")[0] == n)))
    video = F.filter(pairs, lambda p: p.startswith("v=") & (p != "v="))
    lower = F.lower(netloc)
    tube = F.contains(lower, F.lit("youtube.com")) | F.contains(lower, F.lit("youtube-nocookie.com"))
    short = F.contains(lower, F.lit("youtu.be"))
    bare_path = F.regexp_replace(path, "/+$", "")
    new_path = F.when(tube & (path == "/watch"), path).when(tube | short, bare_path).otherwise(path)
    new_query = (
        F.when(tube & (path == "/watch"), F.coalesce(F.get(video, F.lit(0)), F.lit("")))
        .when(tube | short, "")
        .otherwise(F.array_join(F.transform(grouped, equal), "&"))
    )
    made = F.concat(scheme, F.lit("://"), netloc, new_path, F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""))
    return F.when(full == "", "").otherwise(made)


def hrefs(html: Column) -> Column:
    """Distinct link targets of a page, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)[\"']"), F.lit(1)))


def images(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def documents(html: Column) -> Column:
    """Link targets that are PDF files."""
    return F.filter(hrefs(html), lambda h: F.lower(h).endswith(".pdf"))
