"""URL filters: rules decide a URL, and redirect equivalence carries blocks to its aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, is_empty, materialize, parted, require


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host (with all its subdomains) and a path prefix, such as ``example.org/es/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null. Of rules of one length the first in the list wins."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def address_of(url: Column) -> Column:
    """The URL without its fragment, which no server sees; null where the URL has no host."""
    return F.when(host_of(url) != "", F.regexp_extract(url, r"^([^#]*)", 1))


def page_links(url: Column, html: Column) -> Column:
    """Targets that a page names as its canonical address or redirects to, made absolute.

    A target without a host is resolved against the page's address, one without a leading slash against the
    directory of its path, and ``.`` and ``..`` are followed. Other schemes (``mailto:x``) name no address.
    """
    tag = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)")),
        F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)")),
    )
    raw = F.transform(tag, lambda t: F.regexp_extract(t, r"(?i)\b(?:href\s*=\s*|url\s*=\s*)[\"']?([^\"'\s>]+)", 1))
    root = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^:/?#]+):", 1)

    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def followed(link: Column) -> Column:
        """A path from the root, and what follows it, without its ``.`` and ``..``."""
        path, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
        parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
        up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        kept = F.aggregate(
            parts, F.array().cast("array<string>"), lambda kept, p: F.when(p == ".", kept).when(p == "..", up(kept)).otherwise(F.concat(kept, F.array(p)))
        )
        return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(link)

    def absolute(link: Column) -> Column:
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when((root == "") | (link == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("/"), F.concat(root, followed(link)))
            .when(link.startswith("?"), F.concat(bare, link))
            .when(~link.startswith("#"), F.concat(root, followed(F.concat(folder, link))))
        )

    return F.filter(F.transform(raw, absolute), lambda x: x.isNotNull())


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Judges every page: ``page_id, host, path, rule, verdict``.

    A page that a rule fits gets that rule's verdict, whatever its aliases say. The others are judged
    by redirect equivalence: an address and the targets of its redirects and canonical links (from
    ``html`` and from ``redirects(src, dst)``, whose addresses need not be pages) form one component. Addresses
    are compared as they are written, but for their fragments. Such a page is blocked if a rule blocks any address of its
    component and none explicitly allows one; otherwise it is allowed.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is
    allowed. A null html has no links. Repeated rows and rows without an id get the same verdict as their URL; an empty table gives no
    rows; other columns are ignored. Long URLs and pages are read whole. Only addresses that take part in a link reach the component
    search, whose sizes do not matter to any single task: verdicts are combined by partial aggregation, and only pages whose
    address may be a blocked alias are exchanged.
    """
    require(pages, ["page_id", "url", "html"])
    verdicts = {r.pattern: r.verdict for r in rules}
    found = pages.where("html rlike '(?i)canonical|refresh'").select(
        F.col("url").alias("src"), F.explode(page_links(F.col("url"), F.col("html"))).alias("dst")
    )
    if redirects is not None:
        found = found.unionByName(redirects.select("src", "dst"))
    edges = found.select(address_of(F.col("src")).alias("src"), address_of(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src != dst")
    edges = materialize(edges.distinct(), "alias-edges")
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("__address"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if is_empty(edges):
        return _with_verdict(judged, F.lit(False), verdicts)
    blocked = materialize(blocked_aliases(edges, rules).withColumnRenamed("address", "__open"), "blocked-aliases")
    maybe, rest = parted(judged.withColumn("__open", F.when(F.col("rule").isNull(), F.col("__address"))), "__open", blocked)
    met = maybe.join(blocked.withColumn("__blocked", F.lit(True)), "__open", "left")
    rest = rest.withColumn("__blocked", F.lit(False))
    columns = ["page_id", "host", "path", "rule", "__blocked"]
    return _with_verdict(met.select(columns).unionByName(rest.select(columns)), F.coalesce("__blocked", F.lit(False)), verdicts)


def blocked_aliases(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """``address``: those in a component of ``edges(src, dst)`` with a blocked and no explicitly allowed address."""
    member = materialize(components(edges, "aliases"), "aliases")
    rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    says = lambda verdict: F.coalesce(rule.isin([r.pattern for r in rules if r.verdict == verdict]), F.lit(False))
    tally = member.groupBy("component").agg((F.bool_or(says("block")) & ~F.bool_or(says("allow"))).alias("blocked"))
    tally = materialize(tally.where("blocked").select("component"), "blocked-components")
    return member.join(tally, "component").select(F.col("node").alias("address"))


def _with_verdict(df: DataFrame, blocked: Column, verdicts: dict[str, str]) -> DataFrame:
    verdict = F.when(blocked, "block").otherwise("allow")
    for pattern, said in verdicts.items():
        verdict = F.when(F.col("rule") == pattern, said).otherwise(verdict)
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
