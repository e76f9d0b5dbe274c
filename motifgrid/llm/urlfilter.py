"""URL filter: rules by host and path, block decisions carried over redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import ascii_lower, bind

#: (verdict, host, path): a rule fits its host, all subdomains and every path that starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: (tags, those that tie their page to a target, the target): attributes in any order, values with or without quotes.
ALIASES = (
    (r"(?i)<link\b[^>]*>", r"""(?i)(?<![\w-])rel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)""", r"""(?i)(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)"""),
    (r"(?i)<meta\b[^>]*>", r"""(?i)(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b""", r"""(?i)(?<![\w-])url\s*=\s*["']?\s*([^"'\s>]+)"""),
)


#: Parts of a URL that servers commonly redirect away: host labels, and parameters that only track.
MIRRORS = r"^(?:www|m)\.([^.]+\.)"
TRACKING = r"[?&](?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(_rest(url), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _matching(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, else null: one CASE, longest first."""
    case = None
    for verdict, rh, rp in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rh) | host.endswith("." + rh)) & path.startswith(rp)
        out = F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))
        case = F.when(fits, out) if case is None else case.when(fits, out)
    return case


def _without_dots(path: Column) -> Column:
    """The path with its segments '.' and '..' resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), _without_dots(path), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def _node(url: Column) -> Column:
    """What identifies a page among links: no scheme, fragment, host case or dot segments."""
    return F.concat(*_parts(url))


def _canonical(url: Column) -> Column:
    """The node that servers commonly send a URL to: without mirror label, closing slashes and tracking parameters."""
    host, path, query = _parts(url)
    left = F.regexp_replace(query, TRACKING, "")
    return F.concat(F.regexp_replace(host, MIRRORS, "$1"), F.regexp_replace(path, "/+$", ""), F.regexp_replace(left, "^[?&]+(.)", "?$1"))


def _absolute(base: Column, target: Column) -> Column:
    """Resolve a link target against its page."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    origin = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, target)`` for every canonical link and refresh redirect of each page."""
    body = F.col(html)

    def targets(tag: str, ties: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(body, F.lit(tag), F.lit(0)), lambda t: t.rlike(ties))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    found = F.concat(*[targets(*a) for a in ALIASES])
    tagged = pages.where(body.rlike(r"(?i)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b"))
    links = tagged.select(F.col(url).alias("url"), F.explode(F.array_distinct(found)).alias("target"))
    links = links.where((F.col("target") != "") & F.col("url").isNotNull())
    return links.select("url", _absolute(F.col("url"), F.col("target")).alias("target"))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_blocked.

    A page with a rule takes the rule's verdict, so an explicit allow always
    wins.  A page without one is blocked if its aliases, over any number of
    steps and in either direction, reach a URL that a rule blocks; otherwise
    it is allowed.  Aliases are a URL and its canonical form, and the ends of
    every canonical link and refresh in the html and of ``redirects`` (url,
    target), which adds crawled ones.

    Null urls and urls without ``://`` have an empty host and path, no rule,
    no aliases and the verdict allow.  Null html has no links; a long one is
    searched whole.  Repeated rows are judged alike.  Other columns are not
    read, whatever their names.  An empty table gives an empty result.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_mg_url"))
    seen = base.select(F.col("_mg_url").alias("url")).where(F.instr("url", "://") > 0).distinct()
    edges = []
    if html is not None:
        edges.append(alias_edges(pages.select(F.col(url).alias("_mg_url"), F.col(html).alias("_mg_html")), "_mg_url", "_mg_html"))
    if redirects is not None:
        edges.append(redirects.select("url", "target"))
    ends = seen
    for e in edges:
        ends = ends.unionAll(e.select("url")).unionAll(e.select(F.col("target").alias("url")))
    links = ends.select(_node(F.col("url")).alias("src"), _canonical(F.col("url")).alias("dst"))
    for e in edges:
        links = links.unionAll(e.select(_node(F.col("url")).alias("src"), _node(F.col("target")).alias("dst")))
    links = links.where("src <> '' and dst <> '' and src <> dst").distinct()

    groups = connected_components(links, "src", "dst")
    h, p = host_and_path(F.concat(F.lit("x://"), F.col("node")))
    ruled = bind(groups, _mg_h=h, _mg_p=p)
    hit = _matching(F.col("_mg_h"), F.col("_mg_p"), rules)["verdict"]
    blocked = ruled.withColumn("v", hit).groupBy("root").agg(F.max(F.col("v") == "block").alias("b")).where("b")
    aliases = groups.join(blocked, "root").select(F.col("node").alias("_mg_node"), F.lit(True).alias("alias_blocked"))

    host, path = host_and_path(F.col("_mg_url"))
    judged = bind(base, host=host, path=path)
    judged = judged.withColumn("_mg_hit", _matching(F.col("host"), F.col("path"), rules))
    # Urls without a node meet no alias; a value of their own keeps them from one task.
    node = F.coalesce(_node(F.col("_mg_url")), F.lit(""))
    node = F.when(node == "", F.concat(F.lit(" "), F.xxhash64("page_id").cast("string"))).otherwise(node)
    judged = judged.withColumn("_mg_node", node).join(aliases, "_mg_node", "left")
    alias = F.coalesce("alias_blocked", F.lit(False))
    verdict = F.coalesce(F.col("_mg_hit")["verdict"], F.when(alias, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("_mg_hit")["rule"].alias("rule"), verdict.alias("verdict"), alias.alias("alias_blocked"))
