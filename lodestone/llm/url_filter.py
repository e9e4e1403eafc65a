"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides.
A url that no rule fits takes the decision of its aliases: urls tied to it by canonical links or
redirects, however long the chain (connected components). Of the aliases' explicit decisions an
allow goes before a block; without any, the url is allowed. A url's own rule is never overruled.

Links are read outside comments, all of a page: absolute, protocol-relative, root-relative, relative
to the page or its <base>, or a query alone, with dot segments removed and the entities of "&"
and "/" decoded. Links of other schemes (mailto:) tie nothing.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and has no
aliases; a null page_id keeps its row; null html has no links; repeated rows are judged one by
one; two urls are one node if host, path (without dot segments) and query are equal (scheme and
fragment do not count); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.pii import bound
from lodestone.session import materialize, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules up to this number are part of the expression; more are joined by host suffix.
INLINE_RULES = 64

COMMENT = r"(?s)<!--.*?-->"
CANONICAL_TAG = r"""(?is)<link\b[^>]*(?<![\w-])rel\s*=\s*(?:"[^">]*\bcanonical\b[^">]*"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>"""
BASE_TAG = r"(?is)<base\b[^>]*>"
HREF = r"""(?is)(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*(?<![\w-])http-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)"""
#: The entities of the characters that urls need escaped.
ENTITIES = ((r"(?i)&(?:sol|#0*47|#x0*2f);", "/"), (r"(?i)&(?:amp|#0*38|#x0*26);", "&"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty for null or without it."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """A path from "/" on without its "." and ".." segments."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))  # the first, empty one stays
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    def clean(segments: Column) -> Column:
        ends = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"), ends)

    return bound(path, lambda p: F.when(p.contains("/."), bound(F.split(p, "/", -1), clean)).otherwise(p))


def query_of(url: Column) -> Column:
    """The query with its "?"; empty without one."""
    return F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)


def key_of(url: Column) -> Column:
    """The node of a url: host, path and query; null if it has no host."""
    return bound(url, lambda u: bound(host_of(u), lambda h: F.when(h != "", F.concat(h, without_dots(path_of(u)), query_of(u)))))


def resolved(target: Column, base: Column) -> Column:
    """The url that a link's target names on a page of url base; null for other schemes."""

    def named(t: Column, b: Column) -> Column:
        root = F.concat(F.lit("http://"), host_of(b))
        folder = F.coalesce(F.nullif(F.regexp_extract(path_of(b), r"^(.*/)", 1), F.lit("")), F.lit("/"))
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.startswith("/"), F.concat(root, t))
            .when(t.startswith("?"), F.concat(root, path_of(b), t))
            .when(t.startswith("#") | (t == ""), b)
            .otherwise(F.concat(root, folder, t))
        )

    return bound(target, lambda t: bound(base, lambda b: named(t, b)))


def plain(value: Column) -> Column:
    """An attribute's value without outer white space, entities decoded."""
    for pattern, character in ENTITIES:
        value = F.regexp_replace(value, pattern, character)
    return F.btrim(value, F.lit(" \t\r\n\f"))


def href_of(tag: Column) -> Column:
    return plain(F.concat(*(F.regexp_extract(tag, HREF, k) for k in (1, 2, 3))))


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """urls plus rule and rule_verdict: of the longest rule that fits, an allow before a block; null if none does."""
    if len(rules) <= INLINE_RULES:
        found = F.lit(None).cast("string")
        verdict = F.lit(None).cast("string")
        for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):  # the last that fits wins
            name, prefix = _split_rule(rule)
            fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(prefix)
            found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, action).otherwise(verdict)
        return urls.withColumns({"rule": found, "rule_verdict": verdict})
    spark = urls.sparkSession
    known = spark.createDataFrame([(a, r, *_split_rule(r)) for a, r in rules], "rule_verdict string, rule string, rule_host string, rule_path string")
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    exploded = urls.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct().select("h", "p", F.explode(suffixes).alias("rule_host"))
    hits = exploded.join(known, "rule_host").filter(F.col("p").startswith(F.col("rule_path")))
    best = hits.groupBy("h", "p").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule_verdict") == "allow")).alias("best"))
    joined = urls.join(best, (F.col(host) == best.h) & (F.col(path) == best.p), "left").drop("h", "p")
    return joined.withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical links or redirects tie together."""
    linked = pages.filter(F.lower(html).contains("canonical") | F.lower(html).contains("refresh")).select(F.col(url).alias("from"), F.regexp_replace(html, COMMENT, "").alias("html"))
    named = href_of(F.regexp_extract("html", BASE_TAG, 0))
    canonical = F.transform(F.regexp_extract_all("html", F.lit(CANONICAL_TAG), F.lit(0)), href_of)
    refresh = F.transform(F.regexp_extract_all("html", F.lit(REFRESH_TAG), F.lit(0)), lambda tag: plain(F.regexp_extract(tag, REFRESH_URL, 1)))
    tied = linked.select(key_of(F.col("from")).alias("a"), F.coalesce(resolved(named, F.col("from")), "from").alias("base"), F.filter(F.concat(canonical, refresh), lambda t: t != "").alias("to"))
    nodes = bound(F.col("base"), lambda base: F.transform("to", lambda t: key_of(resolved(t, base))))
    return tied.select("a", F.explode(nodes).alias("b")).filter("a is not null and b is not null and a != b").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliases_verdict). redirects: further (from, to) urls, e.g. of a crawl log."""
    chosen = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    edges = alias_edges(chosen)
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(F.col("from")).alias("a"), key_of(F.col("to")).alias("b")))
    groups = connected_components(edges)
    # every node of a component has its own explicit decision, also urls that only links name
    node = F.concat(F.lit("x://"), F.col("id"))
    decided = judge(groups.withColumns({"host": host_of(node), "path": path_of(node)}), rules)
    by_group = decided.filter("rule_verdict is not null").groupBy("component").agg(F.min("rule_verdict").alias("aliases_verdict"))  # "allow" < "block"
    inherited = materialize(groups.join(by_group, "component").select(F.col("id").alias("key"), "aliases_verdict"), "aliases")
    own = judge(chosen.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key")), rules)
    judged = own.withColumn("aliases_verdict", F.lit(None).cast("string")) if inherited.isEmpty() else own.join(inherited, "key", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "aliases_verdict", F.lit("allow")).alias("verdict"), "aliases_verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("aliases_verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
