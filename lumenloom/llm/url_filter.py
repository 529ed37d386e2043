"""URL filter [native]: longest-rule verdicts, spread to aliases over redirect and canonical links.

A rule names a host and a path start and blocks or allows. It fits its host and every
subdomain when the URL's path starts with the rule's path; the longest rule (host plus path
characters, then text order) decides. A URL that no rule fits takes the decision of its
redirect class: the connected component over ``<link rel=canonical>`` and
``<meta http-equiv=refresh>`` edges, after folding scheme, its own port, fragment and trailing-slash
or ``.html`` spellings into one address; the query is a part of it. Tags within comments, scripts,
styles, templates and text fields are no links; ``rel`` may list other words beside canonical, and
character references in targets are read. Such a class is blocked if a member is blocked by a
rule and no member is explicitly allowed; an explicit allow always wins, and a class without
any decision is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule,
has no aliases and is allowed. Repeated rows each get the same verdict. An empty table gives
no rows. Null html means no links. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Up to this many rules become one CASE expression; more are joined by host.
INLINE_RULES = 64
#: A rule table of at most this many bytes' worth of rows is broadcast; a larger one is shuffled.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``: everything up to the first slash is the host."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From ``?`` on, up to ``#`` or the end; empty where there is none or nothing behind it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]+)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """One spelling for the aliases of an address; null where there is no host."""
    host, secure = host_of(url), F.lower(F.substring(url, 1, 6)) == "https:"
    bare = F.regexp_replace(host, F.when(secure, ":443$").otherwise(":80$"), F.lit(""))
    plain = F.regexp_replace(path_of(url), r"(?:/index\.html?|/|\.html?)$", "")
    return F.when(host != "", F.concat(bare, plain, query_of(url)))


def decoded(target: Column) -> Column:
    """``target`` with its character references read: numbers, and the names that stand in addresses."""
    refs = F.array_distinct(F.regexp_extract_all(target, F.lit(r"(?i)(&#(?:x[0-9a-f]{1,8}|[0-9]{1,10});?)"), F.lit(1)))

    def char(ref: Column) -> Column:
        low = F.lower(ref)
        digits = F.regexp_replace(low, "[&#x;]", "")
        code = F.when(F.contains(low, F.lit("x")), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    # longer references first, as a shorter one may begin like them
    ordered = F.array_sort(refs, lambda x, y: F.length(y) - F.length(x))
    out = F.when(F.size(refs) > 0, F.aggregate(ordered, target, lambda a, r: F.replace(a, r, char(r)))).otherwise(target)
    # Names of the characters that addresses use; the ampersand last.
    for name, c in (("colon", ":"), ("sol", "/"), ("quest", "?"), ("num", "#"), ("equals", "="), ("period", "."), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return out


def _fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest fitting rule."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    if len(rules) <= INLINE_RULES:
        rule = verdict = None
        for r in ranked:
            rule = F.when(_fits(r), r.text) if rule is None else rule.when(_fits(r), r.text)
            verdict = F.when(_fits(r), r.verdict) if verdict is None else verdict.when(_fits(r), r.verdict)
        null = F.lit(None).cast("string")
        return urls.withColumns(
            {"rule": null if rule is None else rule, "rule_verdict": null if verdict is None else verdict}
        )
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(r.host, r.path, r.text, r.verdict, len(r.text)) for r in ranked],
        "r_host string, r_path string, rule string, rule_verdict string, r_len int",
    )
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = F.split("host", r"\.")
    keys = urls.select("host", "path").distinct()
    suffixes = keys.withColumn("labels", labels).select(
        "host",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("labels")),
                lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
            )
        ).alias("suffix"),
    )
    best = (
        suffixes.join(table, F.col("suffix") == F.col("r_host"))
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.col("r_len")).alias("l"), "rule", "rule_verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.rule_verdict")
    )
    return urls.join(best, ["host", "path"], "left")


def resolve(url: Column, target: Column) -> Column:
    """``target`` as an address with scheme and host, read from the page at ``url``; as it is if it names a scheme."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(url)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = (
        F.when(own.startswith("/"), own)
        .when(own == "", path)
        .otherwise(F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/?(.*/)?", 1), own))
    )
    steps = F.aggregate(
        F.split(F.regexp_replace(full, "^/", ""), "/", -1),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(x == ".", kept)
        .otherwise(F.concat(kept, F.array(x))),
    )
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .otherwise(F.concat(top, F.lit("/"), F.array_join(steps, "/"), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses of all canonical links and refresh redirects found in ``html``.

    Relative targets are resolved against the page's ``<base href>``, or else its own url; both
    ends are folded by ``address_of``.
    """
    whole = F.coalesce(F.col("html"), F.lit(""))
    # what is no markup: a tag in it is no link
    unread = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp|iframe)\b.*?(?:</\1\s*>|\z)"
    listed = r"""[\s"'/]rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s>/]))"""
    tag = rf"""(?is)<link\b(?=[^>]*{listed})[^>]*[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
    root = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    # the cheap test keeps pages without such tags away from the patterns
    low = F.lower(whole)
    none = F.array().cast("array<string>")
    html = F.regexp_replace(whole, unread, " ")
    target = F.when(low.contains("canonical"), F.regexp_extract_all(html, F.lit(tag), F.lit(1))).otherwise(none)
    moved = F.when(low.contains("http-equiv"), F.regexp_extract_all(html, F.lit(refresh), F.lit(1))).otherwise(none)
    linked = low.contains("canonical") | low.contains("http-equiv")
    base = F.when(linked & low.contains("<base"), F.regexp_extract(html, root, 1)).otherwise(F.lit(""))
    # the outer form: for the inner one the optimizer would test the array's size by computing it again
    found = pages.select("url", base.alias("base"), F.explode_outer(F.concat(target, moved)).alias("to")).where("to is not null")
    # few rows; written between the steps, so that none of their expressions is planned inside the next
    found = materialize(found.select("url", decoded(F.col("base")).alias("base"), decoded(F.col("to")).alias("to")), "url-found")
    at = F.when(F.col("base") == "", F.col("url")).otherwise(resolve(F.col("url"), F.col("base")))
    based = materialize(found.select("url", at.alias("at"), "to"), "url-based")
    full = materialize(based.select("url", resolve(F.col("at"), F.col("to")).alias("to")), "url-full")
    at = full.select(address_of(F.col("url")).alias("src"), address_of(F.col("to")).alias("dst"))
    return at.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def judge_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    ``edges`` (src, dst) are further redirect edges between addresses as ``address_of`` spells them.
    """
    links = link_edges(pages)
    if edges is not None:
        links = links.union(edges.select("src", "dst"))
    parts = connected_components(links, "url-links")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address"))
    ruled = match_rules(split, rules)
    # decisions of addresses, then of components: counts are combined before each shuffle
    decided = (
        ruled.where(F.col("address").isNotNull())
        .groupBy("address")
        .agg(
            F.max(F.col("rule_verdict") == "allow").alias("allow"),
            F.max(F.col("rule_verdict") == "block").alias("block"),
        )
        .join(parts.withColumnRenamed("node", "address"), "address", "left")
        .withColumn("component", F.coalesce("component", "address"))
    )
    by_component = decided.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    shut = (
        decided.select("address", "component")
        .join(by_component.where(F.col("block") & ~F.coalesce("allow", F.lit(False))).select("component"), "component", "left_semi")
        .select("address", F.lit(True).alias("shut"))
    )
    return ruled.join(shut, "address", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("shut"), "block"), F.lit("allow")).alias("verdict"),
    )
