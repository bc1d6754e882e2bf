"""URL filters with redirect equivalence.

Rules decide by host (with its subdomains) and path prefix, the longest first.
Urls that lead to one another are aliases: a page's canonical link and its
refresh redirect, a given table of redirects, and the forms that sites redirect
themselves (scheme, fragment, tracking parameters, a final slash). Aliases are
the connected components over these edges; urls of one form are contracted to
one node first, so a url that very many pages share is one node, and components
are found by joins of the edges alone, never gathered. A component that holds a
blocked url blocks its members, unless a rule allows one of them: an explicit
allow goes before a block that comes from an alias, and a url's own rule before
both.

Defined results: a null url, or one without '://', has empty host and path, no
rule and no alias, and is allowed. Null or empty html holds no links; links that
resolve to no url are none. Very long urls are told apart by their digests.
Pages that repeat have a row each; other columns are not read. An empty table
gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch
from .jaccard import components

#: The rules, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that name no other page.
TRACKING = r"^(utm_[a-z]*|gclid|fbclid|ref)(=|$)"
#: Rules of one list: they become one expression.
MOST_RULES = 1000

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def lower(c: Column) -> Column:
    return F.translate(c, *_AZ)


def host(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, a struct (verdict, rule), or null. Of equally long ones the longer host's, then an allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((h == of) | h.endswith(f".{of}")) & p.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + prefix).alias("rule"))).otherwise(out)
    return out


def form(url: Column) -> Column:
    """A digest of what is left of a url without scheme, fragment, tracking parameters and final slashes; null without a host."""
    kept = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    bare = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host(url) != "", F.md5(bare))


def targets(url: Column, html: Column) -> Column:
    """The urls that a page's canonical links and refresh redirects name, relative ones resolved (dot segments stay); comments and scripts do not count."""
    live = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = F.regexp_extract_all(live, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?\s*((?<=["'\s])[^"']*|[^\s"'>]*)""", 1)
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    named = F.concat(F.transform(canonical, lambda t: value(t, "href")), F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)""", 1)))
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme, folder = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_replace(F.concat(F.lit("/"), F.ltrim(path(url), F.lit("/"))), "[^/]*$", "")

    def whole(x: Column) -> Column:
        x = F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))
        rest = F.when(x.startswith("/"), F.concat(top, x)).when(x.startswith("?"), F.concat(top, path(url), x)).otherwise(F.concat(top, folder, x))
        return F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x).when((x == "") | x.startswith("#") | x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(x.startswith("//"), F.concat(scheme, x)).otherwise(rest)

    # most pages name neither word, and need no closer look
    found = F.when(html.rlike("(?i)canonical|refresh") & (host(url) != ""), F.filter(F.transform(named, whole), lambda x: x.isNotNull()))
    return F.coalesce(found, F.array().cast("array<string>"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page host, path, rule, verdict, and alias_class, the least digest of its aliases' forms (null without a host). redirects: further edges, urls (src, dst)."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    h, p = host(F.col("url")), path(F.col("url"))
    page = pages.select("page_id", "url", h.alias("host"), p.alias("path"), targets(F.col("url"), F.col("html")).alias("to"), form(F.col("url")).alias("node"))
    page = scratch.keep(page.withColumn("fit", rule(F.col("host"), F.col("path"), rules)), "pages")
    links = page.where("node IS NOT NULL").select("node", F.explode("to").alias("to"))
    if redirects is not None:
        given = redirects.select(F.col("src").alias("url"), F.col("dst").alias("to"))
        links = links.unionByName(given.select(form(F.col("url")).alias("node"), "to")).unionByName(given.select(form(F.col("to")).alias("node"), F.col("url").alias("to")))
    links = scratch.keep(links.select("node", form(F.col("to")).alias("end"), rule(host(F.col("to")), path(F.col("to")), rules)["verdict"].alias("verdict")).where("node IS NOT NULL AND end IS NOT NULL"), "links")
    # a node is whatever a page or a link names; ends of links count although no page has them
    said = page.select("node", F.col("fit.verdict").alias("verdict")).unionByName(links.select(F.col("end").alias("node"), "verdict"))
    said = said.where("verdict IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(*[F.max(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    said = scratch.keep(said, "said")
    member = components(links.where("node <> end").select(F.col("node").alias("a"), F.col("end").alias("b")), scratch)
    known = said.join(member.withColumnRenamed("doc", "node"), "node", "full").select("node", F.coalesce("comp", "node").alias("comp"), "allow", "block")
    known = scratch.keep(known, "known")
    whole = known.groupBy("comp").agg(F.coalesce(F.max("block") & ~F.max("allow"), F.lit(False)).alias("blocked"))
    known = scratch.keep(known.select("node", "comp").join(whole, "comp"), "nodes")
    out = page.join(known, "node", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    out = out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("comp", "node").alias("alias_class"))
    scratch.close("pages", "nodes")
    return out
