"""URL filters whose block decisions follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii
from .graph import connected_components

# The rules of the query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A tag, in which quoted values may hold < and >, and its attributes with values. A tag that is not closed ends at the next <.
TAG = r"""(?i)<(?:link|meta|base)(?=[\s/])(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
#: What holds no links, whatever it looks like; to the end of the page where it is not closed.
HIDDEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style|template)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"""
ATTRIBUTE = r"""[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: What stands before the target of a refresh, and the target, quoted or not.
TARGET = r"""(?is)^\s*(?:[\d.]*\s*[;,]?\s*\burl\s*=\s*|[\d.]+\s*[;,\s]\s*)(?:"([^"]*)"?.*|'([^']*)'?.*|([^"'].*))$"""
#: Character references that urls in attributes are written with; & comes last.
REFERENCES = (("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"), ("#47|#x2f", "/"), ("#58|#x3a", ":"), ("#61|#x3d", "="), ("amp|#38|#x26", "&"))


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _no_dots(p: Column) -> Column:
    """A path without its segments . and .., which leave a slash at its end."""
    kept = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit("")))


def node(url: Column) -> Column:
    """What names a page in the link graph: the url without its fragment, scheme and host lowered, no . or .. in its path."""
    plain = F.regexp_extract(url, r"^([^#]*)", 1)
    tail = F.regexp_extract(_rest(plain), r"(?s)^[^/?#]*(.*)\z", 1)
    dotted = F.regexp_extract(tail, r"^([^?]*)", 1)
    tail = F.when(F.contains(dotted, F.lit("/.")), F.concat(_no_dots(dotted), F.regexp_extract(tail, r"(?s)^[^?]*(.*)\z", 1))).otherwise(tail)
    return F.concat(lower_ascii(F.regexp_extract(plain, r"(?s)^(.*?://)", 1)), host(url), tail)


def resolve(to: Column, base: Column) -> Column:
    """A link target as a url, seen from the url ``base``; null if it is empty or of a scheme without ://."""
    to = F.regexp_replace(F.regexp_replace(to, r"^\s+|\s+$", ""), r"[\t\r\n]", "")
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.substr(page, F.length(site) + 1), r"(?s)^(.*/)", 1))
    return (
        F.when(to == "", None)
        .when(to.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*)?://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, to))
        .when(F.startswith(to, F.lit("?")), F.concat(page, to))
        .when(F.startswith(to, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), to))
        .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")) & (folder != F.concat(scheme, F.lit("://"))), F.lit("")).otherwise(F.lit("/")), to))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, character references decoded; null without one."""
    every = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    one = F.get(F.filter(every, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(F.regexp_extract(one, r"(?s)^[^=]*=\s*(.*)\z", 1), r"""^["']|["']$""", "")
    for names, char in REFERENCES:
        value = F.regexp_replace(value, f"(?i)&(?:{names});", char)
    return value


def link_tags(html: Column) -> Column:
    """The link, meta and base tags of a page, in order; none of comments, scripts, styles and templates."""
    return F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))


def _tags(tags: Column, kind: str) -> Column:
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^<{kind}[\s/]"))


def html_targets(tags: Column) -> Column:
    """Targets of a page's canonical links and refreshes, as they are written, from its ``link_tags``."""
    links = F.filter(_tags(tags, "link"), lambda t: _attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"))
    metas = F.filter(_tags(tags, "meta"), lambda t: _attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$"))
    goal = lambda c: F.concat(*(F.regexp_extract(c, TARGET, k) for k in (1, 2, 3)))
    return F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(metas, lambda t: goal(_attribute(t, "content"))))


def rule_of(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rhost, rpath in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rhost) | F.endswith(h, F.lit("." + rhost))) & F.startswith(p, F.lit(rpath))
        name, verdict = F.when(fits, F.lit(rhost + rpath)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame, url_col: str, html_col: str | None, redirect_col: str | None) -> DataFrame:
    """Edges ``(u, v)`` between nodes: a page and its canonical link or redirect target.

    Relative targets are seen from the page's url, those in its text from its base tag's.
    """
    named = {"url": url_col} | ({"html": html_col} if html_col else {}) | ({"hop": redirect_col} if redirect_col else {})
    e = pages.where(F.col(url_col).contains("://")).select(*(F.col(c).alias(k) for k, c in named.items()))
    targets = []
    if html_col:
        # Pages without a word of these have no link to read.
        e = e.withColumn("tags", F.when(F.col("html").rlike("(?i)canonical|refresh"), link_tags(F.col("html"))).otherwise(F.array().cast("array<string>")))
        bases = F.filter(F.transform(_tags(F.col("tags"), "base"), lambda t: _attribute(t, "href")), lambda x: x.isNotNull())
        e = e.withColumn("from", F.coalesce(resolve(F.get(bases, F.lit(0)), F.col("url")), F.col("url")))
        targets.append(F.transform(html_targets(F.col("tags")), lambda t: resolve(t, F.col("from"))))
    if redirect_col:
        targets.append(F.array(resolve(F.col("hop"), F.col("url"))))
    e = e.select("url", F.explode(F.concat(*targets)).alias("to")).where("to is not null")
    return e.select(node(F.col("url")).alias("u"), node(F.col("to")).alias("v"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirect_col: str | None = None, rules=RULES) -> DataFrame:
    """Verdict on every page's url: its own rule's, else its aliases'.

    Pages and link targets that redirects and canonical links join are one component, found
    by distributed label propagation. A url without a rule of its own is allowed if some
    alias has an allow rule, else blocked if some alias has a block rule, else allowed.
    A url's own rule always wins. Links are read from tags whatever their attributes' order,
    quotes and spaces, relative ones resolved; tags in comments, scripts, styles and
    templates are none, and one that is not closed ends at the next ``<``.

    Null urls and urls without :// have an empty host and path, no rule and no aliases.
    Repeated rows get a row each.
    """
    scratch = Scratch(pages.sparkSession)
    edges = scratch.save(link_edges(pages, url_col, html_col, redirect_col), "links")
    comps = connected_components(edges, scratch)
    judged = comps.withColumn("verdict", rule_of(host(F.col("node")), path(F.col("node")), rules)[1])
    groups = judged.groupBy("label").agg(F.when(F.bool_or(F.col("verdict") == "allow"), F.lit("allow")).when(F.bool_or(F.col("verdict") == "block"), F.lit("block")).alias("alias_verdict"))
    groups = scratch.save(groups.where("alias_verdict is not null"), "groups")
    aliases = scratch.save(comps.join(groups, "label").select("node", "alias_verdict"), "aliases")

    p = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    p = p.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "own": verdict, "node": F.when(F.col("url").contains("://"), node(F.col("url")))})
    out = p.join(aliases, "node", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"), F.coalesce("alias_verdict", F.lit("none")).alias("alias_verdict"))
