"""URL filtering with redirect equivalence.

A page's own rule decides first: the rule with the longest host-and-path match. The others
are judged by equivalence class: urls joined by redirects, canonical links or being the same
resource form components, and a component is blocked if one of its urls is blocked by a rule
and none is allowed by one; allow takes precedence over block. What no decision reaches is
allowed.

A resource is scheme-free: host, path and query, without the fragment. Edges come from the
pages (every rel=canonical link and meta refresh outside comments and scripts, character
references decoded, resolved by the page's base) and, where given, a table of redirects. A null
url, or one without "://", has empty host and path and stands alone; null pages declare nothing.
Repeated rows are judged each.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, lean, sliced, table

#: The production rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# What is no markup of the page, and the tags that declare links; a quote begins a value only right after "=".
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)", re.S | re.I)
TAG = re.compile(r"""<(link|meta|base)\b((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""", re.I)
ATTRIBUTE = re.compile(r"""([a-z][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']+)""", re.I)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The resource a url names; null where it names none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def targets(url: str | None, page: str | None) -> list[str]:
    """The absolute urls that a page declares its own: every rel=canonical link and every meta refresh, by the page's base."""
    if not url or "://" not in url or not page:
        return []
    base, found = None, []
    for tag, raw in TAG.findall(HIDDEN.sub(" ", page)):
        own = {k.lower(): entities.unescape(a or b or c).strip() for k, a, b, c in reversed(ATTRIBUTE.findall(raw))}  # of repeated attributes the first
        kind = tag.lower()
        if kind == "base":
            base = base or own.get("href")
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split():
            found.append(own.get("href"))
        elif kind == "meta" and own.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(own.get("content", ""))):
            found.append(m[1].strip())
    out = []
    for link in filter(None, found):
        try:
            to = urljoin(urljoin(url, base or ""), link)
        except ValueError:  # such as a broken IPv6 host
            continue
        if "://" in to:
            out.append(to)
    return out


def own_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst: resources that the pages declare equal to their own."""

    @lean
    def run(batches):
        for batch in sliced(batches, 500):
            pairs = [(u, to) for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for to in targets(u, page)]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["url", "to"])

    some = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("canonical|refresh"))
    links = some.mapInArrow(run, "url string, to string")
    return links.select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).where("src <> dst").distinct()


def judged(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, html).

    redirects: an optional table (from_url, to_url).
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url")))).where("src <> dst").distinct()
    url = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = url.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": verdict})
    parts = connected_components(edges)
    # the rules also judge urls that are only linked to, so decisions come from nodes, not pages
    host, path = F.regexp_extract("node", "(?s)^([^/?]*)", 1), F.regexp_extract("node", "(?s)^[^/?]*([^?]*)", 1)
    decided = parts.withColumn("own", own_rule(host, path, rules)[1]).groupBy("component").agg(
        F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked")
    )
    spread = parts.join(cut(decided), "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared"))
    out = rows.join(spread, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))


def op5_redirects(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


#: Holds where no page declares links, as in the driver tables: what no rule fits is then allowed.
OP5_SQL = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(rule, verdict, h, p) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
