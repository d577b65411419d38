"""URL filter with redirect equivalence.

Rules decide on host and path.  Beyond them, pages that redirect to each other
or name the same canonical page are aliases: the nodes are addresses without
scheme and fragment, the edges are canonical links and refresh redirects in the
pages, and redirects given as a table.  A block by rule of any node of a
component reaches all pages of that component that no rule decides; an explicit
allow stands, whatever its component says.  All other pages are allowed.

Rows: one result per input row, repeated rows included.  A null url or one
without ``://`` has empty host and path, no rule and no aliases, and is allowed.  A null
html has no links.  Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.session import written


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<link\s[^>]*>"
META = r"(?i)<meta\s[^>]*>"
CANONICAL = r"(?i)\srel\s*=\s*[\"']?canonical[\"'\s/>]"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
TARGET = r"(?i)url\s*=\s*['\"]?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query: the node of a url.  Null without ``://``."""
    rest = F.regexp_extract(_rest(url), r"^[^#]*", 0)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1))


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as text (host and path), or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.host + r.path)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Sequence[Rule]) -> Column:
    named = F.create_map(*[F.lit(x) for r in rules for x in (r.host + r.path, r.verdict)]) if rules else None
    return named[rule] if rules else F.lit(None).cast("string")


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target): addresses joined by canonical links and refresh redirects."""
    def targets(tag: str, kind: str, value: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_like(t, F.lit(kind)))
        return F.transform(tags, lambda t: F.regexp_extract(t, value, 1))

    rows = pages.where(F.instr("url", "://") > 0).select("url", F.explode(F.concat(
        targets(LINK, CANONICAL, HREF), targets(META, REFRESH, TARGET))).alias("to")).where("to <> ''")
    folder = F.regexp_extract(F.concat(host_of(F.col("url")), F.when(path_of(F.col("url")) == "", "/").otherwise(
        path_of(F.col("url")))), r"^(.*/)", 1)
    full = (F.when(F.instr("to", "://") > 0, F.col("to"))
            .when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to")))
            .when(F.startswith("to", F.lit("/")), F.concat(F.lit("http://"), host_of(F.col("url")), F.col("to")))
            .otherwise(F.concat(F.lit("http://"), folder, F.col("to"))))
    return rows.select(address(F.col("url")).alias("source"), address(full).alias("target"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) of every page.

    ``redirects``: further edges as urls (source, target).
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("source"),
                                                   address(F.col("target")).alias("target")))
    of = components(edges.where("source <> target"), "source", "target")
    seen = F.concat(F.lit("x://"), F.col("node"))
    judged = of.withColumn("rule", decide(host_of(seen), path_of(seen), rules))
    blocked = judged.where(_verdict(F.col("rule"), rules) == "block").select("root").distinct()
    aliases = written(of.join(blocked, "root", "left_semi").select(F.col("node").alias("_node")).distinct(), "aliases")
    rows = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        address(F.col("url")).alias("_address"))
    rows = rows.withColumn("rule", decide(F.col("host"), F.col("path"), rules)).join(
        aliases, F.col("_address") == F.col("_node"), "left")
    own = _verdict(F.col("rule"), rules)
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce(own, F.when(F.col("_node").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(F.col("_node").isNotNull(), "alias").otherwise("default").alias("decided_by"))


def _sql() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
    low = f"'{UPPER}', '{LOWER}'"
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.host}{r.path}'"
        for r in sorted(RULES, key=lambda r: (-len(r.host + r.path), r.host))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.host}{r.path}' THEN '{r.verdict}'" for r in RULES) + " END"
    quoted = {k: v.replace("'", "''") for k, v in (("CANONICAL", CANONICAL), ("HREF", HREF), ("REFRESH", REFRESH), ("TARGET", TARGET))}
    parts = f"""coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), {low}), '') AS host,
        coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"""
    node = f"""(translate(regexp_extract({rest}, '^[^/?#]*'), {low})
        || substr(regexp_extract({rest}, '^[^#]*'), length(regexp_extract({rest}, '^[^/?#]*')) + 1))"""
    return f"""
WITH RECURSIVE
  p AS (SELECT row_number() OVER () AS r, page_id, url, html, {parts}, {node} AS node FROM pages),
  k AS (SELECT node, host, path, unnest(
          list_transform(list_filter(regexp_extract_all(html, '{LINK}'), lambda t: regexp_matches(t, '{quoted["CANONICAL"]}')),
                         lambda t: regexp_extract(t, '{quoted["HREF"]}', 1))
          || list_transform(list_filter(regexp_extract_all(html, '{META}'), lambda t: regexp_matches(t, '{quoted["REFRESH"]}')),
                         lambda t: regexp_extract(t, '{quoted["TARGET"]}', 1))) AS target FROM p WHERE node IS NOT NULL),
  u AS (SELECT node AS source, CASE WHEN instr(target, '://') > 0 THEN target WHEN prefix(target, '//') THEN 'http:' || target
               WHEN prefix(target, '/') THEN 'http://' || host || target
               ELSE 'http://' || regexp_extract(host || CASE path WHEN '' THEN '/' ELSE path END, '^(.*/)', 1) || target END AS url
        FROM k WHERE target <> ''),
  e AS (SELECT DISTINCT source, {node} AS target FROM u),
  b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
  reach AS (SELECT x AS node, x AS member FROM b UNION SELECT node, y FROM reach JOIN b ON member = x),
  m AS (SELECT node, {parts.replace("url", "('x://' || member)")} FROM reach),
  j AS (SELECT DISTINCT node FROM (SELECT node, {rule} AS rule FROM m) WHERE {verdict} = 'block'),
  d AS (SELECT page_id, host, path, {rule} AS rule, node IN (SELECT node FROM j) AS hit FROM p)
SELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN hit THEN 'alias' ELSE 'default' END AS decided_by
FROM d
"""


SQL = _sql()
