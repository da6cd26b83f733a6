"""Operator 13, URL filters by a path-template tree, in column functions alone.

Rules decide the addresses that they fit, and these are the labelled examples
for all others.  Per host a tree of templates grows segment by segment: a
segment whose values are rare at its node becomes the wildcard ``*``; branches
whose labels and continuations do not differ from those of their siblings by
Hoeffding's bound become one branch ``~``; all others stay as they are.  A
branch's purity, its share of blocked examples, is smoothed towards that of
the branch above, and a template is rejected from ``REJECT_AT`` on.

Counts are aggregated before they move.  A node has at most ``LITERALS``
branches of its own, so its look-up row is bounded.  Pages join the look-up
rows, one for each node, on (host, node); a host with a third of all pages is
a skewed partition on the pages' side alone, which adaptive execution splits
(the look-up rows are written first: it splits plain shuffles only).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import written


@dataclass(frozen=True)
class UrlRule:
    """``host`` and all its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str


#: A value is a branch of its own if it has at least so many pages, and at
#: least one in so many of its node's pages (so a node has that many at most).
SUPPORT, LITERALS = 3, 20
#: Levels of the tree; deeper segments stay with the branch of the last one.
DEPTH = 5
#: Error bound of the similarity test; examples that the branch above counts
#: for; purity of a host without examples; purity of a rejected template.
ALPHA, WEIGHT, NEUTRAL, REJECT_AT = 0.05, 4.0, 0.5, 0.7
BOUND = math.sqrt(math.log(2 / ALPHA) / 2)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z in lower case) and path up to ``?`` or
    ``#``; both empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; of equally
    long ones, the first in ASCII order."""
    out = F.lit(None).cast("string")
    for r in sorted(sorted(rules, key=lambda r: r.host + r.path, reverse=True), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, value(r)).otherwise(out)
    return out


def _purity(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + F.lit(WEIGHT) * above) / (labelled + F.lit(WEIGHT))


def _alike(x: str, of: str) -> Column:
    """Whether a branch's share ``x`` of ``of`` is within Hoeffding's bound of
    that of its siblings together; nothing to compare counts as alike."""
    n, m = F.nullif(F.col(of), F.lit(0)), F.nullif(F.col(f"all_{of}") - F.col(of), F.lit(0))
    apart = F.abs(F.col(x) / n - (F.col(f"all_{x}") - F.col(x)) / m)
    return F.coalesce(apart <= F.lit(BOUND) * (F.lit(1.0) / F.sqrt(n) + F.lit(1.0) / F.sqrt(m)), F.lit(True))


def branches(live: DataFrame, level: int) -> DataFrame:
    """(host, node, entries): each node's branches at ``level``, an array of
    (kid, label, n, p) with one entry a literal value, one ``$`` for the end of
    the path and one ``*`` for all other values."""
    sums = {"c": F.count("*"), "lab": F.count("bad"), "bad": F.coalesce(F.sum("bad"), F.lit(0)), "goes_on": F.sum((F.size("segments") > level).cast("long")),
            "digits": F.sum(F.coalesce(F.get("segments", F.lit(level)).rlike("[0-9]"), F.lit(False)).cast("long"))}
    kids = live.groupBy("host", "node", "kid").agg(F.max("n").alias("n"), F.max("p").alias("above"), *[v.alias(k) for k, v in sums.items()])
    literal = (F.col("kid") != "$") & (F.col("c") >= SUPPORT) & (F.col("c") * LITERALS >= F.col("n"))
    node, total = Window.partitionBy("host", "node"), ["c", "lab", "bad"]  # at most LITERALS rows
    own = kids.where(literal)
    own = own.select("*", *[F.sum(k).over(node).alias(f"all_{k}") for k in sums])
    alike = (F.col("all_c") > F.col("c")) & _alike("lab", "c") & _alike("bad", "lab") & _alike("goes_on", "c") & _alike("digits", "c")
    own = own.withColumn("label", F.when(alike, F.lit("~")).otherwise(F.col("kid"))).drop(*[f"all_{k}" for k in sums])
    group = Window.partitionBy("host", "node", "label")
    own = own.select("host", "node", "kid", "label", "above", *[F.sum(k).over(group).alias(k) for k in total])
    end = kids.where("kid = '$'").select("host", "node", "kid", F.col("kid").alias("label"), "above", *total)
    wild = kids.where(~literal & (F.col("kid") != "$")).groupBy("host", "node").agg(F.max("above").alias("above"), *[F.sum(k).alias(k) for k in total])
    wild = wild.select("host", "node", F.lit("*").alias("kid"), F.lit("*").alias("label"), "above", *total)
    entry = F.struct("kid", "label", F.col("c").alias("n"), _purity(F.col("bad"), F.col("lab"), F.col("above")).alias("p"))
    return own.unionByName(end).unionByName(wild).groupBy("host", "node").agg(F.collect_list(entry).alias("entries"))


def _deeper(grown: DataFrame, level: int) -> DataFrame:
    """``grown`` with the pages whose path goes on moved to their branch of ``level``."""
    kid = F.when(F.size("segments") < level, F.lit("$")).otherwise(F.concat(F.lit("="), F.get("segments", F.lit(level - 1))))
    live = grown.where(~F.col("done")).withColumn("kid", kid)
    found = live.join(written(branches(live, level), "branches"), ["host", "node"])
    at = lambda k: F.get(F.filter("entries", lambda e: e["kid"] == k), F.lit(0))
    found = found.withColumn("entry", F.coalesce(at(F.col("kid")), at(F.lit("*"))))
    new = {"node": F.concat("node", F.lit("/"), "entry.label"), "n": F.col("entry.n"), "p": F.col("entry.p"), "done": F.col("kid") == "$"}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in grown.columns]).union(grown.where("done"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``template``, ``purity`` and
    ``verdict`` (allow or block) of each row.  ``label_col`` (1 bad, 0 good,
    null unknown) labels further addresses that no rule fits.

    A null url, or one without ``://``, has an empty host and path and is
    judged with all others of that kind; null ids and repeated rows are rows
    of their own; other columns are left alone; an empty table gives an empty
    one."""
    host, path = host_and_path(F.coalesce(F.col(f"`{url_col}`"), F.lit("")))
    label = F.col(f"`{label_col}`").cast("long") if label_col else F.lit(None).cast("long")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), label.alias("bad"))
    said = longest_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.verdict))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.host + r.path))).withColumn("said", said)
    rows = rows.withColumn("bad", F.coalesce((F.col("said") == "block").cast("long"), F.col("bad")))
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(F.split("path", "/"), 2, F.length("path") + 1))
    rows = written(rows.withColumn("segments", segments), "urls")

    # Each host is a node of its own; a page carries its node's pages and purity.
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), _purity(F.coalesce(F.sum("bad"), F.lit(0)), F.count("bad"), F.lit(NEUTRAL)).alias("p"))
    hosts = written(hosts, "hosts")
    grown = written(rows.join(hosts, "host").withColumn("node", F.lit("")).withColumn("done", F.lit(False)), "tree")
    for level in range(1, DEPTH + 1):
        grown = written(_deeper(grown, level), "tree")
    verdict = F.coalesce("said", F.when(F.col("p") >= REJECT_AT, "block").otherwise("allow"))
    return grown.select(F.col("id").alias(id_col), "host", "path", "rule", F.concat("host", "node").alias("template"), F.col("p").alias("purity"), verdict.alias("verdict"))
