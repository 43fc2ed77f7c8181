"""URL filters: rules first, then a tree of path templates for each host.

A path's segments are generalised (digits, long hexadecimal runs), and the tree of each host is walked from the root down. A place with
too many different segments becomes a wildcard. Elsewhere branches above and below their family's share of blocked labels are merged,
each with its side, unless the labels are likelier under a rate of its own for the branch. Branches without labels stay apart. A
template is rejected if its share of blocked labels, smoothed by its host's and that by the overall one, is high. Labels are urls that
rules decide, unless others are given.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, spread_join, written

#: (rule, verdict). A rule is a host and the beginning of a path; it fits the host and its subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Different segments a place may have before it becomes a wildcard.
FAN = 32
#: Labels that the host's and the overall rate count as; smoothed purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.7


def host_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, as a struct of rule and verdict, else null. Equally long rules: the first in the list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments_of(path):
    """Segments of a path with hexadecimal runs of 16 and more and runs of digits as placeholders."""
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "<hex>"), "[0-9]+", "<n>")
    return F.split(F.regexp_replace(plain, "^/", ""), "/")


def log_factorial(n):
    """ln n! by Gosper's formula, within 0.03."""
    return F.when(n > 0, n * F.log(F.greatest(n, F.lit(1)).cast("double")) - n).otherwise(0.0) + 0.5 * F.log(2 * math.pi * (n + 1 / 6))


def evidence(blocked, labelled):
    """Log-likelihood of labels in their order under a rate of which nothing is known (the integral over all rates)."""
    return log_factorial(blocked) + log_factorial(labelled - blocked) - log_factorial(labelled + 1)


def _renamed(tree: DataFrame, d: int) -> DataFrame:
    """(h, a, s, name) of the branches at level ``d`` that are generalised: host, segments above, segment, wildcard."""
    branch = tree.where(F.size("segs") > d).groupBy("host", F.slice("segs", 1, d).alias("above"), F.get("segs", F.lit(d)).alias("seg"))
    branch = written(branch.agg(F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb")), f"url-branches-{d}")
    family = branch.groupBy("host", "above").agg(F.count("*").alias("fan"), F.sum("bl").alias("fl"), F.sum("bb").alias("fb")).where("fan > 1")
    family = family.select(F.col("host").alias("h"), F.col("above").alias("a"), "fan", "fl", "fb")
    branch = spread_join(branch, written(family, f"url-families-{d}"), [("host", "h"), ("above", "a")], F.col("seg"), "inner").drop("h", "a")
    variable = branch.where(F.col("fan") > FAN).select("host", "above", "seg", F.lit("*").alias("name"))
    # of the others, those that labels put on one side of their family's rate: a window has at most FAN branches
    known = branch.where((F.col("fan") <= FAN) & (F.col("bl") > 0)).withColumn("side", F.when(F.col("bb") * F.col("fl") > F.col("fb") * F.col("bl"), "+").otherwise("-"))
    own = W.partitionBy("host", "above", "side")
    known = known.withColumn("sl", F.sum("bl").over(own)).withColumn("sb", F.sum("bb").over(own))
    rest_l, rest_b = F.col("sl") - F.col("bl"), F.col("sb") - F.col("bb")
    alike = evidence(F.col("sb"), F.col("sl")) >= evidence(F.col("bb"), F.col("bl")) + evidence(rest_b, rest_l)
    known = known.where((rest_l > 0) & alike).withColumn("several", F.count("*").over(own)).where("several > 1")
    # the sides are told apart only where both are there
    name = F.concat(F.lit("*"), F.when((F.col("sl") < F.col("fl")), F.col("side")).otherwise(F.lit("")))
    out = variable.union(known.select("host", "above", "seg", name))
    return out.select(F.col("host").alias("h"), F.col("above").alias("a"), F.col("seg").alias("s"), "name")


def templates(urls: DataFrame) -> DataFrame:
    """(host, leaf, template, n, labelled, blocked, smoothed) of each generalised path ``leaf`` of ``urls`` (host, path, label).

    label: 1 blocked, 0 allowed, null unknown. Counts are those of the merged template. The tree is walked from the root down, one round
    for each level on which two paths of a host still share what is above them: deeper there is nothing to generalise.
    """
    tree = urls.groupBy("host", segments_of(F.col("path")).alias("leaf")).agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked")
    )
    tree, d = written(tree.withColumn("segs", F.col("leaf")), "url-tree"), 0
    while tree.where(F.size("segs") > d).groupBy("host", F.slice("segs", 1, d)).agg((F.min("segs") < F.max("segs")).alias("several")).where("several").limit(1).count():
        renamed = written(_renamed(tree, d), f"url-renamed-{d}")
        keyed = tree.withColumn("above", F.slice("segs", 1, d)).withColumn("seg", F.get("segs", F.lit(d)))
        keyed = spread_join(keyed, renamed, [("host", "h"), ("above", "a"), ("seg", "s")], F.col("leaf"))
        starred = F.concat("above", F.array("name"), F.slice("segs", d + 2, F.size("segs")))
        before, tree = tree, written(keyed.select("host", "leaf", "n", "labelled", "blocked", F.when(F.col("name").isNotNull(), starred).otherwise(F.col("segs")).alias("segs")), f"url-tree-{d}")
        discard(before)
        discard(renamed)
        d += 1
    total = tree.groupBy("host", "segs").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # a template's share is smoothed by its host's, and that by the share of all
    rate = tree.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = (rate[0] or 0) / rate[1] if rate[1] else 0.0
    site = total.groupBy(F.col("host").alias("h")).agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    site = written(site.select("h", ((F.col("hb") + PRIOR * prior) / (F.col("hl") + PRIOR)).alias("base")), "url-hosts")
    total = spread_join(total, site, [("host", "h")], F.col("segs"), "inner").withColumn("smoothed", (F.col("blocked") + PRIOR * F.col("base")) / (F.col("labelled") + PRIOR))
    total = written(total.select(F.col("host").alias("h"), F.col("segs").alias("s"), "n", "labelled", "blocked", "smoothed"), "url-totals")
    out = spread_join(tree.select("host", "leaf", "segs"), total, [("host", "h"), ("segs", "s")], F.col("leaf"), "inner")
    return written(out.select("host", "leaf", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "n", "labelled", "blocked", "smoothed"), "url-templates")


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, smoothed for every row of ``pages`` (page_id, url).

    The verdict is that of the longest fitting rule; else ``block`` where the url's template has a smoothed blocked share of REJECT or
    more, else ``allow``. ``labels`` (host, path, label) replaces the rules' verdicts as labels. A null url, or one without ``://``, has
    empty host and path and is judged like any other. Repeated rows count and come back as often as they came. An empty table gives no
    rows. Further columns of ``pages`` are not read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), segments_of(F.col("path")).alias("leaf"))
    known = labels if labels is not None else rows.select("host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("label"))
    if labels is not None:
        known = known.select("host", "path", "label").unionByName(rows.select("host", "path", F.lit(None).cast("int").alias("label")))
    sheet = templates(known).select(F.col("host").alias("__h"), F.col("leaf").alias("__l"), "template", "smoothed")
    out = spread_join(rows, sheet, [("host", "__h"), ("leaf", "__l")], F.col("page_id"))
    verdict = F.coalesce("ruled", F.when(F.col("smoothed") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "smoothed")
