"""URL filters: host and path rules first, then a path-template tree for each host.

Paths become templates by generalising variable segments into wildcards, per host. Level by level,
sibling branches that are statistically alike merge into one before the next level is looked at: what
follows in them must be distributed alike, and where they have labels, their block rates must not
differ significantly. So labels reach urls that no rule fits. The rules' verdicts are counted at
every node of the merged tree; a url is judged by the smoothed labelled purity of its deepest node
with support.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import join_checked, materialize

#: The rules of the contract: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end.
    A url that is null or has no :// has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.lit(1 << 30))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, _UPPER, _LOWER), path


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; at one length, the first listed. A
    rule fits its host and all subdomains if the path starts with the rule's."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p, v) for v, h, p in ordered]
    pick = lambda i: reduce(lambda rest, x: F.when(x[0], x[i]).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


#: The one name of siblings that merge.
LIKE = "<like>"


def templates(urls: DataFrame, depth: int, least: int, variable: float, n_hosts: int) -> DataFrame:
    """Adds tmpl, the names of the path's segments from the host's root down.

    A segment keeps its literal at (host, level) if it has at least `least` urls and that share
    `variable` of the level's; others become wildcards by their shape. Beyond `depth`, segments
    fold into one "**".
    """
    seg = urls.withColumn("segs", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("deep", F.size("segs") > depth).withColumn("segs", F.slice("segs", 1, depth))
    shape = lambda x: F.when(x.rlike(r"^[0-9]+$"), "<num>").when(x.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), "<num.ext>").when(x.rlike(r"^[0-9a-fA-F-]{16,}$"), "<hex>").otherwise("<any>")
    counts = seg.select("host", F.posexplode("segs").alias("level", "seg")).groupBy("host", "level", "seg").agg(F.count("*").alias("n"))
    level = counts.groupBy("host", "level").agg(F.sum("n").alias("of"))
    kept = counts.join(level, ["host", "level"]).where((F.col("n") >= least) & (F.col("n") >= F.col("of") * variable)).where(~F.col("seg").rlike(r"^[0-9]"))
    # At most depth / variable literals stay for a host, so their list is a bounded cell.
    kept = kept.groupBy("host").agg(F.collect_set(F.concat_ws("/", F.col("level").cast("string"), "seg")).alias("literals"))
    seg = join_checked(seg, kept, "host", "left", n_hosts, int(depth / variable) * 32)
    named = F.transform("segs", lambda x, i: F.when(F.array_contains(F.coalesce("literals", F.array().cast("array<string>")), F.concat_ws("/", i.cast("string"), x)), x).otherwise(shape(x)))
    seg = seg.withColumn("tmpl", F.concat(named, F.when(F.col("deep"), F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))))
    return seg.drop("segs", "deep", "literals")


def merge_level(t: DataFrame, level: int, least: int, apart: float, z: float) -> DataFrame:
    """(host, tmpl, urls, labels, bad, nodes) -> nodes with one more, for templates of `level` at least.

    nodes[-1] is the branch so far, merged. Its children are siblings; each child's next segments are
    compared with those of all siblings together, so no pairs arise. A child is alike with at least
    `least` urls where the total variation distance is within `apart` and what z standard errors
    allow for its size, and where its labels' block rate, if it has labels, is within z standard
    errors of that of all siblings alike in this way.
    """
    here = t.where(F.size("tmpl") >= level).withColumn("up", F.element_at("nodes", -1)).withColumn("name", F.element_at("tmpl", level))
    after = F.when(F.size("tmpl") > level, F.element_at("tmpl", F.least(F.lit(level + 1), F.size("tmpl")))).otherwise("")
    grand = here.groupBy("host", "up", "name", after.alias("after")).agg(F.sum("urls").alias("c"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    child, after_all, up = W.partitionBy("host", "up", "name"), W.partitionBy("host", "up", "after"), W.partitionBy("host", "up")
    grand = grand.withColumns({"n": F.sum("c").over(child), "c_all": F.sum("c").over(after_all), "n_all": F.sum("c").over(up)})
    share, share_all = F.col("c") / F.col("n"), F.col("c_all") / F.col("n_all")
    distance = (F.sum(F.abs(share - share_all)) + 1 - F.sum(share_all)) / 2
    kids = grand.groupBy("host", "up", "name").agg(F.sum("c").alias("n"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"), F.count("*").alias("ways"), distance.alias("distance"))
    shaped = (F.col("n") >= least) & (F.col("distance") <= apart + z * F.sqrt(F.col("ways") / F.col("n")) / 2)
    kids = kids.withColumn("shaped", shaped)
    of = W.partitionBy("host", "up", "shaped")
    rate = F.sum("bad").over(of) / F.sum("labels").over(of)
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) / F.col("labels"))
    alike = F.col("shaped") & F.when(F.col("labels") > 0, F.abs(F.col("bad") / F.col("labels") - rate) <= z * error).otherwise(True)
    kids = kids.withColumn("alike", alike)
    together = (F.count_if("alike").over(up) > 1) & F.col("alike")
    kids = kids.select("host", "up", "name", F.when(together, LIKE).otherwise(F.col("name")).alias("merged"))
    named = here.join(kids, ["host", "up", "name"]).select("host", "tmpl", "urls", "labels", "bad", F.concat("nodes", F.array(F.concat_ws("/", "up", "merged"))).alias("nodes"))
    return t.where(F.size("tmpl") < level).unionByName(named)


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.8, strength: float = 5.0, depth: int = 8, least: int = 5, variable: float = 0.02, apart: float = 0.1, z: float = 1.96) -> DataFrame:
    """Pages (page_id, url, ...) -> page_id, host, path, rule, verdict, template, purity.

    Where a rule fits, its verdict holds, and these verdicts are the labels. Else the url's deepest node
    of the merged tree that has at least `least` labelled urls decides, the host's root left out: its
    branches differ, so it says nothing of any of them. "block" if that node's smoothed purity, (blocked +
    strength * prior) / (labelled + strength), is at least threshold, else "allow", also without such
    a node. Null urls and urls without :// have empty host and path and are allowed. Repeated rows
    count and get their verdict each; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    u = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    u = materialize(u.select("*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    n_hosts, labelled, bad = u.agg(F.approx_count_distinct("host"), F.count("ruled"), F.count_if(F.col("ruled") == "block")).first()
    prior = (bad + 1) / (labelled + 2)
    u = materialize(templates(u, depth, least, variable, n_hosts), "templates")
    t = u.groupBy("host", "tmpl").agg(F.count("*").alias("urls"), F.count("ruled").alias("labels"), F.count_if(F.col("ruled") == "block").alias("bad"))
    t = materialize(t.withColumn("nodes", F.array(F.lit(""))), "tree")
    for level in range(1, (t.agg(F.max(F.size("tmpl"))).first()[0] or 0) + 1):
        t = materialize(merge_level(t, level, least, apart, z), "tree")
    # Every template stands below its nodes but the root; the deepest with support decides.
    below = t.select("host", "tmpl", "labels", "bad", F.posexplode("nodes").alias("level", "node")).where("level > 0")
    nodes = below.groupBy("host", "node").agg(F.sum("labels").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= least)
    nodes = nodes.select("host", "node", ((F.col("bad") + strength * prior) / (F.col("n") + strength)).alias("purity"))
    found = below.select("host", "tmpl", "level", "node").join(nodes, ["host", "node"])
    found = found.groupBy("host", "tmpl").agg(F.max(F.struct("level", "node", "purity")).alias("by")).select("host", "tmpl", F.col("by.node").alias("template"), F.col("by.purity").alias("purity"))
    found = materialize(found, "judged")
    out = join_checked(u, found, ["host", "tmpl"], "left", found.count(), 256)
    method = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
