"""URL filter: rules first, then a path-template tree.

A url gets a host and a path.  Rules (verdict, host, path prefix) judge it if one fits; the longest wins.  For all
others a tree of path templates is grown per host, level by level over the distinct path shapes: segments that look
variable (numbers, identifiers) become wildcards row by row; in the tree, rare branches are generalised to ``*`` and
branches whose labelled shares of bad urls don't differ statistically are merged.  A template is rejected if its
smoothed share of bad labels is high.  With ``apart``, as registered, rare branches too merge only with such of like
labels, mostly unlabelled branches only with each other, and an unlabelled url counts as half bad, so that a template
of mostly unjudged urls is never rejected.  Labels are whatever the caller gives, by default the rules' own verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: fixed values: the rules of the production filter
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

DEPTH = 4              # levels of the tree; what lies deeper is one branch
MIN_SUPPORT = 10       # urls a branch needs to stay a literal
MIN_SHARE = 0.01       # and its least share of its node's urls
MIN_LABELLED = 5       # labelled urls needed to merge a branch or to reject a template
Z = 1.96               # branches closer to their class than so many standard errors are merged
REJECT = 0.8           # smoothed share of bad urls from which on a template is rejected
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    """From the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits.  ``rules`` is a short configuration list."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def path_shape(path: str) -> Column:
    """The path's segments, variable ones as wildcards: digits ``<n>``, long identifiers ``<id>``; at most DEPTH
    plus one for all that lies deeper."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = lambda s: F.when(F.length(s) >= 32, F.lit("<id>")).when(
        s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), F.lit("<id>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
    short = F.transform(F.slice(segments, 1, DEPTH), general)
    return F.when(F.size(segments) > DEPTH, F.concat(short, F.array(F.lit("**")))).otherwise(short)


def template_tree(shapes: DataFrame, apart: bool = False) -> DataFrame:
    """(host, shape, template, purity, labelled) from distinct (host, shape, n, labelled, bad)."""
    judged = 2 * F.col("labelled") >= F.col("n") if apart else F.lit(True)
    tree = shapes.withColumn("template", F.lit(""))
    for d in range(DEPTH + 1):
        tree = stage(tree.withColumn("s", F.get("shape", F.lit(d))), "tree")
        branch = (tree.filter("s is not null").groupBy("host", "template", "s")
                  .agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad"))))
        node = branch.groupBy("host", "template").agg(F.sum("n").alias("node_n"))
        rare = (F.col("n") < MIN_SUPPORT) | (F.col("n") < MIN_SHARE * F.col("node_n"))
        smooth = (F.col("bad") + 1) / (F.col("labelled") + 2)
        band = (F.when(F.col("labelled") < MIN_LABELLED, F.lit(None)).when(smooth < 0.1, F.lit("good"))
                .when(smooth < 0.5, F.lit("fair")).when(smooth < 0.9, F.lit("poor")).otherwise(F.lit("bad")))
        few = F.when(2 * F.col("bad") > F.col("labelled"), F.lit("few-bad")).otherwise("few-good") if apart else F.lit(None)
        branch = (branch.join(node, ["host", "template"]).withColumn("rare", rare)
                  .withColumn("band", F.when(judged, F.when(F.col("rare"), few).otherwise(band))))
        classes = (branch.filter("band is not null").groupBy("host", "template", "band")
                   .agg(F.sum("labelled").alias("class_labelled"), F.sum("bad").alias("class_bad")))
        p = F.col("class_bad") / F.col("class_labelled")
        off = F.abs(F.col("bad") / F.col("labelled") - p) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) / F.col("labelled"))
        name = (F.when(F.col("rare") & F.col("band").isNull(), F.lit("*"))
                .when(F.col("band").isNotNull() & (off <= Z), F.concat(F.lit("*"), F.col("band"))).otherwise(F.col("s")))
        named = (branch.join(classes, ["host", "template", "band"], "left")
                 .select("host", "template", "s", name.alias("name")))
        tree = (tree.join(named, ["host", "template", "s"], "left")
                .withColumn("template", F.when(F.col("s").isNull(), F.col("template"))
                            .otherwise(F.concat(F.col("template"), F.lit("/"), F.col("name"))))
                .select("host", "shape", "n", "labelled", "bad", "template"))
    tree = stage(tree, "templates")
    pure = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    open_ = F.col("n") - F.col("labelled") if apart else F.lit(0)
    purity = (F.col("bad") + open_ / 2 + 1) / (F.col("labelled") + open_ + 2)
    pure = pure.select("host", "template", "labelled", purity.alias("purity"))
    return tree.select("host", "shape", "template").join(pure, ["host", "template"])


def judge_urls(pages: DataFrame, rules=RULES, bad: Column | None = None, apart: bool = False) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``bad`` labels urls (true, false or null) and may use the columns host, path, rule and rule_verdict; by
    default a url that a rule blocks is bad and one that it allows is good.  ``apart`` keeps unlabelled urls out of
    the verdict of labelled ones' templates.  Null urls and such without ``://``
    have empty host and path and are judged with their kind.  A template without enough labels is allowed.
    Repeated rows and ids are judged alike; an empty table gives an empty result; further columns are ignored.
    """
    parsed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    label = F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict") == "block") if bad is None else bad
    rows = stage(parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict)
                 .withColumn("shape", path_shape("path")).withColumn("bad", label), "urls")
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"))
    tree = template_tree(shapes, apart)
    method = F.when((F.col("labelled") >= MIN_LABELLED) & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return rows.drop("bad").join(tree, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")
