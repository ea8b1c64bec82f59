"""URL filters by path-template trees.

1. Segments of a path that look variable (numbers, hexadecimal ids, words with
   digits) become typed wildcards, which leaves few templates per host; they are
   pre-aggregated, so that a hot host is many rows only in map-side combining.
   Segments from the `deep`-th on stand together as one, {rest}.
2. From the root down, a branch's literal segments that hold less than one part
   in `branch` of its pages become the wildcard *, and their subtrees one.
3. From the leaves up, branches of one parent below which nothing stands out are
   merged into one (~) if their share of blocked labels does not differ from
   that of their siblings (two-proportion z-test). One that differs stands out,
   and so does each branch above it.
4. Purity, the share of labelled pages that are blocked, is smoothed down the
   path, from the whole table to the host and on to the merged branch or leaf: a
   branch's own by the same template's over all hosts, that by the branch above.
   At `reject` or more, it blocks.

All steps are aggregates and joins, one round a level; no host is gathered in
one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; null or no `://`: both empty."""
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host with subdomains, then a path prefix) that fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segment(value: Column) -> Column:
    """A typed wildcard for a variable segment; an extension stays."""
    stem, ext = F.regexp_extract(value, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(value, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}")).when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.lit("{h}")).when(stem.rlike(r"[0-9]"), F.lit("{x}")).otherwise(stem)
    return F.concat(kind, F.lower(ext))


def chain(template: Column) -> Column:
    """The branches on the way to a template, from the host's root down: depth,
    branch and the branch above it. A segment holds no slash, each starts with one."""
    parts = F.slice(F.split(template, "/"), 2, F.size(F.split(template, "/")))
    start = lambda n: F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda s: F.concat(F.lit("/"), s)), "")
    node = lambda _, i: F.struct((i + 1).alias("depth"), start(i + 1).alias("node"), start(i).alias("above"))
    return F.transform(parts, node)


def generalise(scratch: Scratch, typed: DataFrame, levels: int, branch: int) -> DataFrame:
    """typed (host, typed, segs, n, ...) with its template: level by level, the
    rare literal segments of each branch become *."""
    typed = typed.withColumn("template", F.lit(""))
    for level in range(levels):
        here = typed.withColumn("seg", F.get("segs", F.lit(level)))
        share = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("n"))
        share = scratch.keep(share, "shares")
        total = share.groupBy("host", "template").agg(F.sum("n").alias("total"))
        rare = share.join(total, ["host", "template"]).where((F.col("n") * branch < F.col("total")) & ~F.col("seg").contains("{"))
        rare = rare.select("host", "template", "seg", F.lit("*").alias("star"))
        here = here.join(rare, ["host", "template", "seg"], "left")
        longer = F.concat("template", F.lit("/"), F.coalesce("star", "seg"))
        typed = scratch.keep(here.withColumn("template", F.coalesce(longer, "template")).drop("seg", "star"), "templates")
    return typed


def merge(scratch: Scratch, nodes: DataFrame, levels: int, z: float) -> DataFrame | None:
    """nodes (host, node, above, depth, l labelled and b blocked pages) with
    merged, and l and b of the branch that a merged node has become a part of;
    level by level from the deepest up. None without a level."""
    out, proud = None, None
    for level in range(levels, 0, -1):
        here = nodes.where(F.col("depth") == level).withColumn("flat", F.lit(True))
        if proud is not None:
            here = here.drop("flat").join(proud, ["host", "node"], "left").withColumn("flat", F.col("stands").isNull()).drop("stands")
        sums = here.where("flat").groupBy("host", "above").agg(F.sum("l").alias("al"), F.sum("b").alias("ab"))
        here = here.join(sums, ["host", "above"], "left")
        # Two proportions, the branch's and its flat siblings' without it.
        rest_l, rest_b = F.col("al") - F.col("l"), F.col("ab") - F.col("b")
        pool = F.col("ab") / F.greatest("al", F.lit(1))
        error = F.sqrt(pool * (1 - pool) * (1 / F.greatest("l", F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
        gap = F.abs(F.col("b") / F.greatest("l", F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1)))
        alike = (F.col("l") == 0) | (rest_l == 0) | (gap <= z * error)
        here = scratch.keep(here.select("host", "node", "above", "depth", "l", "b", (F.col("flat") & alike).alias("merged")), "tested")
        proud = here.where("NOT merged").select("host", F.col("above").alias("node"), F.lit(True).alias("stands")).distinct()
        group = here.where("merged").groupBy("host", "above").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"))
        mine = lambda own, all_: F.when(F.col("merged"), F.col(all_)).otherwise(F.col(own)).alias(own)
        here = here.join(group, ["host", "above"], "left").select("host", "node", "above", "depth", mine("l", "ml"), mine("b", "mb"), "merged")
        out = here if out is None else out.union(here)
    return out


def classify(pages: DataFrame, rules: dict[str, str], labels: Column | None = None, branch: int = 20, smooth: float = 4.0, reject: float = 0.5, z: float = 1.96, deep: int = 16) -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits), verdict
    (allow or block: the rule's, else the tree's), template, branch (the merged
    branch, ending in ~, or the template), purity.

    rules maps a rule (host, `/`, path prefix) to allow or block. labels is 1
    for blocked, 0 for allowed, null for unlabelled pages, as a column of pages;
    by default the rules' verdicts are the labels. A null or malformed url has
    empty host and path. A page whose path ends at a branch is judged by all of
    that branch, one without a path by its host. Repeated rows and null page_ids
    give as many rows; an empty table gives none; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *([labels.alias("label")] if labels is not None else []))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for verdict in ("allow", "block"):
        mine = [r for r, v in rules.items() if v == verdict]
        if mine:
            ruled = F.when(F.col("rule").isin(mine), F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled)
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    segs = F.transform(F.slice(parts, 1, deep - 1), segment)
    segs = F.when(F.size(parts) >= deep, F.concat(segs, F.array(F.lit("{rest}")))).otherwise(segs)
    rows = rows.withColumn("typed", F.array_join(segs, "/"))

    sums = (F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    typed = rows.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("b"))
    typed = scratch.keep(typed.withColumn("segs", F.filter(F.split("typed", "/"), lambda s: s != "")), "typed")
    levels = typed.agg(F.max(F.size("segs"))).first()[0] or 0
    typed = generalise(scratch, typed, levels, branch)

    leaf = scratch.keep(typed.groupBy("host", "template").agg(*sums), "leaves")
    nodes = leaf.select("host", "l", "b", F.explode(chain(F.col("template"))).alias("c"))
    nodes = nodes.groupBy("host", F.col("c.depth").alias("depth"), F.col("c.node").alias("node"), F.col("c.above").alias("above")).agg(*sums)
    nodes = scratch.keep(nodes, "nodes")
    hosts = leaf.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    all_l, all_b = leaf.agg(*sums).first()
    prior = (all_b + 1.0) / (all_l + 2.0)

    kept = lambda share, total, before: (F.col(share) + smooth * before) / (F.col(total) + smooth)
    scored = leaf.join(hosts, "host").select("host", "template", kept("hb", "hl", F.lit(prior)).alias("purity"), F.col("template").alias("branch"))
    merged = merge(scratch, nodes, levels, z)
    if merged is not None:
        wide = nodes.groupBy("node").agg(F.sum("l").alias("gl"), F.sum("b").alias("gb"))
        merged = scratch.keep(merged.join(wide, "node"), "branches")
        way = leaf.select("host", "template", F.explode(chain(F.col("template"))).alias("c")).select("host", "template", F.col("c.node").alias("node"))
        way = way.join(merged, ["host", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "l", "b", "gl", "gb", "merged", "above"))).alias("way"))

        def down(state: Column, x: Column) -> Column:
            over = (x["gb"] + smooth * state["purity"]) / (x["gl"] + smooth)
            purity = F.when(state["done"], state["purity"]).otherwise((x["b"] + smooth * over) / (x["l"] + smooth))
            branch = F.when(~state["done"] & x["merged"], F.concat(x["above"], F.lit("/~"))).otherwise(state["branch"])
            return F.struct(purity.alias("purity"), (state["done"] | x["merged"]).alias("done"), branch.alias("branch"))

        start = F.struct(F.col("purity"), F.lit(False).alias("done"), F.col("branch"))
        end = F.aggregate(F.coalesce("way", F.array()), start, down)
        scored = scored.join(way, ["host", "template"], "left").select("host", "template", end.alias("end")).select("host", "template", "end.purity", "end.branch")
    scored = scratch.keep(scored, "scored")
    judged = scratch.keep(typed.select("host", "typed", "template").join(scored, ["host", "template"]), "judged")
    out = rows.select("page_id", "host", "path", "rule", "ruled", "typed").join(judged, ["host", "typed"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "branch", F.round("purity", 6).alias("purity"))
