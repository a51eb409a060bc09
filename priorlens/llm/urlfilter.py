"""URL filters: host and path rules, and a path-template tree for all other urls.

Rules come first: the longest rule whose host and path fit decides. The urls that
rules decide are the labelled ones. Over all urls grows a tree per host: level by
level, the segments below a node stay literal or become the wildcard ``*``. A segment
is generalised if it carries a number or an escape, if the node has many children that
are rare (``MANY`` of them, with under ``RARE`` urls each on average), or if its blocked
share does not differ from that of its siblings together by more than ``Z`` standard
errors (branches that are alike in statistics merge; a node needs ``BRANCHES`` labelled
siblings for that). Below ``LEVELS`` segments a template ends in ``**``.

A template is rejected if its smoothed labelled purity ``(blocked + PRIOR * anywhere) /
(labelled + PRIOR)`` reaches ``PURE``. ``anywhere`` is the blocked share of the same
template on all hosts, itself smoothed towards one half; it decides for hosts with few
labelled urls of their own, and takes ``PRIOR`` and more labelled urls to reach ``PURE``.

Work is on counts: urls are added up by host and remaining path before each level, all
joins are on ``(host, node)``, and nothing is gathered by host.

Defined cases: a null url, or one without ``://``, has an empty host and path and no
rule; repeated rows get repeated verdicts; an empty table has no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from priorlens.session import cut_lineage

LEVELS, MANY, RARE, BRANCHES, Z = 12, 20, 3.0, 2, 2.0
PRIOR, PURE = 10.0, 0.8

# Fixed values: (host and path, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to the path, query, fragment or end, in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first, so it is wrapped last
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """The segment with its variable part as a wildcard: anything up to a suffix if it holds a digit or escape."""
    suffix = F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)
    return F.when(segment.rlike("[0-9%]"), F.concat(F.lit("*"), suffix)).otherwise(segment)


def _level(open_: DataFrame, base: Column) -> DataFrame:
    """One step down the tree: ``(host, node, rest)`` with counts to the same with a longer node."""
    first = F.substring_index("rest", "/", 1)
    more = F.instr("rest", "/") > 0
    at = open_.select("host", "node", _shape(first).alias("seg"), F.when(more, F.expr("substr(rest, instr(rest, '/') + 1)")).alias("tail"), "n", "labelled", "blocked")
    children = at.groupBy("host", "node", "seg").agg(F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("blocked").alias("c_b"))
    nodes = children.groupBy("host", "node").agg(
        F.count("*").alias("n_seg"), F.sum("c_n").alias("t_n"), F.sum("c_l").alias("t_l"), F.sum("c_b").alias("t_b"), F.sum((F.col("c_l") > 0).cast("long")).alias("n_labelled")
    )
    joined = children.join(nodes, ["host", "node"])
    rate = (F.col("t_b") + base) / (F.col("t_l") + 1)
    own = (F.col("c_b") + base) / (F.col("c_l") + 1)
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("c_l"), F.lit(1)) + F.lit(1e-6))
    alike = (F.col("n_labelled") >= BRANCHES) & (F.col("c_l") > 0) & (F.abs(own - rate) <= Z * error)
    rare = (F.col("n_seg") >= MANY) & (F.col("t_n") < RARE * F.col("n_seg"))
    fixed = F.col("seg").startswith("*") | (F.col("seg") == "")
    named = joined.select("host", "node", "seg", F.when(fixed, F.col("seg")).when(rare | alike, F.lit("*")).otherwise(F.col("seg")).alias("name"))
    moved = at.join(named, ["host", "node", "seg"])
    return moved.select("host", "node", "seg", "tail", F.concat("node", F.lit("/"), "name").alias("deeper"), "n", "labelled", "blocked")


def _rest(path: Column) -> Column:
    return F.when(path.startswith("/"), F.expr("substr(path, 2)")).otherwise(path)


def template_tree(urls: DataFrame) -> DataFrame:
    """``(host, path, template)`` for distinct paths with counts ``n``, ``labelled`` and ``blocked``."""
    base = urls.agg(F.coalesce(F.sum("blocked") / F.sum("labelled"), F.lit(0.5)).alias("b")).first()["b"]
    base = F.lit(float(base if base is not None else 0.5))
    # every path walks down its own row: (host, path) stays, node grows
    live = urls.select("host", "path", F.lit("").alias("node"), _rest(F.col("path")).alias("rest"), "n", "labelled", "blocked")
    done = None
    for depth in range(LEVELS):
        open_ = live.groupBy("host", "node", F.substring_index("rest", "/", 1).alias("rest")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        step = _level(open_, base).select("host", "node", "seg", "deeper").distinct()
        keyed = live.withColumn("seg", _shape(F.substring_index("rest", "/", 1)))
        moved = cut_lineage(
            keyed.join(step, ["host", "node", "seg"]).select(
                "host", "path", F.col("deeper").alias("node"), F.when(F.instr("rest", "/") > 0, F.expr("substr(rest, instr(rest, '/') + 1)")).alias("rest"), "n", "labelled", "blocked"
            )
        )
        ended = moved.where("rest is null").select("host", "path", F.col("node").alias("template"))
        done = ended if done is None else done.unionAll(ended)
        live = moved.where("rest is not null")
        if live.isEmpty():
            return done
    return done.unionAll(live.select("host", "path", F.concat("node", F.lit("/**")).alias("template")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per page: host, path, the fitting rule, the verdict, and the template with its purity."""
    url = F.col(f"`{url_col}`")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = cut_lineage(parsed.withColumns({"rule": rule, "by_rule": verdict}))
    counted = cut_lineage(parsed.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.sum((F.coalesce("by_rule", F.lit("")) == "block").cast("long")).alias("blocked")
    ))
    tree = cut_lineage(template_tree(counted).join(counted, ["host", "path"]))
    by_host = cut_lineage(tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")))
    shared = cut_lineage(by_host.groupBy("template").agg(((F.sum("blocked") + PRIOR / 2) / (F.sum("labelled") + PRIOR)).alias("anywhere")))
    pure = by_host.join(shared, "template").select("host", "template", ((F.col("blocked") + PRIOR * F.col("anywhere")) / (F.col("labelled") + PRIOR)).alias("purity"))
    by_path = cut_lineage(tree.select("host", "path", "template").join(cut_lineage(pure), ["host", "template"]))
    joined = parsed.join(by_path, ["host", "path"], "left")
    method = F.when(F.col("purity") >= PURE, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity")
