"""URL filters: explicit host and path rules, and a tree of path templates per host.

Each host's paths form a tree of segments. Segments of a variable shape, and segments below a
node that hardly ever sees one twice, become the wildcard ``*``; sibling branches that lead to the
same templates and whose labelled shares of bad URLs are statistically alike are merged. A
template whose smoothed purity - the share of bad URLs among its labelled ones, drawn towards the
purity of the node it branches from, that towards the next one's, and the host's towards an even
prior - reaches a limit is rejected, and so are the URLs on it that no rule decides. Branches
without labelled URLs so have the purity of the nearest node that has some.

Defined results: a null URL, or one without ``://``, has an empty host and path, matches no rule
and is judged as the empty template of the empty host; repeated rows count as often as they occur.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import pick, stored

ALLOW, BLOCK, WILDCARD = "allow", "block", "*"
#: A node is variable below if it has so many different children and they recur less often than this.
FANOUT, RECURRENCE = 20, 5.0
#: Weight of the prior, purity from which a template goes, and normal quantile of the share's interval.
SMOOTHING, PURITY, Z = 2.0, 0.8, 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers (with a file's ending), dates, and hexadecimal keys of eight digits or more.
VARIABLE = r"^(\d+([-_.]\d+)*|(?=.*\d)[0-9a-fA-F]{8,}([-][0-9a-fA-F]{4,})*)(\.[A-Za-z0-9]{1,5})?$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, path).otherwise("")


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls; work grows with the number of rules."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def segments(path: Column) -> Column:
    """The path's segments without an ending slash; variable shapes are wildcards."""
    plain = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(plain, lambda x: F.when(x.rlike(VARIABLE), WILDCARD).otherwise(x))


def _generalised(depth: int) -> Column:
    return F.transform("template", lambda x, i: F.when(i == depth, WILDCARD).otherwise(x))


def templates(counts: DataFrame) -> DataFrame:
    """``counts`` (host, shape, n, bad, good) with the column template.

    A level at a time, children of nodes that hardly see one twice become wildcards. What is
    joined are counts of distinct shapes, not URLs; each level is written to the shared folder. It
    ends where no host has shapes enough that are deeper for a node to be variable below."""
    tree = stored(counts.withColumn("template", F.col("shape")), "urls")
    for depth in itertools.count():
        deeper = tree.where(F.size("shape") > depth).groupBy("host").agg(F.count("*").alias("n"))
        if deeper.where(F.col("n") >= FANOUT).isEmpty():
            break
        tree = tree.withColumn("_node", F.slice("template", 1, depth)).withColumn("_child", F.get("template", F.lit(depth)))
        children = tree.where(F.col("_child").isNotNull() & (F.col("_child") != WILDCARD)).groupBy("host", "_node", "_child").agg(F.sum("n").alias("_n"))
        variable = children.groupBy("host", "_node").agg(F.count("*").alias("_children"), F.sum("_n").alias("_visits"))
        variable = variable.where((F.col("_children") >= FANOUT) & (F.col("_visits") < RECURRENCE * F.col("_children"))).select("host", "_node", F.lit(True).alias("_variable"))
        tree = tree.join(variable, ["host", "_node"], "left")
        wild = _generalised(depth)
        tree = tree.withColumn("template", F.when(F.col("_variable") & F.col("_child").isNotNull(), wild).otherwise(F.col("template"))).drop("_node", "_child", "_variable")
        tree = stored(tree, "urls")
    return tree


def _priors(of: DataFrame) -> DataFrame:
    """host, _node, _prior: the smoothed purity of each node from which a family of templates branches."""
    above = lambda path: F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.slice(path, F.lit(1), k))
    needed = of.select("host", "_node").distinct().withColumn("_above", F.explode(above(F.col("_node"))))
    sums = of.select("host", F.explode(above(F.col("template"))).alias("_above"), "bad", "good").groupBy("host", "_above").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ways = needed.join(sums, ["host", "_above"]).groupBy("host", "_node").agg(F.sort_array(F.collect_list(F.struct(F.size("_above"), "bad", "good"))).alias("_way"))
    prior = F.aggregate("_way", F.lit(0.5), lambda p, x: (x["bad"] + p * SMOOTHING) / (x["bad"] + x["good"] + SMOOTHING))
    return ways.select("host", "_node", prior.alias("_prior"))


def rejected(tree: DataFrame) -> DataFrame:
    """host, shape of all that belong to a template whose merged purity is too high."""
    of = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = F.col("bad") + F.col("good")
    share = F.when(n > 0, F.col("bad") / n).otherwise(0.5)
    centre, z2 = (F.col("bad") + Z * Z / 2) / (n + Z * Z), Z * Z
    reach = Z * F.sqrt(n * share * (1 - share) + z2 / 4) / (n + z2)
    alike = F.when(n == 0, "none").when(centre - reach > 0.5, "bad").when(centre + reach < 0.5, "good").otherwise("open")
    constant = F.transform("template", lambda x, i: F.when(x == WILDCARD, F.lit(-1)).otherwise(i))
    last = F.array_max(F.concat(constant, F.array(F.lit(-1))))
    family = F.transform("template", lambda x, i: F.when(i == last, "+").otherwise(x))
    of = of.withColumn("_last", last).withColumn("_alike", alike).withColumn("_family", F.when(F.col("_last") >= 0, family).otherwise(F.col("template")))
    of = stored(of.withColumn("_node", F.slice("template", F.lit(1), F.greatest("_last", F.lit(0)))), "urls")
    merged = of.groupBy("host", "_family", "_node", "_alike").agg(F.sum("bad").alias("_bad"), F.sum("good").alias("_good")).join(_priors(of), ["host", "_node"])
    purity = (F.col("_bad") + F.col("_prior") * SMOOTHING) / (F.col("_bad") + F.col("_good") + SMOOTHING)
    gone = merged.where(purity >= PURITY).select("host", "_family", "_alike")
    gone = of.join(gone, ["host", "_family", "_alike"], "left_semi").select("host", "template")
    return tree.join(gone, ["host", "template"], "left_semi").select("host", "shape")


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url", bad: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict.

    ``bad``: a column of the rows page_id, url, host, path, rule, ruled - true, false, or null
    where a URL isn't labelled. By default URLs that rules block are bad and those they allow good.
    """
    rows = pick(pages, page_id=id_column, url=url_column)
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, ruled = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "shape": segments(F.col("path"))})
    is_bad = (F.col("ruled") == BLOCK) if bad is None else bad
    counts = rows.withColumn("_bad", is_bad).groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good"))
    gone = rejected(templates(counts)).withColumn("_gone", F.lit(True))
    rows = rows.join(gone, ["host", "shape"], "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("_gone"), BLOCK).otherwise(ALLOW)).alias("verdict"))
