"""URL filtering with a path-template tree for each host.

Segments that look variable become wildcards at once. Level by level, another
segment stays literal only where its host has it often under the same template
so far, and where its pages are labelled differently from their siblings, on
this host or on all hosts that share the template; other branches are merged
into the wildcard. A template is rejected if its labelled purity is low, after
smoothing towards that of the same template on all hosts, which is smoothed
towards that of all labelled pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import lookup_join
from .scratch import discard, stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WILDCARD = "*"
#: Segments that always become a wildcard: numbers and hexadecimal names, with or without an extension.
VARIABLE = r"^[0-9a-f-]*[0-9][0-9a-f-]*(\.\w+)?$"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_rule(rules: list[Rule], value) -> Column:
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest comes outermost
        fits = ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def judge(
    pages: DataFrame, rules: list[Rule], page_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, label_col: str = "good",
    min_pages: int = 5, min_share: float = 0.02, z_limit: float = 1.96, smoothing: float = 4.0, unlabelled_weight: float = 0.1, min_purity: float = 0.25, max_depth: int | None = None,
) -> DataFrame:
    """``page_col``, ``host``, ``path``, ``rule``, ``template``, ``purity`` and ``verdict`` for each page.

    Labels come from ``labels`` (``page_col``, boolean ``label_col``) or, by
    default, from the rules: pages that a rule blocks or allows are its bad or
    good examples. Each unlabelled page of a template adds ``unlabelled_weight``
    to the pull towards the purity of the same template on all hosts. A page
    without a rule is blocked if its template's purity is under ``min_purity``
    times that of all labelled pages; one that equals it is allowed. All
    segments count, or with ``max_depth`` those after it as one; urls of any
    length are read whole. Columns of other names aren't looked at. A url that is
    null or has no ``://`` has an empty host and path and the template of the
    empty host's root. Repeated rows are judged each; an empty table gives an
    empty result; without any label every purity is 1.
    """
    rows = pages.select(F.col(page_col).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", _first_rule(rules, lambda r: r.name).cast("string")).withColumn("ruled", _first_rule(rules, lambda r: r.verdict).cast("string"))
    if labels is None:
        rows = rows.withColumn("good", F.when(F.col("ruled").isNotNull(), F.col("ruled") == "allow"))
    else:
        marks = labels.groupBy(F.col(page_col).alias("page")).agg(F.min(label_col).alias("good"))
        rows = rows.join(marks, "page", "left")
    parts = F.array_remove(F.split("path", "/"), "")
    if max_depth is not None:
        parts = F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))).otherwise(parts)
    shape = F.transform(parts, lambda part: F.when(F.regexp_like(part, F.lit(VARIABLE)), WILDCARD).otherwise(part))
    rows = stored(rows.select("page", "host", "path", "rule", "ruled", "good", shape.alias("parts")).withColumn("key", F.array_join(F.concat(F.array("host"), "parts"), "/")), "urls")
    counts = (F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    shapes = stored(rows.groupBy("key").agg(F.any_value("host").alias("host"), F.any_value("parts").alias("parts"), *counts).withColumn("path", F.lit("")), "shapes")
    depth = _literal_depth(shapes, min_pages)
    for level in range(depth):
        longer = _generalised(shapes, level, min_pages, min_share, z_limit)
        discard(shapes)
        shapes = longer
    shapes = shapes.withColumn("path", F.concat("path", F.repeat(F.lit(f"/{WILDCARD}"), F.greatest(F.size("parts") - depth, F.lit(0)))))

    seen = shapes.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    prior = seen.g / (seen.g + seen.b) if seen.g + seen.b else 1.0
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    pull = F.lit(smoothing) + F.lit(unlabelled_weight) * (F.col("n") - F.col("good") - F.col("bad"))
    common = stored(shapes.groupBy("path").agg(*sums).select("path", ((F.col("good") + pull * prior) / (F.col("good") + F.col("bad") + pull)).alias("common")), "common")
    templates = lookup_join(stored(shapes.groupBy(F.concat("host", "path").alias("template"), "path").agg(*sums), "templates"), common, "path")
    purity = stored(templates.select("template", ((F.col("good") + pull * F.col("common")) / (F.col("good") + F.col("bad") + pull)).alias("purity")), "purity")
    named = stored(lookup_join(shapes.select("key", F.concat("host", "path").alias("template")), purity, "template"), "named")
    judged = lookup_join(rows.drop("parts"), named, "key")
    verdict = F.coalesce("ruled", F.when(F.col("purity") < min_purity * prior, "block").otherwise("allow"))
    return judged.select(F.col("page").alias(page_col), "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def _literal_depth(shapes: DataFrame, min_pages: int) -> int:
    """The last level at which a segment may stay literal: deeper, each host has fewer pages than a literal needs, so all segments become wildcards."""
    sizes = shapes.groupBy("host", F.size("parts").alias("depth")).agg(F.sum("n").alias("n"))  # a row for each host and depth
    deeper = sizes.withColumn("upto", F.sum("n").over(W.partitionBy("host").orderBy(F.desc("depth"))))
    return deeper.where(F.col("upto") >= min_pages).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d


def _differs(n: str, suffix: str, z_limit: float) -> Column:
    """Whether a branch's labelled pages are good or bad unlike those of its whole parent."""
    labelled, all_labelled = F.col(f"good{n}") + F.col(f"bad{n}"), F.col(f"good{suffix}") + F.col(f"bad{suffix}")
    share = F.try_divide(F.col(f"good{suffix}"), all_labelled)
    deviation = F.sqrt(labelled * share * (1 - share))
    return F.coalesce((deviation > 0) & (F.abs(F.col(f"good{n}") - labelled * share) > z_limit * deviation), F.lit(False))


def _generalised(shapes: DataFrame, level: int, min_pages: int, min_share: float, z_limit: float) -> DataFrame:
    """``path`` with the segment of one more level, literal or a wildcard; works on shapes of urls with their counts, not on urls."""
    part = F.get("parts", F.lit(level))
    shapes = shapes.withColumn("part", part).withColumn("node", F.concat("host", "path")).withColumn("branch", F.concat_ws("/", "node", "part")).withColumn("shared", F.concat_ws("/", "path", "part"))
    there = shapes.where("part is not null")
    sums = lambda suffix: [F.sum(c).alias(f"{c}{suffix}") for c in ("n", "good", "bad")]
    children = stored(there.groupBy("branch", "node", "shared", "path", "part").agg(*sums("")), "branches")
    over = {
        "node": stored(children.groupBy("node").agg(*sums("_all")), "parents"),
        "shared": stored(children.groupBy("shared").agg(*sums("_shared")), "shared"),
        "path": stored(children.groupBy("path").agg(*sums("_everywhere")), "everywhere"),
    }
    judged = children
    for key, totals in over.items():
        judged = lookup_join(judged, totals, key)
    often = (F.col("n") >= F.greatest(F.lit(min_pages), F.lit(min_share) * F.col("n_all"))) & (F.col("part") != WILDCARD)
    literal = stored(judged.where(often & (_differs("", "_all", z_limit) | _differs("_shared", "_everywhere", z_limit))).select("branch", F.lit(True).alias("literal")), "literal")
    named = lookup_join(shapes, literal, "branch", "left")
    path = F.when(F.col("part").isNull(), F.col("path")).when(F.col("literal"), F.col("shared")).otherwise(F.concat("path", F.lit(f"/{WILDCARD}")))
    longer = stored(named.select("key", "host", "parts", "n", "good", "bad", path.alias("path")), "shapes")
    for table in (children, literal, *over.values()):
        discard(table)
    return longer
