"""URL filter by a path-template tree.

Per host, paths are split at slashes and read level by level. A segment with few pages below its parent becomes a
wildcard, and so does one whose share of blocked labels does not differ from that of its siblings; what stays apart is
a branch of its own. Labels come from the given rules. Every template gets a purity: the share of blocked labels,
smoothed by its parent's purity, up to the host and to all labels. A page that no rule decides is blocked if its
template is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.session import materialize

#: Longest rule wins: host (with its subdomains) and start of the path, blocked or not.
RULES = {"org/": False, "example.org/es/": True, "example.org/en/1": True, "com/fr/": False, "com/de/": True}
#: Levels of the tree; deeper segments share one wildcard.
DEPTH = 4
#: Pages that a segment needs to be kept, and standard errors by which its share of blocked labels must differ.
SUPPORT = 20
APART = 2.5
#: Labels that the parent's purity counts for.
SMOOTHING = 8.0
#: Purity from which a template is rejected.
REJECT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _level(pages: DataFrame, depth: int) -> DataFrame:
    """Extend every template by the segment at ``depth``, or by a wildcard."""
    segment = F.when(F.size("segments") > depth, F.get("segments", F.lit(depth)))
    asked = pages.withColumn("segment", segment)
    counts = [F.count(F.lit(1)).alias("pages"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
    children = asked.where("segment is not null").groupBy("host", "template", "segment").agg(*counts)
    able = materialize(children.where((F.col("pages") >= SUPPORT) & (F.col("labels") > 0)), "url-children")
    parents = able.groupBy("host", "template").agg(F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    share = (F.col("all_blocked") + 0.5) / (F.col("all_labels") + 1.0)
    error = F.sqrt(share * (1 - share) / F.col("labels"))
    differs = F.abs(F.col("blocked") / F.col("labels") - share) >= APART * error
    apart = able.join(parents, ["host", "template"]).where(differs).select("host", "template", "segment", F.lit(True).alias("apart"))
    part = F.when(F.col("segment").isNull(), F.lit("")).when(F.col("apart"), F.concat(F.lit("/"), F.col("segment"))).otherwise(F.lit("/*"))
    if depth == DEPTH - 1:
        part = F.when(F.size("segments") > DEPTH, F.concat(part, F.lit("/**"))).otherwise(part)
    longer = F.concat("template", part)
    return asked.join(apart, ["host", "template", "segment"], "left").select(
        "id", "host", "path", "rule", "label", "segments", longer.alias("template"), F.array_append("above", longer).alias("above")
    )


def _purities(pages: DataFrame) -> DataFrame:
    """``host``, ``template`` and ``purity`` of every template at the last level."""
    counts = [F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
    nodes = materialize(
        pages.select("host", "label", F.posexplode("above").alias("level", "node"), "above")
        .withColumn("parent", F.when(F.col("level") > 0, F.get("above", F.col("level") - 1)))
        .groupBy("host", "level", "parent", "node")
        .agg(*counts),
        "url-nodes",
    )
    whole = nodes.where("level = 0").agg((F.coalesce(F.sum("blocked"), F.lit(0)) / (F.coalesce(F.sum("labels"), F.lit(0)) + 1.0)).alias("share"))
    share = whole.first()["share"]
    smooth = (F.col("blocked") + SMOOTHING * F.col("above_purity")) / (F.col("labels") + SMOOTHING)
    known = nodes.where("level = 0").withColumn("above_purity", F.lit(share)).select("host", "node", smooth.alias("purity"))
    for level in range(1, DEPTH + 1):
        upper = known.select("host", F.col("node").alias("parent"), F.col("purity").alias("above_purity"))
        known = nodes.where(F.col("level") == level).join(upper, ["host", "parent"]).select("host", "node", smooth.alias("purity"))
    return known.withColumnRenamed("node", "template")


def judge(pages: DataFrame, rules: dict[str, bool] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``id_column``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every page.

    The rule decides where one fits; else the purity of the page's template does. A null url has an empty host and path
    and is judged like others. Repeated ids keep their rows; without any labelled page the purity is 0 and nothing is
    rejected; an empty table gives an empty table; other columns, whatever their names, are ignored.
    """
    host, path = host_and_path(F.col(url_column).cast("string"))
    read = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    blocking = [r for r, blocked in rules.items() if blocked]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocking).cast("int"))
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    state = read.select("*", label.alias("label"), segments.alias("segments"), F.lit("").alias("template"), F.array(F.lit("")).alias("above"))
    state = materialize(state, "urls")
    for depth in range(DEPTH):
        state = materialize(_level(state, depth), "urls")
    blocked = F.coalesce(F.col("label") == 1, F.col("purity") >= REJECT)
    return state.join(_purities(state), ["host", "template"]).select(
        F.col("id").alias(id_column), "host", "path", "rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "template", "purity"
    )
