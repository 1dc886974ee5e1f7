"""URL verdicts from host rules and from a tree of path templates.

Per host, paths form a tree of segments.  Level by level, segments that vary (ids, titles) become wildcards; then
branches whose label rates do not differ statistically are merged; a template is rejected when its smoothed share of
bad labels reaches a threshold.  All of it runs on distinct paths and templates, counted before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored
from floorledger.llm.words import ascii_lowered


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class TreeSettings:
    # Levels that the DuckDB statement writes out; the operator goes as deep as the paths do.
    levels: int = 4
    # Level from which levels without varying children are looked for, to be passed over.
    jump_from: int = 8
    # A node's children vary when there are so many kinds, and so many kinds per path.
    least_kinds: int = 5
    kinds_per_path: float = 0.3
    # A child with this share of a varying node's paths keeps its name.
    own_share: float = 0.05
    # Branches merge when their rates differ by less than so many standard errors.
    merge_errors: float = 1.96
    # Labels that the host's rate counts for in a template's, and the whole rate in a host's.
    smoothing: float = 10.0
    # Smoothed share of bad labels from which a template is rejected.
    reject: float = 0.5


SETTINGS = TreeSettings()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty for a null or an url without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, group), F.lit("")) for group in (1, 2))
    return ascii_lowered(host), path


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host and path, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.name)):
        same_host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = same_host & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """Named segments, a star written as %2A."""
    return F.filter(F.split(F.replace(path, F.lit("*"), F.lit("%2A")), "/"), lambda part: part != "")


def _wildcard(segment: Column) -> Column:
    """A star and the ending of a file name."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1))


def _generalised(paths: DataFrame, level: int, settings: TreeSettings) -> DataFrame:
    """Adds one level to each template: the segment, or a wildcard where the node's children vary.

    All paths reach the level.  ``open`` tells those that have to go on: where fewer of them run through a child than
    a varying node has kinds, nothing below varies, and the template gets all that is left of the path at once.
    """
    node = ["host", "template"]
    here = paths.withColumn("segment", F.get("segments", F.lit(level)))
    more = F.size("segments") > level + 1
    children = here.groupBy(*node, "segment").agg(F.sum("paths").alias("own"), F.count(F.when(more, 1)).alias("below"))
    nodes = children.groupBy(*node).agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("kinds"))
    varying = nodes.where(
        (F.col("kinds") >= settings.least_kinds) & (F.col("kinds") >= settings.kinds_per_path * F.col("all"))
    )
    star = F.coalesce(F.col("own") < F.greatest(F.lit(2.0), settings.own_share * F.col("all")), F.lit(False))
    # Written first: it is small, and beside a plain shuffle Spark can split the children of a hot node.
    marks = (
        children.join(stored(varying), node, "left")
        .select(*node, "segment", F.when(F.col("all").isNotNull(), star).otherwise(False).alias("star"), "below")
        .where(F.col("star") | (F.col("below") >= settings.least_kinds))
        .drop("below")
    )
    rest = F.array_join(F.slice("segments", level + 1, F.size("segments")), "/")
    step = F.when(F.col("star"), _wildcard(F.col("segment"))).when(~F.col("star"), F.col("segment")).otherwise(rest)
    return here.join(marks, [*node, "segment"], "left").select(
        "host", "path", "segments", "paths", "labelled", "bad", F.concat("template", F.lit("/"), step).alias("template"),
        (F.col("star").isNotNull() & more).alias("open"),
    )


def _next_varying(paths: DataFrame, level: int, settings: TreeSettings) -> int | None:
    """The next level, from the given one on, at which the children of any node vary."""
    levels = F.sequence(F.lit(level), F.size("segments") - 1)
    nodes = F.transform(
        levels,
        lambda at: F.struct(
            at.alias("level"),
            F.xxhash64("host", "template", F.slice("segments", level + 1, at - level)).alias("node"),
            F.get("segments", at).alias("segment"),
        ),
    )
    each = paths.select("paths", F.explode(nodes).alias("at")).select("paths", "at.*")
    children = each.groupBy("level", "node", "segment").agg(F.sum("paths").alias("own"))
    kinds = children.groupBy("level", "node").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("kinds"))
    varying = kinds.where(
        (F.col("kinds") >= settings.least_kinds) & (F.col("kinds") >= settings.kinds_per_path * F.col("all"))
    )
    return varying.agg(F.min("level")).first()[0]


def _advanced(paths: DataFrame, level: int, to: int | None) -> DataFrame:
    """Paths moved on to a level before which nothing varies; those that end before it are finished."""
    more = F.size("segments") > to if to is not None else F.lit(False)
    upto = F.when(more, F.lit(to or 0)).otherwise(F.size("segments"))
    passed = F.array_join(F.slice("segments", F.lit(level + 1), upto - level), "/")
    return paths.withColumn("template", F.concat("template", F.lit("/"), passed)).withColumn("open", more)


def _tree(paths: DataFrame, settings: TreeSettings) -> DataFrame:
    """``host, path, labelled, bad, template`` of every path, level by level until no path has to go on.

    Few paths go deep; from ``settings.jump_from`` on, levels at which nothing varies are passed over at once.
    """
    now = paths.select("*", _segments(F.col("path")).alias("segments"), F.lit("").alias("template"))
    now = stored(now.withColumn("open", F.size("segments") > 0))
    done, level = [], 0
    while True:
        done.append(now.where(~F.col("open")).select("host", "path", "labelled", "bad", "template"))
        now = now.where("open")
        if now.isEmpty():
            return reduce(DataFrame.union, done)
        if level >= settings.jump_from:
            to = _next_varying(now, level, settings)
            if to != level:
                now = stored(_advanced(now, level, to))
                if to is None:
                    continue
                done.append(now.where(~F.col("open")).select("host", "path", "labelled", "bad", "template"))
                now, level = now.where("open"), to
        now = stored(_generalised(now, level, settings))
        level += 1


def _merged(templates: DataFrame, level: int, settings: TreeSettings) -> DataFrame:
    """Renames branches at a level to a wildcard where their rate is that of their siblings, within error.

    Two siblings at least must agree for that; a branch without labels agrees with any.
    """
    parts = F.split(F.substring("merged", 2, 1_000_000_000), "/")
    starred = F.concat(
        F.lit("/"),
        F.array_join(
            F.transform(parts, lambda part, at: F.when((at == level) & ~part.startswith("*"), "*").otherwise(part)), "/"
        ),
    )
    group = F.when(F.size(parts) > level, starred).otherwise(F.col("merged"))
    branches = templates.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    branches = branches.withColumn("group", group)
    groups = branches.groupBy("host", "group").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("siblings")
    )
    rate = F.col("all_bad") / F.col("all_labelled")
    others = F.col("all_labelled") - F.col("labelled")
    gap = F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / others
    error = F.sqrt(rate * (1 - rate) * (1 / F.col("labelled") + 1 / others))
    apart = F.when((F.col("labelled") > 0) & (others > 0), F.abs(gap) > settings.merge_errors * error)
    similar = branches.join(groups.where("siblings > 1"), ["host", "group"]).where(~F.coalesce(apart, F.lit(False)))
    counted = similar.groupBy("host", "group").agg(F.count(F.lit(1)).alias("agreeing")).where("agreeing > 1")
    renamed = similar.join(counted, ["host", "group"]).select("host", "merged", "group")
    return templates.join(renamed, ["host", "merged"], "left").select(
        "host", "template", "labelled", "bad", F.coalesce("group", "merged").alias("merged")
    )


def _next_alike(templates: DataFrame, below: int | None) -> int | None:
    """The deepest level, below the given one, at which two branches of a host differ there and nowhere else."""
    parts = F.split(F.substring("merged", 2, 1_000_000_000), "/")
    own = F.transform(parts, lambda part, at: F.xxhash64(at, part))
    starred = F.transform(parts, lambda part, at: F.xxhash64(at, F.when(part.startswith("*"), part).otherwise("*")))
    # A branch's hash is that of its segments together, from which one can be exchanged.
    whole = F.aggregate(own, F.lit(0).cast("long"), lambda one, other: one.bitwiseXOR(other))
    branches = templates.select("host", "merged").distinct().select(
        "host", F.size(parts).alias("depth"), whole.alias("whole"),
        F.posexplode(F.arrays_zip(own.alias("own"), starred.alias("starred"))).alias("level", "segment"),
    )
    rest = F.col("whole").bitwiseXOR(F.col("segment.own")).bitwiseXOR(F.col("segment.starred"))
    reached = branches if below is None else branches.where(F.col("level") < below)
    alike = reached.groupBy("host", "depth", "level", rest.alias("rest")).count().where("count > 1")
    return alike.agg(F.max("level")).first()[0]


def _branches(templates: DataFrame, settings: TreeSettings) -> DataFrame:
    """Adds ``merged`` to each template: from the deepest level up, at those levels where branches can agree."""
    merged = stored(templates.select("*", F.col("template").alias("merged")))
    level = _next_alike(merged, None)
    while level is not None:
        merged = stored(_merged(merged, level, settings))
        level = _next_alike(merged, level)
    return merged


def template_verdicts(paths: DataFrame, settings: TreeSettings = SETTINGS) -> DataFrame:
    """``host, path, template, purity, verdict`` from ``host, path, paths, labelled, bad``, one row per path."""
    tree = _tree(paths, settings)
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    templates = _branches(templates, settings)

    whole = templates.agg(F.sum("labelled").alias("w_labelled"), F.sum("bad").alias("w_bad"))
    rate = F.coalesce(F.col("w_bad") / F.when(F.col("w_labelled") > 0, F.col("w_labelled")), F.lit(0.0))
    k = settings.smoothing
    hosts = (
        templates.groupBy("host")
        .agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
        .crossJoin(F.broadcast(whole))  # one row
        .select("host", ((F.col("h_bad") + k * rate) / (F.col("h_labelled") + k)).alias("host_rate"))
    )
    branches = templates.groupBy("host", "merged").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    purity = (F.col("b") + k * F.col("host_rate")) / (F.col("n") + k)
    judged = branches.join(hosts, "host").select("host", "merged", purity.alias("purity"))
    verdict = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    of_template = templates.join(judged, ["host", "merged"]).select("host", "template", "merged", "purity")
    return tree.join(of_template, ["host", "template"]).select(
        "host", "path", F.col("merged").alias("template"), "purity", verdict.alias("verdict")
    )


def url_verdicts(
    pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, settings: TreeSettings = SETTINGS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages`` (page_id, url).

    ``labels`` has page_id and bad (boolean); pages with several labels count several times, null ones not at all.
    The longest fitting rule decides; else the page's template, whose smoothed share of bad labels is ``purity``.  A null url has host and path empty, so rows without
    a host form one group.  Repeated rows each get the same verdict.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("page")).agg(
        F.count(F.lit(1)).alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    counted = parsed.join(marks, F.col("page_id") == F.col("page"), "left")
    paths = counted.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("paths"),
        F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
    )
    judged = template_verdicts(paths, settings)
    name, verdict = rule_of(rules)
    return parsed.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.col("verdict")).alias("verdict"), "template", "purity",
    )
