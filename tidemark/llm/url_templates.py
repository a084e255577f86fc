"""URL filter by rules and by a tree of path templates learned from what the rules decide.

Each host's paths are cut into segments, all of them, and those that are variable by their form become wildcards. At every
level of the tree, hosts included, a branch stands apart if its labels differ from those of its siblings; all others are
merged with their parent. A url has the smoothed purity of the deepest branch above it that stands apart and has labels
of its own, and is rejected if that is bad.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh

#: Weight of the prior in a purity, purity from which a template is rejected, labelled urls that this and standing apart take, z of the merging test.
PRIOR_WEIGHT, REJECT, LEAST_LABELLED, SIMILAR_Z = 2.0, 0.8, 5, 1.96


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A to Z lower-cased; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits (null for none) and whether it allows. Of equally long ones the first in code-point order."""
    text = allow = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        allow = F.when(fits, r.allow) if allow is None else allow.when(fits, r.allow)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return text, allow


def general(segment: Column) -> Column:
    """Numbers, hex of 8 digits or more and ids become "*"; a file ending stays."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})?$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(end))
    variable = stem.rlike(r"^[0-9]+$|^[0-9A-Fa-f-]{8,}$|[0-9].*-|-.*[0-9]|[0-9]{4,}") | (F.length(stem) > 40)
    return F.when(variable, F.concat(F.lit("*"), end)).otherwise(segment)


def template_of(path: Column) -> Column:
    """All segments in their general form."""
    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(F.substr(path, F.lit(2), F.length(path)), "/"), general), "/"))


def branches_above(template: Column) -> Column:
    """The branches of a template from the host's root to itself, as hashes."""
    return F.aggregate(F.split(F.substr(template, F.lit(2), F.length(template)), "/"), F.array(F.lit(0).cast("long")), lambda acc, s: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), s)))


def told_apart(n: Column, bad: Column, other_n: Column, other_bad: Column) -> Column:
    """Whether the rates of two groups of labels differ, both smoothed; false where one of them is too small."""
    p, q, all_ = (bad + 0.5) / (n + 1), (other_bad + 0.5) / (other_n + 1), (bad + other_bad + 1) / (n + other_n + 2)
    z = F.abs(p - q) / F.sqrt(all_ * (1 - all_) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(other_n, F.lit(1))))
    return (n >= LEAST_LABELLED) & (other_n > 0) & (z >= SIMILAR_Z)


def judged_templates(known: DataFrame) -> DataFrame:
    """(host, template, purity, rejected) of all templates. known: host, template, label (1 bad, 0 good, null)."""
    own = checkpointed(known.groupBy("host", "template").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad")))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"))  # one row
    lists = own.withColumn("above", branches_above(F.col("template")))

    # labels of every branch that may stand apart, and of its parent; the parent of a host is the whole table
    paths = lists.filter("n > 0").select("host", "n", "bad", F.posexplode("above").alias("depth", "branch"), "above")
    nodes = paths.select("host", "depth", "branch", F.when(F.col("depth") > 0, F.get("above", F.col("depth") - 1)).alias("parent"), "n", "bad")
    nodes = checkpointed(nodes.groupBy("host", "depth", "branch", "parent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= LEAST_LABELLED))
    parents = nodes.select("host", (F.col("depth") + 1).alias("depth"), F.col("branch").alias("parent"), F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    tested = nodes.join(parents, ["host", "depth", "parent"], "left").crossJoin(F.broadcast(total))
    pn, pbad = F.coalesce("pn", "all_n"), F.coalesce("pbad", "all_bad")
    apart = checkpointed(tested.filter(told_apart(F.col("n"), F.col("bad"), pn - F.col("n"), pbad - F.col("bad"))).select("host", "depth", "branch"))

    # each label counts for the deepest branch above it that stands apart, or else for the whole table
    above = checkpointed(lists.select("host", "template", "n", "bad", F.posexplode("above").alias("depth", "branch")).join(apart, ["host", "depth", "branch"]))
    deepest = above.groupBy("host", "template").agg(F.max(F.struct("depth", "branch", "n", "bad")).alias("m")).select("host", "m.*")
    pools = checkpointed(deepest.groupBy("host", "depth", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n > 0"))
    held = pools.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("held_bad"))
    rest = total.crossJoin(held).select((F.col("all_n") - F.col("held_n")).alias("rest_n"), (F.col("all_bad") - F.col("held_bad")).alias("rest_bad"), ((F.col("all_bad") + 1) / (F.col("all_n") + 2)).alias("prior"))
    judges = above.select("host", "template", "depth", "branch").join(pools, ["host", "depth", "branch"])
    judges = judges.groupBy("host", "template").agg(F.max(F.struct("depth", "n", "bad")).alias("m")).select("host", "template", F.col("m.n").alias("jn"), F.col("m.bad").alias("jbad"))
    both = own.select("host", "template").join(judges, ["host", "template"], "left").crossJoin(F.broadcast(rest))
    n, bad = F.coalesce("jn", "rest_n"), F.coalesce("jbad", "rest_bad")
    purity = (bad + PRIOR_WEIGHT * F.col("prior")) / (n + PRIOR_WEIGHT)
    return both.select("host", "template", purity.alias("purity"), ((purity >= REJECT) & (n >= LEAST_LABELLED)).alias("rejected"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a page: id, host, path, rule (null where none fits), verdict, template, purity.

    A null url or one without :// has an empty host and path and the verdict of their template. Labels are the rules' own
    decisions; without any, everything is allowed. Purity is that of the branch that decides the template. Repeated rows count and are judged each; an empty table gives no rows.
    """
    url = fresh(pages, "__url")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias(url))
    rows = rows.select("id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, allow = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "allow": allow, "template": template_of(F.col("path"))})
    found = judged_templates(rows.select("host", "template", (1 - F.col("allow").cast("int")).alias("label")))
    verdict = F.when(F.col("allow").isNotNull(), F.when(F.col("allow"), "allow").otherwise("block")).when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(found, ["host", "template"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The result in DuckDB's SQL; branches are written out instead of hashed."""

    def case(value) -> str:
        whens = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {value(r)}" for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
        return f"CASE {' '.join(whens)} END"

    stem = r"left(s, len(s) - len(regexp_extract(s, '(\.[A-Za-z]{1,5})?$', 1)))"
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {case(lambda r: f"'{r.text}'")} AS rule, {case(lambda r: str(r.allow).lower())} AS allow FROM u),
g AS (
  SELECT *, list_transform(string_split(substr(path, 2), '/'), lambda s: CASE WHEN len({stem}) > 40 OR regexp_matches({stem}, '^[0-9]+$|^[0-9A-Fa-f-]{{8,}}$|[0-9].*-|-.*[0-9]|[0-9]{{4,}}') THEN '*' || regexp_extract(s, '(\.[A-Za-z]{{1,5}})?$', 1) ELSE s END) AS segs
  FROM r),
own AS (SELECT host, segs, count(allow) AS n, coalesce(sum(CASE WHEN NOT allow THEN 1 WHEN allow THEN 0 END), 0) AS bad FROM g GROUP BY 1, 2),
total AS (SELECT coalesce(sum(n), 0) AS all_n, coalesce(sum(bad), 0) AS all_bad FROM own),
b AS (SELECT host, segs, n, bad, unnest(range(len(segs) + 1)) AS depth FROM own),
nodes AS (SELECT host, depth, segs[1:depth] AS branch, sum(n) AS n, sum(bad) AS bad FROM b GROUP BY 1, 2, 3 HAVING sum(n) >= {LEAST_LABELLED}),
t AS (
  SELECT c.host, c.depth, c.branch, c.n, c.bad, coalesce(p.n, all_n) - c.n AS m, coalesce(p.bad, all_bad) - c.bad AS others
  FROM nodes c CROSS JOIN total LEFT JOIN nodes p ON p.host = c.host AND p.depth = c.depth - 1 AND p.branch = c.branch[1:c.depth - 1] AND c.depth > 0),
z AS (SELECT *, (bad + 0.5::DOUBLE) / (n + 1) AS p, (others + 0.5::DOUBLE) / (m + 1) AS q, (bad + others + 1)::DOUBLE / (n + m + 2) AS w FROM t),
apart AS (SELECT host, depth, branch FROM z WHERE m > 0 AND abs(p - q) / sqrt(w * (1 - w) * (1::DOUBLE / greatest(n, 1) + 1::DOUBLE / greatest(m, 1))) >= {SIMILAR_Z}),
above AS (SELECT b.host, b.segs, b.n, b.bad, b.depth, apart.branch FROM b JOIN apart ON b.host = apart.host AND b.depth = apart.depth AND b.segs[1:b.depth] = apart.branch),
pools AS (
  SELECT host, depth, branch, sum(n) AS n, sum(bad) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY host, segs ORDER BY depth DESC) AS k FROM above) WHERE k = 1 GROUP BY 1, 2, 3 HAVING sum(n) > 0),
rest AS (SELECT all_n - coalesce((SELECT sum(n) FROM pools), 0) AS rest_n, all_bad - coalesce((SELECT sum(bad) FROM pools), 0) AS rest_bad, (all_bad + 1)::DOUBLE / (all_n + 2) AS prior FROM total),
judge AS (SELECT a.host, a.segs, p.n, p.bad, row_number() OVER (PARTITION BY a.host, a.segs ORDER BY a.depth DESC) AS k FROM above a JOIN pools p USING (host, depth, branch)),
f AS (
  SELECT own.host, own.segs, coalesce(j.n, rest_n) AS n, (coalesce(j.bad, rest_bad) + {PRIOR_WEIGHT}::DOUBLE * prior) / (coalesce(j.n, rest_n) + {PRIOR_WEIGHT}::DOUBLE) AS purity
  FROM own CROSS JOIN rest LEFT JOIN judge j ON j.host = own.host AND j.segs = own.segs AND j.k = 1)
SELECT page_id, g.host, path, rule, CASE WHEN allow THEN 'allow' WHEN NOT allow THEN 'block' WHEN purity >= {REJECT} AND n >= {LEAST_LABELLED} THEN 'block' ELSE 'allow' END AS verdict, '/' || array_to_string(g.segs, '/') AS template, purity
FROM g JOIN f ON f.host = g.host AND f.segs = g.segs"""
