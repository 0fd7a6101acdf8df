"""URL filter: host and path rules, and a tree of path templates per host.

Numbers in a segment become a wildcard, and so do segments of which a node has
many for its pages. Sibling branches whose share of blocked pages does not
differ are merged. A template is rejected by its share of blocked pages among
the labelled ones, smoothed by the purity of its parent: from the whole table
over the host down the tree, so a branch without labels has the purity of its
nearest labelled ancestor. A node grows branches as long as it has both pages
with labels and pages without. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import join_counted, stored

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: Levels that the SQL spells out; the tree itself has no such bound.
SQL_LEVELS = 6
#: A node's segments vary if it has more than this many, and this many per page.
MANY, PER_PAGE = 16, 0.25
#: Squared deviation, in standard errors, from which a branch differs from its node.
DIFFERS = 4.0
#: Pages that the prior counts for, and the share from which a template is rejected.
PRIOR_PAGES, REJECTED = 4.0, 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host, and the path up to a query or fragment; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does.

    Rules are a short list of the caller's: each is a test in the expression.
    """
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    The longest rule that fits decides. Where none does, the page's template
    decides: rejected if its purity, ``(blocked + PRIOR_PAGES * p) / (labelled +
    PRIOR_PAGES)``, is at least :data:`REJECTED`. Labels are the verdicts of the
    rules on the pages at and below the template, and ``p`` is the purity of its
    parent: the node above, then the host, then the blocked share of all
    labelled pages. Below a node whose pages all have a rule, or none, nothing
    can be told apart, and the rest of the path is one wildcard ``/**``. A null
    url, or one without ``://``, has an empty host and path and a template of
    its own. Repeated rows weigh as often as they occur, null ids are rows like
    others, an empty table gives an empty result, other columns are ignored.

    The tree is built on distinct paths, level by level. A hot host is counted
    by partial aggregation, and joined back by counted keys.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    paths = (
        rows.groupBy("host", "path")
        .agg(F.count("*").alias("pages"), F.first("ruled").alias("ruled"))
        .select(
            "host",
            "path",
            "pages",
            F.when(F.col("ruled").isNotNull(), F.col("pages")).otherwise(0).alias("labelled"),
            F.when(F.col("ruled") == BLOCK, F.col("pages")).otherwise(0).alias("blocked"),
            F.filter(F.split("path", "/"), lambda x: x != "").alias("segments"),
        )
    )
    paths = stored(paths, "paths")
    sums = paths.agg(
        F.sum("pages").alias("pages"),
        F.sum("labelled").alias("labelled"),
        F.sum("blocked").alias("blocked"),
        F.count("*").alias("paths"),
    ).first()
    overall = ((sums["blocked"] or 0) + 1.0) / ((sums["labelled"] or 0) + 2.0)
    hosts = paths.groupBy("host").agg(
        F.sum("pages").alias("n_pages"),
        F.sum("labelled").alias("n_labelled"),
        F.sum("blocked").alias("n_blocked"),
        F.count("*").alias("of_host"),
    )
    hosts = stored(
        hosts.select("host", "of_host", purity(F.lit(overall)).alias("purity"), mixed()), "hosts"
    )
    going = join_counted(paths, hosts, "host", "of_host", sums["paths"]).select(
        *paths.columns, F.lit("").alias("template"), "purity", "mixed"
    )
    settled, level = None, 0
    while True:
        more = F.size("segments") > level
        on = F.col("mixed") & more
        rest = F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        ended = going.filter(~on).withColumn("template", rest)
        settled = ended if settled is None else settled.unionByName(ended)
        going = going.filter(on)
        if going.isEmpty():
            break
        going = stored(_next_level(going, level, sums["paths"]), f"level-{level}")
        level += 1

    judged = settled.select(
        F.struct("host", "path").alias("page"), F.col("pages").alias("of_path"), "template",
        "purity",
    )
    found = join_counted(
        rows.withColumn("page", F.struct("host", "path")),
        stored(judged, "judged"),
        "page",
        "of_path",
        sums["pages"] or 0,
    )
    learned = F.when(F.col("purity") >= REJECTED, BLOCK).otherwise(ALLOW)
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", learned).alias("verdict"),
        "template",
        "purity",
    )


def purity(above: Column) -> Column:
    """Blocked share of a node's labelled pages, smoothed by the purity above it."""
    return (F.col("n_blocked") + PRIOR_PAGES * above) / (F.col("n_labelled") + PRIOR_PAGES)


def mixed() -> Column:
    """Whether a node has both pages with labels and pages without."""
    labelled = F.col("n_labelled")
    return ((labelled > 0) & (labelled < F.col("n_pages"))).alias("mixed")


def _next_level(paths: DataFrame, level: int, total: int) -> DataFrame:
    """``paths`` with the branch of this level added to their template, and its purity."""
    segment = F.regexp_replace(F.get("segments", F.lit(level)), "[0-9]+", "{n}")
    at = F.struct("host", "template", "branch")
    grown = paths.withColumn("branch", segment)
    branches = grown.groupBy("host", "template", "branch").agg(
        F.sum("pages").alias("pages"),
        F.sum("labelled").alias("labelled"),
        F.sum("blocked").alias("blocked"),
        F.count("*").alias("of_branch"),
        # One value: that of the node.
        F.first("purity").alias("above"),
    )
    branches = stored(branches, f"branches-{level}")
    nodes = branches.groupBy("host", "template").agg(
        F.count("*").alias("n_branches"),
        F.sum("pages").alias("n_pages"),
        F.sum("labelled").alias("n_labelled"),
        F.sum("blocked").alias("n_blocked"),
    )
    node = F.struct("host", "template")
    both = join_counted(
        branches.withColumn("node", node),
        nodes.select(node.alias("node"), "n_branches", "n_pages", "n_labelled", "n_blocked"),
        "node",
        "n_branches",
        total,
    )
    rate = (F.col("n_blocked") + 1.0) / (F.col("n_labelled") + 2.0)
    usual = F.col("labelled") * rate
    apart = (F.col("blocked") - usual) * (F.col("blocked") - usual) > DIFFERS * usual * (1 - rate)
    varies = (F.col("n_branches") > MANY) & (F.col("n_branches") > F.col("n_pages") * PER_PAGE)
    kind = (
        F.when(varies, "*")
        .when(F.col("labelled") == 0, "{unlabelled}")
        .when(~apart, "{usual}")
        .when(F.col("blocked") > usual, "{blocked}")
        .otherwise("{allowed}")
    )
    both = both.withColumn("kind", kind)
    # A branch that is alone in its kind keeps its name; the others become one node.
    kinds = both.groupBy("host", "template", "kind").agg(
        F.count("*").alias("in_kind"),
        F.min("branch").alias("only"),
        F.sum("pages").alias("n_pages"),
        F.sum("labelled").alias("n_labelled"),
        F.sum("blocked").alias("n_blocked"),
        F.first("above").alias("above"),
    )
    alone = (F.col("in_kind") == 1) & (F.col("kind") != "*")
    kinds = kinds.select(
        F.struct("host", "template", "kind").alias("key"),
        "in_kind",
        F.when(alone, F.col("only")).otherwise(F.col("kind")).alias("name"),
        purity(F.col("above")).alias("purity"),
        mixed(),
    )
    named = join_counted(
        both.select(
            F.struct("host", "template", "kind").alias("key"), at.alias("at"), "of_branch"
        ),
        kinds,
        "key",
        "in_kind",
        total,
    ).select("at", "of_branch", "name", "purity", "mixed")
    columns = paths.columns
    going = join_counted(
        grown.drop("purity", "mixed").withColumn("at", at),
        stored(named, f"named-{level}"),
        "at",
        "of_branch",
        total,
    ).withColumn("template", F.concat("template", F.lit("/"), "name"))
    return going.select(*columns)


def sql(rules=RULES, depth: int = SQL_LEVELS) -> str:
    """The same result in DuckDB, for trees of at most ``depth`` levels."""
    names, says = "NULL", "NULL"
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = (
            f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        )
        names = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {names} END"
        says = f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    levels = []
    for i in range(depth):
        levels.append(f"""
l{i}_grown AS (
  SELECT *, regexp_replace(segments[{i + 1}], '[0-9]+', '{{n}}', 'g') AS branch
  FROM t{i} WHERE mixed AND len(segments) > {i}
), l{i}_branches AS (
  SELECT host, template, branch, sum(pages) AS pages, sum(labelled) AS labelled,
         sum(blocked) AS blocked, any_value(purity) AS above
  FROM l{i}_grown GROUP BY ALL
), l{i}_nodes AS (
  SELECT host, template, count(*) AS n_branches, sum(pages) AS n_pages,
         (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS rate
  FROM l{i}_branches GROUP BY host, template
), l{i}_kinds AS (
  SELECT b.*,
         CASE WHEN n_branches > {MANY} AND n_branches > n_pages * {PER_PAGE}::DOUBLE THEN '*'
              WHEN labelled = 0 THEN '{{unlabelled}}'
              WHEN NOT ((blocked - labelled * rate) * (blocked - labelled * rate)
                        > {DIFFERS}::DOUBLE * (labelled * rate) * (1 - rate)) THEN '{{usual}}'
              WHEN blocked > labelled * rate THEN '{{blocked}}'
              ELSE '{{allowed}}' END AS kind
  FROM l{i}_branches b JOIN l{i}_nodes USING (host, template)
), l{i}_named AS (
  SELECT host, template, branch,
         CASE WHEN kind <> '*' AND count(*) OVER k = 1 THEN branch ELSE kind END AS name,
         (sum(blocked) OVER k + {PRIOR_PAGES}::DOUBLE * above)
           / (sum(labelled) OVER k + {PRIOR_PAGES}::DOUBLE) AS purity,
         sum(labelled) OVER k > 0 AND sum(labelled) OVER k < sum(pages) OVER k AS mixed
  FROM l{i}_kinds WINDOW k AS (PARTITION BY host, template, kind)
), t{i + 1} AS (
  SELECT g.host, path, pages, labelled, blocked, segments,
         g.template || '/' || name AS template, n.purity, n.mixed
  FROM l{i}_grown g JOIN l{i}_named n
    ON g.host = n.host AND g.template = n.template AND g.branch = n.branch
),""")
    ends = " UNION ALL ".join(
        f"""
  SELECT host, path, CASE WHEN len(segments) > {i} THEN template || '/**' ELSE template END
         AS template, purity FROM t{i} WHERE NOT (mixed AND len(segments) > {i}) OR {i} = {depth}"""
        for i in range(depth + 1)
    )
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3)
                       ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, {names} AS rule, {says} AS ruled FROM split
), paths AS (
  SELECT host, path, count(*) AS pages,
         CASE WHEN any_value(ruled) IS NULL THEN 0 ELSE count(*) END AS labelled,
         CASE WHEN any_value(ruled) = '{BLOCK}' THEN count(*) ELSE 0 END AS blocked,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segments
  FROM ruled GROUP BY host, path
), overall AS (
  SELECT (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS share FROM paths
), t0 AS (
  SELECT host, path, pages, labelled, blocked, segments, '' AS template,
         (sum(blocked) OVER h + {PRIOR_PAGES}::DOUBLE * share)
           / (sum(labelled) OVER h + {PRIOR_PAGES}::DOUBLE) AS purity,
         sum(labelled) OVER h > 0 AND sum(labelled) OVER h < sum(pages) OVER h AS mixed
  FROM paths, overall WINDOW h AS (PARTITION BY host)
),{''.join(levels)}
done AS ({ends}
)
SELECT page_id, r.host, r.path, rule,
       coalesce(ruled, CASE WHEN purity >= {REJECTED} THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict,
       d.template, purity
FROM ruled r JOIN done d ON r.host = d.host AND r.path = d.path
"""
