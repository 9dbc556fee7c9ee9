"""URL verdicts by rules, and by trust that spreads over the links between hosts.

A url with a fitting rule gets the verdict of the longest one.  The rest is judged by host:
personalised PageRank carries trust from hosts with allowed pages along their links, and distrust
from hosts with blocked pages against the direction of links, to those who link to them.  A host
starts with the share of its pages that rules allow (trust) or block (distrust); a host is blocked
whose distrust reaches the threshold and exceeds its trust.

Scores only grow from step to step, and what is still to come shrinks: as the shares of a giver sum to
one at most, all changes together fall to ``DAMPING`` of the last ones in each step.  So after a step a
host's distance from its final score has a bound, and the steps end when no host's verdict can
change any more, however long that takes; hosts that nobody gives to are final at once.  A host whose
verdict hangs on a tie is left when the bound is a billionth of all that the hosts start with.

Everything is joins and sums over (host, host) edges that are counted before they are shuffled.  A
host with a great share of all links is one row for each linked host in the edge table; sums are
partly made before the shuffle and joins are left to adaptive skew handling.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is
allowed, as is any host without evidence; repeated rows are judged each, null ids too; links without
a host of their own and links of a host to itself are no edges.  Of rules of one length the later one
in the list counts.  Pages of any size are read whole, for their links; no pages give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.llm.scratch import settle

DAMPING = 0.85
STEPS_AT_ONCE = 5  # steps in one plan, before its rows are written and read back
UNCHANGED = 1e-9  # part of the sum of all starting scores that counts as nothing
KINDS = ("trust", "distrust")
BLOCK_FROM = 0.5  # distrust of a host, where 1 is a host with nothing but blocked pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[Rule], value: str) -> Column:
    """The given part (``rule`` or ``verdict``) of the longest rule that fits host and path."""
    found = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda rule: len(rule[1] + rule[2])):
        fits = (
            (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        ) & F.startswith(F.col("path"), F.lit(path))
        found = F.when(fits, F.lit(f"{host}{path}" if value == "rule" else verdict)).otherwise(
            found
        )
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and ``pages``: how many pages of one host link to another host."""
    linked = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.regexp_extract_all("html", F.lit(LINK), F.lit(1)),
                    lambda host: F.translate(host, UPPER, LOWER),
                )
            )
        ).alias("dst"),
    )
    return (
        linked.filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("pages"))
    )


def directed(edges: DataFrame) -> DataFrame:
    """``kind``, ``giver``, ``taker`` and ``share``: what part of its score a host gives to whom.

    Trust goes from the linking host to the linked one, distrust the other way.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "pages").toDF(
        "kind", "giver", "taker", "pages"
    ).unionAll(
        edges.select(F.lit("distrust").alias("kind"), "dst", "src", "pages").toDF(
            "kind", "giver", "taker", "pages"
        )
    )
    totals = both.groupBy("kind", "giver").agg(F.sum("pages").alias("total"))
    return both.join(totals, ["kind", "giver"]).select(
        "kind", "giver", "taker", (F.col("pages") / F.col("total")).alias("share")
    )


def step(scores: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """One step: what a host starts with, and the damped shares that others give to it."""
    given = scores.join(links.withColumnRenamed("giver", "host"), ["kind", "host"]).select(
        "kind", F.col("taker").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score")
    )
    return seeds.unionAll(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def trust_sums(scores: DataFrame) -> DataFrame:
    """A row for each host with its ``trust`` and ``distrust``."""
    return scores.groupBy("host").agg(
        *[
            F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
            for kind in KINDS
        ]
    )


def is_blocked(distrust: Column, trust: Column) -> Column:
    return (distrust >= BLOCK_FROM) & (distrust > trust)


def undecided(scores: DataFrame, takers: DataFrame, left: dict[str, float]) -> bool:
    """Whether the verdict of a host can change, if each score may still grow by what is ``left``.

    Only hosts that take from others grow; one without a score yet may reach the threshold too.
    """
    if left["distrust"] >= BLOCK_FROM:
        return True
    hosts = trust_sums(scores).join(takers, "host")
    most = {k: F.col(k) + F.when(F.col(f"takes_{k}"), left[k]).otherwise(0.0) for k in KINDS}
    surely = is_blocked(F.col("distrust"), most["trust"])
    possibly = is_blocked(most["distrust"], F.col("trust"))
    return not hosts.filter(possibly & ~surely).isEmpty()


def spread(seeds: DataFrame, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """``kind``, ``host`` and ``score`` after so many steps, or when no verdict can change any more."""
    links = settle(directed(edges), "links")
    seeds = settle(seeds, "seeds")
    takers = links.groupBy(F.col("taker").alias("host")).agg(
        *[F.max(F.col("kind") == kind).alias(f"takes_{kind}") for kind in KINDS]
    )
    takers = settle(takers, "takers")
    sums = {row.kind: row.total for row in seeds.groupBy("kind").agg(F.sum("score").alias("total")).collect()}
    nothing = UNCHANGED * max(sums.values(), default=0.0)
    # After so many steps what is left is below that for certain, whatever rounding does to the sums.
    enough = math.ceil(math.log(UNCHANGED * (1 - DAMPING)) / math.log(DAMPING))
    scores, done, wanted = seeds, 0, enough if steps is None else steps
    while done < wanted:
        now = min(STEPS_AT_ONCE, wanted - done)
        before, after = scores, scores
        for _ in range(now):
            before, after = after, step(after, links, seeds)
        done += now
        last = before.select("kind", "host", F.col("score").alias("old"))
        grown = settle(
            after.join(last, ["kind", "host"], "left").select(
                "kind", "host", "score", (F.col("score") - F.coalesce("old", F.lit(0.0))).alias("change")
            ),
            "trust",
        )
        scores = grown.drop("change")
        changes = grown.groupBy("kind").agg(F.sum(F.abs("change")).alias("total")).collect()
        left = dict.fromkeys(KINDS, 0.0) | {
            row.kind: row.total * DAMPING / (1 - DAMPING) for row in changes
        }
        if max(left.values()) <= nothing:
            break
        if steps is None and not undecided(scores, takers, left):
            break
    return scores


def judge(pages: DataFrame, rules: list[Rule], steps: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page."""
    ruled = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    ruled = ruled.withColumns(
        {"rule": fitting_rule(rules, "rule"), "by_rule": fitting_rule(rules, "verdict")}
    )
    start = (
        ruled.filter(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("by_rule") == "allow", 1)).alias("n_allow"),
            F.count(F.when(F.col("by_rule") == "block", 1)).alias("n_block"),
        )
        .select(
            "host",
            F.explode(
                F.create_map(
                    F.lit("trust"), F.col("n_allow") / F.col("n"),
                    F.lit("distrust"), F.col("n_block") / F.col("n"),
                )
            ).alias("kind", "score"),
        )
        .filter(F.col("score") > 0)
        .select("kind", "host", "score")
    )
    scores = spread(start, host_edges(pages), steps)
    blocked = trust_sums(scores).filter(is_blocked(F.col("distrust"), F.col("trust"))).select(
        "host", F.lit("block").alias("by_links")
    )
    return ruled.join(blocked, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", "by_links", F.lit("allow")).alias("verdict"),
    )


def oracle(rules: list[Rule], terms: int = 200) -> str:
    """The same rows in DuckDB SQL: the final scores as the sum of what paths of each length bring.

    The paths end where the longest of them bring less than 0.85 ** 200, that is 1e-14 of a host.
    """

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def fitting(value: str) -> str:
        cases = "".join(
            f" WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND "
            f"starts_with(path, {quoted(p)}) THEN {quoted(h + p if value == 'rule' else v)}"
            for v, h, p in sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))
        )
        return f"CASE{cases} END"

    low = f"{quoted(UPPER)}, {quoted(LOWER)}"
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {low}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {fitting('rule')} AS rule, {fitting('verdict')} AS by_rule FROM parts),
shares AS (SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) AS trust,
    count(*) FILTER (by_rule = 'block') / count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
start AS (SELECT 'trust' AS kind, host, trust AS score FROM shares WHERE trust > 0
    UNION ALL SELECT 'distrust', host, distrust FROM shares WHERE distrust > 0),
linked AS (SELECT DISTINCT page_id, host AS src, translate(target, {low}) AS dst FROM (SELECT page_id,
    host, unnest(regexp_extract_all(html, {quoted(LINK)}, 1)) AS target FROM parts)),
edges AS (SELECT src, dst, count(*) AS pages FROM linked WHERE src <> dst AND src <> '' GROUP BY src, dst),
links AS (SELECT 'trust' AS kind, src AS giver, dst AS taker,
        pages / sum(pages) OVER (PARTITION BY src) AS share FROM edges
    UNION ALL SELECT 'distrust', dst, src, pages / sum(pages) OVER (PARTITION BY dst) FROM edges),
paths AS (SELECT 0 AS n, kind, host, score FROM start UNION ALL
    SELECT p.n + 1, l.kind, l.taker, sum({DAMPING} * p.score * l.share) FROM paths p
    JOIN links l ON p.kind = l.kind AND p.host = l.giver WHERE p.n < {terms} GROUP BY ALL),
blocked AS (SELECT host FROM paths GROUP BY host
    HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) >= {BLOCK_FROM}
    AND sum(CASE WHEN kind = 'distrust' THEN score ELSE -score END) > 0)
SELECT page_id, r.host, path, rule,
    coalesce(by_rule, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN blocked b ON r.host = b.host"""
