"""URL filters: rules first, and for what no rule names, trust and distrust along the links between hosts.

A rule is a host and the begin of a path. It fits a url whose host is the
rule's or below it and whose path starts with the rule's; the longest rule that
fits decides.

Hosts that rules decide are the seeds: a host's trust seed is the share of its
pages that rules allow, its distrust seed the share that they block. Links
between hosts are counted from the pages. Trust flows along links: personalised
PageRank from the trust seeds, a host's score going to the hosts it links to in
proportion to the links. Distrust flows against them: a host that links to
distrusted ones gets a share of their score, in proportion to its part of the
links to them. Scores are not normalised, so a seed of 1 without neighbours
scores 1. A host is blocked if its distrust reaches ``threshold`` and exceeds
its trust; other hosts are allowed.

Both flows are rounds of one join of edges with scores, one sum by host, until
no score changes or ``rounds`` are over. Scores are whole millionths of
millionths, rounded down at every edge, so sums do not depend on task order.
Links and pages are counted before they are shuffled: a host with a third of all
pages, or linked from all hosts, is a row a task.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z in lower case. Path: from there up to ``?``, ``#`` or the end. A null url,
or one without ``://``, has an empty host and path and no rule; the empty host
is in no link graph and allowed. Links are ``href`` values with a host; links
inside a host do not count. Null and empty pages have no links; long ones are
read whole. Repeated rows count each. An empty table gives an empty table. Other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.shared import tidy, written

DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.25
#: Scores are whole numbers of this part of a seed.
UNIT = 10**12

# The capital letters that hosts are lower-cased by.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ALLOW, BLOCK = "allow", "block"

_SPACE = "[ \\t\\n\\r\\f]"
_HREF = rf"""(?i)\bhref{_SPACE}*={_SPACE}*+["']?{_SPACE}*(?:https?:)?//([^/?#"' \t\n\r\f<>]+)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` on the urls of ``host`` and all hosts below it whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
    return own & F.startswith(path, F.lit(rule.path))


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls; of equally long ones the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = _fits(rule, host, path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def judged_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``rule_verdict``."""
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return parts.withColumns({"rule": name, "rule_verdict": verdict})


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``source, target, n``: the links between different hosts; ``pages`` has ``host``."""
    found = pages.where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1))).alias("target")
    )
    pairs = found.select("source", lower(F.col("target")).alias("target")).where("source <> target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def _shares(links: DataFrame, source: str, target: str, flow: str) -> DataFrame:
    """Edges of one flow, with the part of a host's score that goes along each."""
    total = links.groupBy(source).agg(F.sum("n").alias("total"))
    return links.join(total, source).select(
        F.lit(flow).alias("flow"), F.col(source).alias("origin"), F.col(target).alias("host"), (F.col("n") / F.col("total")).alias("share")
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``flow, host, score``: trust along the links and distrust against them.

    ``links`` has ``source, target, n``; ``seeds`` has ``flow`` (``trust`` or ``distrust``), ``host`` and ``score`` in UNIT parts.
    """
    links = written(links)
    edges = written(_shares(links, "source", "target", "trust").unionByName(_shares(links, "target", "source", "distrust")))
    seeds = written(seeds.select("flow", "host", F.col("score").cast("long").alias("score")))
    scores, state = seeds, None
    for _ in range(rounds):
        sent = F.floor(F.col("score") * F.col("share") * F.lit(damping)).cast("long")
        passed = edges.join(scores.withColumnRenamed("host", "origin"), ["flow", "origin"]).select("flow", "host", sent.alias("score"))
        scores = written(seeds.unionByName(passed).groupBy("flow", "host").agg(F.sum("score").alias("score")))
        now = tuple(scores.agg(F.count("*"), F.sum(F.xxhash64("flow", "host", "score").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return scores


@tidy
def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``."""
    own = judged_urls(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), rules)
    by_verdict = {"trust": ALLOW, "distrust": BLOCK}
    counts = own.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("rule_verdict") == v, 1)).alias(flow) for flow, v in by_verdict.items()]
    )
    each = F.explode(F.array(*[F.struct(F.lit(flow).alias("flow"), F.col(flow).alias("pages")) for flow in by_verdict]))
    seeds = counts.select("host", "n", each.alias("seed")).where("seed.pages > 0")
    seeds = seeds.select(F.col("seed.flow").alias("flow"), "host", F.floor(F.col("seed.pages") * F.lit(float(UNIT)) / F.col("n")).alias("score"))
    scores = propagate(host_links(own), seeds, damping, rounds)
    by_host = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("score"))), F.lit(0)).alias(f) for f in by_verdict])
    found = own.drop("url", "html").join(written(by_host), "host", "left").fillna(0, list(by_verdict))
    bad = (F.col("distrust") >= int(threshold * UNIT)) & (F.col("distrust") > F.col("trust"))
    return found.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"),
        (F.col("trust") / UNIT).alias("trust"), (F.col("distrust") / UNIT).alias("distrust"),
    )


def oracle_sql(rules: Sequence[Rule], damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same verdicts on ``pages`` as DuckDB SQL, the rounds one after the other."""

    def longest(value: str) -> str:
        cases = "".join(
            f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
            for r in sorted(rules, key=lambda r: -len(r.name))
        )
        return f"CASE{cases} END"

    def passed(before: str) -> str:
        return f"""
            SELECT flow, host, sum(score)::BIGINT AS score FROM (
                SELECT flow, host, score FROM seeds
                UNION ALL
                SELECT e.flow, e.host, floor(s.score * e.share * {damping!r}::DOUBLE)::BIGINT FROM edges e JOIN {before} s ON s.flow = e.flow AND s.host = e.origin
            ) GROUP BY flow, host"""

    def shares(flow: str, origin: str, host: str) -> str:
        return f"SELECT '{flow}' AS flow, {origin} AS origin, {host} AS host, n::DOUBLE / sum(n) OVER (PARTITION BY {origin}) AS share FROM links"

    steps = ",".join(f"\n        scores_{k} AS MATERIALIZED ({passed('seeds' if k == 0 else f'scores_{k - 1}')})" for k in range(rounds))
    href = _HREF.replace("*+", "*").replace("'", "''")
    return f"""
    WITH own AS MATERIALIZED (
            SELECT *, {longest('name')} AS rule, {longest('verdict')} AS rule_verdict FROM (
                SELECT page_id, html,
                    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
                    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
                FROM pages)
        ),
        links AS MATERIALIZED (
            SELECT source, target, count(*) AS n FROM (
                SELECT host AS source, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{UPPER}', '{LOWER}') AS target FROM own WHERE host <> '')
            WHERE source <> target GROUP BY source, target
        ),
        edges AS MATERIALIZED ({shares('trust', 'source', 'target')} UNION ALL {shares('distrust', 'target', 'source')}),
        counts AS (
            SELECT host, count(*) AS n, count(*) FILTER (rule_verdict = '{ALLOW}') AS trust, count(*) FILTER (rule_verdict = '{BLOCK}') AS distrust
            FROM own WHERE host <> '' GROUP BY host
        ),
        seeds AS MATERIALIZED (
            SELECT 'trust' AS flow, host, floor(trust * {float(UNIT)!r}::DOUBLE / n)::BIGINT AS score FROM counts WHERE trust > 0
            UNION ALL
            SELECT 'distrust', host, floor(distrust * {float(UNIT)!r}::DOUBLE / n)::BIGINT FROM counts WHERE distrust > 0
        ),{steps},
        by_host AS (
            SELECT host, coalesce(sum(score) FILTER (flow = 'trust'), 0)::BIGINT AS trust, coalesce(sum(score) FILTER (flow = 'distrust'), 0)::BIGINT AS distrust
            FROM {f'scores_{rounds - 1}' if rounds else 'seeds'} GROUP BY host
        ),
        joined AS (
            SELECT page_id, own.host, path, rule, rule_verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
            FROM own LEFT JOIN by_host ON by_host.host = own.host
        )
    SELECT page_id, host, path, rule,
        coalesce(rule_verdict, CASE WHEN distrust >= {int(threshold * UNIT)} AND distrust > trust THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict,
        trust / {float(UNIT)!r}::DOUBLE AS trust, distrust / {float(UNIT)!r}::DOUBLE AS distrust
    FROM joined
    """
