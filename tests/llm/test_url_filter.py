from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tests.compare import connect, differences
from tests.llm.data import with_clashes
from tickframe.llm import catalog, url_filter
from tickframe.llm.url_filter import Rule

SCHEMA = "page_id long, url string, html string"
RULES = catalog.URL_RULES
UNIT = url_filter.UNIT


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules=RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def by_brute_force(pages, rules=RULES, damping=0.85, rounds=20, threshold=0.25):
    """{row: (host, path, rule, verdict, trust, distrust)} by dictionaries."""
    own = [(*parts_of(url), html or "") for _, url, html in pages]
    links = Counter()
    for host, _, html in own:
        for target in re.findall(r"""(?i)\bhref[ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:https?:)?//([^/?#"' \t\n\r\f<>]+)""", html):
            if host and host != target.lower():
                links[host, target.lower()] += 1
    size = Counter(h for h, _, _ in own if h)
    scores = {}
    for flow, verdict in (("trust", "allow"), ("distrust", "block")):
        ruled = Counter(h for h, p, _ in own if h and (r := rule_of(h, p, rules)) and r.verdict == verdict)
        seeds = {h: math.floor(n * float(UNIT) / size[h]) for h, n in ruled.items()}
        edges = links if flow == "trust" else {(b, a): n for (a, b), n in links.items()}
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        now = seeds
        for _ in range(rounds):
            new = Counter(seeds)
            for (a, b), n in edges.items():
                if a in now:
                    new[b] += math.floor(now[a] * (n / total[a]) * damping)
            now = new
        scores[flow] = now
    out = []
    for (page_id, _, _), (host, path, _) in zip(pages, own):
        rule = rule_of(host, path, rules)
        trust, distrust = scores["trust"].get(host, 0), scores["distrust"].get(host, 0)
        bad = distrust >= int(threshold * UNIT) and distrust > trust
        out.append((page_id, host, path, rule and rule.name, rule.verdict if rule else "block" if bad else "allow", trust / UNIT, distrust / UNIT))
    return sorted(out, key=repr)


def found(df, **options):
    out = url_filter.judge(df, RULES, **options).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()
    return sorted(map(tuple, out), key=repr)


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "https://a.net", "https://a.net?x=/", "https://a.net/x#y", "http://bexample.net/en/", "http://example.net/en/x",
    "http://b.EXAMPLE.net/en/?q", "http://example.net/en", "http://w.example.com/de/1", "http://w.example.com/en/1", "ftp://x.org/fr/", "http://org/fr/", "//x.org/fr/",
    "http://x.org/fr#/", "http://x.org/FR/", "a://b://c/d", "http://h\u00c9.org/\u00e9?", "http://x.org:80/fr/", "http://x.org/en/" + "y" * 100_000, "http://x\n.org/fr/\nz?q",
]


def test_rules_equal_brute_force(spark):
    pages = [*((k, u, "") for k, u in enumerate(URLS)), (3, URLS[7], None), (None, URLS[7], None)]
    df = with_clashes(spark.createDataFrame(pages, SCHEMA), "host", "path", "rule", "verdict", "trust", "source")
    assert found(df) == by_brute_force(pages)
    assert found(df.limit(0)) == []


def web(seed, n=300, hosts=25):
    """Pages of a few hosts, one with a third of all, that link to each other, most of all to their like."""
    rng = random.Random(seed)
    names = [f"h{k}.{rng.choice(['net', 'org', 'com', 'example.com', 'example.net'])}" for k in range(hosts)]
    out = []
    for k in range(n):
        host = names[0] if k % 3 == 0 else rng.choice(names)
        to = [rng.choice(names) for _ in range(rng.randrange(4))]
        links = "".join(rng.choice([f'<a href="http://{t}/x">', f"<A HREF = //{t.upper()}?y>", f"<a class=q href=' https://{t}'>", f"<a href=/{t}>"]) for t in to)
        out.append((k, f"http://{host}/{rng.choice(['de', 'en', 'fr'])}/{k}", links + " text //a.b"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_brute_force_and_sql(spark, seed):
    pages = web(seed)
    df = spark.createDataFrame(pages, SCHEMA)
    want = by_brute_force(pages)
    assert found(df) == want
    # Hosts without a rule of their own are judged by their links too.
    assert any(rule is None and verdict == "block" for _, _, _, rule, verdict, _, _ in want)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert differences(url_filter.judge(df, RULES).toPandas(), con.execute(url_filter.oracle_sql(RULES)).df()) == []


def test_distrust_flows_against_links_and_trust_along_them(spark):
    rules = [Rule("block", "bad.net", "/"), Rule("allow", "good.org", "/")]
    pages = [
        (1, "http://bad.net/", "<a href='//victim.com/'>"), (2, "http://farm.com/", "<a href='//bad.net/'>" * 9), (3, "http://good.org/", "<a href='//friend.com/'>"),
        (4, "http://victim.com/", ""), (5, "http://friend.com/", "<a href='//bad.net/'>"), (6, "http://other.com/", "<a href='//farm.com/'>"),
    ]
    out = {r.host: r for r in url_filter.judge(spark.createDataFrame(pages, SCHEMA), rules).collect()}
    assert out["farm.com"].verdict == out["other.com"].verdict == "block"
    assert out["victim.com"].verdict == out["friend.com"].verdict == "allow"
    assert out["friend.com"].trust == pytest.approx(0.85) and out["friend.com"].distrust == pytest.approx(0.085)
    assert out["farm.com"].distrust == pytest.approx(0.765) and out["victim.com"].distrust == 0


def test_whole_table_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    theirs = connect(sf_dir).execute(catalog.ORACLE_SQL["op12_url_filter"]).df()
    assert len(theirs) and differences(catalog.QUERIES["op12_url_filter"](spark, sf_dir).toPandas(), theirs) == []
