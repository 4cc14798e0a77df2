"""Path templates against their SQL, plain rules, and made hosts."""

from __future__ import annotations

import random

import duckdb
import pytest

from tierdown.llm.path_templates import LEAST_CHILDREN, RULES, SQL, judged_urls

COLUMNS = ("page_id", "host", "path", "rule", "verdict", "template", "share")


def pages(spark, urls):
    rows = [(i, u, "a/b", 3) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, path string, blocked int")


def judged(spark, urls):
    return sorted((tuple(r) for r in judged_urls(pages(spark, urls)).select(*COLUMNS).collect()), key=lambda r: r[0])


def split(url):
    """Host and path by plain string operations."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def longest_rule(host, path):
    found = None
    for verdict, rule in RULES:
        name, below = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below):
            if found is None or len(rule) > len(found[1]):
                found = verdict, rule
    return found


ODD = [
    None, "", "no scheme", "http://", "://x.org/a", "http://X.Example.ORG/es/1", "http://example.org/en/12?q=/es/", "http://badexample.org/es/1",
    "http://org/", "http://a.com/de", "http://a.com/de/", "http://com/fr/x", "http://b.com?x://y/fr/", "http://b.com#/de/", "http://\u00c4.com/de/\u00c4",
    "a\nb://c.org/d\ne", "http://x.net/" + "s/" * 3000, "http://x.net/" + "9" * 50_000, "http://u:p@h.com:80/de/1", "x://y://z.com/de/",
]


def made(seed=5, n=600):
    rng = random.Random(seed)
    hosts = ["a.example.org", "shop.com", "news.com", "x.net", "Y.NET", "z.edu"]
    parts = ["de", "fr", "en", "es", "item", "12", "345", "tag", "", "about.html"]
    return [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(n)]


@pytest.mark.parametrize("urls", [ODD, ODD * 3 + made() * 2 + [f"http://h.net/{k}/x" for k in range(50)]])
def test_verdicts_equal_sql_and_plain_rules(spark, tmp_path, urls):
    found = judged(spark, urls)
    assert len(found) == len(urls)
    for row, url in zip(found, urls):
        rule = longest_rule(*split(url))
        assert row[1:3] == split(url)
        assert row[3] == (rule[1] if rule else None)
        assert row[4] == rule[0] if rule else row[4] in ("allow", "block")
    pages(spark, urls).coalesce(1).write.parquet(f"{tmp_path}/pages")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    expected = sorted(connection.execute(SQL).fetchall(), key=lambda r: r[0])
    assert [r[:6] for r in found] == [r[:6] for r in expected]
    assert [r[6] for r in found] == pytest.approx([r[6] for r in expected], abs=1e-12)


def test_numbers_and_many_unlike_children_are_wildcards(spark):
    many = [f"http://h.net/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/home" for k in range(2 * LEAST_CHILDREN)]
    few = ["http://h.net/blog/2024/page-7", "http://h.net/blog/2023/page-12"]
    templates = {r[5] for r in judged(spark, many)}
    assert templates == {"/user/*/home"}
    assert {r[5] for r in judged(spark, few)} == {"/blog/{n}/page-{n}"}


def test_alike_branches_merge_and_others_do_not(spark):
    alike = [f"http://h.net/{lang}/{leaf}" for lang in ("de", "fr") for leaf in ("a", "b", "c") for _ in range(5)]
    other = [f"http://h.net/shop/{leaf}" for leaf in ("cart", "pay") for _ in range(5)]
    found = {r[2]: r[5] for r in judged(spark, alike + other)}
    # leaves beside each other have the same below them: nothing
    assert {found[f"/{lang}/{leaf}"] for lang in ("de", "fr") for leaf in ("a", "b", "c")} == {"/*/*"}
    assert found["/shop/cart"] == found["/shop/pay"] == "/shop/*"


def test_templates_carry_labels_to_hosts_without_rules(spark):
    """A branch that rules block on one host is judged by that elsewhere; one they allow too."""
    known = [f"http://one.com/{lang}/{k}" for lang in ("de", "fr") for k in range(40)]
    unknown = [f"http://two.net/{lang}/{k}" for lang in ("de", "fr") for k in range(40)]
    found = judged(spark, known + unknown)
    assert {(r[2][:4], r[4]) for r in found if r[1] == "two.net"} == {("/de/", "block"), ("/fr/", "allow")}
    assert all(r[3] is None for r in found if r[1] == "two.net")


def test_nothing_labelled_allows_all_and_no_rows(spark):
    assert {r[4] for r in judged(spark, ["http://h.net/a", "http://g.edu/b", None])} == {"allow"}
    assert judged_urls(pages(spark, ["x"]).limit(0)).count() == 0


def test_one_host_may_hold_a_third_of_all_rows(spark):
    urls = ["http://hot.com/de/1"] * 2000 + [f"http://h{k}.com/fr/{k}" for k in range(1000)] + ["http://hot.com/x/y"] * 1000
    found = judged(spark, urls)
    assert len(found) == 4000 and {r[4] for r in found[:2000]} == {"block"} and {r[4] for r in found[2000:3000]} == {"allow"}
