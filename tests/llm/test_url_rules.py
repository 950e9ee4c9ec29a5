import random
import re

import pytest

from transit_spark.llm import url_rules
from transit_spark.llm.queries_pages import RULES
from transit_spark.llm.url_rules import UrlRule, addressed, judge_urls, rule_index, rule_table, site_rule

KIND = "page_id long, url string, token string, host string, salt string, best string"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "t", "h", "s", "b") for k, u in urls], KIND).repartition(3)


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute(urls, rules):
    """Every rule is run over every url."""
    out = []
    for k, url in urls:
        host, path = cut(url)
        fitting = [r for r in rules if re.search(r.regex(), host + path)] if host + path else []
        best = min(fitting, key=lambda r: (r.tier, -len(r.body), r.action != "block", r.body), default=None)
        out.append((k, host, path, best and best.tier, best and best.body, best and best.action))
    return sorted(out, key=str)


def some_urls():
    rng = random.Random(5)
    hosts = ["Example.com", "www.example.com", "a.www.EXAMPLE.com", "notexample.com", "x.net", "net", "com", "cheap-pills.example.org"]
    hosts += ["blog.casino-win.example.net", "pills.example.org", "example.com:80", "user@example.com", "münchen.example.net", "ads.tracker.org"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/en/a/b", "/es/x?u=/en/", "/fr/#/en/", "?x=/en/", "#/en/", "/a-pills.html", "/english/", "/es/\nz"]
    urls = [(k, rng.choice(["http://", "https://", "//x://", "://"]) + rng.choice(hosts) + rng.choice(paths)) for k in range(300)]
    urls += [(400, None), (401, ""), (402, "example.com/en/"), (403, "http://"), (None, "http://x.net/es/1"), (7, "http://x.net/es/1"), (7, "http://x.net/es/1")]
    return urls


def test_addresses(spark, rows):
    urls = some_urls()
    assert rows(addressed(pages(spark, urls))) == sorted(((k, *cut(u)) for k, u in urls), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("broadcast", [True, False])
def test_verdicts_equal_running_every_rule(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    urls = some_urls()
    # ties, a rule without a token, wild cards, a rule given twice, a path that ends inside a word
    more = (UrlRule("block", "b.com/"), UrlRule("allow", "com/en", 1), UrlRule("block", "com/en", 1), UrlRule("block", "xample*m/e*/"))
    rules = (*RULES, *more, more[0], UrlRule("allow", "é"), UrlRule("block", "||x.net/es/"), site_rule("block", "net", "/e"))
    found = judge_urls(pages(spark, urls), rule_table(spark, rules))
    assert found.columns == ["doc_id", "host", "path", "tier", "name", "action"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(urls, rules)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_are_filed_under_their_rarest_token(spark, rows):
    urls = [(k, f"http://a.example.com/en/{k}") for k in range(5)] + [(9, "http://b.example.net/es/")]
    rules = rule_table(spark, [site_rule("block", "example.com", "/en/"), site_rule("block", "example.net", "/en/"), UrlRule("block", "bad")])
    index = rule_index(addressed(pages(spark, urls)).select("host", "path"), rules)
    assert rows(index, "name", "token") == [("bad", ""), ("example.com/en/", "com"), ("example.net/en/", "net")]


def test_tokens_are_whole_runs():
    assert site_rule("block", "example.com", "/en").tokens() == ["com", "example"]
    assert UrlRule("block", "a.b/c").tokens() == ["b"]
    assert UrlRule("block", "||ads*.x-y*").tokens() == ["x"]


def test_empty(spark):
    assert judge_urls(pages(spark, []), rule_table(spark, RULES)).count() == 0
    found = judge_urls(pages(spark, [(1, "http://x.net/es/")]), rule_table(spark, []))
    assert [tuple(r) for r in found.collect()] == [(1, "x.net", "/es/", None, None, None)]
