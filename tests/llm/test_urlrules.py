import re

import compare
import pytest
from tests.conftest import FOLDER
from veritally.llm import oracle, queries, urlrules

URLS = [
    None, "", "no scheme", "http://", "https://COM/", "https://com", "https://a.com/x", "https://acom/x", "https://Example.com/en/1", "https://example.com/EN/1",
    "https://www.example.com/en/1?q=/es/", "http://m.www.example.com/en/", "ftp://x.net/es/#/fr/", "http://net/fr/", "http://net/fr", "http://x.net?/fr/", "://net/es/",
    "https://a.b/c://net/es/", "http://cheap-pills.org/", "http://pillses.org/", "http://casino-win.org", "http://casino-win.com/", "http://x.org/pills-/", "http://x.org/\n/a",
    "http://user@example.com:80/en/", "http://ExAmPlE.COM/en/é中",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    listed = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [r for r in listed if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0]
    words = "adult|ads|bets|casino|pills|porn|spam|viagra"
    return host, path, None, "block" if re.match(rf"([^/]*[.-])?({words})[.-]", host + path) else "allow"


def test_verdicts_against_brute_force(spark):
    rows = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS + URLS)], "page_id int, url string, rule string, tokens string")
    for row in urlrules.judge(rows).collect():
        assert (row.host, row.path, row.rule, row.verdict) == brute(row.url), row.url
    assert urlrules.judge(rows.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([(["www", "example", "com"],), (["example", "com"],), (["a", "com"],)], "tokens array<string>")
    rules = urlrules.LISTED
    filed = urlrules.rarest(tokens, rules)
    assert filed["en"] == [1, 2] and filed["com"] == [0]  # no URL has the token en
    assert sorted(n for numbers in filed.values() for n in numbers) == list(range(len(rules)))


def test_rules_as_a_table(spark):
    """More rules than a plan holds give the verdicts of brute force, columns of the operator's own names beside them."""
    rows = spark.createDataFrame(
        [(k, u, "x", "y", "z", "n") for k, u in enumerate(URLS + URLS)], "page_id int, url string, rule string, tokens string, _best string, `a.b` string"
    )
    idle = tuple(urlrules.Rule("block", f"site{k}.test", f"/p{k}/", f"site{k}.test/p{k}/") for k in range(3000))
    rules = urlrules.LISTED + idle + urlrules.GENERAL
    found = urlrules.judge(rows, rules).collect()
    assert len(found) == 2 * len(URLS) and {(r["_best"], r["a.b"]) for r in found} == {("z", "n")}
    for row in found:
        assert (row.host, row.path, row.rule, row.verdict) == brute(row.url), row.url
    one = spark.createDataFrame([("http://a.site7.test/p7/x",)], "url string")
    assert [(r.rule, r.verdict) for r in urlrules.judge(one, rules).collect()] == [("site7.test/p7/", "block")]
    assert urlrules.judge(rows.limit(0), rules).count() == 0
    unknown = urlrules.table(spark, (urlrules.Rule("block", pattern="^x"),))
    with pytest.raises(Exception, match="no literal token"):
        urlrules.judge_by_table(rows, unknown).collect()


def test_query_against_sql(spark):
    con = compare.connect(FOLDER)
    own = queries.url_filter(spark, FOLDER).collect()
    assert sorted(map(tuple, own), key=repr) == sorted(con.execute(oracle.URL_FILTER).fetchall(), key=repr)
