import re

import pytest
from pyspark.sql import functions as F
from tests.test_queries import DATA

from tidelake.llm import queries, url_filter
from tidelake.llm._common import table


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for rule in queries.URL_RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path) and (best is None or len(rule.text) > len(best)):
            best = rule.text
    return best


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://A.Org/x", "http://x.org?y", "https://example.org/es/1", "https://m.example.org/en/12#a",
    "https://badexample.org/es/1", "http://u:p@x.com/fr/a?b", "ftp://x.com/de/", "http://com/fr/", "http://a/b://c.org/d", "http://É.org/é", "http://x.com/de\n/y", "x" * 50_000 + "://long.org/" + "p" * 50_000,
]


@pytest.fixture(scope="module")
def judged(spark):
    return queries.op1_url_filter(spark, DATA).join(table(spark, DATA, "pages").select("page_id", "url"), "page_id").collect()


def test_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    models = url_filter.UrlModels(spark.createDataFrame([], "gram long, accepted long, rejected long"), -1.0)
    found = {r.page_id: r for r in url_filter.judge(rows, queries.URL_RULES, models).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, plain_rule(host, path))
        allow = {r.text: r.allow for r in queries.URL_RULES}.get(found[i].rule, True)
        assert found[i].verdict == ("allow" if allow else "block")


def test_rules_of_all_pages(judged):
    assert all((r.host, r.path, r.rule) == (*plain_parts(r.url), plain_rule(*plain_parts(r.url))) for r in judged)


def test_models_block_rejected_hosts_and_spare_others(judged):
    spam = re.compile(r"casino|bets|pills|ads-|adult|spam")
    free = [r for r in judged if r.rule is None]
    bad = [r for r in free if spam.search(r.host)]
    assert bad and all(r.verdict == "block" for r in bad if "casino" in r.host or "pills" in r.host)
    good = [r for r in free if not spam.search(r.host)]
    assert sum(r.verdict == "block" for r in good) <= 0.02 * len(good)


def test_scores_match_a_plain_model(spark):
    """Counts are exact, also where a URL has n-grams that the models have never seen."""
    urls = [f"a{i}.com/x{i % 3}" for i in range(12)] + [f"casino{i}.net/win" for i in range(12)]
    labelled = spark.createDataFrame([(u, "casino" in u) for u in urls] + [(None, True), ("z", None)], "url string, rejected boolean")
    models = url_filter.fit(labelled)
    import math
    import zlib

    def plain(url):
        total = 0.0
        for side, sign in ((False, 1), (True, -1)):
            counts, contexts = {}, {}
            for u in urls:
                if ("casino" in u) == side and zlib.crc32(u.encode()) % 4 != 2:
                    for i, c in enumerate(u):
                        for k in range(url_filter.ORDER + 1):
                            context = (k, ("^" * k + u[:i])[len("^" * k + u[:i]) - k :] if k else "")
                            counts[context, c] = counts.get((context, c), 0) + 1
                            contexts[context] = contexts.get(context, 0) + 1
            for i, c in enumerate(url):
                p = 1 / 256
                for k in range(url_filter.ORDER + 1):
                    context = (k, ("^" * k + url[:i])[len("^" * k + url[:i]) - k :] if k else "")
                    n = contexts.get(context, 0)
                    p = (counts.get((context, c), 0) + url_filter.PRIOR * p) / (n + url_filter.PRIOR)
                total += sign * math.log(p)
        return total / len(url)

    wanted = ["a1.com/x1", "casino3.net/win", "other.org", "a1.com/x1", "c", "", None, "a1.com/" * 50]
    rows = spark.createDataFrame([(u, 5.0, "x") for u in wanted], "url string, ratio double, row string")
    got = url_filter.score_urls(rows, models).collect()
    assert sorted(r.url or "" for r in got) == sorted(u or "" for u in wanted) and got[0].asDict().keys() == {"url", "row", "ratio"}
    for r in got:
        assert r.ratio == pytest.approx(plain(r.url) if r.url else 0.0, abs=1e-5)


def test_rare_ngrams_go_by_the_join(spark, monkeypatch):
    """The score is the same, whichever n-grams are broadcast."""
    pages = table(spark, DATA, "pages")
    labelled = url_filter.seed_labels(pages, queries.REJECT_WORDS)
    scored = {}
    for common in (4096, 3):
        monkeypatch.setattr(url_filter, "COMMON", common)
        models = url_filter.fit(labelled)
        scored[common] = models.threshold, sorted(url_filter.score_urls(pages.select("page_id", "url"), models).collect())
    assert scored[4096] == scored[3]


def test_ngrams_cross_the_slices_of_a_batch(monkeypatch):
    texts = url_filter.pa.array(["http://a.b/c", None, "", "x", "é" * 9])
    whole = [(int(r), int(g)) for rows, grams in url_filter._places(texts) for r, g in zip(rows, grams, strict=True)]
    monkeypatch.setattr(url_filter, "SLICE_BYTES", 3)
    assert [(int(r), int(g)) for rows, grams in url_filter._places(texts) for r, g in zip(rows, grams, strict=True)] == whole
    assert [r for r, _ in whole] == [0] * 12 + [3] + [4] * 18


def test_empty_table_and_one_sided_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    models = url_filter.fit(url_filter.seed_labels(empty, ["x"]))
    assert models.threshold == -float("inf")
    assert url_filter.judge(empty, queries.URL_RULES, models).count() == 0
    some = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert url_filter.fit(url_filter.seed_labels(some, ["x"])).threshold == -float("inf")
    assert url_filter.seed_labels(some.withColumn("url", F.lit(None).cast("string")), ["x"]).count() == 0
