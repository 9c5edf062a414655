import random
import string

from netflow_spark.llm.urls import RULES, url_verdicts

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, label double, n long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "clash", "clash", 1.0, 3) for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in host), tail[:end]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_hosts_paths_and_rules(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://ORG/", "https://Example.org/en/1", "http://a.example.org/en/12?x=1", "http://badexample.org/es/",
            "ftp://x.com?/fr/", "http://x.com/fr/#a/b?c", "http://x.com/fr", "a://b://c/d", "http://u@h:80/p;q?x=1&y=2#z", "http://É.org/é", "http://x.com/de/\n?a", "x" * 20_000 + "://a.net/" + "y/" * 5000]
    for _ in range(300):
        urls.append(f"{rng.choice(['http', 'https'])}://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example.org', 'org', 'q.com', 'com', 'z.net'])}"
                    f"{rng.choice(['/en/1', '/en/2', '/es/', '/fr/', '/de/', '/', ''])}{rng.choice(['', '9', '?a=b', '#c', 'x/y'])}")
    urls += urls[:20]
    got = {r.page_id: r for r in url_verdicts(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r, rule = got[i], ruled(*parts(u))
        assert (r.host, r.path) == parts(u)
        assert r.rule == (rule.host + rule.path if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_trees_learn_what_rules_label(spark):
    """Rule-labelled urls differ in their digits; unruled ones follow them."""
    rng = random.Random(3)
    urls = [f"http://s{rng.randrange(9)}.com/de/{'7' * 30}" for _ in range(80)] + [f"http://s{rng.randrange(9)}.com/fr/{'q' * 30}" for _ in range(80)]
    urls += [f"http://t.net/en/{'7' * 30}", f"http://t.net/en/{'q' * 30}"]
    got = {r.page_id: r.verdict for r in url_verdicts(pages(spark, urls)).collect()}
    assert got[len(urls) - 2] == "block" and got[len(urls) - 1] == "allow"


def test_labels_of_one_kind_and_none(spark):
    assert {r.verdict for r in url_verdicts(pages(spark, ["http://a.net/x", None])).collect()} == {"allow"}
    assert {r.verdict for r in url_verdicts(pages(spark, ["http://a.com/de/x", "http://b.net/"])).collect()} == {"block"}
    assert url_verdicts(pages(spark, [])).count() == 0


def test_rare_label_is_in_a_small_sample(spark):
    """One blocked url among many; with the sample of the size asked for and far smaller."""
    urls = [f"http://s{i % 9}.com/fr/{'q' * 20}{i}" for i in range(600)] + [f"http://s1.com/de/{'7' * 30}"]
    for size in (2, 40):
        got = {r.page_id: r for r in url_verdicts(pages(spark, urls), max_train=size, trees=2).collect()}
        assert len(got) == len(urls) and got[600].verdict == "block" and {got[i].verdict for i in range(600)} == {"allow"}
