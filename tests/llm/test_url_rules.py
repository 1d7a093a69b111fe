"""Operator 13: hosts and paths, fixed rules, and mined rules against all combinations counted one by one."""

import random
from itertools import combinations

from rentwire.llm import queries, url_rules

RULES = queries.URL_RULES


def plain_place(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    m = min((rest.index(c, n) for c in "?#" if c in rest[n:]), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1", "https://www.example.net/fr/", "http://x.example.com/de/?q=1", "http://example.com/de", "http://b.org/fr/#a", "http://b.org/fr", "http://net", "http://net/", "http://fakenet/",
    "http://notexample.com/de/", "no scheme", "", None, "http://", "ftp://u:p@h.net:80/p", "http://a.net?x=/y", "//x.net/", "x://y://z.net/", "http://É.net/é", "http://a.example.net/EN/", "http://a.example.net/en/" + "long-" * 3000, "http://a\nb.net/c\nd",
]


def test_places_and_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, "a", "b") for k, u in enumerate(URLS)], "page_id long, url string, host string, best string")
    none = url_rules.mine(pages.limit(0).selectExpr("url", "true as blocked"))
    assert none.count() == 0
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.best) for r in url_rules.judge(pages, none, RULES).collect()}
    for k, u in enumerate(URLS):
        place = plain_place(u)
        rule, verdict = plain_rule(*place)
        assert got[k] == (*place, rule, verdict or "allow", "b"), u


def test_mined_rules_equal_all_combinations_counted(spark):
    draw = random.Random(1)
    rows = []
    for k in range(1500):
        host = draw.choice(["casino", "news", "shop"]) + draw.choice(["-win", "-x", ""]) + draw.choice([".com", ".io"])
        url = f"http://{host}/{draw.choice(['a', 'b'])}/{draw.randrange(9)}"
        bad = ("casino" in host and ".com" in host) or draw.random() < 0.03
        rows.append((url, bad))
    rows += [("http://hot.com/" + "/".join(f"t{k}" for k in range(60)), True)] * 700  # a third of all rows: one URL of many tokens
    rows += [(None, True), ("http://q.com/a/1", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = {r.rule: (r.verdict, r.support, round(r.confidence, 9)) for r in url_rules.mine(labelled, support=30, confidence=0.9, lift=1.1).collect()}
    tokens = {r.url: r.tokens for r in labelled.select("url", url_rules.tokens(labelled.url).alias("tokens")).distinct().collect()}
    known = [(tokens[u], b) for u, b in rows if u and b is not None]
    base = sum(b for _, b in known) / len(known)
    counts = {}
    for own, bad in known:
        some = [t for t in own if not t.startswith("p:t")]
        for n in range(1, len(some) + 1):
            for c in combinations(sorted(some), n):
                s = counts.setdefault(c, [0, 0])
                s[0], s[1] = s[0] + 1, s[1] + bad
    strong = {}
    for c, (n, bad) in counts.items():
        right, share, verdict = (bad, base, "block") if 2 * bad > n else (n - bad, 1 - base, "allow")
        if n >= 30 and right / n >= 0.9 and right / n / share >= 1.1:
            strong[c] = (verdict, n, round(right / n, 9))
    want = {" ".join(c): v for c, v in strong.items() if not any(set(o) < set(c) and strong[o][0] == v[0] and strong[o][2] >= v[2] for o in strong)}
    plain = {r: v for r, v in rules.items() if "p:t" not in r}
    assert plain == want and "h:casino h:com" in plain
    assert "p:t59" in rules


def test_judged_by_the_best_fitting_rule(spark):
    mined = spark.createDataFrame(
        [("h:casino", ["h:casino"], "h:casino", "block", 0.9, 50), ("h:casino p:news", ["h:casino", "p:news"], "p:news", "allow", 0.95, 40), ("q:ref", ["q:ref"], "q:ref", "block", 0.9, 60)],
        "rule string, wanted array<string>, rarest string, verdict string, confidence double, support long",
    )
    urls = ["http://casino-win.com/x", "http://casino.com/news/1", "http://a.com/?ref=1", "http://casino.com/?ref=2", "http://casino.net/x", "http://plain.com/", None]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined, r.rule) for r in url_rules.judge(pages, mined, RULES).collect()}
    assert len(got) == 14
    assert [got[k] for k in range(7)] == [
        ("block", "h:casino", None), ("allow", "h:casino p:news", None), ("block", "q:ref", None), ("block", "q:ref", None), ("block", None, "net/"), ("allow", None, None), ("allow", None, None),
    ]
    assert all(got[k] == got[k + 7] for k in range(7))


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com"), (2, "http://b.com"), (3, "http://c.com"), (None, "http://d.com")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_rules.labelled_pages(pages, labels).collect())) == [("http://a.com", False), ("http://b.com", True)]


def test_rules_of_far_tokens_in_long_urls(spark):
    draw = random.Random(7)
    rows = []
    for _ in range(900):
        host, end = draw.choice(["evil", "shop"]), draw.choice(["ref", "id"])
        middle = [f"m{k}" for k in range(11) if draw.random() < 0.85]
        bad = (host == "evil" and end == "ref") or (host == "shop" and not {"m0", "m5", "m10"} - set(middle) and end == "id") or draw.random() < 0.04
        rows.append((f"http://{host}/{'/'.join(middle)}?{end}=1", bad))
    rows += [("http://mixed/" + "/".join(f"t{k}" for k in range(60)), k % 2 == 0) for k in range(300)]  # long, and no part of it tells anything
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    tokens = {r.url: r.tokens for r in labelled.select("url", url_rules.tokens(labelled.url).alias("tokens")).distinct().collect()}
    base = sum(b for _, b in rows) / len(rows)
    counts = {}
    for url, bad in rows[:900]:
        own = sorted(tokens[url])
        for n in range(1, len(own) + 1):
            for c in combinations(own, n):
                s = counts.setdefault(c, [0, 0])
                s[0], s[1] = s[0] + 1, s[1] + bad
    strong = {}
    for c, (n, bad) in counts.items():
        right, share, verdict = (bad, base, "block") if 2 * bad > n else (n - bad, 1 - base, "allow")
        if n >= 60 and right / n >= 0.9 and right / n / share >= 1.1:
            strong[c] = (verdict, n, round(right / n, 9))

    def shorter(c):  # any smaller set that says the same
        return any(o in strong and strong[o][0] == strong[c][0] and strong[o][2] >= strong[c][2] for n in range(1, len(c)) for o in combinations(c, n))

    want = {" ".join(c): v for c, v in strong.items() if not shorter(c)}
    got = {r.rule: (r.verdict, r.support, round(r.confidence, 9)) for r in url_rules.mine(labelled, support=60, confidence=0.9, lift=1.1).collect()}
    assert got == want and "h:evil q:ref" in got and "h:shop p:m0 p:m10 p:m5 q:id" in got
