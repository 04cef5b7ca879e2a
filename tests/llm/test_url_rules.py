from itertools import combinations

from pyspark.sql import functions as F

from cairnfield.llm import url_rules


def test_fixed_rules(spark, folder):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "HTTP://WWW.Example.COM/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://b.example.com/en/": ("b.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/en": ("example.com", "/en", "com/", "allow"),
        "https://a.net/es/1#x": ("a.net", "/es/1", "net/es/", "block"),
        "https://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "https://a.net/de/1": ("a.net", "/de/1", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "x://É.com?u=http://a.net/es/": ("É.com", "", None, "allow"),
        "a.com/x": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://a://b.com/": ("a:", "//b.com/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, "http://a.com/x"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.query(spark, folder(pages=pages, labels=labels)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]
    none = url_rules.query(spark, folder(pages=pages.limit(0), labels=labels))
    assert none.count() == 0


def brute(rows, min_count, min_support, min_confidence, min_lift):
    total, bad = len(rows), sum(b for _, b in rows)
    stats = {}
    for tokens, b in rows:
        for n in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), n):
                seen, hit = stats.get(s, (0, 0))
                stats[s] = (seen + 1, hit + b)
    sure = {s: h / n for s, (n, h) in stats.items() if n >= min_count and n / total >= min_support and h / n >= min_confidence and h / n >= min_lift * bad / total}
    return {s: c for s, c in sure.items() if not any(set(o) < set(s) and oc >= c for o, oc in sure.items())}


def test_mining_against_brute_force(spark):
    rows = []
    for i in range(240):
        tokens = {f"h:{'abc'[i % 3]}", f"p:{'xy'[i % 2]}", f"q:{i % 5}"}
        rows.append((sorted(tokens), (i % 3 == 0 and i % 2 == 0) or i % 5 == 4 and i % 7 == 0))
    df = spark.createDataFrame([(t, bool(b)) for t, b in rows], "tokens array<string>, blocked boolean")
    limits = {"min_count": 4, "min_support": 0.01, "min_confidence": 0.5, "min_lift": 1.5}
    rules = url_rules.mine_rules(df, **limits)
    got = {tuple(sorted(r["tokens"])): round(r["confidence"], 9) for r in rules.collect()}
    want = brute(rows, **limits)
    assert got == {s: round(c, 9) for s, c in want.items()} and got
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "row long, tokens array<string>")
    hits = url_rules.match(pages, rules.select(F.xxhash64("tokens").alias("id"), "tokens"), "row")
    assert {r["row"] for r in hits.collect()} == {i for i, (t, _) in enumerate(rows) if any(set(s) <= set(t) for s in want)}


def test_mined_verdicts(spark, folder):
    pages = [(i, f"http://h{i % 7}.org/{'bad' if i % 4 == 0 else 'good'}/{i}") for i in range(200)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(100)]
    got = url_rules.query(spark, folder(pages=spark.createDataFrame(pages, "page_id long, url string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_rules_of_a_thousandth_of_the_labels(spark, folder):
    rare = lambda i: i % 1000 == 7
    pages = [(i, f"http://{'rare' if rare(i) else f'h{i % 7}'}.org/x/{i}") for i in range(10_001)] + [(20_000, "http://rare.org/y")]
    labels = [(i, 0 if rare(i) else 1, 0) for i in range(10_000)]
    got = url_rules.query(spark, folder(pages=spark.createDataFrame(pages, "page_id long, url string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(10_000) if rare(i)} | {20_000}


def test_rules_of_eight_pages(spark):
    rows = [(["h:rare" if i < 8 else f"h:{i % 7}"], i < 8) for i in range(1000)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in rules] == [(["h:rare"], 1.0)]


def test_long_urls_ties_and_clashing_names(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}", 1, 2) for i in range(40)] + [(100, "http://h.org/" + "bad/" * 300_000, 0, 0), (101, "http://h.org/" + "/".join(f"w{i}" for i in range(20_000)), 0, 0)], "page_id long, url string, tokens int, verdict int")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0, "x") for i in range(40)], "doc_id long, quality int, toxic int, page_id string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, url_rules.train(pages, labels.drop("page_id"))).collect()}
    assert len(got) == 42 and all((got[i]["verdict"] == "block") == (i % 2 == 1) for i in range(40)) and got[100]["verdict"] == "block" and got[101]["verdict"] == "allow"
    assert len(got[100]["path"]) == 1_200_001
    both = spark.createDataFrame([(["a", "b"], True)] * 10 + [(["c"], False)] * 20, "tokens array<string>, blocked boolean")
    assert sorted(r["tokens"] for r in url_rules.mine_rules(both).collect()) == [["a"], ["b"]]
