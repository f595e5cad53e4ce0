from graphloom.llm import url_filter
from graphloom.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/1?x", "http://example.com/EN/", "http://badexample.com/en/", "ftp://x.net/fr/", "http://x.net/frx",
    "http://x.net?y=/fr/", "http://x.net#f", "http://net/es/1", "http://a.b.c.d.e.net/es/", "http://x.org/en/", "x://y.com://z/en/", "http://x.net:80/es/", "http://x.net/es/\nz", "http://..com/", "http://" + "a." * 5000 + "net/es/" + "p/" * 20000,
]


def judge(url, rules, default="allow"):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
    host, rest = tail[:cut].lower() if tail[:cut].isascii() else tail[:cut], tail[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    path = rest[:end]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS)] + [(3, URLS[4], None, None), (None, URLS[4], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, key string")
    rules = [*URL_RULES, ("b.c.d.e.net", "", "block"), ("org", "/e", "block")]
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("org", "/e", "allow")], "host string, path string, verdict string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, listed).collect()}
    assert got == {(i, *judge(u, rules)) for i, u, _, _ in rows}


def test_empty_list_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    listed = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, listed).collect()] == [(1, "a.com", "/x", None, "allow")]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    made, blocks = url_filter.bloom(keys, 5000)
    words = {r["block"]: r[1:] for r in made.collect()}
    from pyspark.sql import functions as F

    def passing(df):
        where, bits = url_filter._bits(F.col("key"), F.lit(blocks))
        got = df.select(where.alias("b"), *[F.struct(w.alias("w"), m.alias("m")).alias(f"p{k}") for k, (w, m) in enumerate(bits)]).collect()
        return sum(all(r["b"] in words and words[r["b"]][p["w"]] & p["m"] for p in r[1:]) for r in got)

    assert passing(keys) == 5000
    assert passing(spark.range(5000, 15000).selectExpr("concat('k', id) AS key")) < 200
