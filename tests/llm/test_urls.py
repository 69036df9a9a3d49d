import math
import random

from seqmill.llm import queries, urls


def plain(url, rules=urls.RULES):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    best = None
    for verdict, rule in rules:
        name, begin = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + begin) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def plain_grams(host, path):
    out = []
    for side, part in enumerate((host, path)):
        data = b"\x02" + part.encode() + b"\x02"
        out += [(side, data[i : i + n]) for n in urls.SIZES for i in range(len(data) - n + 1)]
    return out


ODD = [None, "", "no scheme", "://", "http://", "http://a.NET", "http://a.NET/x", "HTTP://Net/", "ftp://x.example.net/en/a?b#c", "http://example.com/de", "http://example.com/de/", "http://wexample.com/de/", "http://a.org/fr/x://net/",
       "x://y://z.net/", "http://net?/x", "http://net#/", "http://É.Org/fr/é", "http://a\nb.net/\n?q", "http://a.net/" + "x" * 5000, "http://\x02\x03.com/\x02", "//a.net/", "http://user@h.net:80/p"]


def test_rules_equal_a_plain_loop(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in enumerate(ODD + ODD)], "page_id long, url string, host string, rule string, score double")
    model = urls.fit(urls.ruled(pages))
    rows = {r.page_id: r for r in urls.judge(pages, model).collect()}
    assert len(rows) == 2 * len(ODD)
    for i, u in enumerate(ODD + ODD):
        host, path, best = plain(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best and best[1])
        if best:
            assert rows[i].verdict == best[0] and rows[i].score is None
        else:
            assert rows[i].verdict == ("block" if rows[i].score >= 0.5 else "allow")


def test_scores_equal_a_plain_sum():
    rng = random.Random(1)
    made = [("".join(rng.choices("abc.é", k=rng.randrange(9))), "/" + "".join(rng.choices("ab/1", k=rng.randrange(7)))) for _ in range(60)] + [("", ""), (None, None)]
    model = urls.fit_rows(made, [len(h or "") % 2 for h, _ in made], 1 << 20)
    where = {}
    for u in made:
        grams = plain_grams(u[0] or "", u[1] or "")
        found, offsets = urls.ngrams([u], 1 << 20)
        assert offsets.tolist() == [0, len(grams)]
        by_size = sorted(grams, key=lambda g: len(g[1]))
        for g, k in zip(by_size, found.tolist(), strict=True):
            assert where.setdefault(g, k) == k
        z = model.bias + sum(model.weights[k] for k in found) / math.sqrt(max(1, len(grams)))
        assert abs(model.score([u])[0] - 1 / (1 + math.exp(-z))) < 1e-9
    assert len(set(where.values())) == len(where)
    assert abs(model.score(made) - [model.score([u])[0] for u in made]).max() < 1e-9


def test_model_on_urls_it_has_not_seen(spark):
    """Half of the ruled urls, by host, teach the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    rows = [(r.url, r.label) for r in urls.ruled(pages).distinct().collect()]
    side = lambda u: sum(plain(u)[0].encode()) % 2
    model = urls.fit(spark.createDataFrame([r for r in rows if side(r[0])], "url string, label int"))
    held = [r for r in rows if not side(r[0])]
    scores = model.score([plain(u)[:2] for u, _ in held])
    right = sum((s >= 0.5) == (y == 1) for s, (_, y) in zip(scores, held, strict=True))
    assert len(held) > 100 and right / len(held) > 0.9
    again = urls.fit(spark.createDataFrame([r for r in rows[::-1] if side(r[0])], "url string, label int").repartition(5))
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = urls.fit(urls.ruled(empty))
    assert urls.judge(empty, none).count() == 0
    pages = spark.createDataFrame([(1, "http://b.com/x"), (1, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, none).collect()] == ["allow"] * 2
    one = urls.fit(spark.createDataFrame([("http://a.net/", 1), ("http://odd", 7), (None, None)], "url string, label int"))
    assert [r.verdict for r in urls.judge(pages, one).collect()] == ["block"] * 2
    rows = queries.QUERIES["op12_urls"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count() and {r.verdict for r in rows} == {"allow", "block"}
