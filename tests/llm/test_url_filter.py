import datetime as dt
import random

from pyspark.sql import functions as F

from papyra.llm.url_filter import filter_urls, match_captures, url_keys, validity_intervals

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
CAP, ENT = "capture_id long, url string, fetched date", "key string, list string, day date, action string"


def slow_keys(url):
    if url is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].lower()
    address = host.startswith("[")
    host = host[: host.index("]") + 1] if address else host.split(":")[0]
    host = host[:-1] if host.endswith(".") else host
    if not host:
        return []
    labels, seg = host.split("."), [s for s in path.split("/") if s]
    if address or (len(labels) == 4 and all(x.isdigit() for x in labels)):
        labels = []
    return list(dict.fromkeys([host, *(".".join(labels[-k:]) for k in range(2, len(labels) + 1)), *(f"{host}/{'/'.join(seg[:k])}" for k in range(1, len(seg) + 1))]))


def slow_valid(entries, key, name, day):
    on, since = False, None
    for d in sorted({e[2] for e in entries if e[0] == key and e[1] == name and e[2] <= day}):
        now = all(e[3] != "remove" for e in entries if e[:3] == (key, name, d))
        if now and not on:
            since = d
        on = now
    return since if on else None


def test_against_slow(spark):
    rnd = random.Random(0)
    hosts, paths = ["a.example.com", "example.com", "b.x.org", "Ünï.org", "x.org."], ["", "/", "/p", "/p/q", "/p/q/r/s", "/z?q=/p"]
    caps = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(paths)}", D(rnd.randrange(200))) for i in range(150)]
    keys = ["example.com", "a.example.com", "example.com/p", "x.org", "b.x.org/p/q", "ünï.org", "nothing.net"]
    entries = [(rnd.choice(keys), rnd.choice(["ads", "allow", "malware"]), D(rnd.randrange(-50, 220)), rnd.choice(["add", "remove", "add"])) for _ in range(80)]
    c, e = spark.createDataFrame(caps, CAP), spark.createDataFrame(entries, ENT)
    want = {(i, n, k, s) for i, u, d in caps for k in slow_keys(u) for n in ("ads", "allow", "malware") if (s := slow_valid(entries, k, n, d))}
    assert {tuple(r) for r in match_captures(c, e).collect()} == want
    for r in filter_urls(c, e).collect():
        mine = [w for w in want if w[0] == r.capture_id]
        assert r.n_valid == len(mine)
        if mine:
            top = max((len(k), k) for _, _, k, _ in mine)[1]
            n = min((w[1] != "allow", w[1]) for w in mine if w[2] == top)
            assert (r.blocked, r.list, r.key) == (*n, top)
        else:
            assert (r.blocked, r.list, r.key) == (False, None, None)


def test_keys(spark):
    urls = ["https://u:p@A.b.C.d.e.f.g.h:80/x//y?z#w", "ftp://host", "nonsense", "", None, "http://", "http:///p", "http://é.fr/é/b/c/d", "http://10.0.0.1:8/x", "https://[::1]:80/a/b", "http://[fe80::1.2.3.4]", "http://1.2.3.4.5/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_keys(F.col("url")).alias("k"))
    for r in df.collect():
        assert sorted(r.k or []) == sorted(slow_keys(r.url)), r.url


def test_odd_rows(spark):
    c = spark.createDataFrame([(1, "http://a.b/", D(5)), (1, "http://a.b/", D(5)), (2, None, D(5)), (3, "http://a.b/", None), (None, "http://a.b/", D(5)), (4, "x" * 100000, D(5))], CAP).withColumns({x: F.lit(1) for x in ("id", "key", "list", "day", "bucket")})
    e = spark.createDataFrame([("a.b", "ads", D(1), None), ("a.b", "ads", D(1), "add"), (None, "ads", D(1), "add"), ("a.b", None, D(1), "add"), ("a.b", "x", None, "add"), ("A.B", "bad", D(5), "add"), ("a.b", "bad", D(5), "remove")], ENT)
    got = sorted(((str(r.capture_id), r.blocked, r.n_valid, r.list) for r in filter_urls(c, e).collect()))
    assert got == [("1", True, 1, "ads"), ("1", True, 1, "ads"), ("2", False, 0, None), ("3", False, 0, None), ("4", False, 0, None), ("None", False, 0, None)]
    assert filter_urls(c.limit(0), e).count() == 0
    assert {r.n_valid for r in filter_urls(c, e.limit(0)).collect()} == {0}
    assert validity_intervals(e.limit(0)).count() == 0


def test_deep_entries_and_case_of_paths(spark):
    caps = [(1, "http://a.b.c.d.e.f.g.H.org/x", D(5)), (2, "http://x.org/1/2/3/4/5/6?q", D(5)), (3, "http://X.org/Ab/C", D(5)), (4, "http://x.org/ab/C", D(5))]
    caps += [(5, "http://10.0.0.1/", D(5)), (6, "https://[::1]/p", D(5))]
    keys = ["b.c.d.e.f.g.h.org", "x.org/1/2/3/4/5", "X.Org/Ab", "0.1", "[::1]"]
    c, e = spark.createDataFrame(caps, CAP), spark.createDataFrame([(k, "ads", D(0), "add") for k in keys], ENT)
    got = {r.capture_id: (r.blocked, r.key) for r in filter_urls(c, e).collect()}
    assert got == {1: (True, "b.c.d.e.f.g.h.org"), 2: (True, "x.org/1/2/3/4/5"), 3: (True, "x.org/Ab"), 4: (False, None), 5: (False, None), 6: (True, "[::1]")}


def test_captures_that_share_an_id(spark):
    c = spark.createDataFrame([(1, "http://a.b/", D(5)), (1, "http://c.d/", D(5)), (1, "http://a.b/", D(1)), (1, "http://a.b/", D(5))], CAP)
    e = spark.createDataFrame([("a.b", "ads", D(3), "add")], ENT)
    assert sorted((r.blocked, r.key) for r in filter_urls(c, e).na.fill("").collect()) == [(False, ""), (False, ""), (True, "a.b"), (True, "a.b")]
