import random

import numpy as np
import pytest

from kinfold.llm import queries, topk, urls
from kinfold.llm.queries import URL_RULES

RULES = "verdict string, host string, path string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_judging_equals_a_plain_search(spark):
    rnd = random.Random(6)
    hosts = ["a.example.com", "EXAMPLE.com", "example.net", "x.y.example.org", "com", "notexample.com", "example.com.", "..com", "éxample.NET", "user@example.com:80"]
    made = [f"{rnd.choice(['http', 'ftp', ''])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/7', '/en/75', '/de/8', '/de/', '/es/1', '/EN/7'])}{rnd.choice(['', '?q=/en/7', '#://com/en/', '/' + 'z' * 3000])}" for _ in range(300)]
    made += [None, "", "example.com/en/7", "://", "http://", "http:///en/", "a://b://c", "http://com\n/en/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made)], "page_id long, url string, host string")
    for rules in (URL_RULES, URL_RULES + [("allow", "com", "/en/"), ("block", "example.com", ""), ("allow", None, "/"), ("block", "", "/")], []):
        got = urls.judge(df, spark.createDataFrame(rules, RULES))
        known = [r for r in rules if r[1]]
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: plain(u, known) for i, u in enumerate(made)}
    assert urls.judge(df.limit(0), spark.createDataFrame(URL_RULES, RULES)).count() == 0


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "http://com/en/")] * 5 + [(None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in urls.judge(df, spark.createDataFrame(URL_RULES, RULES)).collect()) == ["allow"] + ["block"] * 5


@pytest.mark.parametrize("n,k,part", [(0, 3, 1 << 16), (5, 8, 1 << 16), (400, 5, 64), (3000, 10, 300)])
def test_top_k_equals_brute_force(spark, n, k, part):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = [int(centre[rng.integers(20)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(n)]
    codes = [codes[0] if i % 3 == 0 and n else c for i, c in enumerate(codes)]  # a third are copies
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)) + [(None, 5), (10**6, None)] + [(0, c) for c in signed[:1]] * 2, "id long, code long")
    got = {}
    for r in topk.top_k(df, df.where("id % 10 = 0"), k=k, part=part).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    a = np.array(codes, np.uint64)
    for q in range(0, n, 10):
        d = np.bitwise_count(a ^ a[q]).astype(int)
        best = sorted(zip(d.tolist(), range(n)))[:k]
        assert sorted(got[q]) == [(i + 1, x, y) for i, (x, y) in enumerate(best)]
    assert len(got) == len(range(0, n, 10))


def test_codes(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],), ([],), ([1.0, 2.0],)], "e array<double>")
    got = [r[0] for r in df.select(topk.binary_code(df.e)).collect()]
    assert got[0] == got[5] is not None and got[1] is got[2] is got[3] is None and got[4] == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_top_k_on_the_sample_vectors(spark, sf):
    got = {}
    for r in queries.op9_topk(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = vectors.select("vec_id", topk.binary_code(vectors.embedding).alias("c")).where("c is not null").collect()
    codes, ids = np.array([r.c for r in rows]).view(np.uint64), [r.vec_id for r in rows]
    asked = [i for i, x in enumerate(ids) if x % 100 == 0]
    for i in asked:
        best = sorted(zip(np.bitwise_count(codes ^ codes[i]).astype(int).tolist(), ids))[:10]
        assert sorted(got[ids[i]]) == [(n + 1, d, x) for n, (d, x) in enumerate(best)]
    assert len(got) == len(asked)


def test_probes_are_made_by_radius(monkeypatch):
    assert [len(topk.flips(9, r)) for r in range(11)] == [1, 9, 36, 84, 126, 126, 84, 36, 9, 1, 0]
    assert all(v.bit_count() == 3 for v in topk.flips(12, 3).tolist()) and len(set(topk.flips(12, 3).tolist())) == 220
    assert [topk.segment_count(n) for n in (1, 500, 2_000, 50_000, 10**10)] == [16, 7, 6, 4, 2]
    # only codes under the probed values are met: one at 1 bit of the segment's value is, one at 3 bits isn't
    index = topk.pa.table({"low": topk.pa.array([5, 4, 2], topk.pa.int64()), "code": topk.pa.array([5, 4, 2], topk.pa.int64()), "ids": topk.pa.array([[1], [2], [3]])})
    asked = topk.pa.table({"s": [0], "q": topk.pa.array([5], topk.pa.int64()), "bound": [64], "low": [5], "least": [0], "most": [1]})
    assert topk._nearest(index, asked, [4], 10).to_pydict() == {"q": [5, 5], "distance": [0, 1], "neighbor_id": [1, 2]}


def test_very_long_hosts(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "example.com/en/7x"), (2, "http://" + "." * 100_000 + "net/de/"), (3, "http://" + "x" * 300_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(URL_RULES, RULES)).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("net/de/", "block"), 3: (None, "allow")}


def test_the_query_judges_by_the_contract(spark, tmp_path):
    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://a.example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://x.org/es/1": ("org/es/", "block"),
        "http://x.org/en/1": (None, "allow"),
    }
    rows = list(enumerate(want))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op5_urls(spark, str(tmp_path)).collect()}
    assert got == {i: want[u] for i, u in rows}
