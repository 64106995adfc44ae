"""Crawl / map fixtures and a property check against a sequential queue BFS."""
import random

from pyspark.sql import functions as F

from pagefold.operators import crawl as C


def _snapshot(spark, graph, missing=()):
    rows = []
    for url, links in graph.items():
        if url in missing:
            continue
        body = "<html><body>" + "".join(f'<a href="{l}">x</a>' for l in links) + "</body></html>"
        rows.append((url, 200, body))
    return spark.createDataFrame(rows, "url string, http_status int, body string")


def _seeds(spark, seeds, budget_col="max_pages", budget=10, depth=2, follow=True):
    return spark.createDataFrame([(i, s, budget, depth, follow) for i, s in enumerate(seeds)],
                                 f"crawl_id long, seed_url string, {budget_col} int, max_depth int, follow boolean")


def queue_crawl(graph, seed, max_pages, max_depth, missing=(), mode="crawl"):
    """Sequential reference: FIFO queue, seen set, failures listed but not expanded."""
    host = seed.split("/")[2].lower()
    seen, queue, out = {seed}, [(seed, 0)], []
    if mode == "map":
        urls = [seed]
        while queue and len(urls) < max_pages:
            u, d = queue.pop(0)
            if d >= max_depth or u in missing or u not in graph:
                continue
            for l in graph[u]:
                if l.split("/")[2].lower() != host or l in seen:
                    continue
                seen.add(l)
                urls.append(l)
                if len(urls) >= max_pages:
                    break
                queue.append((l, d + 1))
        return urls
    while queue and len(out) < max_pages:
        u, d = queue.pop(0)
        ok = u in graph and u not in missing
        out.append(u)
        if not ok or d >= max_depth:
            continue
        for l in graph[u]:
            if l.split("/")[2].lower() == host and l not in seen:
                seen.add(l)
                queue.append((l, d + 1))
    return out


DEPTH = {"https://ex.com/": ["https://ex.com/a", "https://other.com/x"], "https://ex.com/a": ["https://ex.com/b"],
         "https://ex.com/b": []}


def test_depth_and_off_host(spark):
    snap = _snapshot(spark, DEPTH)
    got = [r["url"] for r in C.crawl_bfs(_seeds(spark, ["https://ex.com/"]), snap).orderBy("rank").collect()]
    assert got == ["https://ex.com/", "https://ex.com/a", "https://ex.com/b"]


def test_budget_and_default_types(spark):
    g = {"https://ex.com/": ["https://ex.com/a", "https://ex.com/b", "https://ex.com/c"]}
    snap = _snapshot(spark, g)
    got = [r["url"] for r in C.crawl_bfs(_seeds(spark, ["https://ex.com/"], budget=2, depth=5), snap)
           .orderBy("rank").collect()]
    assert got == ["https://ex.com/", "https://ex.com/a"]
    seed_only = C.crawl_bfs(_seeds(spark, ["https://ex.com/"], follow=False), _snapshot(spark, DEPTH)).collect()
    assert [r["url"] for r in seed_only] == ["https://ex.com/"]


def test_map_and_fragment(spark):
    g = {"https://ex.com/": ["https://ex.com/a#frag"], "https://ex.com/a": ["https://ex.com/b"], "https://ex.com/b": []}
    m = C.map_bfs(_seeds(spark, ["https://ex.com/"], "max_urls", 10, 2), _snapshot(spark, g))
    urls = [r["url"] for r in m.orderBy("rank").collect()]
    assert urls == ["https://ex.com/", "https://ex.com/a", "https://ex.com/b"]
    assert all("#" not in u for u in urls)


def test_random_graphs_match_queue(spark):
    rnd = random.Random(7)
    graph, missing = {}, set()
    for g in range(12):
        n = rnd.randint(3, 12)
        nodes = [f"https://h{g}.com/{i}" for i in range(n)]
        for u in nodes:
            graph[u] = [rnd.choice(nodes) for _ in range(rnd.randint(0, 5))] + (["https://off.com/z"] if rnd.random() < .3 else [])
        missing |= {u for u in nodes[1:] if rnd.random() < 0.15}
    seeds = [f"https://h{g}.com/0" for g in range(12)]
    snap = _snapshot(spark, graph, missing)
    for budget, depth in ((4, 2), (10, 3)):
        cp = C.crawl_bfs(_seeds(spark, seeds, budget=budget, depth=depth), snap).collect()
        mp = C.map_bfs(_seeds(spark, seeds, "max_urls", budget, depth), snap).collect()
        for i, s in enumerate(seeds):
            got = [r["url"] for r in sorted((r for r in cp if r["crawl_id"] == i), key=lambda r: r["rank"])]
            assert got == queue_crawl(graph, s, budget, depth, missing)
            gm = [r["url"] for r in sorted((r for r in mp if r["crawl_id"] == i), key=lambda r: r["rank"])]
            assert gm == queue_crawl(graph, s, budget, depth, missing, mode="map")


def test_rollup(spark):
    g = {"https://ex.com/": ["https://ex.com/a", "https://ex.com/gone"], "https://ex.com/a": []}
    cp = C.crawl_bfs(_seeds(spark, ["https://ex.com/"]), _snapshot(spark, g))
    r = C.crawl_rollup(cp).collect()[0]
    assert (r["pages_crawled"], r["pages_skipped"], r["http_status"]) == (3, 1, 200)


def test_depth_beyond_five_and_default_depths(spark):
    chain = {f"https://ex.com/{i}": [f"https://ex.com/{i + 1}"] for i in range(12)}
    snap = _snapshot(spark, chain)
    for depth, pages in ((9, 10), (5, 6), (0, 1), (None, 1), (-1, 3)):
        got = C.crawl_bfs(_seeds(spark, ["https://ex.com/0"], budget=100, depth=depth), snap).collect()
        assert len(got) == pages, depth
    assert C.map_bfs(_seeds(spark, ["https://ex.com/0"], "max_urls", 100, 9), snap).count() == 10


def test_seed_that_does_not_parse_is_a_failed_row(spark):
    snap = _snapshot(spark, DEPTH)
    seeds = _seeds(spark, ["https://ex.com/", "http://bad host/", None])
    pages = C.crawl_bfs(seeds, snap)
    bad = pages.where("error IS NOT NULL").collect()
    assert {(r["crawl_id"], r["url"], r["ok"]) for r in bad} == {(1, "http://bad host/", False), (2, None, False)}
    roll = {r["crawl_id"]: r for r in C.crawl_rollup(pages).collect()}
    assert roll[0]["pages_crawled"] == 3 and roll[1]["pages_crawled"] == 0 and roll[1]["error"] == "invalid_url"
    assert C.map_bfs(_seeds(spark, ["http://bad host/"], "max_urls"), snap).first()["error"] == "invalid_url"


def test_contents_of_visited_pages(spark):
    g = {"https://ex.com/": ["https://ex.com/a", "https://ex.com/gone"], "https://ex.com/a": ["https://ex.com/"]}
    snap = _snapshot(spark, g)
    pages = C.crawl_bfs(_seeds(spark, ["https://ex.com/", "https://ex.com/a"]), snap)
    got = {(r["crawl_id"], r["url"]): r for r in C.crawl_contents(pages, snap, ["links"]).collect()}
    assert got[0, "https://ex.com/"]["links"] == ["https://ex.com/a", "https://ex.com/gone"]
    assert got[1, "https://ex.com/"]["links"] == got[0, "https://ex.com/"]["links"]
    assert not got[0, "https://ex.com/gone"]["ok"] and got[0, "https://ex.com/gone"]["links"] is None
    roll = C.crawl_rollup(pages, C.crawl_contents(pages, snap, ["html"]).select("url", F.lit(True).alias("truncated")).distinct())
    assert all(r["truncated"] for r in roll.collect())


def test_a_full_crawl_is_not_carried_on(spark, monkeypatch):
    """Levels hold what is listed, no finds behind the budget, and end with the last crawl that is not full."""
    kept, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    at = "https://e.com/{}".format
    graph = {at(i): [at(7 * i + k) for k in range(1, 8)] + [at(0), at(i)] for i in range(60)}
    seeds = [at(0), at(1), at(50)]
    rows = C.crawl_bfs(_seeds(spark, seeds, budget=12, depth=6), _snapshot(spark, graph)).collect()
    for i, seed in enumerate(seeds):
        assert [r["url"] for r in sorted(rows, key=lambda r: r["rank"]) if r["crawl_id"] == i] == queue_crawl(graph, seed, 12, 6)
    levels = [f.collect() for f in kept if "rank" in f.columns]
    assert max(r["rank"] for f in levels for r in f) == 11
    assert [len(f) > 0 for f in levels] == [True, True, True, False]  # seeds, two levels and none
