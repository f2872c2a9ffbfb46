"""Graphs that grow by batches, bodies that are scanned once, counted captures, summaries and drift by area."""

import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import content, contributions, drift, fold, partials
from trailmark.schema import conform
from trailmark.sources import captures, osint
from trailmark.streaming import live
from trailmark.tables import Store


def test_partials_merge_into_the_whole(spark):
    rows = [(i, "GET", ["shop.test", "cdn.test"][i % 5 == 0], f"/api/x{i % 4}", f"/api/x{i % 4}", [200, 404, None][i % 3], ["user", None, "admin"][i % 3], ["bearer", "cookie:sid"][: i % 3], ["q", "q", "z"][: i % 4], [(f"c{i % 2}", i % 3 == 0, i % 2 == 0, ["Lax", None, "Strict"][i % 3])]) for i in range(60)]
    schema = "id long, method string, host string, path string, path_template string, status int, role string, credentials array<string>, query_params array<string>, set_cookies array<struct<name string, httponly boolean, secure boolean, samesite string>>"
    x = contributions.classified(conform(spark.createDataFrame(rows, schema)), ["shop.test"], "shop.test")
    added, linked = contributions.node_contributions(x), contributions.edge_contributions(x)
    for n in (1, 4):
        part = F.pmod(F.col("ev"), F.lit(n))
        nodes = reduce(DataFrame.unionByName, [partials.node_partials(added.filter(part == k)) for k in range(n)])
        edges = reduce(DataFrame.unionByName, [partials.edge_partials(linked.filter(part == k)) for k in range(n)])
        got = partials.finished_nodes(partials.merged_nodes(partials.merged_nodes(nodes)))
        assert sorted(map(str, got.collect())) == sorted(map(str, contributions.nodes_from(added).select(got.columns).collect()))
        assert sorted(map(str, partials.merged_edges(edges).collect())) == sorted(map(str, contributions.edges_from(linked).collect()))


def test_growing_graph(spark, tmp_path):
    def batch(k):
        paths = [f"/live/name{chr(97 + k)}{chr(97 + i)}/{{id}}" for i in range(4)] + [f"/api/x{k % 3}"]
        return conform(spark.createDataFrame([(100 * k + i, "GET", "shop.test", p, p, 200) for i, p in enumerate(paths)], "id long, method string, host string, path string, path_template string, status int"))

    grown = live.IncrementalGraph(f"{tmp_path}/g", ["shop.test"], "shop.test", fold=True)
    grown.FANIN = 3
    for k in range(5):
        grown.add(batch(k), k)
    assert grown.rebuilds >= 1  # twelve siblings fold, and more of them do after that
    grown.add(batch(4), 4)
    grown.add(batch(1), 1)  # merged long ago
    every = reduce(DataFrame.unionByName, [batch(k) for k in range(5)])
    x = contributions.classified(fold.fold_siblings(every), ["shop.test"], "shop.test")
    nodes, edges = grown.graph(spark)
    assert "endpoint:GET:shop.test:/live/{slug}/{id}" in {r["id"] for r in nodes.collect()} or "route:shop.test/live/{slug}/{id}" in {r["id"] for r in nodes.collect()}
    assert sorted(map(str, nodes.collect())) == sorted(map(str, contributions.nodes_from(contributions.node_contributions(x)).select(nodes.columns).collect()))
    assert sorted(map(str, edges.collect())) == sorted(map(str, contributions.edges_from(contributions.edge_contributions(x)).collect()))
    store = Store(f"{tmp_path}/g/paths")
    assert all(b - a + 1 in (1, 3, 9) for a, b in store.ranges(spark)) and len(store.ranges(spark)) <= 4
    other = live.IncrementalGraph(f"{tmp_path}/g", ["other.test"], None)
    assert {r["type"] for r in other.graph(spark)[0].collect()} == {"third_party"} and other.rebuilds == 1


def test_bodies_are_scanned_once(spark, tmp_path):
    scans = []

    def scan(bodies):
        found = content.script_scan(bodies)
        scans.append(found.select("content").count())
        return found

    script = 'fetch("/api/a"); new Worker("./w.js")'
    rows = [(i, [script, script + " ", "plain", None, ""][i % 5]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, body string")
    store = f"{tmp_path}/scans"
    first = content.scanned_once(df, "body", scan, store, 0)
    assert first.columns == ["id", "body", "refs", "assets"] and first.count() == 20
    assert {r["id"] % 5: (r["refs"] is None, len(r["refs"] or []), len(r["assets"] or [])) for r in first.collect()} == {0: (False, 1, 1), 1: (False, 1, 1), 2: (False, 0, 0), 3: (True, 0, 0), 4: (False, 0, 0)}
    more = spark.createDataFrame([(1, script), (2, 'axios.get("/api/new")')], "id long, body string")
    for _ in range(2):  # a batch may come again
        later = content.scanned_once(more, "body", scan, store, 1)
        assert {r["id"]: [x["path"] for x in r["refs"]] for r in later.collect()} == {1: ["/api/a"], 2: ["/api/new"]}
    assert scans == [4, 1, 1]
    assert content.scanned_once(df.limit(0), "body", content.script_scan).count() == 0


def test_counted_captures(spark, tmp_path):
    head = "Tool,Method,Host,Request,Response,Path"
    lines = ["Proxy,GET,shop.test,GET / HTTP/1.1,HTTP/1.1 200 OK,/", "Proxy,GET,bad host!,GET / HTTP/1.1,,/", "Scanner,GET,shop.test,GET /x HTTP/1.1,,/x", ",get,Shop.test,GET /y HTTP/1.1,,/y"]
    (tmp_path / "c.csv").write_text("\n".join([head, *lines]) + "\n")
    rows, counts = captures.counted(spark, f"file://{tmp_path}/c.csv", skip_tools=[" scanner "])
    assert {r["tool"]: tuple(r)[1:] for r in counts.collect()} == {"Proxy": (2, 1, 1, 0), "Scanner": (0, 0, 0, 1), "?": (1, 1, 0, 0)}
    assert sorted(r["path"] for r in rows.select("path").collect()) == ["/", "/y"]
    only = captures.counted(spark, f"file://{tmp_path}/c.csv", only_tools=["scanner"])[1]
    assert {r["tool"]: r["items"] for r in only.collect()} == {"Proxy": 0, "Scanner": 1, "?": 0}
    entry = lambda status: {"request": {"method": "GET", "url": "https://shop.test/a", "headers": []}, "response": {"status": status, "headers": [], "content": {}}}
    (tmp_path / "c.json").write_text("﻿" + json.dumps({"log": {"entries": [entry(200), entry(0)]}}))
    assert [tuple(r) for r in captures.counted(spark, f"file://{tmp_path}/c.json")[1].collect()] == [("?", 2, 1, 1, 0)]
    (tmp_path / "other.json").write_text('{"entries": []}')
    for name in ("other.json", "c.txt"):
        if name == "c.txt":
            (tmp_path / name).write_text("x")
        with pytest.raises(ValueError):
            captures.read(spark, f"file://{tmp_path}/{name}")


def test_summaries_of_open_sources(spark):
    full = {"host": "a.test", "generated_at": "now", "dns": {"A": ["1.2.3.4"], "MX": [], "TXT": ["x"]}, "tls": {"issuer": "CA", "days_until_expiry": 9}, "subdomains": {"count": 40, "names": [f"s{i}" for i in range(40)]}, "ports": {"open": [{"port": 443, "service": "https"}]}, "files": {"robots": {"disallow": ["/x"] * 30}}, "notes": [], "email_security": {}, "technology": [{"name": "nginx", "evidence": "x"}]}
    got = {r["run"]: json.loads(r["summary"]) for r in osint.summary(spark.createDataFrame([("a", json.dumps(full)), ("b", "{}")], "run string, value string")).collect()}
    assert got["a"] == {
        "host": "a.test", "collected_at": "now", "dns": {"A": ["1.2.3.4"]}, "tls": {"issuer": "CA", "days_until_expiry": "9"}, "technology": ["nginx"], "subdomains_count": 40, "subdomains_sample": [f"s{i}" for i in range(25)],
        "robots_disallow": ["/x"] * 20, "open_ports": [443], "provenance": osint.PROVENANCE,
    }
    assert got["b"] == {"provenance": osint.PROVENANCE}


def test_drift_by_area(spark):
    schema = "id string, type string, label string, host string, path string, method string, api_state string"
    old = spark.createDataFrame([("e1", "endpoint", "* /api/x/{param}", "h", "/api/x/{param}", "*", "STATIC_ONLY"), ("e2", "endpoint", "GET /old", "h", "/old", "GET", None), ("t", "third_party", "cdn", None, None, None, None), ("s", "script", "a.js", "h", None, None, None)], schema)
    new = spark.createDataFrame([("e3", "endpoint", "GET /api/x/{id}", "h", "/api/x/{id}", "GET", "BOTH"), ("e4", "endpoint", "* /api/y", "h", "/api/y", "*", "STATIC_ONLY"), ("e5", "endpoint", "POST /admin/z", "h", "/admin/z", "POST", None), ("c", "cookie", "sid", None, None, None, None)], schema)
    areas = spark.createDataFrame([("GET /api/x/{id}", "x"), ("POST /admin/z", "admin")], "label string, area string")
    got = {(r["area"], r["change"], r["label"]): r["why"] for r in drift.by_area(old, new, areas).collect()}
    assert got == {
        ("x", "appeared", "GET /api/x/{id}"): drift.GAP_CLOSED, ("endpoint", "appeared", "* /api/y"): drift.NEW_ENDPOINT[1], ("admin", "appeared", "POST /admin/z"): drift.NEW_ENDPOINT[0], ("cookie", "appeared", "sid"): drift.APPEARED["cookie"],
        ("endpoint", "gone", "GET /old"): drift.GONE["endpoint"], ("third_party", "gone", "cdn"): drift.GONE["third_party"],
    }
