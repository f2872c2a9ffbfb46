"""Parameters of nested bodies, assets of scripts, technologies, typed walks and packages, against small cases of known answers."""

import gzip
import json
import zlib
from collections import deque

import pytest
from pyspark.sql import functions as F

from tests.test_captures import column
from trailmark.functions import http
from trailmark.operators import extract, package, reach, reason, stack
from trailmark.plans import ingest_queries, model
from trailmark.schema import conform


def leaves(body):
    """By a walk over the parsed text."""
    out = []

    def walk(x, name, depth):
        if depth > 12:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{name}.{ {'jo@x.com': '{email}', '12345': '{id}'}.get(k, k)[:200] }", depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x[:5]):
                walk(v, f"{name}[{i}]", depth + 1)
        else:
            out.append(name)

    walk(json.loads(body), "$", 0)
    return sorted(out)


def test_json_leaves(spark):
    deep = 1
    for _ in range(13):
        deep = {"d": deep}
    bodies = [
        {"user": {"email": "a", "p": {"q": 1}}, "jo@x.com": 5, "l": [{"k": 1}, 2, 3, 4, 5, 6], "12345": None, "e": {}, "f": []}, [1, [2, {"x": "y"}]], "x", 3, None,
        {"deep": deep, "shallow": deep["d"]["d"]}, {"k" * 300: True, "a.b": 1.5, "ünï": "c"}, [[[[[[[[[[[[1]]]]]]]]]]]], [[[[[[[[[[[[[1]]]]]]]]]]]]],
    ]
    texts = [json.dumps(b) for b in bodies]
    got = column(spark, texts, lambda c: F.transform(http.json_leaves(c), lambda x: x["name"]))
    assert [sorted(x) for x in got] == [leaves(t) for t in texts]
    assert not any("@" in name for names in got for name in names)
    assert column(spark, ["nope", "", None, '{"a":1,"a":2}'], http.json_leaves) == [None] * 4
    params = column(spark, ['{"a":{"b":1}}', "a=1&b=2&a=3", "nope"], lambda c: F.transform(http.body_params(c, F.lit("application/json")), lambda p: p["name"]))
    assert params == [["$.a.b"], [], []]
    assert column(spark, ["a=1&b=&a=3"], lambda c: F.transform(http.body_params(c, F.lit("application/x-www-form-urlencoded")), lambda p: p["name"])) == [["a", "b", "a"]]


def test_inflation_is_bounded_and_takes_all_members(monkeypatch):
    import zstandard

    two = gzip.compress(b"one ") + gzip.compress(b"two")
    assert http._inflated(two, "gzip") == b"one two"
    assert http._inflated(zlib.compress(b"x" * 10), "deflate") == b"x" * 10
    raw = zlib.compressobj(wbits=-15)
    assert http._inflated(raw.compress(b"plain") + raw.flush(), "deflate") == b"plain"
    frames = zstandard.compress(b"a" * 1000) + zstandard.compress(b"b")
    assert http._inflated(frames, "zstd") == b"a" * 1000 + b"b"
    monkeypatch.setattr(http, "INFLATED", 100)
    assert http._inflated(zstandard.compress(b"a" * 1000), "zstd") == b"a" * 100
    assert http._inflated(gzip.compress(b"a" * 1000), "gzip") == b"a" * 100
    assert http._inflated(gzip.compress(b"a" * 60) * 2, "gzip") == b"a" * 100
    assert http._inflated(b"no", "gzip") is None and http._inflated(b"", "lzma") is None


def test_files_that_scripts_name(spark):
    cases = {
        "./w.js": ("h.test", "/static/js/w.js"), "w.js?x=1#y": ("h.test", "/static/js/w.js"), "../maps/a.map": ("h.test", "/static/maps/a.map"), "../../../../top.js": ("h.test", "/top.js"), "/sw.js": ("h.test", "/sw.js"),
        "//cdn.test/lib.js": ("cdn.test", "/lib.js"), "https://CDN.test:8443/a/b.js?q": ("cdn.test", "/a/b.js"), "https://cdn.test": None, "data:text/x": None, "blob:x": None, "a/{param}.js": None, "": None, "  ": None,
        ".": ("h.test", "/static/js/"), "a/./b/../c.js": ("h.test", "/static/js/a/c.js"), "x" * 250: None, "chunk-1f38ebe00b8f1bef.js": ("h.test", "/static/js/chunk-{hash}.js"),
    }
    got = column(spark, list(cases), lambda c: extract.resolved(c, F.lit("h.test"), F.lit("/static/js/app.js?v=2")))
    assert [tuple(x) if x else None for x in got] == list(cases.values())
    body = "new Worker('./w.js'); new SharedWorker(`s.js`); navigator.serviceWorker . register(\"/sw.js\"); importScripts('/a.js'); new Worker('bad\"); //# sourceMappingURL=app.js.map"
    named = column(spark, [body, None], lambda c: extract.resolved_assets(extract.script_assets(c, F.lit("/m.map")), F.lit("h.test"), F.lit("/s/app.js")))
    assert [tuple(x) for x in named[0]] == [("import_scripts", "h.test", "/a.js"), ("service_worker", "h.test", "/sw.js"), ("sourcemap", "h.test", "/m.map"), ("sourcemap", "h.test", "/s/app.js.map"), ("worker", "h.test", "/s/s.js"), ("worker", "h.test", "/s/w.js")]
    assert [tuple(x) for x in named[1]] == [("sourcemap", "h.test", "/m.map")]


def test_workers_and_source_maps_of_a_build(spark):
    script = [("worker", "shop.test", "/w.js"), ("sourcemap", "shop.test", "/got.map"), ("sourcemap", "shop.test", "/lost.map"), ("worker", "other.test", "/x.js")]
    rows = [(1, "/app.js", "application/javascript", 200, script), (2, "/got.map", "application/json", 200, []), (3, "/lost.map", "application/json", 404, []), (4, "/", "text/html", 200, [])]
    x = [(i, "GET", "shop.test", p, p, m, s, a) for i, p, m, s, a in rows]
    schema = "id long, method string, host string, path string, path_template string, mime string, status int, js_assets array<struct<kind string, host string, path string>>"
    built = model.build(conform(spark.createDataFrame(x, schema)), "shop", ["shop.test"], "shop.test")
    assert [(e["src"], e["dst"]) for e in built.edges.filter("type = 'SPAWNS'").collect()] == [("script:shop.test/app.js", "script:shop.test/w.js")]
    assert [u["we_know"] for u in built.unknowns.filter("type = 'SOURCE_MAP_NOT_CAPTURED'").collect()] == [["a source map is named: /lost.map"]]


def test_technologies(spark):
    df = spark.createDataFrame(
        [([("Server", "Apache/2.4.1 (Unix)"), ("X-AspNetMvc-Version", "5.2"), ("VIA", "1.1 Varnish")], ["wordpress_x", "TS01234567"], '<META NAME="generator" CONTENT="Hugo 0.121"><app-root> vue.min.js grecaptcha', "/signalr/x"),
         ([("server", "jetty(9.4)")], None, '<meta name="generator" content="WordPress.com"><script src=jquery.js></script>jquery-3.1.0.min.js', None), (None, None, None, None)],
        "h array<struct<name: string, value: string>>, c array<string>, b string, p string",
    )
    found = [[(s["category"], s["name"], s["how"], s["version"]) for s in r["s"]] for r in df.select(stack.detected(F.col("h"), F.col("c"), F.col("b"), F.col("p")).alias("s")).collect()]
    assert set(found[0]) == {
        ("Web server", "Apache", "header:server", "2.4.1"), ("Language & framework", "ASP.NET MVC", "header:x-aspnetmvc-version", "5.2"), ("Edge & CDN", "Varnish", "header:via", ""), ("CMS & platform", "WordPress", "cookie", ""),
        ("Edge & CDN", "F5 BIG-IP", "cookie", ""), ("API", "SignalR", "path", ""), ("Frontend", "Angular", "page", ""), ("Frontend", "Vue", "page", ""), ("Services", "reCAPTCHA", "page", ""), ("CMS & platform", "Hugo", "meta generator", "0.121"),
    }
    assert set(found[1]) == {("Web server", "Jetty", "header:server", "9.4"), ("CMS & platform", "WordPress", "meta generator", ""), ("Frontend", "jQuery", "page", "")}
    assert found[2] == []


NODES = [("h", "host", "shop.test"), ("p1", "route", "/a"), ("p2", "route", "/b"), ("s1", "script", "one.js"), ("s2", "script", "two.js"), ("e1", "endpoint", "GET /x"), ("e2", "endpoint", "GET /y"), ("e3", "endpoint", "GET /z"), ("q", "parameter", "id"), ("r", "role", "admin")]
EDGES = [
    ("h", "p1", "SERVES", "OBSERVED"), ("h", "p2", "SERVES", "OBSERVED"), ("p1", "s1", "INCLUDES", "OBSERVED"), ("p2", "s1", "INCLUDES", "OBSERVED"), ("s1", "s2", "SPAWNS", "INFERRED"), ("s2", "s1", "SPAWNS", "INFERRED"), ("s2", "e1", "REFERENCES", "INFERRED"),
    ("p2", "e2", "CALLS", "OBSERVED"), ("h", "e2", "EXPOSES", "OBSERVED"), ("e1", "q", "USES_PARAMETER", "OBSERVED"), ("r", "e3", "REACHED", "OBSERVED"), ("p1", "p2", "NAVIGATES_TO", "OBSERVED"), ("s2", "e1", "CALLS", "OBSERVED"), ("gone", "e3", "CALLS", "OBSERVED"),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(NODES, "id string, type string, label string"), spark.createDataFrame(EDGES, "src string, dst string, type string, state string")


def test_reach(small):
    nodes, edges = small
    got = {(r["start"], r["label"]): [(h["src"], h["type"], h["dst"]) for h in r["trail"]] for r in reach.reach(nodes, edges, nodes.select("id")).collect()}
    up = [("s1", "SPAWNS", "s2"), ("s2", "CALLS", "e1")]
    assert got == {
        ("e1", "/a"): [("p1", "INCLUDES", "s1"), *up], ("e1", "/b"): [("p2", "INCLUDES", "s1"), *up], ("q", "/a"): [("p1", "INCLUDES", "s1"), *up, ("e1", "USES_PARAMETER", "q")], ("q", "/b"): [("p2", "INCLUDES", "s1"), *up, ("e1", "USES_PARAMETER", "q")],
        ("s1", "/a"): [("p1", "INCLUDES", "s1")], ("s1", "/b"): [("p2", "INCLUDES", "s1")], ("s2", "/a"): [("p1", "INCLUDES", "s1"), up[0]], ("s2", "/b"): [("p2", "INCLUDES", "s1"), up[0]],
        ("e2", "/b"): [("p2", "CALLS", "e2")], ("e2", "shop.test"): [("h", "EXPOSES", "e2")],
    }
    assert {(r["start"], r["label"]) for r in reach.reach(nodes, edges, nodes.filter("id = 'e2'").select("id"), 1).collect()} == {("e2", "/b")}
    assert reach.reach(nodes, edges, nodes.filter("id = 'r'").select("id")).count() == 0


def test_areas_are_reached(small, spark):
    areas = spark.createDataFrame([("e1", "x"), ("e2", "x"), ("e3", "z")], "id string, area string")
    assert {tuple(r) for r in reach.area_reach(*small, areas).collect()} == {("x", "/a", "code"), ("x", "/b", "code"), ("x", "shop.test", "traffic")}


def test_page_calls_and_blast(small):
    nodes, edges = small
    got = {(r["start"], r["endpoint"]): (r["via"], r["type"], r["hops"]) for r in reach.page_calls(nodes, edges, nodes.filter("id in ('h', 'p1', 's2', 'e3')").select("id")).collect()}
    assert got == {("h", "e2"): ("h", "EXPOSES", 1), ("h", "e1"): ("s2", "CALLS", 4), ("p1", "e2"): ("p2", "CALLS", 2), ("p1", "e1"): ("s2", "CALLS", 3), ("s2", "e1"): ("s2", "CALLS", 1)}
    for direction, at, to in (("out", 0, 1), ("in", 1, 0)):
        for depth in (1, 3, 6):
            found = {(r["start"], r["id"]): r["hop"] for r in reach.blast(nodes, edges, nodes.select("id"), direction, depth).collect()}
            want = {}
            known = {n[0] for n in NODES}
            for start in known:
                queue, seen = deque([(start, 0)]), {start}
                while queue:
                    cur, d = queue.popleft()
                    for e in EDGES:
                        if d < depth and e[at] == cur and e[2] in reach.FLOW_EDGES and e[to] in known and e[to] not in seen:
                            seen.add(e[to])
                            want[start, e[to]] = d + 1
                            queue.append((e[to], d + 1))
            assert found == want


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(i, "GET" if i % 3 else "POST", "shop.test", f"/api/{'admin' if i % 5 == 0 else 'item'}/r{i % 60}", 200 if i % 7 else 403, ["user", "admin", None][i % 3], ["bearer"] if i % 2 else [], [f"p{i % 20:02}"]) for i in range(1, 400)]
    rows += [(900 + i, "GET", "shop.test", f"/page{i}", 200, "user", [], []) for i in range(50)]
    rows = [(i, m, h, p, p, s, r, c, q, "text/html" if i >= 900 else "application/json") for i, m, h, p, s, r, c, q in rows]
    x = conform(spark.createDataFrame(rows, "id long, method string, host string, path string, path_template string, status int, role string, credentials array<string>, query_params array<string>, mime string"))
    return model.build(x, 'a "shop"', ["shop.test"], "shop.test", fold=False)


def parsed(row):
    return json.loads(row["document"])


def cites(x):
    if isinstance(x, dict):
        return {e for k, v in x.items() for e in (v if k == "evidence" and isinstance(v, list) else cites(v))}
    return {e for v in x for e in cites(v)} if isinstance(x, list) else set()


def test_package(shop):
    row = package.document(shop).first()
    doc = parsed(row)
    assert doc["app"] == 'a "shop"' and doc["scope"] == ["shop.test"] and doc["roles"] == ["admin", "user"]
    ends, pages = shop.nodes.filter("type = 'endpoint'").count(), shop.nodes.filter("type = 'route'").count()
    assert doc["shape"]["endpoint"] == ends >= 60 and pages == 50
    assert doc["coverage"]["endpoints"] == f"40/{ends} (capped)" and doc["coverage"]["routes"] == "40/50 (capped)" and doc["coverage"]["auth"] == "1/1"
    assert len(doc["endpoints"]) == len(doc["routes"]) == 40
    assert all(1 <= len(e["evidence"]) <= 3 and len(e["params"]) <= 12 for e in doc["endpoints"])
    assert cites({k: v for k, v in doc.items() if k != "evidence"}) == set(doc["evidence"])
    assert row["n_cited"] == len(doc["evidence"]) and row["token_estimate"] == len(row["document"]) // 4
    graph = doc["graph"]
    assert set(graph) == {"nodes", "adjacency", "entry_points", "hubs", "communities", "trust_zones", "cross_area", "to_third_party", "execution_flows"}
    assert len(graph["nodes"]) == 60 and not {"parameter", "operation"} & {n["type"] for n in graph["nodes"]}
    assert all(len(a["to"]) <= package.NEIGHBOURS for a in graph["adjacency"]) and {a["id"] for a in graph["adjacency"]} <= {n["id"] for n in graph["nodes"]}
    assert all(f["hops"][-1]["dst"].startswith("endpoint:") and f["entry"] == "shop.test" for f in graph["execution_flows"]) and len(graph["execution_flows"]) == 25
    assert sum(1 for _ in graph["hubs"]) == 10


def test_package_scopes_and_budget(shop):
    doc = parsed(package.document(shop, "endpoints", "auth", cap=5).first())
    assert set(doc) == {"app", "scope", "endpoints", "coverage", "evidence"} and len(doc["endpoints"]) == 5
    whole = parsed(package.document(shop, "open").first())
    few = package.document(shop, "open", budget=600).first()
    kept = parsed(few)
    assert set(kept) == {"app", "unknowns", "endpoints", "coverage", "evidence"}
    shown = [*kept["endpoints"], *kept["unknowns"]]
    assert shown == [*whole["endpoints"], *whole["unknowns"]][: len(shown)] and 0 < len(shown) < 80
    assert kept["coverage"]["unknowns"].startswith("0/") and cites(shown) == set(kept["evidence"])
    with pytest.raises(ValueError):
        package.document(shop, "nothing")
    with pytest.raises(ValueError):
        package.document(shop, lens="nothing")


def test_plans(shop):
    areas = reason.with_area(shop.nodes).filter("type IN ('endpoint', 'route')").select("id", "area")
    doc = parsed(package.document(shop, "falsify", budget=4000, areas=areas).first())
    assert doc["instructions"] == package.INSTRUCTIONS["falsify"] and set(doc) >= {"plan", "graph", "endpoints", "unknowns", "evidence"}
    assert doc["plan"]["recon"][0]["step"] == "confirm the map is complete" and doc["plan"]["posture"][0]["privileged"] > 0
    lines = doc["plan"]["lines_of_inquiry"]
    assert [x["leverage"] for x in lines] == sorted((x["leverage"] for x in lines), reverse=True) and lines[0]["leverage"] > 0
    assert all(len(x["endpoints"]) <= 20 and len(x.get("open_questions", [])) <= 6 and x["reach"] == ["from shop.test (via traffic)"] for x in lines)
    assert "contains privileged-looking endpoints" in " ".join(x["why_it_matters"] for x in lines)
    assert cites({k: v for k, v in doc.items() if k != "evidence"}) == set(doc["evidence"])


def test_package_of_nothing(spark):
    empty = model.build(conform(spark.createDataFrame([], "id long")), "none")
    doc = parsed(package.document(empty).first())
    assert doc["endpoints"] == [] and doc["evidence"] == {} and doc["coverage"]["endpoints"] == "0/0"


def test_labels_of_communities(spark):
    """Against the same rounds over dictionaries."""
    kinds = ["route", "script", "endpoint", "endpoint", "third_party", "parameter", "host"]
    named = [(f"n{i:02}", kinds[i % 7], f"/area{i % 5}/x{i}" if kinds[i % 7] in ("route", "endpoint") else None, f"l{i}") for i in range(42)]
    linked = [(f"n{i:02}", f"n{(i * k + 3) % 42:02}", "CALLS", "OBSERVED") for i in range(42) for k in (2, 5) if (i * k) % 4]
    nodes = spark.createDataFrame(named, "id string, type string, path string, label string")
    edges = spark.createDataFrame(linked, "src string, dst string, type string, state string")
    near = {n[0]: set() for n in named}
    for a, b, *_ in linked:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    kind = {n[0]: n[1] for n in named}
    shell = {i for i in kind if kind[i] in ("route", "script") and len(near[i]) > max(12, 0.2 * len(kind))}
    held = {i for i in kind if kind[i] in reason.LEAVES + reason.CONNECTORS} | shell
    area = {r["id"]: r["area"] for r in reason.with_area(nodes).collect()}
    for a in {v for i, v in area.items() if v and i not in held and kind[i] in ("route", "endpoint")}:
        hub, *rest = sorted(i for i in kind if area[i] == a and i not in held and kind[i] in ("route", "endpoint"))
        for i in rest:
            near[i].add(hub)
            near[hub].add(i)
    label = {i: i for i in kind if i not in held}

    def voted(ids):
        counts = {}
        for i in ids:
            if i in label:
                counts[label[i]] = counts.get(label[i], 0) + 1
        return min(counts, key=lambda x: (-counts[x], x)) if counts else None

    for _ in range(reason.ROUNDS):
        label = {i: voted(near[i] | {i}) for i in label}
    label |= {i: x for i in held if (x := voted(near[i]))}
    assert {r["id"]: r["community"] for r in reason.communities(nodes, edges).collect()} == label
    assert 1 < len(set(label.values())) < len(kind)


def test_reach_carries_no_trails_through_its_fronts(spark, monkeypatch):
    """Fronts have a fixed width however long the walk; trails of four hops are the smallest of the shortest, against all walks."""
    kinds = {"h": "host", "p": "route", "q": "route"} | dict.fromkeys(("a1", "a2", "b1", "b2", "c1", "c2"), "script") | {"e1": "endpoint", "e2": "endpoint"}
    nodes = spark.createDataFrame([(i, k, f"label {i}") for i, k in kinds.items()], "id string, type string, label string")
    rows = [("h", "a1", "SERVES"), ("h", "a2", "LOADS"), ("p", "b1", "LOADS"), ("q", "a1", "LOADS"), ("a1", "b1", "CALLS"), ("a1", "b2", "LOADS"), ("a2", "b1", "LOADS"), ("a2", "b2", "CALLS"), ("b1", "c1", "SPAWNS")]
    rows += [("b1", "c2", "LOADS"), ("b2", "c1", "CALLS"), ("b2", "c2", "SPAWNS"), ("c1", "e1", "CALLS"), ("c2", "e1", "REFERENCES"), ("c2", "e2", "CALLS"), ("c1", "a1", "LOADS"), ("b1", "a2", "LOADS")]
    edges = spark.createDataFrame([(*r, "OBSERVED") for r in rows], "src string, dst string, type string, state string")
    written, settle = [], reach.settle
    monkeypatch.setattr(reach, "settle", lambda df, name: written.append((name, df.columns)) or settle(df, name))
    got = {(r["start"], r["entry"]): (r["hops"], [tuple(h) for h in r["trail"]]) for r in reach.reach(nodes, edges, nodes.filter("type = 'endpoint'").select("id")).collect()}
    want = {}
    for start in ("e1", "e2"):
        walks, seen = [(start, [])], {start}
        while walks:
            back = sorted(([(s, k, "OBSERVED", d), *trail] for at, trail in walks for s, d, k in rows if d == at and s not in seen))
            best = {}
            for trail in back:
                best.setdefault(trail[0][0], trail)
            seen |= set(best)
            want |= {(start, s): (len(t), t) for s, t in best.items() if kinds[s] in reach.ENTRY_TYPES}
            walks = [(s, t) for s, t in best.items() if kinds[s] not in reach.ENTRY_TYPES]
    assert got == want and max(h for h, _ in got.values()) == 4
    assert [c for n, c in written if n == "front"] and all("trail" not in c for n, c in written if n == "front")


def test_json_parameters_work_in_many_tasks(spark):
    """One small file is not one task."""
    assert ingest_queries.json_parameters(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
