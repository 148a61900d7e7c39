"""The operators on pages, conversations and vectors, and the pipeline."""

from __future__ import annotations

import json

import numpy as np
import pytest
from compare import connection, duck_rows, spark_rows
from conftest import DOCS

import corpus_pipeline
from ethogrid.llm import additive, chat, queries, urlfilter


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(connection(sf_dir), queries.ORACLE[name])


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end].lower(), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p) for _, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_url_rules_equal_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    verdict = {h + p: v for v, h, p in urlfilter.RULES}
    for r in urlfilter.url_filter(pages).collect():
        assert (r.host, r.path, r.rule) == brute_rule(urls[r.page_id])
        assert r.verdict == verdict.get(r.rule, r.verdict) and r.verdict in ("allow", "block")


def test_url_odd_rows(spark):
    urls = [None, "foo", "", "HTTP://WWW.Example.com/en/a?b://c", "x://y://z/p#k/", "http://badexample.com/en/", "://net/es/x", "a://net?/es/", "http://h.net/fr/#é", "http://com", "http://example.com/en/"]
    df = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, trust string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.url_filter(df.union(df.limit(1))).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}
    assert urlfilter.url_filter(df.limit(0)).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://feeder.org/x", '<a href="http://bad.net/">'), (3, "http://far.org/x", "<a href='http://feeder.org/'>"), (4, "http://good.com/", '<a href="http://liked.org/a">'), (5, "http://liked.org/a", ""), (6, "http://lone.org/", "")]
    verdict = {r.page_id: r.verdict for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_chat_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("a", "early")), (1, 2, "assistant", call(("a", "search", {"query": "x"}), ("b", "fetch", '{"url": {"$result":"a"}}'), content="ok")),
        (1, 3, "tool", result("b", {"z": 1, "a": 2.0})), (1, 4, "tool", result("q", "?")),
        (2, 0, "assistant", call(("a", "search", {"limit": 0}), ("a", "search", {"query": "y"}))), (2, 1, "tool", result("a", 1)),
        (3, 0, "assistant", call(("x", "calculate", {"expression": {"$result": "y"}}), ("y", "calculate", {"expression": {"$result": "x"}}), ("w", "nope", {"k": {"$result": "none"}}))),
        (3, 1, "tool", result("x", 1)), (3, 2, "tool", result("y", 1)), (None, 0, "tool", result("a", 1)), (4, None, None, None), (4, 1, "user", '{"a": NaN}'), (4, 2, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, status string")
    linked = chat.link_tools(df)
    got = sorted(linked.collect(), key=lambda r: (r.conv_id or 0, r.order_key))
    order = [(r.kind, r.call_id) for r in got if r.conv_id == 1]
    assert order.index(("call", "a")) < order.index(("result", "a")) < order.index(("call", "b")) < order.index(("result", "b"))
    status = {(r.conv_id, r.kind, r.call_id, r.item): r.status for r in got if r.call_id}
    assert status[1, "result", "q", 0] == "orphan" and status[2, "call", "a", 0] == "linked" and status[2, "call", "a", 1] == "duplicate"
    assert status[3, "call", "x", 0] == status[3, "result", "y", 0] == "cyclic" and status[3, "call", "w", 2] == "waiting" and status[None, "result", "a", 0] == "orphan"
    errors = {(r.conv_id, r.call_id, r.item): r.error for r in got if r.kind == "call"}
    assert errors[2, "a", 0] == "$.query: missing" and errors[2, "a", 1] is None and errors[3, "w", 2] == "unknown tool" and errors[1, "b", 2] is None
    assert '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"b"}' in {r.json for r in got}
    assert all(json.loads(r.json) for r in chat.conversation_json(linked).collect())
    assert chat.link_tools(df.limit(0)).count() == 0


def test_chat_keeps_every_message(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = chat.link_tools(talks).collect()
    assert sorted((r.conv_id, r.turn, json.loads(r.json)["content"]) for r in rows) == sorted((r.conv_id, r.turn, r.text) for r in talks.collect())


def test_chat_bears_odd_json(spark):
    texts = [
        '{"tool_call_id":"a","content":1e400}', '{"tool_call_id":"a","content":-1e999}', '{"tool_call_id":"a","content":"\\ud800"}', '{"tool_call_id":"\\udfff"}',
        '{"tool_calls":[{"id":"a","name":"\\ud83d","arguments":{}}]}', '{"tool_call_id":"a","content":' + "[" * 5000 + "]" * 5000 + "}", '{"tool_call_id":"a","content":' + "9" * 5000 + "}",
        '{"tool_calls":[{"id":"b","name":"search","arguments":"{\\"query\\":1e999}"}]}', '{"tool_calls":{}}', '{"tool_calls":[1]}', "{", "{}", '{"tool_call_id":null}', "x" * 300_000,
    ]
    rows = chat.link_tools(spark.createDataFrame([(1, k, None, t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(texts)
    kinds = {r.turn: (r.kind, r.error) for r in rows}
    assert {k for k, v in kinds.items() if v[0] != "message"} == {7} and kinds[7] == ("call", "$: not JSON")
    assert all(json.loads(r.json)["content"] == texts[r.turn] for r in rows if r.kind == "message")


def test_chat_turns_of_any_sign(spark):
    turns = [None, -(1 << 63), -5, -1, 0, 3, (1 << 63) - 1]
    rows = chat.link_tools(spark.createDataFrame([(1, t, "user", str(t)) for t in reversed(turns)], "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted(rows, key=lambda r: r.order_key)] == turns


def test_chat_orders_as_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for conv in range(40):
        names = [f"c{k}" for k in range(int(rng.integers(1, 12)))]
        for turn in range(int(rng.integers(1, 25))):
            if rng.random() < 0.5:
                said = []
                for _ in range(int(rng.integers(1, 3))):
                    asks = [str(x) for x in rng.choice([*names, "gone"], int(rng.integers(0, 3)))]
                    said.append((str(rng.choice(names)), "search", {"query": [{"$result": a} for a in asks]}))
                rows.append((conv, turn, "assistant", call(*said)))
            else:
                rows.append((conv, turn, "tool", result(str(rng.choice(names)), turn)))
    # one chain of calls, each of which asks for the result of the one before
    rows += [(99, 2 * k, "assistant", call((f"c{k}", "search", {"query": {"$result": f"c{k - 1}"} if k else "x"}))) for k in range(1500)]
    rows += [(99, 2 * k + 1, "tool", result(f"c{k}", k)) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.item): (r.kind, r.call_id, r.status, r.order_key) for r in chat.link_tools(df, bucket=64).collect()}

    firsts, asks = {}, {}
    for conv, turn, _, text in rows:
        said = json.loads(text)
        items = [("result", said["tool_call_id"], [])] if "tool_call_id" in said else [("call", c["id"], sorted(chat._asked(c["arguments"]))) for c in said["tool_calls"]]
        for item, (kind, i, wanted) in enumerate(items):
            if (conv, kind, i) not in firsts:
                firsts[conv, kind, i] = (turn, item)
                asks[conv, kind, i] = [("result", w) for w in wanted] if kind == "call" else []
    for (conv, kind, i), wanted in asks.items():
        if kind == "result" and (conv, "call", i) in firsts:
            wanted.append(("call", i))
    place, grown = {}, True
    missing = {n for n in firsts if n[1] == "call" and any((n[0], "call", w) not in firsts or (n[0], "result", w) not in firsts for _, w in asks[n])}
    while grown:  # until nothing new can stand
        grown = False
        for n, (turn, _) in firsts.items():
            waits = [(n[0], *w) for w in asks[n]]
            if n not in place and all(w in place for w in waits):
                last = max((place[w] for w in waits), default=(-1, 0))
                place[n] = (turn, 0) if turn > last[0] else (last[0], last[1] + 1)
                grown = True
    for (conv, turn, item), (kind, i, status, key) in got.items():
        n = (conv, kind, i)
        if firsts[n] != (turn, item):
            assert status == "duplicate"
            continue
        answered = (conv, "result" if kind == "call" else "call", i) in firsts
        wanted = "waiting" if n in missing else "cyclic" if n not in place else "linked" if answered else "unanswered" if kind == "call" else "orphan"
        assert status == wanted, n
    for conv in {c for c, _, _ in got}:
        by_key = sorted((key, turn, item, kind, i) for (c, turn, item), (kind, i, _, key) in got.items() if c == conv)
        wanted = sorted((*(place.get((conv, kind, i), (turn, 0)) if firsts[conv, kind, i] == (turn, item) else (turn, 0)), turn, item) for _, turn, item, kind, i in by_key)
        assert [(turn, item) for _, turn, item, _, _ in by_key] == [(turn, item) for _, _, turn, item in wanted]
    assert max(d for _, d in place.values()) >= 1


def test_schemas_with_unknown_keywords_are_refused(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"patternProperties": {}}}}, {"items": [1]}, {"type": "text"}, {"anyOf": [{"if": True}]}):
        with pytest.raises(ValueError):
            chat.link_tools(df, {"t": schema})


@pytest.mark.parametrize(("value", "schema", "bad"), [
    (True, {"enum": [1]}, "$: not in enum"), (1.0, {"enum": [1]}, None), (1, {"const": True}, "$: not const"), (5, {"exclusiveMaximum": 3}, "$: out of range"), (3, {"exclusiveMinimum": 3}, "$: out of range"),
    (0.3, {"multipleOf": 0.1}, None), (7, {"multipleOf": 2}, "$: not a multiple"), ("abc", {"pattern": "^b"}, "$: pattern"), ([1, 1.0], {"uniqueItems": True}, "$: repeated items"), ([1, True], {"uniqueItems": True}, None),
    (5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, None), (5, {"anyOf": [{"type": "string"}]}, "$: none of anyOf"), (5, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "$: not one of oneOf"),
    (5, {"allOf": [{"minimum": 1}, {"maximum": 4}]}, "$: out of range"), (5, {"not": {"type": "integer"}}, "$: excluded"), ({}, {"minProperties": 1}, "$: length")])
def test_schema_keywords(value, schema, bad):
    assert chat.violation(value, schema) == bad


@pytest.mark.parametrize(("value", "schema", "bad"), [(1.0, {"type": "integer"}, None), (True, {"type": "number"}, "$: not number"), ([1, "a"], {"items": {"type": "integer"}}, "$[1]: not integer"), ({"a": {"b": 1}}, {"properties": {"a": {"additionalProperties": False}}}, "$.a.b: not allowed"), (7, {"maximum": 5}, "$: out of range"), (None, {"type": ["string", "null"]}, None)])
def test_schemas(value, schema, bad):
    assert chat.violation(value, schema) == bad


def test_nearest_has_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = rows.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {(r.query_id, r["rank"]): r for r in additive.nearest(rows, additive.Params(shortlist=100)).collect()}
    hits = 0
    queries_ = ids[ids % 50 == 0]
    for q in queries_:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hits += sum(got[q, k].vec_id in best for k in range(1, 6))
        assert all(abs(got[q, k].score - s[ids == got[q, k].vec_id][0]) < 1e-12 for k in range(1, 6))
    assert hits >= 0.95 * 5 * len(queries_) and len(got) == 5 * len(queries_)


def test_nearest_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (50, [1.0, None]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (6, [1.0, 0.1]), (7, [2.0, 0.2, 1.0]), (150, [0.0, 0.0, 2.0]), (6, [1.0, 0.1]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in additive.nearest(df).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 6), (0, 3, 100), (100, 1, 1), (100, 2, 6), (100, 3, 0), (150, 1, 7)]
    assert additive.nearest(df.limit(0)).count() == 0 and additive.nearest(df.where("vec_id = 0")).count() == 0


def test_nearest_of_one_large_group(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 3)))]
    got = additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), additive.Params(shortlist=20)).collect()
    assert {(r["rank"], r.vec_id) for r in got if r.query_id == 350} == {(k + 1, k) for k in range(5)}
    assert {(r["rank"], r.vec_id) for r in got if r.query_id == 0} == {(k, k) for k in range(1, 6)}


def test_pipeline(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).persist()
        counts.append(docs.count())
        assert k == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_pipeline_stages_bear_odd_rows(spark, sf_dir, odd):
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, sf_dir).collect()
        assert len(rows) <= 3 * odd.count(), name
        assert stage(spark, none, sf_dir).count() == 0, name
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, None, 3, 4, 5, 6, 7, 8]))


def test_ranks_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    hosts = [f"{n}.org" for n in "abcdefghij"] + ["bad.net", "worse.net", "good.com", "www.a.org", "x.y.b.org"]
    rows = []
    for k in range(120):
        path = "/es/" if rng.random() < 0.3 else "/p"
        links = "".join(f'<a href="http://{h}/q">' for h in rng.choice(hosts, int(rng.integers(0, 5))))
        rows.append((k, f"http://{rng.choice(hosts)}{path}", links))
    p = urlfilter.Params()
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).where("rule is null").collect()}

    # the same in plain loops over a dense graph, in floating point
    own, verdict = [], {h + p_: v for v, h, p_ in urlfilter.RULES}
    for _, url, _ in rows:
        host, _, rule = brute_rule(url)
        own.append((host, verdict.get(rule)))
    names = sorted({h for h, _ in own} | {brute_rule(x)[0] for _, _, html in rows for x in html.split('"')[1::2]} | {h.split(".", 1)[1] for h, _ in own if h.count(".") > 1})
    place = {h: k for k, h in enumerate(names)}
    edges = np.zeros((len(names), len(names)))
    for (host, _), (_, _, html) in zip(own, rows, strict=True):
        for target in {brute_rule(x)[0] for x in set(html.split('"')[1::2])}:
            if target != host:
                edges[place[host], place[target]] += 1
        if host.count(".") > 1:
            edges[place[host], place[host.split(".", 1)[1]]] += 1
            edges[place[host.split(".", 1)[1]], place[host]] += 1

    def rank(e, seeds):
        out = e.sum(axis=1, keepdims=True)
        move = np.divide(e, out, out=np.zeros_like(e), where=out > 0)
        start = seeds / max(seeds.sum(), 1)
        score = start
        for _ in range(p.rounds):
            score = start * (1 - p.passed / 100) + p.passed / 100 * score @ move
        return score

    seeds = {v: np.array([sum(1 for h, x in own if h == n and x == v) for n in names], float) for v in ("allow", "block")}
    trust, distrust = rank(edges, seeds["allow"]), rank(edges.T, seeds["block"])
    assert len(got) > 8 and {v for _, _, v in got.values()} == {"allow", "block"}
    for host, (t, d, v) in got.items():
        k = place[host]
        assert abs(t / p.unit - trust[k]) < 1e-9 and abs(d / p.unit - distrust[k]) < 1e-9
        assert v == ("block" if d > p.ratio * t else "allow")
    # beyond the bound for copies, pages join their hosts' scores, with the same result
    again = urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), urlfilter.Params(small=0))
    assert {r.host: (r.trust, r.distrust, r.verdict) for r in again.where("rule is null").collect()} == got


@pytest.mark.parametrize("schema", [{"multipleOf": 0}, {"multipleOf": -2}, {"minimum": "1"}, {"maximum": None}, {"maxLength": True}, {"exclusiveMinimum": float("nan")}, {"pattern": 3}, {"items": {"multipleOf": 0}}])
def test_schemas_with_odd_bounds_are_refused(schema):
    with pytest.raises(ValueError):
        chat.checked(schema)


def test_one_bucket_of_calls_needs_no_components(spark, monkeypatch):
    call = json.dumps({"tool_calls": [{"id": "c", "name": "search", "arguments": {"query": "x"}}]})
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "c", "content": "y"})), (1, 1, "assistant", call), (1, 2, "user", "hello")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = lambda bucket: sorted(map(tuple, chat.link_tools(frame, bucket=bucket).collect()), key=repr)
    several = told(1)
    monkeypatch.setattr(chat, "components", lambda links: pytest.fail("components of one bucket"))
    assert told(100) == several and "linked" in {r[5] for r in several}
