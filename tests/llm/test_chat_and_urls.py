from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from granary.llm import chat_format as C
from granary.llm import url_filter as U

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 12}, "c": {"type": "array", "items": {"enum": [1, 2]}}}, "additionalProperties": False}}


def calls(*items):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in items]})


def result(i, content="x"):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 1, "user", "hi"),
    (1, 2, "assistant", calls(("c1", "add", {"b": "z", "a": 1.0}), ("c2", "add", {"a": -1, "x": 1}))),
    (1, 3, "tool", result("c2")),
    (1, 4, "tool", result("c1", {"b": 1, "a": [2.0]})),
    (1, 5, "assistant", calls(("c3", "add", {"a": 1, "b": "$result:c1"}), ("c1", "add", {"a": 1}))),
    (1, 6, "tool", result("c1", "again")),
    (1, 7, "tool", result("lost")),
    (1, 8, "assistant", calls(("l1", "add", {"a": 1, "b": "$result:l2"}), ("l2", "add", {"a": 1, "b": "$result:l1"}))),
    (1, 9, "assistant", calls(("u1", "nosuch", {}), (None, "add", '{"a": 2}'))),
    (1, 10, "assistant", "{not json"),
    (2, 0, "tool", result("early")),
    (2, 3, "assistant", calls(("early", "add", {"a": 3}))),
    (None, 1, "assistant", calls(("c1", "add", {"a": 1}))),
    (3, None, "user", None),
    (3, None, None, None),
]


def test_linking(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' as kind")
    got = {(r.conv_id, r.turn, r.part, r.role): r for r in C.link_calls(df, SCHEMAS).collect()}
    at = lambda t, p=0, c=1: next(r for k, r in got.items() if k[:3] == (c, t, p))
    assert at(2).status == "linked" and at(2).valid and at(2).json == '{"args":{"a":1,"b":"z"},"id":"c1","name":"add","type":"call"}'
    assert at(2, 1).errors == ["$.a:minimum", "$.x:additional"] and not at(2, 1).valid
    assert at(4).json == '{"content":{"a":[2],"b":1},"id":"c1","type":"result"}' and at(4).status == "linked"
    assert at(5).status == "unanswered" and (at(5).level, at(5).order_turn) == (2, 5)
    assert at(5, 1).status == "duplicate_call" and at(6).status == "duplicate_result" and at(7).status == "orphan"
    assert at(8).status == at(8, 1).status == "cyclic" and at(8).level is None
    assert at(9).errors == ["name:unknown"] and at(9, 1).errors == ["id:missing"] and at(9, 1).status == "unlinked"
    assert at(10).status == "none" and at(1).kind == "message"
    early, call = at(0, 0, 2), at(3, 0, 2)  # a result that stands before its call comes after it
    assert (call.order_turn, call.level) < (early.order_turn, early.level)
    assert at(1, 0, None).status == "unlinked" and len([k for k in got if k[0] == 3]) == 2
    assert C.link_calls(df.limit(0), SCHEMAS).count() == 0


def test_chain_of_references_orders_levels(spark):
    rows = [(1, 9 - k, "assistant", calls((f"c{k}", "add", {"a": 1} | ({"b": f"$result:c{k - 1}"} if k else {})))) for k in range(6)] + [(1, 20 + k, "tool", result(f"c{k}")) for k in range(6)]
    got = {r.call_id: r for r in C.link_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), SCHEMAS).filter("kind = 'call'").collect()}
    assert [got[f"c{k}"].level for k in range(6)] == [0, 2, 4, 6, 8, 10]
    assert [got[f"c{k}"].order_turn for k in range(6)] == [9, 20, 21, 22, 23, 24]


def test_canonical_json():
    assert C.canonical({"é": 1.0, "a": [True, None, 1.5, "\n"]}) == '{"a":[true,null,1.5,"\\n"],"é":1}'
    with pytest.raises(ValueError):
        C.canonical(float("nan"))
    assert C.violations({"c": [1, 3]}, SCHEMAS["add"]) == ["$.a:required", "$.c[1]:enum"] and C.violations([], SCHEMAS["add"]) == ["$:type"]


def test_chat_query_equals_sql(spark, sf_dir):
    import duckdb

    got = C.op10_chat_format(spark, sf_dir).toPandas()
    want = duckdb.sql(C.ORACLE.replace("FROM conversations", f"FROM '{sf_dir}/conversations.parquet'")).df()
    key = ["conv_id", "turn", "part"]
    a, b = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True).astype(str).replace({"None": "nan", "<NA>": "nan"}) for x in (got, want))
    assert a.equals(b)


URLS = [
    ("https://A.Example.ORG/en/1x?q", "a.example.org", "/en/1x", "example.org/en/1"),
    ("http://b.org/es/", "b.org", "/es/", "org/"),
    ("ftp://x.com/fr/1#f", "x.com", "/fr/1", "com/fr/"),
    ("x.com/fr/", "", "", None),
    (None, "", "", None),
    ("", "", "", None),
    ("http://notorg/a", "notorg", "/a", None),
    ("http://a.org", "a.org", "", None),
    ("http://a.org?x/y", "a.org", "", None),
    ("https://com/de/", "com", "/de/", "com/de/"),
    ("a://b.net/p://q/r", "b.net", "/p://q/r", None),
    ("http://É.org/x", "É.org", "/x", "org/"),
]


def test_urls(spark):
    weights = U.train(U.labelled_urls(spark))
    df = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)] + [(99, "https://cheap-casino-pills.example.com/en/5"), (98, "https://city-museum.example.net/en/5")], "page_id long, url string").selectExpr("*", "'mine' as path", "7 as extra")
    got = {r.page_id: r for r in U.judge(df, weights).collect()}
    for k, (_, host, path, rule) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), URLS[k]
        assert 0 < got[k].score < 1
    assert got[0].verdict == "block" and got[1].verdict == "allow" and got[9].verdict == "block"
    assert got[99].score > 0.5 > got[98].score and got[99].verdict == "block" and got[98].extra == 7
    assert U.judge(df.limit(0), weights).count() == 0


def test_url_training_without_rows(spark):
    weights = U.train(U.labelled_urls(spark).limit(0))
    assert weights == [0.0] * (U.BUCKETS + 1)


def test_url_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = U.judge(df, [0.0] * (U.BUCKETS + 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_training_equals_gradient_descent_on_the_weights(spark):
    """The dual form against plain gradient descent over the buckets, on the same hashed grams."""
    import numpy as np

    rows = U.add_host_path(U.labelled_urls(spark)).select("label", U.grams(F.col("host"), F.col("path")).alias("g")).collect()
    x = np.zeros((len(rows), U.BUCKETS + 1))
    for k, r in enumerate(rows):
        np.add.at(x[k], [g.b for g in r.g], [g.x for g in r.g])
    x[:, U.BUCKETS] = 1
    y, w = np.array([r.label for r in rows], float), np.zeros(U.BUCKETS + 1)
    for _ in range(U.STEPS):
        w = w * (1 - U.RATE * U.DECAY) + U.RATE / len(y) * (x.T @ (y - 1 / (1 + np.exp(-(x @ w)))))
    assert np.allclose(U.train(U.labelled_urls(spark)), w, atol=1e-9)


def hosts_of(spark, urls):
    return [r.host for r in U.add_host_path(spark.createDataFrame([(u,) for u in urls], "url string")).collect()]


def test_labelled_hosts_are_not_those_of_the_pages(spark, sf_dir):
    hosts = {h.host for h in U.add_host_path(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("host").distinct().collect()}
    assert not hosts & {r.host for r in U.add_host_path(U.labelled_urls(spark)).collect()}


def test_prefixes_and_ends_tell_nothing(spark):
    """Both classes get every prefix, end and path at about the same rate."""
    rows = [(U.made_up(kind, k), kind) for kind in ("unwanted", "ordinary") for k in range(400)]
    for part in (lambda u: u.split("//")[1].split(".")[0] in ("www", "blog", "m", "shop"), lambda u: ".example." in u, lambda u: "/fr/" in u):
        shares = [sum(part(u) for u, y in rows if y == kind) / 400 for kind in ("unwanted", "ordinary")]
        assert abs(shares[0] - shares[1]) < 0.08


def test_unseen_hosts(spark):
    """Names that the table doesn't have: unwanted ones behind any prefix are caught at 0.75 or more (0.79 measured), ordinary ones blocked at 0.03 or less (0.022)."""
    unwanted = [f"{p}{a}{j}{b}.example.{t}" for p in ("", "www.", "blog.", "m.") for a, b in (("casino", "win"), ("free", "bets"), ("cheap", "pills"), ("adult", "x"), ("spam", "farm"), ("ads", "track"), ("poker", "bonus"), ("porn", "tube")) for j in ("-",) for t in ("com", "net")]
    ordinary = [f"{p}{n}.example.{t}" for p in ("", "www.", "blog.", "m.") for n in ("ththat", "tiontion", "heonha", "ouqueaux", "einkeitst", "gartenhaus", "city-museum", "bread-and-salt", "lesdeuxmondes", "kirchturm", "oldtown", "lamaison", "elpueblo", "wanderweg", "tulips") for t in ("com", "net")]
    known = set(hosts_of(spark, [r.url for r in U.labelled_urls(spark).collect()]))
    weights = U.train(U.labelled_urls(spark))
    rows = [(f"https://{h}/{p}", y) for y, hosts in ((1, unwanted), (0, ordinary)) for h in hosts if h not in known for p in ("en/77", "es/9.html", "")]
    got = U.judge(spark.createDataFrame(rows, "url string, y int"), weights, rules=()).toPandas()
    caught, blocked = (got[got.y == 1].verdict == "block").mean(), (got[got.y == 0].verdict == "block").mean()
    assert caught >= 0.75 and blocked <= 0.03, (caught, blocked)


def test_long_and_repeated_urls(spark):
    long = "https://" + "a" * 5000 + ".net/" + "b/" * 50_000
    got = U.judge(spark.createDataFrame([(1, long), (1, long), (2, "://"), (3, "http:///x")], "page_id long, url string"), [0.0] * (U.BUCKETS + 1)).collect()
    assert [(r.page_id, len(r.host), len(r.path)) for r in got] == [(1, 5004, 100_001)] * 2 + [(2, 0, 0), (3, 0, 2)]


def test_lone_surrogates_and_long_texts(spark):
    rows = [(1, 1, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"add","arguments":{"a":1}}]}'), (1, 2, "assistant", '{"tool_calls":[{"id":"k","name":"add","arguments":"{\\"a\\":\\"\\\\udc00\\"}"}]}'), (1, 3, "tool", '{"tool_call_id":"\\udfff"}'), (2, 1, "user", "x " * 500_000), (2, 1, "user", "x " * 500_000), (3, 1, "assistant", calls(("d", "add", {"a": 1})).replace('"a": 1', '"a": 7, "a": 2'))]
    got = C.link_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), SCHEMAS).collect()
    assert sorted((r.conv_id, r.turn, r.kind, r.errors) for r in got) == [(1, 1, "message", []), (1, 2, "call", ["$:not_json"]), (1, 3, "message", []), (2, 1, "message", []), (2, 1, "message", []), (3, 1, "call", [])]
    assert next(r.json for r in got if r.conv_id == 3) == '{"args":{"a":2},"id":"d","name":"add","type":"call"}'
