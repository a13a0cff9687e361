"""Versioned sets of tables, incremental compiles, and rules declared on tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import constraints as K
from granary.operators import incremental as I
from granary.sources import snapshot as S

# --- versioned sets


def ids(spark, folder, name, version=None):
    return sorted(r.id for r in S.read(spark, folder, version)[name].collect())


def test_a_write_that_dies_midway_leaves_the_set_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert S.read(spark, folder) == {} and S.manifest(spark, folder) is None
    first = S.write({"a": spark.range(3), "b": spark.range(2)}, folder)
    assert first.version == 0 and first.tables["a"]["rows"] == 3

    def broken(batches):
        for b in batches:
            yield b
        raise RuntimeError("the task dies")

    dying = spark.range(100, 200, numPartitions=2).mapInPandas(broken, "id long")
    with pytest.raises(Exception, match="the task dies"):
        S.write({"a": spark.range(50), "b": dying}, folder)  # a has been written in full by then
    assert S.versions(spark, folder) == [0]
    assert ids(spark, folder, "a") == [0, 1, 2] and ids(spark, folder, "b") == [0, 1]

    S.write({"b": spark.range(5)}, folder, expected=0)
    assert ids(spark, folder, "a") == [0, 1, 2] and len(ids(spark, folder, "b")) == 5  # a is taken over
    assert len(ids(spark, folder, "b", version=0)) == 2
    gone = S.expire(spark, folder)
    assert len(gone) == 3 and S.versions(spark, folder) == [1]  # both parts of the dead write, and the old b
    assert ids(spark, folder, "a") == [0, 1, 2] and len(ids(spark, folder, "b")) == 5


def test_one_of_two_writers_wins(spark, tmp_path):
    folder = str(tmp_path / "set")
    S.write({"a": spark.range(1)}, folder)
    S.publish(spark, folder, 1, S.manifest(spark, folder).tables)
    with pytest.raises(S.Conflict):
        S.publish(spark, folder, 1, {})
    with pytest.raises(S.Conflict):
        S.write({"a": spark.range(9)}, folder, expected=0)
    assert S.versions(spark, folder) == [0, 1] and ids(spark, folder, "a") == [0]


def test_errors_refuse_a_set(spark, tmp_path):
    folder = str(tmp_path / "set")
    with pytest.raises(S.Rejected) as e:
        S.write({"a": spark.range(1)}, folder, {"refs": spark.range(1), "names": spark.range(0)})
    assert e.value.names == ["refs"] and not (tmp_path / "set").exists()
    S.write({"a": spark.range(1).filter("id > 5")}, folder, {"names": spark.range(0)})
    assert S.manifest(spark, folder).tables["a"]["rows"] == 0 and ids(spark, folder, "a") == []


# --- incremental compile

NOTE = "id long, text string, refs array<long>"


def links(notes):
    return notes.select(F.col("id").alias("src"), F.explode("refs").alias("dst"))


def closure(some, every):
    """id and the sorted texts of all notes that a note reaches, by plain Python over the collected notes (the full rule)."""
    rows = {r.id: r for r in every.collect()}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in rows[todo.pop()].refs or []:
                if j in rows and j not in seen:
                    seen.add(j)
                    todo.append(j)
        return "|".join(sorted(rows[j].text or "" for j in seen))

    made = [(r.id, reach(r.id)) for r in some.select("id").collect()]
    return some.sparkSession.createDataFrame(made, "id long, reached string")


@pytest.mark.parametrize("seed", range(3))
def test_delta_equals_full(spark, seed):
    rng = random.Random(seed)
    old = {i: (f"t{i}", [rng.randrange(45) for _ in range(rng.choice([0, 0, 1, 2]))]) for i in range(40)}  # cycles, self and dangling references
    new = dict(old)
    for i in rng.sample(range(40), 3):
        new[i] = (old[i][0] + "!", old[i][1])
    new.pop(rng.randrange(40))
    new[41] = ("late", [rng.randrange(40)])
    frame = lambda d: spark.createDataFrame([(i, t, r) for i, (t, r) in d.items()], NOTE)
    before, after = frame(old), frame(new)
    got, report = I.compile_delta(before, closure(before, before), after, links, closure, "id", ["text", "refs"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closure(after, after).collect()))
    again = {r.id: (r.change, r.ring) for r in report.collect()}
    assert {i for i, (c, _) in again.items() if c != "dependent"} == {i for i in old.keys() | new.keys() if old.get(i) != new.get(i)}
    assert all((c == "dependent") == (ring > 0) for c, ring in again.values())


def test_nothing_changed_makes_nothing(spark):
    notes = spark.createDataFrame([(1, "a", [2]), (2, None, None)], NOTE)
    done = closure(notes, notes)
    got, report = I.compile_delta(notes, done, notes, links, closure, "id", ["text", "refs"])
    assert report.count() == 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, done.collect()))


def test_breadcrumbs_equal_sql_on_letters_without_capitals(spark, tmp_path):
    import duckdb

    from granary.plans import compile_queries as Q

    rows = [(i, t) for i, t in enumerate(["Große Maße\n\nß", "a\x0bb \t\r\fc", "ﬁne ŉ", None, "", "ßßßßßßßßßßßß and twenty more"] * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("incremental_compile", "incremental_report"):
        got = sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.execute(Q.SQL[name]).fetchall(), key=repr)


# --- rules


def broken(tables):
    return sorted((r.table, r.row, r.rule, r.detail) for r in K.violations(tables).collect())


def test_rules_on_nested_fields(spark):
    kind = "id string, type string, title string, rates array<struct<category:string,value:string>>, refs array<string>, source struct<page:int,name:string>"
    rows = [
        ("a", "incentive", "Aid", [("micro", "5"), ("tiny", "x")], ["b", "gone"], (3, "doc")),
        ("b", "rule", " ", None, None, (0, None)),
        ("c", None, "A long title", [(None, None)], ["a"], None),
        ("c", "rule", "Aid", [], [], (7, "doc")),
        (None, "rule", "Aid", [], ["b"], (7, "doc")),
    ]
    t = K.Table("records", spark.createDataFrame(rows, kind), "id", [
        K.required("type"), K.required("title"), K.one_of("type", ("incentive", "rule")), K.length("title", 0, 8), K.one_of("rates[].category", ("micro", "small")), K.number("rates[].value", 0, 100),
        K.number("source.page", 1), K.required("source.name", when="type = 'rule'"), K.items("rates", 1, when="type = 'incentive' or id = 'c'"), K.Resolve("refs[]", "records", "id"), K.Unique(("id",)),
    ])
    assert broken([t]) == sorted([
        ("records", "a", "enum", "rates[].category"), ("records", "a", "number", "rates[].value"), ("records", "a", "resolve", "refs[]=gone"),
        ("records", "b", "required", "title"), ("records", "b", "number", "source.page"), ("records", "b", "required_if", "source.name"),
        ("records", "c", "required", "type"), ("records", "c", "length", "title"), ("records", "c", "items", "rates"), ("records", "c", "unique", "id"), ("records", "c", "unique", "id"),
    ])


def test_references_between_tables_are_one_join_a_target(spark):
    docs = K.Table("docs", spark.createDataFrame([(1,), (2,)], "k long"), "k")
    a = K.Table("a", spark.createDataFrame([(1, 1), (2, 9), (3, None)], "k long, doc long"), "k", [K.Resolve("doc", "docs", "k")])
    b = K.Table("b", spark.createDataFrame([("x", "2"), ("y", "8")], "k string, d string"), "k", [K.Resolve("d", "docs", "k", when="k = 'y'")])
    assert broken([docs, a, b]) == [("a", "2", "resolve", "doc=9"), ("b", "y", "resolve", "d=8")]
    plan = K.violations([docs, a, b])._jdf.queryExecution().analyzed().toString()
    assert plan.count("LeftAnti") == 1


def test_coercions_to_lists(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, '"a"'), (3, '{"name": "x"}'), (4, "null"), (5, None), (6, '[{"name": "x"}, {"name": null}]'), (7, "[]")], "k int, j string").withColumn("v", F.try_parse_json("j"))
    got = df.orderBy("k").select(K.as_list(F.col("v"), "string").alias("s"), K.as_list(F.col("v"), "struct<name:string>").alias("m")).collect()
    assert [r.s for r in got[:2]] == [["a", "b"], ["a"]] and [r.s for r in got[3:5]] == [[], []] and got[6].s == []
    assert [x.name for x in got[2].m] == ["x"] and [x.name for x in got[5].m] == ["x", None] and got[3].m == []
