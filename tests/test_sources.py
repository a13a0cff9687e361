from __future__ import annotations

import json

import pytest

from granary.operators import compilation as C
from granary.sources import records, vault, snapshot

RECORDS = {
    "incentive": {"incentive_id": "I1", "name": "Capital help", "status": "rate_unstated", "category_rates": [{"enterprise_category": "micro", "rate_text": "5%"}], "source": {"source_id": "S", "source_url": "https://x", "page_start": None, "verification_status": "disputed"}, "odd_key": {"a": [1, None]}},
    "ambiguity_flag": {"id": "A1", "status": "open", "description": "what is unclear", "source_ids": ["S"]},
    "authority": {"authority_id": "U1", "type": "dept", "name": "Office", "source": {"source_url": ""}},
    "glossary_term": {"term_id": "T", "term": "Term", "definitions": [{"scheme_id": "X", "definition_text": "d" * 300}]},
}


@pytest.mark.parametrize("entity", RECORDS)
def test_front_matter_round_trip(entity):
    front = vault.to_front_matter(entity, RECORDS[entity], "test")
    assert front["type"] == vault.TYPE_OF[entity]
    assert vault.to_payload(front) == (entity, RECORDS[entity])


def test_notes_round_trip_through_files(spark, tmp_path):
    notes = [(f"{e}/{k}.md", json.dumps(vault.to_front_matter(e, r), ensure_ascii=False), f"body of {e}\nरकम [x](../y.md)\n") for k, (e, r) in enumerate(RECORDS.items())]
    df = spark.createDataFrame(notes, "path string, front string, body string")
    vault.write_notes(df, str(tmp_path / "vault"))
    (tmp_path / "vault" / "index.md").write_text("no note")
    (tmp_path / "vault" / "_templates").mkdir()
    (tmp_path / "vault" / "_templates" / "t.md").write_text("no note")
    (tmp_path / "vault" / "bad.md").write_text("no front matter")
    (tmp_path / "vault" / "list.md").write_text("---\n[1, 2]\n---\nx")
    (tmp_path / "vault" / "untyped.md").write_text("---\ntitle: t\nsources: [{\"id\": \"a\"}]\n---\nx")
    got = {r.path: r for r in vault.scan_notes(spark, str(tmp_path / "vault")).collect()}
    assert set(got) == {n[0] for n in notes} | {"bad.md", "list.md", "untyped.md"}
    for path, front, body in notes:
        assert json.loads(got[path].front) == json.loads(front)
        assert got[path].body == body and got[path].concept_id == path[:-3]
    errors = {(r.path, r.error) for r in vault.spec_errors(vault.scan_notes(spark, str(tmp_path / "vault"))).collect()}
    assert errors == {("authority/2.md", "source without resource"), ("bad.md", "front matter missing"), ("list.md", "front matter is no mapping"), ("untyped.md", "type missing"), ("untyped.md", "source without resource")}


@pytest.mark.parametrize(
    "token, base, want",
    [("[[a/b]]", None, "a/b"), ("/a/b.md#part", None, "a/b"), ("../b.md", "x/y/z.md", "x/b"), ("./b.md", "x/z.md", "x/b"), ("ID-1", None, "ID-1"), ("https://e.org", None, None), (None, None, None), ("#f", None, None), ("[[a|label]]", None, "a")],
)
def test_references(token, base, want):
    assert vault.resolve_reference(token, base) == want


def test_records(spark, tmp_path):
    folder = tmp_path / "records" / "district"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"district_id": "D", "name": "N", "state": "S"}))
    (folder / "b.json").write_text("{broken")
    assert [r.district_id for r in records.read_records(spark, str(tmp_path / "records"), "district").collect()] == ["D"]
    assert records.read_records(spark, str(tmp_path / "records"), "act").count() == 0


def test_chunk_sink_refuses_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "chunk_id string, text string")
    with pytest.raises(ValueError, match="repeated chunk ids"):
        records.write_chunks(df, str(tmp_path / "chunks"))
    assert not (tmp_path / "chunks").exists()


def test_compile_writes_nothing_while_there_are_errors(spark, tmp_path):
    ok, bad = spark.range(3), spark.range(1)
    assert C.write_if_clean({"t": ok}, [bad], str(tmp_path / "out")) == 1
    assert not (tmp_path / "out").exists()
    assert C.write_if_clean({"t": ok}, [bad.filter("id < 0")], str(tmp_path / "out")) == 0
    assert snapshot.read(spark, str(tmp_path / "out"))["t"].count() == 3
    assert C.write_if_clean({"t": spark.range(9)}, [bad, bad.filter("id < 0")], str(tmp_path / "out")) == 1
    assert snapshot.read(spark, str(tmp_path / "out"))["t"].count() == 3


def test_member_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" patna ",), ("Old Patna",), ("Gaya",), (None,)], "n string")
    got = [r[0] for r in df.select(C.normalize_member(F.col("n"), {"Patna": ["old patna"]})).collect()]
    assert got == ["Patna", "Patna", "Gaya", None]


def test_sources_come_from_the_registry_and_from_parts():
    registry = {"S": ("Title of S", "https://s"), "T": ("T", "https://t")}
    flag = vault.to_front_matter("ambiguity_flag", {"id": "A", "source_ids": ["S", "unknown", "S"]}, registry=registry)
    assert flag["sources"] == [{"id": "S", "resource": "https://s", "title": "Title of S"}] and vault.to_payload(flag)[1]["source_ids"] == ["S", "unknown", "S"]
    act = {"act_id": "X", "sections": [{"source": {"source_id": "T", "source_url": "", "verification_status": "disputed"}}, {"source": {"source_id": "T", "source_url": None, "page_start": 2}}, {}]}
    front = vault.to_front_matter("act", act, registry=registry)
    assert [(e["id"], e["resource"]) for e in front["sources"]] == [("T", "https://t")] and front["status"] == "draft"
    assert vault.to_payload(front) == ("act", act)
    district = {"district_id": "D", "source": {"source_id": "S", "source_url": "https://own"}}
    front = vault.to_front_matter("district", district, registry=registry)
    assert front["sources"] == [{"id": "S", "resource": "https://own", "title": "Title of S"}] and vault.to_payload(front) == ("district", district)


def test_records_and_notes_as_frames(spark):
    given = [(e, json.dumps(r, ensure_ascii=False)) for e, r in RECORDS.items()]
    back = vault.records_of(vault.notes_of(spark.createDataFrame(given, "entity string, record string"), "test")).collect()
    assert {r.entity: json.loads(r.record) for r in back} == RECORDS
    assert vault.notes_of(spark.createDataFrame([], "entity string, record string")).count() == 0


def test_roundtrip_joins_nothing_and_keeps_equal_records(spark, tmp_path):
    from granary.plans import render_queries as Q

    spark.sql("SELECT 1L AS n_nationkey, 'A' AS n_name").write.parquet(str(tmp_path / "nation.parquet"))
    spark.sql("SELECT 7L AS c_custkey, 'X' AS c_name FROM range(3)").write.parquet(str(tmp_path / "customer.parquet"))
    got = Q.vault_roundtrip(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in got.collect()) == ["D1", "I7", "I7", "I7"]
