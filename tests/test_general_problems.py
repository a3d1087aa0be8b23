"""Nested records and orphan references against plain Python."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.operators import nested, references

L = "SUPPORTS"


def rows(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id long, payload string, v string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_shapes_and_childless_parents(spark):
    good = [
        {"label": L, "claim": "a", "evidence": [[[1, 2, "P", 3], [4, None, None, None]], [], {"items": [{"wiki_page": "Q", "sentence_id": "5"}, [1, 1, "R", "2"]]}]},
        {"claim": "b", "label": L},
        {"claim": "c", "label": L, "evidence": None},
        {"claim": "d", "label": L, "evidence": [], "zz": {"n": [1, {"k": 2}]}},
        {"claim": "e", "label": L, "evidence": [None, {"items": None}, {"other": 1}]},
    ]
    got = found(nested.evidence_rows(rows(spark, map(json.dumps, good))))
    assert got == sorted(
        [
            (0, 0, 0, "P", 3), (0, 0, 1, "", -1), (0, 1, -1, "", -1), (0, 2, 0, "Q", 5), (0, 2, 1, "R", 2),
            (1, -1, -1, "", -1), (2, -1, -1, "", -1), (3, -1, -1, "", -1), (4, 0, -1, "", -1), (4, 1, -1, "", -1), (4, 2, -1, "", -1),
        ]
    )


def test_invalid_payloads_give_no_row(spark):
    whole = json.dumps({"label": L, "claim": "a"})
    assert found(nested.evidence_rows(rows(spark, [f" {whole}\n"]))) == [(0, -1, -1, "", -1)]
    bad = [whole + " x", whole + "}", whole + "]", whole + "]}", whole + "}]", whole + "," + whole, None, "", "{", "[]", "3", '"x"', json.dumps({"label": "OTHER", "claim": "a"}), json.dumps({"label": L, "claim": "  \t"}), json.dumps({"label": L, "claim": None}),
           json.dumps({"label": L, "claim": 7}), json.dumps({"label": None, "claim": "a"}), json.dumps({"label": L, "claim": "a", "evidence": [[[1, 2, "P"]]]}),
           json.dumps({"label": L, "claim": "a", "evidence": [[{"wiki_page": "P"}], [[1, 2, "P", 3, 4]]]})]
    assert found(nested.evidence_rows(rows(spark, bad))) == []


def test_tables_link_to_their_parents(spark):
    data = rows(spark, [json.dumps({"id": 9, "record_id": 1, "label": L, "claim": "a", "evidence": [[[1, 2, "P", 3]], []]}), json.dumps({"label": L, "claim": "b", "n": 1.5})])
    t = nested.flatten_evidence(data)
    assert {r.record_id: r.n_sets for r in t["records"].collect()} == {0: 2, 1: 0}
    assert "record_id_payload" in t["records"].columns
    assert found(t["sets"]) == [(0, 0, 1), (0, 1, 0)]
    assert found(t["items"]) == [(0, 0, 0, 1, 2, "P", 3)]


def test_every_member_and_array_gets_its_place(spark):
    data = [
        {"label": L, "claim": "a", "id": 7, "meta": {"batch": 3, "review": {"by": "x", "rounds": [1, 2]}}, "odd": 5,
         "evidence": [{"note": "n", "items": [{"wiki_page": "P", "annotator": {"group": 8, "tags": ["t", "u"]}}]}, [[1, 2, "Q", 3]]]},
        {"label": L, "claim": "b", "id": "8", "odd": {"k": 1}, "grid": [[1], [2, 3]]},
        {"label": L, "claim": "c", "odd": ["z", {"k": 2}]},
    ]
    t = nested.flatten_evidence(rows(spark, map(json.dumps, data)))
    by = {n: {tuple(r[c] for c in df.columns if c in r.asDict()): r.asDict() for r in df.collect()} for n, df in t.items()}
    assert {(r["id"], r["meta_batch"], r["meta_review_by"], r["odd"], r["odd_k"]) for r in by["records"].values()} == {("7", 3, "x", "5", None), ("8", None, None, None, 1), (None, None, None, None, None)}
    assert [r["note"] for r in by["sets"].values() if r["note"]] == ["n"]
    assert sorted((r["evidence_set_id"], r["annotator_group"]) for r in by["items"].values()) == [(0, 8), (1, None)]
    assert found(t["records.meta_review_rounds"]) == [(0, 0, 1), (0, 1, 2)]
    assert found(t["items.annotator_tags"]) == [(0, 0, 0, 0, "t"), (0, 0, 0, 1, "u")]
    assert found(t["records.grid.value"]) == [(1, 0, 0, 1), (1, 1, 0, 2), (1, 1, 1, 3)]
    assert {(r["odd_position"], r["value"], r["k"]) for r in by["records.odd"].values()} == {(0, "z", None), (1, None, 2)}
    cells = {tuple(r.ordinals) for r in nested.flat_cells(t).where("table_name = 'items.annotator_tags'").collect()}
    assert cells == {(0, 0, 0), (0, 0, 1)}


def test_empty_table(spark):
    t = nested.flatten_evidence(rows(spark, []))
    assert [t[k].count() for k in ("records", "sets", "items")] == [0, 0, 0]
    assert nested.evidence_rows(rows(spark, [])).count() == 0


def test_object_members():
    assert nested.object_members("OBJECT<a: ARRAY<OBJECT<x: BIGINT>>, `b c`: STRING, d: VARIANT>") == {"a": "ARRAY<OBJECT<x: BIGINT>>", "b c": "STRING", "d": "VARIANT"}
    assert nested.object_members("VOID") == {}


T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(seconds=n)


def orphans(spark, refs, parents, width=4):
    r = spark.createDataFrame([(i, p, s, at(t), "clash") for i, (p, s, t) in enumerate(refs)], "evidence_row_id long, wiki_page string, sentence_id int, recorded_at timestamp_ntz, at string")
    p = spark.createDataFrame([(a, b, at(c), at(d), 1) for a, b, c, d in parents], "page_id string, sentence_id int, loaded_at timestamp_ntz, removed_at timestamp_ntz, ref int")
    return {x.evidence_row_id: x.reason for x in references.wiki_orphans(r, p, width).collect()}


def brute(refs, parents):
    out = {}
    for i, (p, s, t) in enumerate(refs):
        if p is None or s is None or t is None:
            continue
        mine = [(a, b) for q, u, a, b in parents if q == p and u == s and a is not None and (b is None or b > a)]
        if any(a <= t and (b is None or b > t) for a, b in mine):
            continue
        out[i] = "withdrawn" if any(a <= t for a, _ in mine) else "not_loaded" if mine else "missing"
    return out


def test_live_intervals_with_ties_nulls_and_repeats(spark):
    refs = [("A", 0, 5), ("A", 0, 10), ("A", 0, 9), ("A", 0, 20), ("A", 1, 5), ("a", 0, 5), (None, 0, 5), ("A", None, 5), ("A", 0, None), ("A", 0, 5), ("B", 0, 1)]
    parents = [("A", 0, 5, 10), ("A", 0, 5, 10), ("A", 0, 15, 18), ("A", 0, 3, 4), ("B", 0, 2, None), (None, 0, 1, None), ("A", 1, None, None), ("A", 1, 9, 9)]
    assert orphans(spark, refs, parents) == brute(refs, parents)


@pytest.mark.parametrize("width", [1, 3, 16])
def test_hot_key_over_many_tasks(spark, width):
    refs = [("H", 1, t % 500) for t in range(900)] + [("C", t % 7, t) for t in range(60)]
    parents = [("H", 1, 30 * k, 30 * k + 17) for k in range(16)] + [("C", k, 10 * k, None) for k in range(5)]
    assert orphans(spark, refs, parents, width) == brute(refs, parents)


def test_no_parents_and_no_references(spark):
    assert orphans(spark, [("A", 0, 5)], []) == {0: "missing"}
    assert orphans(spark, [], [("A", 0, 5, None)]) == {}


def test_report_and_runs(spark):
    df = spark.createDataFrame([("p", k) for k in (1, 2, 2, 3, 7, 9, 10, None)] + [(None, 4)], "page_id string, sentence_id int")
    assert found(references.key_runs(df.where("page_id = 'p'"), ["page_id"], "sentence_id")) == [("p", 1, 3, 3), ("p", 7, 7, 1), ("p", 9, 10, 2)]
    o = spark.createDataFrame([(1, "missing"), (2_678_400_000_000, "missing")], "position long, reason string")
    assert found(references.orphan_report(o, "t")) == [("t", "1970-01", "missing", 1), ("t", "1970-02", "missing", 1)]


@pytest.mark.parametrize("width", [1, 2, 7])
def test_key_runs_of_a_hot_page_over_many_tasks(spark, width):
    """Runs that cross task borders are put together, one that fills whole tasks included."""
    keys = [("p", k) for k in [*range(400), *range(401, 900), 905]] + [("q", k) for k in (5, 3, 4, 4, 900)]
    df = spark.createDataFrame(keys, "page_id string, sentence_id int").repartition(3)
    want = [("p", 0, 399, 400), ("p", 401, 899, 499), ("p", 905, 905, 1), ("q", 3, 5, 3), ("q", 900, 900, 1)]
    assert found(references.key_runs(df, ["page_id"], "sentence_id", width)) == want


def test_micros_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 0, 123456),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(references.micros(F.col("t"))).head()[0] == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
