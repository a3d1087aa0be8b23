import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.functions import identity, text
from attestry.operators import families, layout, metrics, multisource, relational, retrieval, usage, verify, versions


def test_first_top_and_numbers(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 1, "n"), (None, 0, "m")], "k string, o int, v string")
    assert sorted(r.v for r in relational.first_rows(df, ["k"], [F.col("o")]).collect()) == ["m", "y", "z"]
    assert sorted((r.v, r.rank) for r in relational.top_rows(df, ["k"], [F.col("o")], 1).collect()) == [("m", 1), ("y", 1), ("z", 1)]
    big = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    n = relational.number_rows(big, ["x"], "n").collect()
    assert sorted(r.n for r in n) == list(range(1, 1001)) and all(r.n == r.x + 1 for r in n)
    assert relational.number_rows(big.where("x < 0"), ["x"], "n").count() == 0


def test_expectations_and_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, "c"), (None, "d")], "k int, v string")
    assert relational.expect(df, F.lit(True), "ok") is df
    with pytest.raises(relational.ExpectationFailed):
        relational.expect(df, F.col("v").isNotNull(), "null v")
    assert [tuple(r) for r in relational.duplicate_keys(df, ["k"]).orderBy("k").collect()] == [(1, 2), (2, 2)]
    assert [tuple(r) for r in relational.conflicting_keys(df, ["k"], "v").collect()] == [(1, 2)]
    one = df.where("k = 1").agg(relational.ordered_text("v", "k").alias("t"), relational.ordered_list("k", "v").alias("l")).head()
    assert (one.t, one.l) == ("a b", [1, 1])
    r = df.agg(relational.ratio(F.sum("k"), F.lit(0)).alias("z"), relational.ratio(F.sum("k"), F.lit(0), None).alias("n")).head()
    assert (r.z, r.n) == (0.0, None)


def test_latest_as_of(spark):
    facts = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "w", 9)], "fact_id int, k string, at int")
    obs = spark.createDataFrame([("u", 5, 1), ("u", 5, 2), ("u", 3, 9), ("u", 6, 1)], "k string, t int, id int")
    got = {r.fact_id: r.observation and r.observation.id for r in layout.latest_as_of(facts, obs, ["k"], "at", "t", "id").collect()}
    assert got == {1: 2, 2: None, 3: None}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_hot_keys_over_partitions(spark, parts):
    events = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11 > 4).cast("string").alias("c"))
    rows = sorted((r.k, r.o, r.c) for r in events.collect())
    want, last, n = [], None, 0
    for k, o, c in rows:
        if last is None or last[0] != k:
            n = 1
        elif last[1] == c:
            continue
        else:
            n += 1
        want.append((k, o, n))
        last = (k, c)
    assert sorted((r.k, r.o, r.version_number) for r in layout.content_versions(events, "k", "c", ["o"], parts).collect()) == want
    facts = events.where("o % 3 = 0").select("k", F.col("o").alias("at"), F.lit("f").alias("c"))
    obs = events.where("o % 17 = 5")
    got = {(r.k, r["at"]): r.observation and r.observation.o for r in layout.latest_as_of(facts, obs, ["k"], "at", "o", "o", parts).collect()}
    seen = [(k, o) for k, o, _ in rows if o % 17 == 5]
    assert got == {(k, o): max((p for q, p in seen if q == k and p <= o), default=None) for k, o, _ in rows if o % 3 == 0}


def test_sentence_bm25_keeps_zero_scores_and_order(spark):
    schema = "q string, claim string, page string, sid int, text string"
    data = [("1", "red fox", "A", 0, "the red fox runs"), ("1", "red fox", "A", 1, "nothing here"), ("1", "red fox", "B", 0, "a red house"), ("1", "red fox", "C", 0, ""), ("2", "", "A", 0, "x")]
    got = retrieval.rank_sentences(spark.createDataFrame(data, schema), "q", "claim", ["page", "sid"], "text").orderBy("q", "rank").collect()
    assert [(r.q, r.page, r.sid) for r in got] == [("1", "A", 0), ("1", "B", 0), ("1", "A", 1), ("1", "C", 0), ("2", "A", 0)]
    assert got[2].score == 0.0


def page_scores(sentences, title, query, fields, k1=1.2, b=0.75):
    """BM25 over all pages in plain Python."""
    docs = {f: {} for f in fields}
    for page, t in sentences:
        if page is not None:
            if "body" in fields:
                docs["body"].setdefault(page, []).extend((t or "").lower().split())
            if "title" in fields:
                docs["title"][page] = title(page).split()
    total = {}
    for f, boost in fields.items():
        d = {p: w for p, w in docs[f].items() if w}
        mean = sum(map(len, d.values())) / max(len(d), 1)
        for w in query.lower().split():
            df = sum(w in x for x in d.values())
            for p, x in d.items():
                if tf := x.count(w):
                    total[p] = total.get(p, 0) + boost * math.log(1 + (len(d) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / mean))
    return sorted(((round(s, 6), p) for p, s in total.items()), key=lambda x: (-x[0], x[1]))


def test_index_and_page_search(spark, tmp_path):
    rows = [("red_fox", "the red fox"), ("red_fox", "ran"), ("dog", "a red dog"), ("c", ""), ("c", None), (None, "red"), ("red_foX", "the red fox ran")]
    df = spark.createDataFrame(rows, "page string, text string")
    index = retrieval.page_index(df, "page", "text", text.title_words)
    body = {(r.page, r.term): r.tf for r in index.postings.where("field = 'body'").collect()}
    assert body[("red_fox", "the")] == 1 and len(body) == 11 and {r.page: r.length for r in index.lengths.where("field = 'body'").collect()} == {"red_fox": 4, "dog": 3, "red_foX": 4}
    index.save(str(tmp_path / "index"))
    index = retrieval.PageIndex.load(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([("1", "red fox"), ("2", "zebra"), ("3", ""), ("4", None)], "q string, claim string")
    got = retrieval.search_pages(q, "q", "claim", index, "page", {"title": 3.0, "body": 1.0}, 3).orderBy("q", "rank").collect()
    assert [(r.q, r.page, r.rank) for r in got] == [("1", "red_foX", 1), ("1", "red_fox", 2), ("1", "dog", 3)] and got[0].score == got[1].score > got[2].score > 0
    assert retrieval.search_pages(q.where("false"), "q", "claim", index, "page", {"body": 1.0}).count() == 0
    empty = retrieval.page_index(df.where("false"), "page", "text", text.title_words)
    assert retrieval.search_pages(q, "q", "claim", empty, "page", {"body": 1.0}).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_pruned_search_loses_nothing(spark, seed):
    """Frequent words beside rare ones, pages of very different lengths, few pages per query word; as by scoring every page."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    rows = [(f"p{rng.randrange(60) if rng.random() < 0.7 else 0}", " ".join(rng.choices(vocabulary, odds, k=rng.randint(1, 12)))) for _ in range(500)]
    queries = [(str(i), " ".join(rng.choices(vocabulary, odds, k=rng.randint(1, 9)))) for i in range(25)]
    index = retrieval.page_index(spark.createDataFrame(rows, "page string, text string"), "page", "text", text.title_words)
    fields = {"title": 3.0, "body": 1.0}
    got = {}
    for r in retrieval.search_pages(spark.createDataFrame(queries, "q string, claim string"), "q", "claim", index, "page", fields, 4).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.score, r.page))
    for q, claim in queries:
        want = page_scores(rows, lambda p: p, claim, fields)[:4]
        assert [p for _, p in got.get(q, [])] == [p for _, p in want] and all(abs(x[0] - y[0]) < 2e-6 for x, y in zip(got.get(q, []), want))


def test_page_search_lays_pages_out_once(spark, monkeypatch):
    """Words and lengths are shuffled by page once, to as many tasks as the search is to have."""
    monkeypatch.setattr(retrieval, "PART_POSTINGS", 1)
    index = retrieval.page_index(spark.createDataFrame([("a", "red fox"), ("b", "a red dog"), ("c", "dog fox")], "page string, text string"), "page", "text", text.title_words)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = retrieval.search_pages(spark.createDataFrame([("1", "a red fox dog")], "q string, claim string"), "q", "claim", index, "page", {"body": 1.0}, 2)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert [r.page for r in got.orderBy("rank").collect()] == ["b", "a"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_page = re.findall(r"hashpartitioning\(page#\d+, (\d+)\)", plan)
    assert by_page == ["7", "7"]  # one task a posting


def test_dense_fuse_expand(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<float>")
    for block, most in ((1, 100), (10, 100), (1, 0), (2, 0)):
        got = retrieval.dense_top(v.where("id in (1, 2, 4)"), v, "id", "v", 2, block, most).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id, r.score) for r in got] == [(1, 1, 1.0), (1, 3, 1.0), (2, 2, 1.0), (2, 1, 0.0)]
    assert retrieval.dense_top(v.where("id > 9"), v, "id", "v").count() == 0
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "x", 3)], "q string, d string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "q string, d string, rank int")
    f = retrieval.fuse([a, b], "q", ["d"]).orderBy("rank").collect()
    assert [(r.d, r.rrf_score) for r in f] == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]
    more = spark.createDataFrame([("q", "y", 0, 1), ("q", "w", 0, 2), ("q", "v", 1, 1)], "q string, d string, query_order int, rank int")
    e = retrieval.expand_candidates(a, more, "q", "d", 3).orderBy("rank").collect()
    assert [r.d for r in e] == ["x", "y", "w"]


def test_embedding_cache_encodes_new_texts_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, text string")
    cache = texts.where("id = 1").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(9.0)).alias("embedding"))
    rows, new = retrieval.cached_embeddings(texts, cache, lambda c: F.array(F.char_length(c).cast("double")))
    assert new.count() == 1
    assert {r.id: r.embedding for r in rows.collect()} == {1: [9.0], 2: [1.0], 3: [1.0], 4: None}


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 6)], "q string, d string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "b"), ("r", "a")], "q string, d string")
    m = {r.q: r for r in metrics.ranking_metrics(ranks, gold, ["q"], ["d"], (1, 5, 10)).collect()}
    assert (m["q"].gold, m["q"].first_rank, m["q"].reciprocal_rank, m["q"].hit_at_1, m["q"].recall_at_5, m["q"].recall_at_10) == (2, 2, 0.5, 0.0, 0.5, 1.0)
    assert (m["r"].reciprocal_rank, m["r"].first_rank, m["r"].hit_at_10) == (0.0, None, 0.0)


def test_classification(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "x")], "g string, p string")
    per = {r.label: (r.support, r.precision, r.recall, r.f1) for r in metrics.class_metrics(df, "g", "p", ("a", "b", "c")).collect()}
    assert per == {"a": (2, 1.0, 0.5, 0.666667), "b": (1, 0.5, 1.0, 0.666667), "c": (1, 0.0, 0.0, 0.0)}
    cells = metrics.confusion_matrix(df, "g", "p", ("a", "b"), ("a", "b", "x")).collect()
    assert len(cells) == 6 and sum(r.n for r in cells) == 3
    s = metrics.classification_summary(df, "g", "p", ("a", "b", "c")).head()
    assert (s.n, s.accuracy, s.macro_f1) == (4, 0.5, 0.444444)
    e = metrics.selective_metrics(df, "g", "p", ("a", "b")).head()
    assert (e.decision_coverage, e.abstained) == (0.75, 1)
    assert metrics.selective_metrics(df.where("false"), "g", "p", ("a",)).head().decided_accuracy is None


def test_gold_sets(spark):
    gold = spark.createDataFrame([(1, 0, "P", 1), (1, 0, "P", 2), (1, 1, "Q", 1), (2, 0, "R", 1), (3, 0, "S", 1)], "c int, s int, page string, sid int")
    seen = spark.createDataFrame([(1, "P", 1), (1, "Q", 1), (2, "R", 9)], "c int, page string, sid int")
    got = {r.c: (r.any_page, r.any_sentence, r.complete_set) for r in metrics.gold_set_hits(gold, seen, ["c"], "s", "page", "sid").collect()}
    assert got == {1: (True, True, True), 2: (True, False, False), 3: (False, False, False)}


def test_temperature_and_calibration(spark):
    import random

    rng = random.Random(1)
    data = []
    for _ in range(3000):
        z = [rng.gauss(0, 1) for _ in range(3)]
        import math

        p = [math.exp(x) for x in z]
        data.append((*[3 * x for x in z], rng.choices(range(3), p)[0]))
    df = spark.createDataFrame(data, "a double, b double, c double, g int")
    assert 2.5 < metrics.fit_temperature(df, ["a", "b", "c"], "g") < 3.6
    assert metrics.fit_temperature(df.where("false"), ["a", "b", "c"], "g") == 1.0
    b = spark.createDataFrame([(1.0, True), (0.0, False), (0.99, False)], "c double, ok boolean")
    assert {r.bin: r.n for r in metrics.calibration_bins(b, "c", F.col("ok")).collect()} == {14: 2, 0: 1}


def test_samples(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").otherwise("c").alias("l"))
    assert metrics.balanced_quotas({"a": 900, "b": 90, "c": 10}, ("a", "b", "c"), 100) == {"a": 45, "b": 45, "c": 10}
    s = {r.l: r["count"] for r in metrics.balanced_sample(df, "l", "id", ("a", "b", "c"), 100).groupBy("l").count().collect()}
    assert s == {"a": 45, "b": 45, "c": 10}
    h = {r.l: r.d for r in metrics.half_split(df, "l", "id").groupBy("l").agg(F.abs(F.sum(1 - 2 * F.col("half"))).alias("d")).collect()}
    assert all(d <= 1 for d in h.values())
    r = metrics.exact_rank(df.withColumn("h", F.xxhash64("id")), ["l"], ["h", "id"])
    assert r.groupBy("l").agg(F.max("_rank").alias("m"), F.count_distinct("_rank").alias("d")).where("m <> d").count() == 0


SCREEN = "qid string, claim string, rank int, page_id string, sentence_id int, text string"


def test_screening(spark):
    long = " ".join(f"word{i}" for i in range(30))
    near = " ".join([f"word{i}" for i in range(28)] + ["word29", "word28"])
    data = [("1", "Some claim", 1, "P", 0, long), ("1", "Some claim", 2, "P", 1, ""), ("1", "Some claim", 3, "P_-LRB-disambiguation-RRB-", 0, "x"), ("1", "Some claim", 4, "P", 0, long),
            ("1", "Some claim", 5, "Q", 0, long.upper()), ("1", "Some claim", 6, "P", 5, near), ("1", "Some claim", 7, "R", 0, "other text"), ("1", "Some claim", 8, "R", 1, "third text"),
            ("1", "Some claim", 9, "R", 2, None)]
    df = spark.createDataFrame(data, SCREEN)
    full = {r.rank: r.decision for r in verify.screen(df, "qid", 2).collect()}
    assert full == {1: "SELECTED", 2: "EMPTY_TEXT", 3: "DISAMBIGUATION_PAGE", 4: "DUPLICATE_EVIDENCE_ID", 5: "DUPLICATE_TEXT", 6: "NEAR_DUPLICATE_SAME_PAGE", 7: "SELECTED", 8: "UNUSED", 9: "EMPTY_TEXT"}
    windowed = {r.rank: r.decision for r in verify.screen_windowed(df, "qid", 2).collect()}
    assert windowed == full | {6: "SELECTED", 7: "UNUSED"}


def test_entity_variants(spark):
    claim = "The Eiffel Tower is located in France"
    data = [("1", claim, 1, "Eiffel_Tower", 0, "x"), ("1", claim, 2, "Eiffel_Tower_-LRB-Paris,_Texas-RRB-", 0, "y"), ("2", "Eiffel Tower in Paris Texas is in America", 1, "Eiffel_Tower", 0, "x"),
            ("2", "Eiffel Tower in Paris Texas is in America", 2, "Eiffel_Tower_-LRB-Paris,_Texas-RRB-", 0, "y"), ("3", "The Eiffel Tower replica is in Ohio", 1, "Eiffel_Tower_-LRB-a,_b-RRB-", 0, "x")]
    got = {(r.qid, r.rank): r.mismatch for r in verify.entity_mismatch(spark.createDataFrame(data, SCREEN), "qid", "claim", "page_id").collect()}
    assert got == {("1", 1): None, ("1", 2): "ENTITY_VARIANT_MISMATCH", ("2", 1): "CANONICAL_PAGE_FOR_QUALIFIED_ENTITY", ("2", 2): None, ("3", 1): None}


def test_roles_and_verdicts(spark):
    data = [("1", "P", 0, 1, "ENTAILMENT", 0.95, True), ("1", "P", 1, 2, "ENTAILMENT", 0.95, True), ("1", "Q", 0, 3, "CONTRADICTION", 0.99, True), ("1", "R", 0, 4, "NEUTRAL", 0.9, False), ("2", "P", 0, 1, "ENTAILMENT", 0.5, False)]
    df = spark.createDataFrame(data, "qid string, page_id string, sentence_id int, rank int, nli_label string, confidence double, accepted boolean")
    roles = {(r.qid, r.rank): r.role for r in verify.contribution_roles(df, "qid").collect()}
    assert roles == {("1", 1): "PRIMARY_SUPPORT", ("1", 2): "SAME_PAGE_ADDITIONAL", ("1", 3): "PRIMARY_REFUTATION", ("1", 4): "NOT_DECISIVE", ("2", 1): "NOT_DECISIVE"}
    claims = spark.createDataFrame([("1",), ("2",), ("3",)], "qid string")
    v = {r.qid: (r.verdict, r.supporting_pages, r.supporting_rows) for r in verify.page_verdicts(claims, df, "qid").collect()}
    assert v == {"1": ("CONFLICTING_EVIDENCE", 1, 2), "2": ("INSUFFICIENT_EVIDENCE", 0, 0), "3": ("INSUFFICIENT_EVIDENCE", 0, 0)}
    a = spark.createDataFrame([("NEUTRAL", 0.99, True), ("ENTAILMENT", 0.9, True), ("ENTAILMENT", 0.89, True), ("ENTAILMENT", 0.95, False)], "l string, c double, p boolean")
    assert [r[0].reason for r in a.select(verify.acceptance(F.col("l"), F.col("c"), F.col("p"))).collect()] == ["NEUTRAL_RELATION", "ACCEPTED_DECISIVE", "BELOW_CONFIDENCE_THRESHOLD", "SUBJECT_NOT_GROUNDED"]


def test_components_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "n")
    links = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(35, 33), (33, 33)], "a long, b long")
    got = {r.n: r.component for r in families.connected_components(nodes, links, "n").collect()}
    assert got == {i: 0 if i < 30 else 33 if i in (33, 35) else i for i in range(40)}


def test_families_and_votes(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    data = [(1, "p", "a b"), (2, "p", same), (3, "q", same.upper()), (4, "r", "a b"), (5, None, "c"), (6, None, None)]
    docs = spark.createDataFrame(data, "d long, pub string, t string")
    fam = families.source_families(docs, "d", "pub", "t")
    assert {r.d: r.component for r in fam.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    ok = (True, True, "BEFORE_REFERENCE", "WITHIN_WINDOW")
    rows = [
        ("k", 1, "ENTAILMENT", 0.95, *ok), ("k", 2, "ENTAILMENT", 0.95, *ok), ("m", 1, "ENTAILMENT", 0.9, *ok), ("m", 4, "CONTRADICTION", 0.9, *ok), ("z", 5, "NEUTRAL", 1.0, *ok),
        ("y", 1, "CONTRADICTION", 0.9, *ok), ("y", 4, "CONTRADICTION", 0.9, *ok), ("n", 1, "ENTAILMENT", 0.9, *ok), ("n", 2, "CONTRADICTION", 0.9, *ok),
        ("b", 1, "ENTAILMENT", 0.95, False, True, None, None), ("b", 2, "ENTAILMENT", 0.95, True, False, "AFTER_REFERENCE", "WITHIN_WINDOW"),
        ("b", 3, "ENTAILMENT", 0.5, True, True, "UNKNOWN", "UNKNOWN"), ("b", 4, "ENTAILMENT", 0.95, True, True, "UNKNOWN", "FUTURE_DATED"),
    ]
    ev = spark.createDataFrame(rows, "case string, d long, stance string, confidence double, nli_accepted boolean, admissible boolean, relation string, freshness string")
    found = families.findings(ev, fam.withColumnRenamed("component", "component"), ["d"])
    assert [r.decision for r in found.where("case = 'b'").orderBy("d").collect()] == ["NLI_NOT_ACCEPTED", "ADMISSIBILITY_BLOCKED", "BELOW_CONFIDENCE_THRESHOLD", "TEMPORAL_REVIEW_REQUIRED"]
    reuse = spark.createDataFrame([("m", 1, 4, "POSSIBLE_TEXT_REUSE"), ("k", 1, 4, "POSSIBLE_TEXT_REUSE")], "case string, left_id long, right_id long, relation string")
    votes = families.corroboration(found, "case", "d", reuse)
    got = {r.case: (r.outcome, r.decisive, r.warnings[2:]) for r in votes.collect()}
    opposing, shared, within = "OPPOSING_EVIDENCE_NEEDS_REVIEW", "POSSIBLE_SHARED_ORIGIN_BETWEEN_DECISIVE_FAMILIES", "OPPOSING_EVIDENCE_WITHIN_SAME_FAMILY"
    assert got == {
        "k": ("SINGLE_FAMILY_SUPPORT", 2, []), "m": ("UNRESOLVED_OPPOSING_EVIDENCE", 2, [opposing, shared]), "z": ("NO_DECISIVE_EVIDENCE", 0, []),
        "y": ("MULTI_FAMILY_REFUTATION_UNVERIFIED", 2, []), "n": ("UNRESOLVED_OPPOSING_EVIDENCE", 2, [opposing, within]),
        "b": ("NO_DECISIVE_EVIDENCE", 0, ["EVIDENCE_PUBLISHED_AFTER_REFERENCE_REVIEW_CONTEXT", "SOME_EVIDENCE_LACKS_AUDITED_TEMPORAL_CONTEXT", "TEMPORAL_REVIEW_REQUIRED"]),
    }
    assert families.corroboration_violations(votes, found, "case").count() == 0
    assert families.corroboration_violations(votes.withColumn("mixed", F.lit(7)), found, "case").count() == 6


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((300, 150), (300, 320), (200, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        links = spark.createDataFrame(edges, "a long, b long")
        got = {r.n: r.component for r in families.connected_components(spark.range(n).withColumnRenamed("id", "n"), links, "n").collect()}
        assert got == dict(enumerate(root))


def test_verification_as_one_plan(spark):
    claims = spark.createDataFrame([("1", "The Iron Mill was built in Brum"), ("2", "Nothing is known")], "q string, claim string")
    rows = [
        (1, "Iron_Mill", 0, "The Iron Mill was built in Brum ."), (2, "Iron_Mill", 0, "The Iron Mill was built in Brum ."), (3, "Other", 1, "the iron mill was built in Brum"),
        (4, "Iron_-LRB-disambiguation-RRB-", 0, "Iron may be a mill"), (5, "Old_Mill", 0, "The was built in Brum mill"), (6, "Iron_Mill", 4, "Iron mill stuff"), (7, "Iron_Mill", 5, ""), (8, "Far", 0, "x y"), (9, "Far", 1, "z"),
    ]
    ranked = spark.createDataFrame([("1", *r) for r in rows], "q string, rank int, page_id string, sentence_id int, text string")
    verdicts, evidence = verify.verify_claims(claims, ranked, "q", top_k=3, threshold=0.4)
    assert {r["rank"]: r.decision for r in evidence.collect()} == {1: "SELECTED", 3: "DUPLICATE_TEXT", 4: "DISAMBIGUATION_PAGE", 5: "SELECTED", 6: "SELECTED"}
    assert {r["rank"]: (r.nli_label, r.reason) for r in evidence.where("decision = 'SELECTED'").collect()} == {
        1: ("ENTAILMENT", "ACCEPTED_DECISIVE"), 5: ("ENTAILMENT", "SUBJECT_NOT_GROUNDED"), 6: ("NEUTRAL", "NEUTRAL_RELATION")
    }
    v = {r.q: (r.verdict, r.basis, r.retrieved_count, r.assessed_count, r.excluded_count, r.unused_count, r.blocked_count, r.primary_count) for r in verdicts.collect()}
    assert v == {"1": ("SUPPORTING_EVIDENCE", "SUPPORT_ONLY", 5, 3, 2, 0, 1, 1), "2": ("INSUFFICIENT_EVIDENCE", "NO_DECISIVE_EVIDENCE", 0, 0, 0, 0, 0, 0)}
    with pytest.raises(Exception, match="no probabilities"):
        verify.scored_pairs(claims.withColumn("text", F.lit("x")), lambda c, t: [F.lit(0.9), F.lit(0.9), F.lit(0.1)]).collect()


def test_observations_and_attachments(spark):
    schema = "source_id long, provider string, outcome string, status int, observed_at timestamp, doc_id long, version_id long, etag string"
    at = datetime(2024, 1, 1)
    rows = [
        (1, "p", "FETCHED", 200, at, 1, 11, None), (1, " ", "FETCHED", 200, at, 1, 11, None), (1, "p", "FAILED", 99, at, None, None, None), (1, "p", "FETCHED", 200, at, 1, None, None),
        (1, "p", "FAILED", None, at, None, 11, None), (2, "p", "FETCHED", 200, at, 1, 11, None), (1, "p", "FETCHED", 200, at, 1, 12, None), (1, "p", "FAILED", 304, at, None, None, "e" * 513), (1, "p", "X", 200, None, 1, 11, None),
    ]
    docs = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, source_id long")
    vers = spark.createDataFrame([(11, 1), (12, 2)], "version_id long, doc_id long")
    obs = spark.createDataFrame(rows, schema).withColumn("n", F.monotonically_increasing_id())
    got = [r.problem for r in versions.checked_observations(obs, docs, vers).orderBy("n").collect()]
    assert got == [None, "PROVIDER", "STATUS", "FETCHED_WITHOUT_VERSION", "VERSION_WITHOUT_DOCUMENT", "DOCUMENT_OWNER", "VERSION_OWNER", "ETAG", "TIME"]
    ev = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "evidence_id long, doc_id long")
    has = spark.createDataFrame([(2, 11)], "evidence_id long, version_id long")
    asked = [(0, 1, 11, "m"), (1, 1, 11, "m"), (2, 2, 11, "m"), (3, 3, 11, "m"), (4, 9, 11, "m"), (5, 1, 11, " "), (6, 3, 12, "m")]
    done = versions.attach_once(spark.createDataFrame(asked, "n int, evidence_id long, version_id long, method string"), ev, vers, has, [F.col("n")])
    assert [r.action for r in done.orderBy("n").collect()] == ["ATTACH", "EXISTING", "EXISTING", "OTHER_DOCUMENT", "UNKNOWN", "METHOD", "ATTACH"]


def test_benchmark_summary(spark):
    cases = spark.createDataFrame([("a", "c", "SUPPORTS", "SUPPORTS"), ("b", "c", "REFUTES", "NOT ENOUGH INFO"), ("d", "c", "REFUTES", "CONFLICT")], "q string, claim string, label string, predicted string")
    hits = spark.createDataFrame([("a", True, True, False), ("b", True, False, False)], "q string, any_page boolean, any_sentence boolean, complete_set boolean")
    ev = spark.createDataFrame([("a", "SELECTED", "ENTAILMENT", True), ("b", "ENTITY_VARIANT_MISMATCH", None, None), ("b", "SELECTED", "CONTRADICTION", False)], "q string, decision string, nli_label string, accepted boolean")
    s = metrics.benchmark_summary(cases, hits, ev, "q", ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")).head()
    assert (s.total, s.label_agreement, s.decision_coverage, s.decided_accuracy, s.abstained, s.conflicting) == (3, 0.333333, 0.333333, 1.0, 2, 1)
    assert s.gold_labels == {"SUPPORTS": 1, "REFUTES": 2} and s.exclusion_reasons == {"ENTITY_VARIANT_MISMATCH": 1} and s.any_sentence_rate == 0.5 and s.mean_assessed == 0.667 and len(s.confusion) == 12
    f = {r.q: (r.failure_type, r.flags, r.assessed_count, r.excluded_count) for r in metrics.failure_rows(cases, hits, ev, "q").collect()}
    assert f["b"] == ("ABSTENTION_ON_DECISIVE_GOLD", "GOLD_SENTENCE_NOT_ASSESSED;NO_ACCEPTED_DECISIVE_NLI;DECISIVE_LABEL_BELOW_THRESHOLD;ENTITY_VARIANT_FILTER_APPLIED", 1, 1) and f["d"][0] == "CONFLICTING_PREDICTION"


def test_pair_relations(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:99], "x"])
    docs = spark.createDataFrame([("g", 1, "p", a), ("g", 2, "q", b), ("g", 3, "p", "z"), ("g", 4, "r", a)], "g string, d long, pub string, t string")
    got = {(r.left_id, r.right_id): r.relation for r in families.pair_relations(docs, "g", "d", "pub", "t").collect()}
    assert got[(1, 2)] == "POSSIBLE_TEXT_REUSE" and got[(1, 3)] == "SAME_PUBLISHER" and got[(1, 4)] == "IDENTICAL_TEXT" and got[(2, 3)] == "UNDETERMINED"


def test_declared_origin_comes_after_the_publisher_and_before_the_text(spark):
    same = " ".join(f"w{i}" for i in range(100))
    data = [("g", 1, "p", "o", same), ("g", 2, "p", "o", same), ("g", 3, "q", "o", same), ("g", 4, "r", None, same), ("g", 5, "s", None, "z"), ("g", 6, "t", "", "z"), ("g", 7, "u", "", "y")]
    docs = spark.createDataFrame(data, "g string, d long, pub string, org string, t string")
    got = {(r.left_id, r.right_id): (r.relation, r.similarity) for r in families.pair_relations(docs, "g", "d", "pub", "t", origin="org").collect()}
    assert got[(1, 2)] == ("SAME_PUBLISHER", None) and got[(1, 3)] == ("DECLARED_COMMON_ORIGIN", None) and got[(3, 4)] == ("IDENTICAL_TEXT", None)
    assert got[(4, 5)][0] == got[(6, 7)][0] == "UNDETERMINED" and len(got) == 21


def test_versions_and_integrity(spark):
    v = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "a"), ("k", 5, None), ("k", 6, None), ("j", 1, None)], "k string, o int, c string")
    got = sorted((r.k, r.o, r.version_number) for r in layout.content_versions(v, "k", "c", ["o"]).collect())
    assert got == [("j", 1, 1), ("k", 1, 1), ("k", 3, 2), ("k", 4, 3), ("k", 5, 4)]
    target = spark.createDataFrame([("k", "x")], "k string, other string")
    assert [r.k for r in versions.new_rows(v, target, ["k"], [F.col("o")]).collect()] == ["j"]
    h = F.sha2(F.lit("hello"), 256)
    df = spark.createDataFrame([(0, 5, "hello"), (1, 3, "el"), (3, 3, ""), (0, 9, "hello"), (0, 2, "xx")], "s int, e int, p string")
    bad = df.select(versions.snapshot_problem(F.lit("hello"), h, F.col("s"), F.col("e"), F.col("p"), F.sha2("p", 256))).collect()
    assert [r[0] for r in bad] == [None, None, "BOUNDS", "BOUNDS", "TEXT"]
    a = spark.createDataFrame([(1, 0, 5)], "d int, s int, e int")
    assert versions.same_spans(a, a, ["d"]).count() == 0 and versions.same_spans(a, a.withColumn("e", F.lit(6)), ["d"]).count() == 1
    old = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 9),), (None,)], "t timestamp_ntz")
    assert versions.retained(old, "t", F.lit("2024-01-10").cast("timestamp_ntz"), 7).count() == 2


def test_usage_and_quota(spark):
    e = spark.createDataFrame([("u", datetime(2024, 1, 1, 5), 200, 10.0), ("u", datetime(2024, 1, 1, 6), 429, 1.0), ("u", datetime(2024, 1, 3), 500, 4.0), ("u", datetime(2024, 1, 3), 302, 1.0)], "u string, t timestamp_ntz, c int, l double")
    f = usage.filled_days(usage.daily_usage(e, "u", "t", "c", "l"), "u", F.lit("2024-01-03").cast("date"), 3).orderBy("day").collect()
    assert [(r.requests, r.successful, r.failed, r.limited) for r in f] == [(2, 1, 0, 1), (0, 0, 0, 0), (2, 0, 1, 0)]
    times = [0, 10, 59, 60, 61, 125, 200]
    q = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, t // 60, t % 60), i) for i, t in enumerate(times)] + [("b", datetime(2024, 1, 1), 99)], "k string, t timestamp_ntz, id int")
    got = {r.id: (r.hit, r.allowed) for r in usage.quota_decisions(q, "k", "t", "id", 2, 60).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (2, True), 5: (1, True), 6: (1, True), 99: (1, True)}
    p = usage.nearest_rank(spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double"), "v").head()
    assert (p.n, p.p50, p.p90, p.p95) == (10, 5.0, 9.0, 10.0)
    assert usage.nearest_rank(spark.createDataFrame([], "v double"), "v").head().n == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_quota_of_a_hot_key_nulls_and_repeats(spark, parts):
    rng = random.Random(parts)
    seconds = sorted(rng.choice((rng.randrange(4000), rng.randrange(300))) for _ in range(400))
    t0 = datetime(2024, 1, 1)
    rows = [("hot", t0 + timedelta(seconds=s), s) for s in seconds] + [("b", t0 + timedelta(seconds=s), 7) for s in (0, 0, 5, 90)] + [(None, t0, 1), (None, t0, 2), ("b", None, 3)]
    want, start, n = [], None, 0
    for s in seconds:
        if start is None or s >= start + 60:
            start, n = s, 0
        n += 1
        want.append(n)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int")
    got = usage.quota_decisions(df, "k", "t", "id", 3, 60, parts).collect()
    assert sorted(r.hit for r in got if r.k == "hot") == sorted(want) and len(got) == len(rows)
    assert sorted(r.hit for r in got if r.k == "b" and r.t) == [1, 1, 2, 3] and all(r.hit is None and r.allowed is None for r in got if r.k is None or r.t is None)


def test_medians_differences_and_winner(spark):
    m = usage.medians(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None)], "k string, v double"), "v", ["k"])
    assert sorted(map(tuple, m.collect())) == [("a", 2, 1.5), ("b", 1, 5.0)]
    d = relational.set_differences(spark.createDataFrame([("a",), (None,), ("z",), ("z",)], "l string"), "l", ("a", "b"))
    assert sorted(map(tuple, d.collect()), key=str) == [("b", 0), ("z", 2), (None, 1)]
    w = metrics.winner(spark.createDataFrame([("n", 1.0), ("m", 1.0), ("o", 0.5)], "name string, s double"), "name", "s").head()
    assert tuple(w) == ("m", 1.0)
    a = spark.createDataFrame([("q", 1, "x", 1.0), ("q", 2, "y", 0.5)], "q string, rank int, d string, score double")
    b = spark.createDataFrame([("q", 1, "x", 1.0000001), ("q", 2, "z", 0.5), ("q", 3, "w", 0.1)], "q string, rank int, d string, score double")
    assert sorted(r["rank"] for r in metrics.same_rankings(a, b, ["q"], ["d"]).collect()) == [2, 3]
    s = relational.first_seen(spark.createDataFrame([("p", 3), ("p", 1), ("q", 2)], "p string, n int"), "p", "n")
    assert sorted(map(tuple, s.collect())) == [("p", 1), ("q", 2)]
    t = spark.createDataFrame([("b a b",), ("a b b",), (None,)], "t string").select(text.token_multiset(F.col("t")).alias("m")).collect()
    assert t[0].m == t[1].m == ["a", "b", "b"] and t[2].m is None
    k = verify.sentence_keys(spark.createDataFrame([("1", "P", 0, 2), ("1", "P", 0, 1), ("1", "P", 1, 3)], "q string, page_id string, sentence_id int, rank int"), "q")
    assert sorted(r["rank"] for r in k.collect()) == [1, 3]


def test_assessment_over_several_documents(spark):
    whole = "The Iron Mill was built in Brum . It has a wheel"
    docs = [("k", 1, "p", None, whole), ("k", 2, "q", None, "x " * 3 + whole), ("k", 3, "p", None, "The Iron Mill is nothing"), ("z", 4, "r", None, whole)]
    d = spark.createDataFrame(docs, "case string, doc_id long, source_id string, origin string, content string").withColumn("content_sha256", F.sha2("content", 256))
    p = identity.passages(d.select("doc_id", F.col("content").alias("text"))).join(d.select("case", "doc_id"), "doc_id")
    p = p.withColumn("sha256", F.when(F.col("doc_id") == 4, "bad").otherwise(F.col("sha256")))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    meta = d.select("doc_id", "source_id", F.col("content_sha256").alias("sha256"), F.when(F.col("doc_id") != 3, at).alias("published_at"), at.alias("retrieved_at"))
    fetched = d.where("doc_id < 3").select("doc_id", F.lit("FETCHED").alias("outcome"), at.alias("observed_at"))
    profile = spark.createDataFrame([("p", datetime(2023, 1, 1), "A", "old"), ("p", datetime(2023, 6, 1), "B", ""), ("q", datetime(2030, 1, 1), "C", "later")], "source_id string, observed_at timestamp, method string, publisher_name string")
    context = multisource.document_context(meta, fetched, profile, at, at, F.lit(None).cast("int"), 3)
    c = {r.doc_id: (r.flags, r.warnings) for r in context.collect()}
    assert c[1] == (["IMMUTABLE_CONTENT_HASH", "MATCHED_FETCH_OBSERVATION", "PUBLICATION_TIME_RECORDED", "SOURCE_PROFILE_OBSERVED", "PROFILE_METHOD_B"], [])
    assert c[2][1] == ["SOURCE_PROFILE_NOT_OBSERVED"] and c[3][1] == ["FETCH_OBSERVATION_NOT_FOUND", "PUBLICATION_TIME_UNKNOWN"]
    claims = spark.createDataFrame([("k", "The Iron Mill was built in Brum"), ("z", "x")], "case string, claim string")
    out = multisource.assess(claims, p, d, context, threshold=0.4)
    s = out.summary.collect()
    assert [(r.case, r.supporting, r.refuting, r.outcome) for r in s] == [("k", 2, 0, "MULTI_FAMILY_SUPPORT_UNVERIFIED")] and s[0].warnings[0] == "INDEPENDENCE_NOT_PROVEN"
    assert [r.doc_id for r in out.rejected.collect()] == [4] and {r.doc_id: r.component for r in out.findings.collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, folder, parts):
    from attestry.operators import dataset
    from attestry.sources.tables import table

    pairs = table(spark, folder, "nli_pairs")
    a = dataset.clean_pairs(pairs).orderBy("example_id").collect()
    b = dataset.clean_pairs(pairs.repartition(parts).orderBy(F.rand())).orderBy("example_id").collect()
    assert a == b


def test_sentences_of_large_pages_rank_as_all_candidates_do(spark):
    """The same rows whether pages are joined with their queries or go through them piece by piece."""
    rng = random.Random(5)
    words = ["the", "of", "light", "stands", "tower", *[f"w{i}" for i in range(30)]]
    s = [(p, i, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for p, n in (("a", 60), ("b", 3), ("c", 25)) for i in range(n)]
    q = [("1", ["the", "light", "w3", "the"]), ("2", ["of", "w1"]), ("3", ["unseen"]), ("4", [])]
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("3", "a"), ("3", "b"), ("4", "c")], "q string, page string")
    sentences = spark.createDataFrame(s, "page string, sid int, words array<string>")
    queries = spark.createDataFrame(q, "q string, asked array<string>")
    whole = pairs.join(sentences, "page").join(queries, "q").withColumn("text", F.lit("")).withColumn("claim", F.lit(""))
    want = retrieval.rank_sentences(whole, "q", "claim", ["page", "sid"], "text", 7, words="words", asked="asked").orderBy("q", "rank").collect()
    for large in (1000, 10):
        got = retrieval.rank_page_sentences(pairs, queries, sentences, "q", "page", "sid", 7, large=large).orderBy("q", "rank").collect()
        assert got == want


def test_index_counts_words_where_pages_lie(spark, folder):
    """Whole pages are shuffled once; pages too large for that give the same index."""
    from attestry.plans import evidence_catalog

    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    whole, cut = evidence_catalog._index(spark, folder), evidence_catalog._index(spark, folder, 20)
    plain = retrieval.page_index(evidence_catalog.d.canonical_sentences(evidence_catalog.table(spark, folder, "wiki_sentences")), "page_id", "text", text.title_words)
    for x in (whole, cut):
        assert rows(x.postings) == rows(plain.postings) and rows(x.lengths) == rows(plain.lengths)


def test_raw_lines_are_not_shuffled_with_sentences(spark, folder, monkeypatch):
    """A row is chosen by the length of its raw line; the line itself stays where it was read."""
    from attestry.plans import evidence_catalog

    d, s = evidence_catalog.d, evidence_catalog.table(spark, folder, "wiki_sentences")
    slim = d.slim_sentences(s)
    for f in (d.canonical_sentences, d.stored_sentences):
        keys = lambda df: sorted(r.row_id for r in df.select("row_id").collect())
        assert keys(f(slim.repartition("page_id"))) == keys(f(s))
    seen, whole = [], d.canonical_sentences
    monkeypatch.setattr(d, "canonical_sentences", lambda x: seen.append(x.columns) or whole(x))
    evidence_catalog._index(spark, folder)
    assert seen and all("raw_line" not in x for x in seen)


def test_gold_evidence_lays_out_only_sentences_the_queries_refer_to(spark, folder, monkeypatch):
    from attestry.plans import dataset_catalog, evidence_catalog

    d, q = evidence_catalog.d, evidence_catalog._queries(spark, folder).select("claim_id", "split")
    cols = ["claim_id", "split", "evidence_set_id", "evidence_item_position", "wiki_page", "sentence_id", "evidence_text"]
    rows = lambda df: sorted(map(str, df.join(q, ["claim_id", "split"], "left_semi").select(cols).collect()))
    want, seen, whole = rows(dataset_catalog._gold(spark, folder)), [], d.canonical_sentences
    monkeypatch.setattr(d, "canonical_sentences", lambda x: seen.append(x.count()) or whole(x))
    assert rows(evidence_catalog._gold(spark, folder)) == want and want
    assert len(seen) == 1 and seen[0] < evidence_catalog.table(spark, folder, "wiki_sentences").count() / 10


def test_words_of_a_page_are_put_together_before_their_shuffle(spark, monkeypatch):
    """A row of postings per page and piece, not one per word, goes through the shuffle; no posting is lost."""
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(rng.choice("abcd"), rng.randint(0, 50), rng.randint(0, 1), rng.randint(1, 9)) for _ in range(300)]
    schema = pa.schema([("page", pa.string()), ("word", pa.int32()), ("at", pa.int8()), ("tf", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 50]], schema) for i in range(0, 300, 50)]
    monkeypatch.setattr(retrieval, "PACK_POSTINGS", 120)
    packed = list(retrieval._packed(iter(batches)))
    assert [x.num_rows for x in packed] == [4, 4]
    assert sorted((r["page"], *x) for b in packed for r in b.to_pylist() for x in zip(r["word"], r["at"], r["tf"])) == sorted(rows)
    index = retrieval.page_index(spark.createDataFrame([("a", "red fox"), ("b", "a red dog")], "page string, text string"), "page", "text", text.title_words)
    plan = retrieval.search_pages(spark.createDataFrame([("1", "red dog")], "q string, claim string"), "q", "claim", index, "page", {"body": 1.0}, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # to put together, and to search


def test_sentences_are_laid_out_as_numbers_of_the_words_asked_for(spark, monkeypatch):
    """Neither other words nor texts are shuffled; too many words to broadcast stay as they are, and give the same rows."""
    rng = random.Random(9)
    words = ["the", "of", "light", *[f"w{i}" for i in range(20)]]
    s = [(p, i, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for p, n in (("a", 40), ("b", 5)) for i in range(n)] + [("b", 99, None)]
    sentences = spark.createDataFrame(s, "page string, sid int, words array<string>")
    queries = spark.createDataFrame([("1", ["the", "light", "w3", "the"]), ("2", ["unseen"]), ("3", None)], "q string, asked array<string>")
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "a")], "q string, page string")
    seen, write = {}, retrieval.shared_checkpoint
    monkeypatch.setattr(retrieval, "shared_checkpoint", lambda df, name: seen.setdefault(name, write(df, name)))
    rank = lambda: retrieval.rank_page_sentences(pairs, queries, sentences, "q", "page", "sid", 7, large=10).orderBy("q", "rank").collect()
    got, laid = rank(), seen["words"]
    assert dict(laid.dtypes)["words"] == "array<int>"
    known = {"the", "light", "w3"}
    assert sorted((r.page, r.sid, r["_size"], len(r.words)) for r in laid.collect()) == sorted((p, i, len(w or ()), sum(x in known for x in w or ())) for p, i, w in s)
    seen.clear()
    monkeypatch.setattr(retrieval, "SMALL_TERMS", 0)
    assert rank() == got and len(got) == 20
    assert dict(seen["words"].dtypes)["words"] == "array<string>"


def test_rows_laid_out_by_claim_are_screened_where_they_lie(spark):
    """Screening shuffles ranked rows with their texts once, for all of its windows."""
    s = "qid string, claim string, rank int, page_id string, sentence_id int, text string"
    rows = spark.createDataFrame([("1", "Red Fox is in Ohio", i, f"Red_Fox-LRB-{x}-RRB-", i, f"text {i % 2}") for i, x in enumerate(("Ohio", "Iowa", "Ohio"))], s)
    out = verify.screen_windowed(verify.sentence_keys(rows.repartition("qid"), "qid"), "qid", 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert len({r.decision for r in out.collect()}) > 1


def test_only_repeated_keys_are_shuffled_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("abc") + str(i % 40 if i < 60 else i), rng.choice([None, 1, 2]), rng.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s int, o int, v int")
    order, seen, whole = [F.col("o").desc(), F.col("v")], [], relational.first_rows
    want = sorted(r.v for r in whole(df, ["k", "s"], order).collect())
    monkeypatch.setattr(relational, "first_rows", lambda x, *a: seen.append(x.count()) or whole(x, *a))
    assert sorted(r.v for r in relational.first_rows_of_few(df, ["k", "s"], order).collect()) == want and len(want) < 400
    assert seen == [400 - sum(n == 1 for n in Counter(r[:2] for r in rows).values())] and seen[0] < 200
    assert sorted(r.v for r in relational.first_rows_of_few(df, ["k", "s"], order, most=0).collect()) == want


def test_search_without_an_index_finds_the_same(spark, monkeypatch):
    """As over an index, for pages read in pieces, without a shuffle of texts; also where the words asked for are too many to broadcast."""
    rng = random.Random(20)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(f"p{rng.randrange(30)} w{rng.randrange(9)}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for _ in range(400)] + [("p0 w0", None), (None, "w1"), ("x", "")]
    df = spark.createDataFrame(rows, "page string, text string").repartition(3)
    q = spark.createDataFrame([(str(i), " ".join(rng.choices([*vocabulary[:20], "unseen"], k=5))) for i in range(20)] + [("none", None)], "q string, claim string")
    monkeypatch.setattr(retrieval, "COUNT_WORDS", 20)
    index = retrieval.page_index(df, "page", "text", text.title_words)
    for fields in ({"title": 3.0, "body": 1.0}, {"body": 1.0}):
        want = retrieval.search_pages(q, "q", "claim", index, "page", fields, 5).orderBy("q", "rank").collect()
        search = lambda: retrieval.search_sentences(q, "q", "claim", df, "page", "text", text.title_words, fields, 5)
        got = search()
        assert got.orderBy("q", "rank").collect() == want and want
        assert "text" not in got._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(retrieval, "SMALL_TERMS", 3)
            assert search().orderBy("q", "rank").collect() == want
    assert retrieval.search_sentences(q, "q", "claim", df.where("false"), "page", "text", text.title_words, {"body": 1.0}).count() == 0
    assert retrieval.search_sentences(q.where("false"), "q", "claim", df, "page", "text", text.title_words, {"body": 1.0}).count() == 0


def test_texts_of_ranked_sentences_are_not_shuffled_by_claim(spark, folder, monkeypatch):
    """What goes to the choice of a claim's best sentences is their keys and scores, whatever Spark would broadcast itself."""
    from attestry.plans import evidence_catalog

    seen, write = {}, evidence_catalog.shared_checkpoint
    monkeypatch.setattr(evidence_catalog, "shared_checkpoint", lambda df, name: write(seen.setdefault(name, df), name))

    def by_claim(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        mine = [plan.output().toString()] if "Exchange hashpartitioning(qid" in plan.toString().split("\n")[0] else []
        return mine + [x for p in below for x in by_claim(p)]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert evidence_catalog._best(spark, folder).count()
        found = by_claim(seen["best"]._jdf.queryExecution().executedPlan().initialPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found and not any("text#" in x or "claim#" in x for x in found)
