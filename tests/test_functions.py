import pytest
from pyspark.sql import functions as F

from attestry.functions import identity, labels, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.tokens, "It's 3 Été_x!", ["it", "s", "3", "été_x"]),
        (text.nfkc_tokens, "ﬁne Ｆox", ["fine", "fox"]),
        (text.tokens, "", []),
        (text.tokens, None, None),
        (text.canonical_text, "A -lrb- b -RRB-, C!", "a b c"),
        (text.is_disambiguation_page, "Eiffel_-LRB-disambiguation-RRB-", True),
        (text.is_disambiguation_page, "Disambiguation", False),
        (text.clean_text, "A  -LRB- b -RRB- , c .", "A ( b ), c."),
        (text.wiki_title, " A_b--c ", "A b c"),
        (text.query_text, "ﬁ  x", "fi x"),
        (text.subject_anchor, "The Eiffel Tower in Paris, Texas is tall.", "eiffel tower"),
        (text.subject_anchor, "Rio's sequel is long.", "rio"),
        (text.subject_anchor, "Most of them are gone.", None),
        (text.subject_anchor, "the tower is tall", None),
        (text.subject_anchor, "Nothing here", None),
        (text.subject_queries, "Rio's sequel is long.", ["Rio 2", "Rio sequel film"]),
        (text.subject_queries, "Due Date was only shot in Ohio.", ["Due Date", "Due Date film"]),
        (text.subject_queries, "Some of us are.", []),
        (text.folded_tokens, "Straße", ["strasse"]),
        (text.is_sha256, "a" * 64, True),
        (text.is_sha256, None, False),
        (identity.public_url, "HTTPS://Exa-mple.ORG:443?q=1#f", "https://exa-mple.org/?q=1"),
        (identity.public_url, "http://example.org:8080/a", "http://example.org:8080/a"),
        (identity.public_url, "http://u:p@example.org/", None),
        (identity.public_url, "ftp://example.org/", None),
        (identity.public_url, "http://127.0.0.1/", None),
        (identity.public_domain, "Bücher.example.", "xn--bcher-kva.example"),
        (identity.public_domain, "localhost", None),
        (identity.text_value, "  a \n b ", "a b"),
        (identity.text_value, " ", None),
        (lambda c: identity.aware_timestamp(c).isNull(), "2024-01-01T00:00:00", True),
        (lambda c: identity.aware_timestamp(c).isNull(), "2024-01-01T00:00:00Z", False),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_page_title_and_phrases(spark):
    t = one(spark, "Paris_-LRB-Texas-RRB-", text.page_title)
    assert (t.base, t.qualifier) == ("paris", "texas")
    assert one(spark, "Paris", text.page_title).qualifier is None
    df = spark.createDataFrame([("the new york times", "new york"), ("newer york", "new"), ("a", "")], "t string, p string")
    assert [r[0] for r in df.select(text.contains_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, False]


def test_all_null_batches(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    for f in (text.nfkc, text.folded_tokens, identity.public_domain, identity.public_url, text.actor_fingerprint(b"k")):
        assert [r[0] for r in df.select(f(F.col("x"))).collect()] == [None, None]


def test_shingles_and_ratio(spark):
    assert one(spark, "a b c d e f", lambda c: text.shingles(text.tokens(c))) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b", lambda c: text.shingles(text.tokens(c))) == []
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.sequence_ratio("a", "b")).collect()] == [0.75, None]
    f = text.actor_fingerprint(b"k")
    assert len(spark.createDataFrame([("u",)], "u string").select(f("u")).head()[0]) == 24


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 5000])
def test_passages_put_together_give_the_text(spark, size):
    doc = ("word 👩 " * size)[: size * 3]
    p = identity.passages(spark.createDataFrame([(1, doc, 5), (2, None, 1), (3, " \n", 2)], "doc_id long, text string, ordinal int"), max_chars=100)
    parts = sorted(p.collect(), key=lambda r: r.ordinal)
    assert "".join(r.text for r in parts) == (doc if doc.strip() else "")
    assert all(r.end_offset - r.start_offset <= 100 for r in parts)
    assert identity.passage_ends("x" * 250, 100) == [100, 200, 250]


def test_labels(spark):
    df = spark.createDataFrame([(2.0, 1.0, 0.0), (1.0, 1.0, 1.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0)], "a double, b double, c double")
    ps = labels.softmax([F.col(c) for c in "abc"])
    got = df.select(labels.top_label(ps), labels.probabilities_ok(ps), F.round(ps[0], 4)).collect()
    assert [tuple(r) for r in got] == [("ENTAILMENT", True, 0.6652), ("ENTAILMENT", True, 0.3333), (None, False, None), (None, False, None)]
    codes = spark.createDataFrame([(200,), (301,), (401,), (403,), (404,), (422,), (429,), (500,), (503,), (None,)], "c int")
    assert [r[0] for r in codes.select(labels.status_outcome(F.col("c"))).collect()] == [
        "success", "redirect", "unauthorized", "forbidden", "client_error", "invalid_request", "rate_limited", "server_error", "unavailable", None,
    ]
    with pytest.raises(ValueError):
        labels.softmax([F.col("a")], 0)
    assert one(spark, "NEUTRAL", labels.label_id) == 2 and one(spark, "x", labels.label_id) is None


def test_discovery_problem(spark):
    schema = "u string, d string, t string, p string, l string, s string"
    data = [("https://a.org/x", "A.org", "t", "p", None, None), ("http://a.org/x", "a.org", "t", "p", None, None), ("https://a.org/x", "b.org", "t", "p", None, None),
            ("https://a.org/x", "a.org", " ", "p", None, None), ("https://a.org/x", "a.org", "t", None, None, None), ("https://a.org/x", "a.org", "t", "p", "x" * 17, None)]
    got = spark.createDataFrame(data, schema).select(identity.discovery_problem(*[F.col(c) for c in "udtpls"])).collect()
    assert [r[0] for r in got] == [None, "URL", "DOMAIN", "TITLE", "PUBLISHER", "LANGUAGE"]
