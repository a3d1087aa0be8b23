import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestry.sources import discovery, records, sinks


def test_claim_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"id": 1, "label": "SUPPORTS", "claim": " x ", "evidence": [[[1, 2, "P", 0]]]}), "", "{broken", json.dumps({"id": 2, "label": "SUPPORTS", "claim": ""})]))
    good, bad = records.accepted_and_rejected(records.claim_lines(spark, str(tmp_path / "a.jsonl")))
    assert [(r.claim_id, r.claim, r.evidence_set_count) for r in good.collect()] == [(1, "x", 1)]
    assert bad.count() == 2 and {r.source_file for r in bad.collect()} == {"a.jsonl"}


def test_zipped_pages_and_lines(spark, tmp_path):
    page = {"id": "P", "text": "t", "lines": "0\tFirst .\tLink\tTarget\n1\t\nloose\twords\nplain\n\n2\tThird ."}
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("wiki/b.jsonl", json.dumps(page) + "\n" + json.dumps({"id": "", "text": "", "lines": ""}) + "\n" + json.dumps({"'id'": "", "text": "orphan"}))
        z.writestr("__MACOSX/b.jsonl", "{}")
        z.writestr("wiki/._b.jsonl", "{}")
        z.writestr("wiki/a.txt", "{}")
    pages, rejected = records.page_records(records.zipped_pages(spark, str(tmp_path)))
    assert [r.page_id for r in pages.collect()] == ["P"] and rejected.count() == 1
    got = sorted((r.sentence_id, r.text, r.raw_line) for r in records.page_lines(pages).collect())
    assert got == [(0, "First .", "0\tFirst .\tLink\tTarget"), (1, "", "1\t\nloose\twords\nplain"), (2, "Third .", "2\tThird .")]


def test_discovery(spark):
    news = json.dumps({"articles": [{"url": "https://A.org/x#y", "title": " t  u ", "source": {"name": None}, "publishedAt": "2024-01-01T00:00:00Z"}, {"url": "http://a.org/x", "title": "t"}, {"url": "https://a.org/x", "title": " "}, 5]})
    got = records.news_hits(spark.createDataFrame([(news,), (None,), ("[]",)], "payload string")).collect()
    assert [(r.url, r.publisher_name, r.title) for r in got] == [("https://a.org/x", "a.org", "t u")]
    reviews = json.dumps({"claims": [{"text": "c", "claimReview": [{"url": "https://b.org/1", "publisher": {"name": "B"}}, {"url": "bad"}]}, {"claimReview": None}]})
    got = records.review_hits(spark.createDataFrame([(reviews,)], "payload string")).collect()
    assert [(r.url, r.publisher_name, r.title) for r in got] == [("https://b.org/1", "B", "c")]


def test_sinks(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    sinks.write_table(df, str(tmp_path / "t"), sort_by=["id"])
    assert sinks.read_table(spark, str(tmp_path / "t"), ["id"], "k = 1").count() == 33
    a = sinks.write_manifest(df, "t", ["k"], str(tmp_path / "m"))
    b = json.loads(sinks.manifest(df.repartition(7), "t", ["k"]).head()[0])
    assert a == b and a["rows"] == 100
    assert json.loads(sinks.manifest(df.where("false"), "t", ["k"]).head()[0])["rows"] == 0
    sinks.write_report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 100
    assert sinks.markdown(df.where("id = 0")) == "| id | k |\n| --- | --- |\n| 0 | 0 |\n"
    with pytest.raises(ValueError):
        sinks.markdown(df, 1)
    prints = {n: json.loads(sinks.manifest(d, "t", ["k"]).head()[0])["fingerprint"] for n, d in (("one", df), ("two", df.unionAll(df)), ("three", df.unionAll(df).unionAll(df)))}
    assert len(set(prints.values())) == 3 and "0" not in prints.values()
    (tmp_path / "f.txt").write_bytes(b"abc")
    f = sinks.file_manifest(spark, str(tmp_path / "f.txt")).head()
    assert (f.length, f.sha256[:8]) == (3, "ba7816bf")
    sinks.register_views(spark, {"some_view": df})
    assert spark.sql("SELECT count(*) FROM some_view").head()[0] == 100


def test_discovery_source(spark, tmp_path):
    discovery.register(spark)
    page = {"articles": [{"url": "https://a.org/x#y", "title": " T ", "source": {"name": "A"}}, {"url": "http://a.org/z", "title": "no https"}]}
    (tmp_path / "1.json").write_text(json.dumps(page))
    (tmp_path / "2.json").write_text("broken")
    (tmp_path / "note.txt").write_text("x")
    df = spark.read.format("discovery").option("connector", "news").load(str(tmp_path))
    hits = records.news_hits(df, keep=("connector", "page")).collect()
    assert [(r.connector, r.page, r.url, r.title) for r in hits] == [("news", "1.json", "https://a.org/x", "T")]
    with pytest.raises(Exception, match="above 3 bytes"):
        spark.read.format("discovery").option("connector", "news").option("maxBytes", 3).load(str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("discovery").option("connector", "news").load(str(tmp_path / "empty")).count() == 0
