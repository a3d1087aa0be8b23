"""Copies, survivors and split overlaps against plain Python."""

import random
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.llm import copies, split_overlap, survivors

PAIR = "example_id long, claim string, premise string, code long, form string"


def links(spark, pairs):
    df = spark.createDataFrame([(i, c, p, 7, "clash") for i, (c, p) in enumerate(pairs)], PAIR)
    return sorted(tuple(r) for r in copies.copy_links(df, "example_id", ["claim", "premise"], "a", "b").collect())



def bare(s):
    return "".join(c for c in s if not c.isspace() and not unicodedata.category(c).startswith("P")).upper().lower()


def test_formatting_order_nulls_and_ties(spark):
    pairs = [("A b.", "C"), ("a B", "c!"), ("c", "ab"), (None, "c"), ("ab", None), ("  ", "c"), ("ab", "d"), ("Straße", "x"), ("STRASSE", "X"), ("...", "!"), ("?", "«»"), ("ab", "C"), ("c", "c"), ("C", "c ")]
    groups = {}
    for i, (c, p) in enumerate(pairs):
        if c and p and c.strip() and p.strip():
            groups.setdefault(tuple(sorted((bare(c), bare(p)))), []).append(i)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert links(spark, pairs) == want and (0, 2) in want and (7, 8) in want and (9, 10) in want
    assert links(spark, []) == []


def test_hot_copies_and_counts(spark):
    df = spark.range(3000).select(F.col("id").alias("example_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("c"), "id")).alias("claim"), F.lit("p").alias("premise"))
    n = copies.record_copies(df, "example_id", ["claim", "premise"])
    assert n.count() == 2001 and n.agg(F.max("copies")).head()[0] == 1000 and n.agg(F.sum("copies")).head()[0] == 3000
    assert copies.copy_links(df, "example_id", ["claim", "premise"], "a", "b").agg(F.count("*"), F.max("a")).head()[:] == (999, 0)


WIKI = "row_id long, page_id string, sentence_id int, text string, raw_line string, source_member string, loaded_at timestamp_ntz, removed_at timestamp_ntz, form string"


def wiki(spark, data):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, p, s, t, None, m, None if d is None else t0 + timedelta(days=d), None, "x") for i, p, s, t, m, d in data], WIKI)


def test_page_spellings_and_text_choice(spark):
    data = [
        (1, "A_b", 0, "short", "m", 0), (2, " A b\t", 0, "longer  ", "m", 1), (3, "A__b", 0, "longer", "n", 2), (4, "a_b", 0, "x", "m", 0),
        (5, "Gü_-LRB-film-RRB-", 1, None, "m", 5), (6, "Gü (film)", 1, " ", "m", 5), (7, "Gü_-lrb-film-rrb-", 1, None, "m", 4),
        (8, None, 0, "t", "m", 0), (9, None, 0, "t", "m", 0), (10, "A_b", None, "t", "m", 0), (11, "A_b", None, "t", "m", 0), (12, "Q", 3, "tie", "m", None), (13, "Q", 3, "tie", "m", None),
    ]
    got = {r.group_row_id: r for r in survivors.wiki_survivors(wiki(spark, data)).collect()}
    assert {k: r.text_row_id for k, r in got.items()} == {1: 3, 5: 5, 12: 12}
    assert got[1].source_member == "n" or got[1].source_member == "m"
    assert survivors.wiki_survivors(wiki(spark, [])).count() == 0


def test_votes_prefer_trusted_and_recent(spark):
    data = [(1, "P", 0, "t", "old", 0), (2, "P", 0, "t", "old", 1), (3, "P", 0, "t", "new", 400)]
    groups = survivors.wiki_groups(wiki(spark, data))
    field = (survivors.Field("source_member"),)
    assert survivors.field_winners(groups, "row_id", "loaded_at", field, half_life_days=30).head().source_member == "new"
    assert survivors.field_winners(groups, "row_id", "loaded_at", field, half_life_days=1e9).head().source_member == "old"
    trust = F.when(F.col("source_member") == "new", 5.0).otherwise(1.0)
    assert survivors.field_winners(groups, "row_id", "loaded_at", field, trust, 1e9).head().source_member == "new"


def test_a_reloaded_sentence_is_live(spark):
    t = lambda d: datetime(2023, 1, 1) + timedelta(days=d)
    data = [(1, "P", 0, "t", None, "m", t(0), t(150), "x"), (2, "P", 0, "t", None, "m", t(180), None, "x"), (3, "Q", 0, "t", None, "m", t(0), None, "x"), (4, "Q", 0, "t", None, None, t(9), t(10), "x")]
    got = {r.group_row_id: (r.loaded_at, r.removed_at, r.removed_at_row_id) for r in survivors.wiki_survivors(spark.createDataFrame(data, WIKI)).collect()}
    assert got == {1: (t(180), None, 2), 3: (t(9), t(10), 4)}


def test_a_hot_group_of_survivors(spark):
    """A third of all rows are deliveries of one sentence."""
    n = 6000
    i = F.col("id")
    hot = i % 3 == 0
    df = spark.range(n).select(
        i.alias("row_id"), F.when(hot, "Hot_page").otherwise(F.concat(F.lit("P"), (i / 2).cast("int"))).alias("page_id"), F.lit(0).alias("sentence_id"),
        F.when(i == 4242, "the longest text").otherwise("short").alias("text"), F.lit(None).cast("string").alias("raw_line"), F.concat(F.lit("s"), i % 7).alias("source_member"),
        F.timestamp_add("SECOND", i.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("loaded_at"), F.lit(None).cast("timestamp_ntz").alias("removed_at"),
    )
    got = {r.group_row_id: r.text_row_id for r in survivors.wiki_survivors(df).collect()}
    assert got[0] == 4242 and len(got) > 1 and df.where(hot).count() == 2000


def test_trust_of_a_source_is_its_share_of_texts(spark):
    data = [(1, "P", 0, "t", "good", 0), (2, "P", 0, "t", "bad", 0), (3, "Q", 0, " ", "bad", 0), (4, "R", 0, None, "bad", 0), (5, "S", 0, "t", None, 0)]
    rows = wiki(spark, data)
    trust = survivors.source_trust(rows, "source_member", F.col("text").rlike(r"\S"))
    assert {r.source_member: round(r.trust, 3) for r in trust.collect()} == {"good": 1.0, "bad": 0.333}
    assert survivors.wiki_survivors(rows).head().source_member == "good"
    given = spark.createDataFrame([("bad", 0.9), ("good", 0.1)], "source_member string, trust double")
    assert survivors.wiki_survivors(rows, trust=given).head().source_member == "bad"


NLI = "example_id long, split string, source_type string, claim string, premise string, record string, k long"
CLAIM = "The potter Ada Vell led the Old Society for 6 years in Brum ."
PREMISE = "Its first president was Ada Vell , a potter from Brum , who served for 6 years as noted by Tom Hale in a long letter of 1887 ."


def overlap(spark, rows):
    df = spark.createDataFrame([(i, s, "g", c, p, "clash", 1) for i, s, c, p in rows], NLI)
    return sorted(tuple(r) for r in split_overlap.overlap_pairs(df).collect())


def test_overlaps(spark):
    rows = [
        (1, "train", CLAIM, PREMISE),
        (2, "test", CLAIM.upper().replace(" .", ""), PREMISE),
        (3, "validation", CLAIM.replace("years", "yaers"), PREMISE.replace("first ", "").replace("long letter", "longer letter")),
        (4, "test", CLAIM.replace("6", "7"), PREMISE),  # figure
        (5, "test", CLAIM.replace("Ada", "Eda"), PREMISE),  # name
        (6, "test", CLAIM, "Something else was said about it ."),
        (7, "test", None, PREMISE), (8, None, CLAIM, PREMISE), (9, "test", " ", PREMISE), (10, "test", "...", PREMISE),
        (11, "test", CLAIM.replace("led the", "guided an"), PREMISE),  # two words of twelve
        (12, "train", CLAIM, PREMISE.lower()),
        (13, "test", "Word", "one"), (14, "train", "word", "One!"),
    ]
    assert overlap(spark, rows) == sorted([(1, 2), (1, 3), (2, 12), (3, 12), (13, 14)])
    assert overlap(spark, []) == [] and overlap(spark, rows[:1]) == []


def test_number_words_and_sentence_openings():
    pair = lambda a, b: split_overlap.same_record("It was open for a while", a, "It was open for a while", b)
    assert not pair("the fair lasted six days in all", "the fair lasted seven days in all")
    assert not pair("the fair lasted six days in all", "the fair lasted days in all")
    assert pair("the guild met there on each day", "the guild met three on each day")
    assert pair("It rained for long. The fair closed early then", "It rained for long. A fair closed early then")
    assert not pair("It rained for long. The fair in Brum closed then", "It rained for long. The fair in Drum closed then")
    assert not pair("alone", "another")


def test_records_of_one_template(spark):
    """Ten thousand records that differ in names and figures only, and a hot claim; each has one partner."""
    n = 5000
    names = [f"{a}{b}{c}{d}".capitalize() for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmnpr" for d in ("ax", "en", "il", "op", "ur", "ys", "ed", "ak", "in", "ob")][:n]
    claim = lambda k: f"the old mill of {names[k]} was sold by the town"
    premise = lambda k, w: f"In that year the {w} of {names[k]} sold the old mill to a neighbour after a long quarrel"
    rows = [(k, "train", claim(k), premise(k, "council")) for k in range(n)] + [(n + k, "test", claim(k), premise(k, "councill")) for k in range(n)]
    assert overlap(spark, rows) == [(k, n + k) for k in range(n)]


def test_long_premises(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(600)] for _ in range(60)]
    rows = [(k, "train", "the same claim of all", " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        other = list(t)
        for at in rng.sample(range(600), 40 if k % 2 else 90):
            other[at] = "changed"
        rows.append((1000 + k, "test", "the same claim of all", " ".join(other)))
    assert overlap(spark, rows) == [(k, 1000 + k) for k in range(60) if k % 2]


def test_report_counts_copies_without_pairs(spark):
    rows = [(i, "train", CLAIM, PREMISE) for i in range(5)] + [(9, "test", CLAIM, PREMISE.upper()), (10, "test", "other claim here", PREMISE)]
    df = spark.createDataFrame([(i, s, "g", c, p, "x", 1) for i, s, c, p in rows], NLI)
    assert [tuple(r) for r in split_overlap.overlap_report(df).collect()] == [("test", "g", 2, 1, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_find_every_pair_within_the_bound(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    for _ in range(400):
        a = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, rng.randint(1, 60), rng.randint(60, 150)]))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 8))):
            kind, at = rng.random(), rng.randrange(len(b) + 1)
            if kind < 0.34:
                b.insert(at, rng.choice(vocabulary))
            elif b and kind < 0.67:
                del b[min(at, len(b) - 1)]
            elif b:
                b[min(at, len(b) - 1)] = rng.choice(vocabulary)
        if not b:
            continue
        most = max(1, max(len(a), len(b)) // 8)
        edits = split_overlap.word_edits(a, b, most)
        if edits is not None and len(a) > sum(i >= 0 for i, _ in edits):
            for x, y in ((a, b), (b, a)):
                stored, sought = split_overlap.stored_blocks(x), split_overlap.sought_blocks(y)
                assert any(set(s) & set(t) for s, t in zip(stored, sought))


def test_word_edits():
    assert split_overlap.word_edits(["a", "b"], ["a", "b"], 1) == []
    assert split_overlap.word_edits(["a", "b", "c"], ["a", "c"], 1) == [(1, -1)]
    assert split_overlap.word_edits(["a", "b"], ["c", "d"], 1) is None
    assert split_overlap.word_edits([], ["a"], 1) == [(-1, 0)]
