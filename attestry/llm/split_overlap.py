"""Records of evaluation splits that recur, exactly or almost, in the training split.

Records are canonicalised (case, punctuation, spacing) and hashed, copies of a side collapsed to one
representative; evaluation hashes joined with training hashes settle the records that are equal.
Records that are almost equal share their figures, so the same join is made on the hash of a record's
figures in their order. Where a group of equal figures is crowded it is split further, without loss:
by the rarest of the evaluation record's certain names, which the training record must hold, and where
that is crowded too by blocks. A text of L words that may differ from another by at most k words is cut
into k + 1 blocks, one of which the other text must hold unchanged; the hash of a claim block with a
premise block is the join key. The scheme finds every pair within the bound. Candidates are then held
against the bound in word order.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from attestry.llm.text import digest, words
from attestry.session import shared_checkpoint

TRAIN = "train"
SHARE = 8  # one word in eight may differ, but always one


def _bound(n: int) -> int:
    return max(1, n // SHARE)


def _cuts(length: int) -> int:
    """Differing words to provide for: those of the longest text that can still be a partner."""
    return max(1, length // (SHARE - 1))


def _blocks(length: int) -> list[tuple[int, int]]:
    """(start, size) of the blocks of a text of ``length`` words; the last ones are longer by one."""
    n = _cuts(length) + 1
    base, longer = divmod(length, n)
    out, start = [], 0
    for i in range(n):
        size = base + (i >= n - longer)
        out.append((start, size))
        start += size
    return out


PLACED = 32  # longest text whose blocks are told by their place; beyond it places would multiply


def _hash(length: int, i: int, words: list[str]) -> int:
    place = f"{length} {i}" if 1 < length <= PLACED else "-"
    return xxhash.xxh64_intdigest(f"{place} {' '.join(words)}")


def stored_blocks(words: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the blocks of a text: (those of a short one, those of a long one), one of the lists empty."""
    n = len(words)
    blocks = list(dict.fromkeys(_hash(n, i, words[s : s + z]) for i, (s, z) in enumerate(_blocks(n)) if z))
    return (blocks, []) if n <= PLACED else ([], blocks)


def sought_blocks(words: list[str]) -> tuple[list[int], list[int]]:
    """All blocks under which a (short, long) partner of ``words`` may have been stored.

    Blocks of long partners are sought anywhere in the text, once for each of the few sizes they have, so that
    their number grows as the text does.
    """
    n = len(words)
    high = max(n + 1, n // (SHARE - 1) * SHARE + n % (SHARE - 1))
    short, long, sizes = set(), set(), set()
    for length in range(max(1, n - _bound(n)), high + 1):
        k, d = _cuts(length), n - length
        blocks = _blocks(length)
        if length == 1:
            short |= {_hash(1, 0, [w]) for w in words}
        elif length > PLACED:
            sizes |= {z for _, z in blocks}
        else:
            for i, (start, size) in enumerate(blocks):
                for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                    at = start + shift
                    if at >= 0 and at + size <= n:
                        short.add(_hash(length, i, words[at : at + size]))
    for z in sizes:
        long |= {_hash(length, 0, words[at : at + z]) for at in range(n - z + 1)}
    return sorted(short), sorted(long)


Blocks = Callable[[list[str]], tuple[list[int], list[int]]]
Batches = Iterator[pa.RecordBatch]
KEYS = "id long, figures long, k long"


def _key_rows(keys: Callable[[str, str], np.ndarray]) -> Callable[[Batches], Batches]:
    """Rows (id, figures, k): the keys that ``keys`` gives for each claim and premise."""

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            each = [keys(c, p) for c, p in zip(batch["claim"].to_pylist(), batch["premise"].to_pylist())]
            sizes = [len(x) for x in each]
            flat = np.concatenate([np.zeros(0, "uint64"), *each]).view("int64")
            yield pa.record_batch({"id": np.repeat(batch["id"].to_numpy(), sizes), "figures": np.repeat(batch["figures"].to_numpy(), sizes), "k": flat})

    return rows


def _block_keys(blocks: Blocks) -> Callable[[str, str], np.ndarray]:
    """A key of a short claim with a short premise is of a block of each; a long text gives keys of its own blocks alone."""

    def keys(claim: str, premise: str) -> np.ndarray:
        (c, long_c), (p, long_p) = (tuple(np.array(x, "uint64") for x in blocks([_fold(w) for w in _tokens(t)[0]])) for t in (claim, premise))
        both = (c[:, None] * np.uint64(0x9E3779B97F4A7C15) + p[None, :]).ravel()
        return np.unique(np.concatenate([both, long_p, long_c ^ np.uint64(0x5851F42D4C957F2D)]))

    return keys


def _word_keys(fields: list[list[str]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, i) for i, words in enumerate(fields) for w in dict.fromkeys(words)], "uint64")


def name_keys(claim: str, premise: str) -> np.ndarray:
    """The certain names of a record, which no partner lacks in the same field."""
    fields = []
    for text in (claim, premise):
        words, opens = _tokens(text)
        fields.append([_fold(w) for w, o in zip(words, opens) if w[0].isupper() and not o] if _mixed(words) else [])
    return _word_keys(fields)


def held_keys(claim: str, premise: str) -> np.ndarray:
    """All words of a record, by field."""
    return _word_keys([[_fold(w) for w in _tokens(text)[0]] for text in (claim, premise)])


MARKS = re.compile(r"-[LR]RB-", re.I)
WORDS = re.compile(r"[^\W_]+")


def _tokens(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text, and whether each opens a sentence, where its capital says nothing of a name.

    A full stop after a word of three letters or fewer may be that of an abbreviation and opens none.
    """
    text = MARKS.sub(" ", text)
    words, opens, end = [], [], 0
    for m in WORDS.finditer(text):
        gap = text[end : m.start()]
        opens.append(not words or "!" in gap or "?" in gap or ("." in gap and (len(words[-1]) > 3 or words[-1].isdigit())))
        words.append(m[0])
        end = m.end()
    return words, opens


def _fold(word: str) -> str:
    return word.upper().lower()


def word_edits(a: list[str], b: list[str], most: int) -> list[tuple[int, int]] | None:
    """The edits (place in a or -1, place in b or -1) of a shortest alignment, or None beyond ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = most + 1
    table = []
    row = [j if j <= most else far for j in range(m + 1)]
    table.append(row)
    for i in range(1, n + 1):
        new = [far] * (m + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            best = row[j - 1] + (a[i - 1] != b[j - 1])
            if row[j] + 1 < best:
                best = row[j] + 1
            if new[j - 1] + 1 < best:
                best = new[j - 1] + 1
            new[j] = best
        if min(new) > most:
            return None
        table.append(new)
        row = new
    if row[m] > most:
        return None
    i, j, edits = n, m, []
    while i or j:
        here = table[i][j]
        if i and j and a[i - 1] == b[j - 1] and table[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
        elif i and j and table[i - 1][j - 1] + 1 == here:
            i, j = i - 1, j - 1
            edits.append((i, j))
        elif i and table[i - 1][j] + 1 == here:
            i -= 1
            edits.append((i, -1))
        else:
            j -= 1
            edits.append((-1, j))
    return edits


# English numbers in words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)


def _mixed(words: list[str]) -> bool:
    letters = "".join(words)
    return letters != letters.lower() and letters != letters.upper()


def _touches_name(sides: list[tuple[list[str], list[bool], int]], names: set[str]) -> bool:
    """Whether an edit, given as (words as written, sentence openings, place or -1) of each side, touches a name or figure.

    Inside a sentence of a text of mixed case the capital decides; for a word that opens a sentence, or where the
    case is lost, the words written with a capital elsewhere in the pair do.
    """
    sides = [x for x in sides if x[2] >= 0]
    # A word that becomes a number by a misspelling is none: the other side would be one too, or missing.
    if any(c.isdigit() for w, _, k in sides for c in w[k]) or all(_fold(w[k]) in NUMBERS for w, _, k in sides):
        return True
    sure = [w[k][0].isupper() for w, o, k in sides if not o[k] and _mixed(w)]
    return any(sure) if sure else any(_fold(w[k]) in names for w, _, k in sides)


def same_record(claim_a: str, premise_a: str, claim_b: str, premise_b: str) -> bool:
    """Both fields within the bound, a word of each unchanged, and no edit touches a name or figure."""
    fields = [(_tokens(claim_a), _tokens(claim_b)), (_tokens(premise_a), _tokens(premise_b))]
    names: set[str] | None = None
    for (a, opens_a), (b, opens_b) in fields:
        fa, fb = [_fold(w) for w in a], [_fold(w) for w in b]
        if fa == fb:
            continue
        edits = word_edits(fa, fb, max(1, max(len(fa), len(fb)) // SHARE))
        if edits is None or len(fa) == sum(i >= 0 for i, _ in edits):
            return False
        if names is None:
            names = {_fold(w) for pair in fields for x, opens in pair if _mixed(x) for w, o in zip(x, opens) if w[0].isupper() and not o}
        if any(_touches_name([(a, opens_a, i), (b, opens_b, j)], names) for i, j in edits):
            return False
    return True


@F.pandas_udf(BooleanType())
def same_record_udf(ca: pd.Series, pa: pd.Series, cb: pd.Series, pb: pd.Series) -> pd.Series:
    return pd.Series([same_record(*x) for x in zip(ca, pa, cb, pb)], dtype="bool")


FIGURE = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]*\p{Nd}[\p{L}\p{N}]*"
CROWD = 8  # a key is crowded where it pairs more than this many records for each it holds
SMALL_ROWS = 200_000  # rows of 40 bytes that may be broadcast: 8 MB


def _records(rows: DataFrame) -> DataFrame:
    """Rows that take part, with their side, the hash of the canonical record and that of its figures in order; written once."""
    forms = rows.where(F.col("split").isNotNull()).select(
        "example_id", "split", "source_type", (F.col("split") == TRAIN).alias("in_train"), words(F.col("claim")).alias("c"), words(F.col("premise")).alias("p")
    )
    figures = [F.array_join(F.regexp_extract_all(F.col(x), F.lit(FIGURE), F.lit(0)), " ") for x in ("c", "p")]
    # Texts without a word are told after the canonical form is made, so that it is made once.
    record = F.when((F.col("c") != "") & (F.col("p") != ""), digest(F.concat("c", F.lit("\n"), "p")))
    return shared_checkpoint(forms.select("example_id", "split", "source_type", "in_train", record.alias("record"), F.xxhash64(*figures).alias("figures")), "records").where("record is not null")


def _crowded(e: str, t: str) -> Column:
    return F.col(e) * F.col(t) > CROWD * (F.col(e) + F.col(t))


def _crowded_candidates(texts: DataFrame) -> DataFrame:
    """(eval_id, train_id) within crowded groups of equal figures; ``texts`` holds (id, in_train, figures, claim, premise)."""
    evaluation, train = texts.where("not in_train"), texts.where("in_train")
    by_name = evaluation.mapInArrow(_key_rows(name_keys), KEYS)
    held = shared_checkpoint(train.mapInArrow(_key_rows(held_keys), KEYS), "held")
    counts = held.groupBy("figures", "k").agg(F.count("*").alias("t"))
    # The rarest name of each evaluation record; one that no training record holds leaves no partner.
    rarest = by_name.join(counts, ["figures", "k"], "left").groupBy("id", "figures").agg(F.min(F.struct(F.coalesce("t", F.lit(0)).alias("t"), "k")).alias("b"))
    rarest = shared_checkpoint(rarest.select("id", "figures", "b.*"), "rarest")
    asked = rarest.where("t > 0").groupBy("figures", "k").agg(F.count("*").alias("e"), F.first("t").alias("t"))
    few = rarest.drop("t").join(asked.where(~_crowded("e", "t")), ["figures", "k"])
    named = few.select("figures", "k", F.col("id").alias("eval_id")).join(held.withColumnRenamed("id", "train_id"), ["figures", "k"]).select("eval_id", "train_id")
    settled = rarest.join(asked.where(_crowded("e", "t")), ["figures", "k"], "left_anti").select("id")
    rest = evaluation.join(settled, "id", "left_anti")
    sought = rest.mapInArrow(_key_rows(_block_keys(sought_blocks)), KEYS).withColumnRenamed("id", "eval_id")
    # Only groups that still have evaluation records are cut into blocks.
    stored = train.join(rest.select("figures").distinct(), "figures", "left_semi").mapInArrow(_key_rows(_block_keys(stored_blocks)), KEYS).withColumnRenamed("id", "train_id")
    blocked = sought.join(stored, ["figures", "k"]).select("eval_id", "train_id").distinct()
    return named.unionByName(blocked)


def representative_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members gives each row's representative within its side; pairs links an
    evaluation representative ``eval_id`` to a training representative ``train_id``.

    Rows with a null or blank claim or premise or a null split take no part; any split but
    ``train`` counts as evaluation. At least one word of each field must be unchanged. Word edits are as the
    statement of the problem counts them; a figure is a word with a digit or a number in words.
    """
    rec = _records(rows)
    reps = shared_checkpoint(rec.groupBy("in_train", "record", "figures").agg(F.min("example_id").alias("rep"), F.count("*").alias("copies")), "reps")
    members = rec.drop("figures").join(reps.drop("figures"), ["in_train", "record"])
    sides = [reps.where(w).select("record", F.col("rep").alias(n)) for w, n in (("not in_train", "eval_id"), ("in_train", "train_id"))]
    equal = sides[0].join(sides[1], "record").select("eval_id", "train_id")

    groups = reps.groupBy("figures").agg(F.count_if(~F.col("in_train")).alias("e"), F.count_if("in_train").alias("t")).where("e > 0 and t > 0")
    live = reps.join(groups, "figures").select(F.col("rep").alias("id"), "in_train", "record", "figures", _crowded("e", "t").alias("crowded"))
    live = shared_checkpoint(live, "live")
    # The size decides: beyond the bound texts are joined by a shuffle.
    ids = F.broadcast(live) if live.count() <= SMALL_ROWS else live
    texts = shared_checkpoint(rows.select(F.col("example_id").alias("id"), "claim", "premise").join(ids, "id"), "texts")

    few = live.where("not crowded")
    near = few.where("not in_train").select("figures", F.col("id").alias("eval_id"), F.col("record").alias("r")).join(
        few.where("in_train").select("figures", F.col("id").alias("train_id"), "record"), "figures"
    )
    candidates = near.where("r <> record").select("eval_id", "train_id").unionByName(_crowded_candidates(texts.where("crowded")))
    left = texts.where("not in_train").select(F.col("id").alias("eval_id"), F.col("record").alias("ra"), F.col("claim").alias("ca"), F.col("premise").alias("pa"))
    right = texts.where("in_train").select(F.col("id").alias("train_id"), F.col("record").alias("rb"), F.col("claim").alias("cb"), F.col("premise").alias("pb"))
    found = candidates.join(left, "eval_id").join(right, "train_id").where("ra <> rb").where(same_record_udf("ca", "pa", "cb", "pb"))
    return members, equal.unionByName(found.select("eval_id", "train_id"))


def overlap_pairs(rows: DataFrame) -> DataFrame:
    """(example_id_a, example_id_b), smaller first: every overlapping row of training and evaluation."""
    members, pairs = representative_pairs(rows)
    ev = members.where("not in_train").select(F.col("rep").alias("eval_id"), F.col("example_id").alias("e"))
    tr = members.where("in_train").select(F.col("rep").alias("train_id"), F.col("example_id").alias("t"))
    both = pairs.join(ev, "eval_id").join(tr, "train_id")
    return both.select(F.least("e", "t").alias("example_id_a"), F.greatest("e", "t").alias("example_id_b"))


def overlap_report(rows: DataFrame) -> DataFrame:
    """Per split and source_type: rows, rows that recur in training, and training rows they match.

    Counted from representatives and their copy counts; the pairs of copies are not made.
    """
    members, pairs = representative_pairs(rows)
    sizes = members.where("in_train").select(F.col("rep").alias("train_id"), "copies").distinct()
    linked = pairs.join(sizes, "train_id").groupBy(F.col("eval_id").alias("rep")).agg(F.sum("copies").alias("matches"))
    return (
        members.where("not in_train")
        .join(linked, "rep", "left")
        .groupBy("split", "source_type")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("matches").alias("overlapping_rows"),
            F.coalesce(F.sum("matches"), F.lit(0)).alias("train_matches"),
        )
    )
