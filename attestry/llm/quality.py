"""Statistics of a text's words, signs, lines and repetitions, and the share of it that is running prose.

Prose shows in every language by a steady supply of the language's frequent words between few
separators. Both are counted in a window that moves over the units of a text (a word, a number, or one
sign of a script without spaces); characters around which frequent words are too thin for the
separators are not prose. Sentences repeated over and over, further copies of a line or paragraph, word
trigrams that recur and dominate a text, and long chains of frequent words without content are not prose
either.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.pretokens import WHITE_SPACE, text_chunks

OTHER, SPACE, LETTER, DIGIT, IDEOGRAPH = range(5)
# Scripts written without spaces (kana, CJK ideographs with extension A, compatibility forms).
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
SENTENCE_END = re.compile(r"[.!?。！？…]+[\s\"”»)]*|\n+")
LINE_END = tuple(".!?。！？…:;\"”»)")
MARKER = re.compile(r"^\s*(?:[-*•·#]|\d+[.)]|\[[ x]?\]|[A-Z]\d*\))")


@dataclass(frozen=True)
class QualityRules:
    """half_window: units on either side. least_score: frequent-word share less separator_weight times
    separators per unit, below which a unit is not in prose. repeats: times a sentence must occur for
    its further copies to count as filler. chain: frequent words in a row of which prose has few;
    chain_share, chain_gaps: least share of units in such chains, and most separators or figures per unit,
    that together mark words strung without sense, seen in chain_window units on either side.
    trigram_share: share of a text's characters from which a trigram that occurs ``repeats`` times is filler;
    the same share of a text's sentences makes forms of one or two signs filler. recurring_share: share from which all such trigrams together are. copied_units: least units of a line or
    paragraph whose further copies are filler.
    junk_share: share of characters outside prose from which a text is junk."""

    half_window: int = 12
    least_score: float = 0.06
    separator_weight: float = 0.5
    repeats: int = 3
    chain: int = 3
    chain_share: float = 0.1
    chain_window: int = 25
    chain_gaps: float = 0.03
    trigram_share: float = 0.3
    recurring_share: float = 0.9
    copied_units: int = 3
    junk_share: float = 2 / 3


RULES = QualityRules()


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "M": LETTER, "N": DIGIT}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], "uint8")
    for a, b in UNSPACED:
        table[a : b + 1] = IDEOGRAPH
    table[WHITE_SPACE] = SPACE
    return table


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _window_mean(values: np.ndarray, owner_start: np.ndarray, owner_end: np.ndarray, half: int) -> np.ndarray:
    """Mean over each position's window, kept within its text."""
    i = np.arange(len(values))
    a, b = np.maximum(i - half, owner_start), np.minimum(i + half + 1, owner_end)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[b] - total[a]) / (b - a)


def _repeated_spans(text: str, least: int, short_share: float) -> list[tuple[int, int]]:
    """Places of the sentences that occur ``least`` times or more in a text, case and outer space ignored.

    Forms of one or two signs, as single words on lines of their own are, must be ``short_share`` of all sentences.
    """
    spans, start = [], 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        if end > start:
            spans.append((start, end))
        start = end
    if len(spans) < least:
        return []
    forms = [text[a:b].strip().lower() for a, b in spans]
    counts = Counter(forms)
    return [x for x, f in zip(spans, forms) if f and counts[f] >= (least if len(f) > 2 else max(least, short_share * len(spans)))]


def _copied_spans(text: str, separator: str) -> list[tuple[int, int]]:
    """Places of the second and later copies of a text's parts, outer space ignored."""
    spans, seen, start = [], set(), 0
    for part in text.split(separator):
        form = part.strip()
        if form and form in seen:
            spans.append((start, start + len(part)))
        seen.add(form)
        start += len(part) + len(separator)
    return spans


def _under(places: np.ndarray, n: int) -> np.ndarray:
    """The units of trigrams that begin at ``places``, out of ``n``."""
    out = np.zeros(n, bool)
    for k in range(3):
        out[places + k] = True
    return out


STATS = (
    ("n_chars", "long"), ("n_words", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("digit_ratio", "double"), ("line_end_share", "double"), ("marker_line_share", "double"),
    ("common_word_share", "double"), ("language", "string"), ("duplicate_line_share", "double"),
    ("duplicate_paragraph_share", "double"), ("duplicate_sentence_share", "double"), ("top_trigram_share", "double"),
    ("non_prose_share", "double"), ("is_junk", "boolean"),
)


def _repeated_share(parts: list[str], least: int) -> float:
    """Share of characters in further copies of parts that occur ``least`` times or more."""
    whole = sum(map(len, parts))
    if not whole:
        return 0.0
    return sum(len(p) * (n - 1) for p, n in Counter(parts).items() if n >= least) / whole


def text_stats(texts: pa.Array, common: dict[str, set[str]], rules: QualityRules = RULES) -> dict[str, list]:
    """Columns of STATS for texts without nulls."""
    raw = texts.to_pylist()
    values = [html.unescape(v) if "&" in v else v for v in raw]
    n_texts = len(values)
    joined = "".join(values)
    points = np.frombuffer(joined.encode("utf-32-le"), "uint32")
    n = len(points)
    lengths = np.array([len(v) for v in values], "int64")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out: dict[str, list] = {"n_chars": [len(v) for v in raw]}
    size = np.maximum(lengths, 1)
    kind = _classes()[points] if n else np.zeros(0, "uint8")

    at = np.zeros(n + 1, bool)
    at[starts] = True
    if n:
        at[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == IDEOGRAPH)
    bounds = np.flatnonzero(at)
    first, end = bounds[:-1], bounds[1:]
    unit = np.isin(kind[first], (LETTER, DIGIT, IDEOGRAPH)) if n else np.zeros(0, bool)
    first, end = first[unit], end[unit]
    m = len(first)
    edges = np.searchsorted(first, starts)
    owner = np.repeat(np.arange(n_texts), np.diff(edges))
    is_word = kind[first] != DIGIT if m else np.zeros(0, bool)

    out["n_words"] = _sums(is_word, edges).tolist()
    word_chars = _sums((end - first) * is_word, edges)
    out["mean_word_length"] = (word_chars / np.maximum(out["n_words"], 1)).tolist()
    out["symbol_ratio"] = (_sums(kind == OTHER, starts) / size).tolist()
    out["digit_ratio"] = (_sums(kind == DIGIT, starts) / size).tolist()

    # Distinct words are looked up once.
    width = 1 + (points >= 0x80).astype("int8") + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width, dtype="int64")])
    tokens = np.empty(2 * m + 1, "int64")
    tokens[0:-1:2], tokens[1::2] = offset[first], offset[end]
    tokens[-1] = offset[n]
    tokens = np.concatenate([[0], tokens])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens) - 1, [None, pa.py_buffer(tokens), pa.py_buffer(joined.encode())])
    coded = spans.take(pa.array(np.arange(1, 2 * m + 1, 2))).dictionary_encode()
    number = coded.indices.to_numpy().astype("int64")
    words = [w.decode(errors="replace").lower() for w in coded.dictionary.to_pylist()]
    languages = sorted(common)
    shares = []
    words_per_text = np.maximum(np.diff(edges), 1)
    frequent_by = []
    for lang in languages:
        table = np.array([w in common[lang] for w in words], bool) if words else np.zeros(0, bool)
        frequent = table[number] if m else np.zeros(0, bool)
        frequent_by.append(frequent)
        shares.append(_sums(frequent, edges) / words_per_text)
    shares = np.array(shares) if languages else np.zeros((1, n_texts))
    best = shares.argmax(0)
    out["common_word_share"] = shares.max(0).tolist()
    out["language"] = [languages[b] if s > 0 else None for b, s in zip(best, shares.max(0))]
    # A word that touches a digit is part of a code, not a word.
    free = np.ones(m, bool)
    if m:
        free &= (kind[np.minimum(end, n - 1)] != DIGIT) | (end >= n)
        free &= (kind[np.maximum(first - 1, 0)] != DIGIT) | (first == 0) | (kind[first] == IDEOGRAPH)
        free |= kind[first] == IDEOGRAPH
    frequent = np.zeros(m, bool)
    for k in range(len(languages)):
        mine = best[owner] == k if m else np.zeros(0, bool)
        frequent[mine] = frequent_by[k][mine]
    frequent &= free

    # Separators in the gap after each unit.
    breaks = (kind == OTHER) & ~np.isin(points, [0x27, 0x2019, 0x2D, 0x5F])
    tabs = (points == 9) | (points == 0x7C)
    newline = points == 10
    blank = (kind == SPACE) & ~newline
    totals = [np.concatenate([[0], np.cumsum(x)]) for x in (breaks | tabs, newline, blank)]
    after = np.concatenate([first[1:], [n]]) if m else first
    after = np.minimum(after, starts[owner + 1]) if m else after
    hard, lines, wide = (t[after] - t[end] for t in totals)
    gap = np.where((hard > 0) | (wide >= 3), 1.0, np.where(lines > 0, 0.5, 0.0))
    lo, hi = edges[:-1][owner] if m else edges[:0], edges[1:][owner] if m else edges[:0]
    score = _window_mean(frequent.astype(float), lo, hi, rules.half_window) - rules.separator_weight * _window_mean(gap, lo, hi, rules.half_window)
    # Chains of frequent words: salad of words rather than sentences.
    turn = np.ones(m + 1, bool)
    if m:
        turn[1:m] = (frequent[1:] != frequent[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(turn)
    run_size = np.repeat(np.diff(runs), np.diff(runs))
    chained = frequent & (run_size >= rules.chain)
    salad = (_window_mean(chained.astype(float), lo, hi, rules.chain_window) >= rules.chain_share) & (
        _window_mean(np.maximum(gap, ~is_word), lo, hi, rules.chain_window) <= rules.chain_gaps
    )
    outside = (score < rules.least_score) | salad
    repeated = [_repeated_spans(v, rules.repeats, rules.trigram_share) for v in values]
    for k, spans in enumerate(repeated):
        for a, b in spans:
            outside[np.searchsorted(first, starts[k] + a) : np.searchsorted(first, starts[k] + b)] = True
    line_end, marked, dup_line, dup_par = [], [], [], []
    for k, v in enumerate(values):
        rows = [r for r in (x.strip() for x in v.split("\n")) if r]
        n_rows = max(len(rows), 1)
        line_end.append(sum(r.endswith(LINE_END) for r in rows) / n_rows)
        marked.append(sum(bool(MARKER.match(r)) for r in rows) / n_rows)
        dup_line.append(_repeated_share(rows, 2))
        dup_par.append(_repeated_share([p for p in (x.strip() for x in v.split("\n\n")) if p], 2))
        for separator, copied in (("\n", dup_line[-1]), ("\n\n", dup_par[-1])):
            for a, b in _copied_spans(v, separator) if copied else ():
                i, j = np.searchsorted(first, [starts[k] + a, starts[k] + b])
                if j - i >= rules.copied_units:
                    outside[i:j] = True
    out |= {"line_end_share": line_end, "marker_line_share": marked, "duplicate_line_share": dup_line}
    begin = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), starts[:-1][owner], first) if m else first
    weight = (after - begin) * 1.0
    covered = _sums(weight, edges)

    # Word trigrams: characters under the occurrences of the dominant one; units under those that are filler.
    top = np.zeros(n_texts)
    if m >= 3:
        same = owner[2:] == owner[:-2]
        key = (number[:-2] * 1_000_003 + number[1:-1]) * 1_000_003 + number[2:]
        place = np.flatnonzero(same)
        key, own, chars = key[same], owner[:-2][same], (end[2:] - first[:-2])[same]
        order = np.lexsort((key, own))
        key, own, chars, place = key[order], own[order], chars[order], place[order]
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        groups = np.flatnonzero(change)
        if len(groups):
            counts = np.diff(np.concatenate([groups, [len(key)]]))
            np.maximum.at(top, own[groups], np.where(counts > 1, counts * chars[groups], 0))
            recurs = counts >= rules.repeats
            dominant = recurs & (counts * chars[groups] >= rules.trigram_share * size[own[groups]])
            under = _under(place[np.repeat(recurs, counts)], m)
            whole = _sums(weight * under, edges) >= rules.recurring_share * np.maximum(covered, 1)
            outside |= _under(place[np.repeat(dominant, counts)], m) | (under & whole[owner])
    out["top_trigram_share"] = np.minimum(1.0, top / size).tolist()

    share = np.where(covered > 0, _sums(weight * outside, edges) / np.maximum(covered, 1), 1.0)
    dup_sent = [sum(b - a for a, b in spans) / max(len(v), 1) for v, spans in zip(values, repeated)]
    out |= {"duplicate_paragraph_share": dup_par, "duplicate_sentence_share": dup_sent}
    out["non_prose_share"] = share.tolist()
    is_text = np.array([bool(v.strip()) for v in values], bool)
    out["is_junk"] = ((share >= rules.junk_share) & is_text).tolist()
    return out


ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def common_words(rows: list) -> dict[str, set[str]]:
    """Lower-case frequent words by language, from rows (lang, word)."""
    out: dict[str, set[str]] = {}
    for lang, word in rows:
        if lang and word:
            out.setdefault(lang, set()).add(word.lower())
    return out


def document_quality(docs: DataFrame, common: dict[str, set[str]], rules: QualityRules = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id_column`` and the columns of STATS), one row per document, whole texts, no shuffle.

    Null, empty and blank texts have zero counts and shares, ``non_prose_share`` 1 and ``is_junk`` false.
    A text without any word or digit is wholly outside prose. Extra columns are dropped. ``common`` is
    the word list by language: a list of fixed length, sent with the function.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = pc.fill_null(batch["text_"], ""), batch["id_"]
            for a, b in text_chunks(texts):
                stats = text_stats(texts.slice(a, b - a), common, rules)
                yield pa.record_batch([ids.slice(a, b - a), *(pa.array(stats[c], ARROW[t]) for c, t in STATS)], names=[id_column, *(c for c, _ in STATS)])

    schema = ", ".join([f"{id_column} long", *(f"{c} {t}" for c, t in STATS)])
    return docs.select(F.col(id_column).cast("long").alias("id_"), F.col(text_column).alias("text_")).mapInArrow(rows, schema)
