"""SQL of the queries on retrieval, evaluation, verification, provenance and usage."""

from __future__ import annotations

from attestry.functions.text import ARTICLES, COMPARISON, FILM, GENERIC, LOCATIVE, PREDICATES, SEARCH_PREDICATES
from attestry.plans.dataset_catalog import _CANON, _CLAIMS, _GOLD, _STORED


def _tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _unmark(x: str, flags: str = "gi") -> str:
    for mark, sign in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}")):
        x = f"regexp_replace({x}, '{mark}', '{sign}', '{flags}')"
    return x


def _words(x: str) -> str:
    return f"array_to_string({_tok(f'replace({_unmark(x)}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})')}, ' ')"


_SOME = " WHERE claim_id % 50 = 0"
_Q = f"{_CLAIMS}, q AS (SELECT split || ':' || claim_id AS qid, claim_id, split, claim, label FROM uc{_SOME})"
_PG = f"pg AS (SELECT page_id, {_words('page_id')} AS title, string_agg(text, ' ' ORDER BY sentence_id) AS body FROM cs GROUP BY page_id)"


def _field(field: str, queries: str = "q", key: str = "qid", text: str = "claim", p: str = "") -> str:
    """CTEs that end in ``{p}{field}_s``: BM25 of one field over the corpus."""
    f = p + field
    return f"""{f}_t AS (SELECT page_id, unnest({_tok(field)}) AS term FROM pg),
      {f}_l AS (SELECT page_id, count(*) AS length FROM {f}_t GROUP BY 1), {f}_tf AS (SELECT page_id, term, count(*) AS tf FROM {f}_t GROUP BY ALL),
      {f}_df AS (SELECT term, count(*) AS df FROM {f}_tf GROUP BY 1), {f}_n AS (SELECT count(*) AS n, avg(length) AS mean FROM {f}_l),
      {f}_q AS (SELECT {key}, term, count(*) AS qtf FROM (SELECT {key}, unnest({_tok(text)}) AS term FROM {queries}) GROUP BY ALL),
      {f}_s AS (SELECT {key}, page_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
        FROM {f}_q JOIN {f}_df USING (term) JOIN {f}_tf USING (term) JOIN {f}_l USING (page_id) CROSS JOIN {f}_n GROUP BY ALL)"""


def _top(name: str, source: str, k: int, key: str = "qid") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT {key}, page_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, page_id) AS rank
      FROM (SELECT {key}, page_id, round(sum(score), 6) AS score FROM ({source}) GROUP BY ALL)) WHERE rank <= {k})"""


_BOTH = "SELECT qid, page_id, 3.0 * score AS score FROM title_s UNION ALL SELECT qid, page_id, score FROM body_s"
_PAGES = f"{_Q}, {_CANON}, {_PG}, {_field('title')}, {_field('body')}, {_top('pt', _BOTH, 20)}"
_SENT = f"""{_PAGES}, {_STORED}, ca AS (SELECT qid, page_id, sentence_id, text, claim FROM pt JOIN st USING (page_id) JOIN q USING (qid)),
  cl AS (SELECT qid, page_id, sentence_id, len({_tok('text')}) AS length FROM ca), cn AS (SELECT qid, count(*) AS n, avg(length) AS mean FROM cl GROUP BY 1),
  ct AS (SELECT qid, page_id, sentence_id, term, count(*) AS tf FROM (SELECT qid, page_id, sentence_id, unnest({_tok('text')}) AS term FROM ca) GROUP BY ALL),
  cd AS (SELECT qid, term, count(*) AS df FROM ct GROUP BY ALL),
  qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tok('claim')}) AS term FROM q) GROUP BY ALL),
  sc AS (SELECT qid, page_id, sentence_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
    FROM qt JOIN cd USING (qid, term) JOIN ct USING (qid, term) JOIN cl USING (qid, page_id, sentence_id) JOIN cn USING (qid) GROUP BY ALL),
  sr AS (SELECT * FROM (SELECT qid, page_id, sentence_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id, sentence_id) AS rank
    FROM (SELECT qid, page_id, sentence_id, round(coalesce(score, 0.0), 6) AS score FROM cl LEFT JOIN sc USING (qid, page_id, sentence_id))) WHERE rank <= 50)"""
_OVERLAP = f"len(list_intersect(list_distinct({_tok('claim')}), list_distinct({_tok('text')}))) / len(list_distinct({_tok('claim')}))"
_R1 = f"""{_SENT}, r0 AS (SELECT qid, page_id, sentence_id, text, claim, sr.rank AS input_rank, CAST({_OVERLAP} AS FLOAT) AS f, {_OVERLAP} AS o
    FROM sr JOIN ca USING (qid, page_id, sentence_id)),
  r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, input_rank) AS rank FROM r0) WHERE rank <= 10)"""


def _has(text: str, phrase: str) -> str:
    return f"({phrase} <> '' AND contains(' ' || {text} || ' ', ' ' || {phrase} || ' '))"


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _anchors(source: str, keys: str) -> str:
    """CTEs that end in ``an``: the subject anchor and the further searches of each claim."""
    word = r"(?:^|[^\p{L}\p{N}\p{M}_])([A-Za-z](?:[\p{L}\p{N}\p{M}_''-]*[\p{L}\p{N}\p{M}_])?)"
    name = r"[A-Z][\p{L}\p{N}_-]*"
    return rf"""an0 AS (SELECT *, regexp_replace({_STRIP.format('claim')}, '^["“”]+|["“”]+$', '', 'g') AS t FROM {source}),
  an1 AS (SELECT *, regexp_matches(t, '\s+(?:{PREDICATES})\b', 'i') AS has,
    regexp_replace(regexp_extract(t, '^(.*?)\s+(?:{PREDICATES})\b', 1, 'is'), '^[ ,.;:!?\t]+|[ ,.;:!?\t]+$', '', 'g') AS subject FROM an0),
  an2 AS (SELECT *, regexp_extract(subject, '^({name}(?:\s+{name})*)[''’]s\b', 1) AS owner, regexp_extract(subject || ' in ', '^(.*?)\s+(?:in|at|near)\s+', 1, 'is') AS free FROM an1),
  an3 AS (SELECT *, regexp_extract_all(CASE WHEN owner <> '' THEN owner ELSE {_STRIP.format('free')} END, '{word}', 1) AS w FROM an2),
  an4 AS (SELECT *, CASE WHEN lower(w[1]) = 'the' THEN w[2:] ELSE w END AS named FROM an3),
  an5 AS (SELECT *, CASE WHEN has AND len(w) > 0 AND lower(w[1]) NOT IN {_LIST(GENERIC)} AND len(named) > 0 AND regexp_matches(named[1], '^\p{{Lu}}')
      AND (len(named) = 1 OR regexp_matches(named[-1], '^\p{{Lu}}')) THEN nullif({_words("array_to_string(named, ' ')")}, '') END AS anchor,
    regexp_matches(claim, '\s+(?:{SEARCH_PREDICATES})\b', 'i') AS has2,
    regexp_extract_all(regexp_replace(regexp_extract(claim, '^(.*?)\s+(?:{SEARCH_PREDICATES})\b', 1, 'is'), '^[ "“”.,;:!?]+|[ "“”.,;:!?]+$', '', 'g'), '[A-Za-z][A-Za-z0-9''’-]*') AS v FROM an4),
  an6 AS (SELECT *, CASE WHEN lower(v[1]) IN {_LIST(ARTICLES)} THEN v[2:] ELSE v END AS vn, array_to_string(v, ' ') AS vt FROM an5),
  an7 AS (SELECT *, regexp_extract(vt, '^(.+?)[''’]s sequel$', 1, 'i') AS vo, regexp_matches(claim, '\b(?:{FILM})\b', 'i') AND NOT ends_with(lower(vt), ' film') AS film,
    coalesce(has2 AND len(v) BETWEEN 1 AND 7 AND lower(v[1]) NOT IN {_LIST([g for g in GENERIC if g not in ARTICLES])} AND len(vn) > 0 AND regexp_matches(vn[1], '^\p{{Lu}}')
      AND (len(vn) = 1 OR regexp_matches(vn[-1], '^\p{{Lu}}') OR (len(vn) = 2 AND lower(vn[-1]) = 'sequel')), false) AS good FROM an6),
  an AS (SELECT {keys}, anchor, CASE WHEN NOT good THEN [] WHEN vo <> '' THEN [vo || ' 2', vo || ' sequel film'] WHEN film THEN [vt, vt || ' film'] ELSE [vt] END AS searches FROM an7)"""


_GROUNDED = f"(anchor IS NULL OR {_has(_words('page_id'), 'anchor')} OR {_has(_words('text'), 'anchor')})"
_SCORED = f"""{_R1}, {_anchors('q', 'qid')},
  r2 AS (SELECT r1.*, round(o * o, 6) AS p_entailment, round(2 * o * (1 - o), 6) AS p_contradiction, round((1 - o) * (1 - o), 6) AS p_neutral, {_GROUNDED} AS grounded,
    coalesce({_has(_words('text'), 'anchor')}, false) AS externally_grounded FROM r1 JOIN an USING (qid)),
  r3 AS (SELECT *, nli_label <> 'NEUTRAL' AND confidence >= 0.4 AND grounded AS accepted,
    CASE WHEN nli_label = 'NEUTRAL' THEN 'NEUTRAL_RELATION' WHEN confidence < 0.4 THEN 'BELOW_CONFIDENCE_THRESHOLD' WHEN NOT grounded THEN 'SUBJECT_NOT_GROUNDED' ELSE 'ACCEPTED_DECISIVE' END AS reason
    FROM (SELECT *, greatest(p_entailment, p_contradiction, p_neutral) AS confidence, CASE WHEN p_entailment >= greatest(p_contradiction, p_neutral) THEN 'ENTAILMENT'
      WHEN p_contradiction >= p_neutral THEN 'CONTRADICTION' ELSE 'NEUTRAL' END AS nli_label FROM r2))"""
_TITLE = rf"replace({_unmark('page_id')}, '_', ' ')"
_IN_BRACKETS = r"'^(.*?)\s*\(([^()]*)\)\s*$'"
_SCREENED = f"""{_SCORED},
  s0 AS (SELECT *, {_words('claim')} AS cw, {_TITLE} AS tt FROM r3),
  s1 AS (SELECT *, regexp_matches(tt, {_IN_BRACKETS}) AS m FROM s0),
  s2 AS (SELECT *, array_to_string({_tok(f"CASE WHEN m THEN regexp_extract(tt, {_IN_BRACKETS}, 1) ELSE tt END")}, ' ') AS base,
    CASE WHEN m THEN array_to_string({_tok(f"regexp_extract(tt, {_IN_BRACKETS}, 2)")}, ' ') END AS own, array_to_string({_tok(_unmark("coalesce(text, '')"))}, ' ') AS canon FROM s1),
  s3 AS (SELECT *, coalesce(regexp_matches(cw, '{LOCATIVE}') AND NOT regexp_matches(cw, '{COMPARISON}') AND len(string_split(base, ' ')) >= 2 AND {_has('cw', 'base')}, false) AS lon,
    coalesce(own IS NOT NULL AND ({' OR '.join(_has('cw', f"concat_ws(' ', base, '{x}', own)") for x in ('in', 'at', 'near'))}), false) AS lnamed FROM s2),
  kin AS (SELECT qid, base, bool_or(lnamed) AS scoped, bool_or(own IS NULL) AS canonical FROM s3 WHERE lon GROUP BY ALL),
  s4 AS (SELECT s3.*, CASE WHEN canon = '' THEN 'EMPTY_TEXT' WHEN regexp_matches(lower(tt), '\\(\\s*disambiguation\\s*\\)$') AND NOT contains(lower(claim), 'disambiguation') THEN 'DISAMBIGUATION_PAGE'
    WHEN NOT lon THEN NULL WHEN own IS NULL AND scoped THEN 'CANONICAL_PAGE_FOR_QUALIFIED_ENTITY'
    WHEN own IS NOT NULL AND NOT lnamed AND (canonical OR contains(string_split(page_id, '-LRB-')[-1], ',')) THEN 'ENTITY_VARIANT_MISMATCH' END AS own_reason FROM s3 LEFT JOIN kin USING (qid, base)),
  s5 AS (SELECT *, first(struct_pack(r := rank, p := page_id, s := sentence_id)) OVER (PARTITION BY qid, canon, own_reason IS NULL ORDER BY rank) AS fst FROM s4),
  s6 AS (SELECT *, own_reason IS NULL AND fst.r = rank AS ok FROM s5),
  s7 AS (SELECT *, sum(ok::INT) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS place FROM s6),
  sd AS (SELECT *, CASE WHEN own_reason IS NOT NULL THEN own_reason WHEN ok THEN CASE WHEN place <= 5 THEN 'SELECTED' ELSE 'UNUSED' END
    WHEN fst.p = page_id AND fst.s = sentence_id THEN 'DUPLICATE_EVIDENCE_ID' ELSE 'DUPLICATE_TEXT' END AS decision FROM s7)"""
_ROLE = """CASE WHEN NOT accepted THEN 'NOT_DECISIVE'
      WHEN row_number() OVER (PARTITION BY qid, page_id, nli_label, accepted ORDER BY confidence DESC, rank, sentence_id) > 1 THEN 'SAME_PAGE_ADDITIONAL'
      WHEN nli_label = 'ENTAILMENT' THEN 'PRIMARY_SUPPORT' ELSE 'PRIMARY_REFUTATION' END AS role"""


def _verdict(before: str, rows: str) -> str:
    return f"""{before}, vg AS (SELECT q.qid, count(DISTINCT page_id) FILTER (accepted AND nli_label = 'ENTAILMENT') AS supporting_pages,
    count(DISTINCT page_id) FILTER (accepted AND nli_label = 'CONTRADICTION') AS refuting_pages,
    count(*) FILTER (accepted AND nli_label = 'ENTAILMENT') AS supporting_rows, count(*) FILTER (accepted AND nli_label = 'CONTRADICTION') AS refuting_rows
    FROM q LEFT JOIN {rows} r USING (qid) GROUP BY q.qid),
  vv AS (SELECT *, CASE WHEN supporting_pages > 0 AND refuting_pages > 0 THEN 'CONFLICTING_EVIDENCE' WHEN supporting_pages > 0 THEN 'SUPPORTING_EVIDENCE'
    WHEN refuting_pages > 0 THEN 'REFUTING_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM vg)"""


_CHAIN = f"""{_SCREENED}, ch AS (SELECT *, {_ROLE} FROM sd WHERE decision = 'SELECTED')"""
_JUDGED = f"""{_verdict(_CHAIN, 'ch')}, ju AS (SELECT qid, claim, label, CASE verdict WHEN 'SUPPORTING_EVIDENCE' THEN 'SUPPORTS' WHEN 'REFUTING_EVIDENCE' THEN 'REFUTES'
    WHEN 'INSUFFICIENT_EVIDENCE' THEN 'NOT ENOUGH INFO' ELSE 'CONFLICT' END AS predicted FROM vv JOIN q USING (qid) WHERE label IN ('SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO'))"""
_PROB = """l AS (SELECT vec_id, label % 3 AS gold_id, embedding[1]::DOUBLE * 10 / 2.1753 AS a, embedding[2]::DOUBLE * 10 / 2.1753 AS b, embedding[3]::DOUBLE * 10 / 2.1753 AS c FROM embeddings),
  m AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM l),
  pr AS (SELECT vec_id, gold_id, ea / (ea + eb + ec) AS p0, eb / (ea + eb + ec) AS p1, ec / (ea + eb + ec) AS p2 FROM m),
  pc AS (SELECT *, round(greatest(p0, p1, p2), 9) AS confidence,
    (CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END) = gold_id AS correct FROM pr)"""
_BINS = f"{_PROB}, bi AS (SELECT CAST(least(floor(confidence * 15), 14) AS INT) AS bin, count(*) AS n, avg(correct::INT) AS accuracy, avg(confidence) AS confidence FROM pc GROUP BY 1)"
_USED = """du AS (SELECT user_id, ts::DATE AS day, value, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'signup' THEN 429 ELSE 201 END AS code FROM events),
  dd AS (SELECT user_id, day, count(*) AS requests, count(*) FILTER (code BETWEEN 200 AND 299) AS successful, count(*) FILTER (code >= 400 AND code <> 429) AS failed,
    count(*) FILTER (code = 429) AS limited, sum(value) AS latency_sum FROM du GROUP BY ALL),
  df AS (SELECT user_id, day, coalesce(requests, 0) AS requests, coalesce(successful, 0) AS successful, coalesce(failed, 0) AS failed, coalesce(limited, 0) AS limited,
    coalesce(latency_sum, 0.0) AS latency_sum FROM (SELECT DISTINCT user_id FROM dd)
    CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN dd USING (user_id, day))"""
_CUTS = (1, 5, 10, 20, 50)


def _summary() -> str:
    hits = ", ".join(f"round(avg(CASE WHEN f{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}, round(avg(f{k} / gold), 6) AS recall_at_{k}" for k in _CUTS)
    found = ", ".join(f"count(*) FILTER (rank <= {k}) AS f{k}" for k in _CUTS)
    return f"""WITH {_GOLD}, {_PAGES.replace(_CANON + ", ", "")}, g AS (SELECT DISTINCT q.qid, wiki_page AS page_id FROM gold JOIN q USING (claim_id, split)),
      m AS (SELECT qid, count(*) AS gold, min(rank) AS first_rank, {found} FROM g LEFT JOIN pt USING (qid, page_id) GROUP BY 1)
      SELECT count(*) AS queries, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, {hits} FROM m"""


_REVERSE = f"len(list_intersect(list_distinct({_tok('claim')}), list_distinct({_tok('text')}))) / nullif(len(list_distinct({_tok('text')})), 0)"
_HITS = f"""{_GOLD}, {_JUDGED.replace(_CANON + ", ", "")}, g AS (SELECT q.qid, evidence_set_id, wiki_page, sentence_id FROM gold JOIN q USING (claim_id, split)),
  x AS (SELECT qid, evidence_set_id, EXISTS (SELECT 1 FROM ch r WHERE r.qid = g.qid AND r.page_id = g.wiki_page) AS p,
    EXISTS (SELECT 1 FROM ch r WHERE r.qid = g.qid AND r.page_id = g.wiki_page AND r.sentence_id = g.sentence_id) AS s FROM g),
  z AS (SELECT qid, evidence_set_id, bool_or(p) AS p, bool_or(s) AS s, bool_and(s) AS c FROM x GROUP BY ALL),
  hi AS (SELECT qid, bool_or(p) AS any_page, bool_or(s) AS any_sentence, bool_or(c) AS complete_set FROM z GROUP BY qid),
  ev AS (SELECT qid, bool_or(decision = 'SELECTED' AND nli_label <> 'NEUTRAL' AND accepted) AS yes, bool_or(decision = 'SELECTED' AND nli_label <> 'NEUTRAL' AND NOT accepted) AS no,
    count(*) FILTER (decision = 'SELECTED') AS assessed_count, count(*) FILTER (decision NOT IN ('SELECTED', 'UNUSED')) AS excluded_count,
    bool_or(decision = 'ENTITY_VARIANT_MISMATCH') AS variant FROM sd GROUP BY 1)"""
_RATE = "round(count(*) FILTER ({}) / count(*), 6)"

_NONBLANK = "text IS NOT NULL AND trim(text) <> ''"
_CASES = f"""cs1 AS (SELECT *, CASE WHEN title IS NOT NULL THEN source || '/' || title END AS publisher, CASE WHEN doc_id % 2 = 0 THEN lang END AS origin,
    (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS "case" FROM documents WHERE {_NONBLANK}), cs2 AS (SELECT *, {_tok('text')} AS w FROM cs1),
  cs3 AS (SELECT *, CASE WHEN len(w) >= 80 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS sh FROM cs2),
  pr0 AS (SELECT a."case", a.doc_id AS left_id, b.doc_id AS right_id, CASE WHEN a.publisher = b.publisher THEN 'SAME_PUBLISHER' WHEN a.origin = b.origin AND a.origin <> '' THEN 'DECLARED_COMMON_ORIGIN'
    WHEN a.w = b.w AND len(a.w) >= 12 THEN 'IDENTICAL_TEXT' END AS sure, a.sh AS sa, b.sh AS sb FROM cs3 a JOIN cs3 b ON a."case" = b."case" AND a.doc_id < b.doc_id),
  pr1 AS (SELECT *, CASE WHEN sure IS NULL AND sa IS NOT NULL AND sb IS NOT NULL THEN round(len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))), 6) END AS similarity FROM pr0),
  pr2 AS (SELECT "case", left_id, right_id, coalesce(sure, CASE WHEN similarity >= 0.85 THEN 'POSSIBLE_TEXT_REUSE' ELSE 'UNDETERMINED' END) AS relation, similarity FROM pr1)"""
_FAMILIES = f"""nd AS (SELECT doc_id, CASE WHEN title IS NOT NULL THEN source || '/' || title END AS p, {_tok('text')} AS w FROM documents WHERE {_NONBLANK}),
  ky AS (SELECT doc_id, 'p' || p AS k FROM nd WHERE p IS NOT NULL UNION ALL SELECT doc_id, 'w' || array_to_string(w, ' ') FROM nd WHERE len(w) >= 12),
  hb AS (SELECT k, min(doc_id) AS h FROM ky GROUP BY k), lk AS (SELECT doc_id AS a, h AS b FROM ky JOIN hb USING (k) WHERE doc_id <> h),
  bo AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc AS (SELECT doc_id AS n, doc_id AS c FROM nd UNION SELECT bo.b, rc.c FROM rc JOIN bo ON bo.a = rc.n),
  fa AS (SELECT n AS doc_id, min(c) AS component FROM rc GROUP BY n)"""
_CONTEXT = """cx0 AS (SELECT doc_id, published_at AS p, retrieved_at AS r, TIMESTAMP '2023-01-10' AS a, TIMESTAMP '2022-06-01' AS f FROM documents),
  cx AS (SELECT *, CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p::DATE < f::DATE THEN 'BEFORE_REFERENCE' WHEN p::DATE > f::DATE THEN 'AFTER_REFERENCE' ELSE 'SAME_REFERENCE_DAY' END AS relation,
    CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p > a THEN 'FUTURE_DATED' WHEN floor((epoch_us(a) - epoch_us(p)) / 1000000 / 86400) > 365 THEN 'OLDER_THAN_WINDOW' ELSE 'WITHIN_WINDOW' END AS freshness FROM cx0)"""
_VOTES = f"""{_FAMILIES}, {_CONTEXT},
  fi0 AS (SELECT source || '#' || (doc_id % 8) AS "case", doc_id, CASE doc_id % 3 WHEN 0 THEN 'ENTAILMENT' WHEN 1 THEN 'CONTRADICTION' ELSE 'NEUTRAL' END AS stance,
    (doc_id % 20) / 20 + 0.05 AS confidence, doc_id % 13 <> 0 AS ok, doc_id % 11 <> 0 AS adm FROM documents WHERE {_NONBLANK}),
  fi AS (SELECT fi0.*, component, relation, freshness, CASE WHEN stance = 'NEUTRAL' THEN 'NEUTRAL' WHEN NOT ok THEN 'NLI_NOT_ACCEPTED' WHEN NOT adm THEN 'ADMISSIBILITY_BLOCKED'
    WHEN confidence < 0.5 THEN 'BELOW_CONFIDENCE_THRESHOLD' WHEN freshness IN ('OLDER_THAN_WINDOW', 'FUTURE_DATED') THEN 'TEMPORAL_REVIEW_REQUIRED' ELSE 'ELIGIBLE' END AS decision
    FROM fi0 JOIN fa USING (doc_id) JOIN cx USING (doc_id)),
  si AS (SELECT "case", component, bool_or(decision = 'ELIGIBLE' AND stance = 'ENTAILMENT') AS s, bool_or(decision = 'ELIGIBLE' AND stance = 'CONTRADICTION') AS r FROM fi GROUP BY ALL),
  vo AS (SELECT "case", count(*) FILTER (s) AS supporting, count(*) FILTER (r) AS refuting, count(*) FILTER (s AND r) AS mixed FROM si GROUP BY 1),
  fl AS (SELECT "case", count(*) FILTER (decision = 'ELIGIBLE') AS decisive, bool_or(relation = 'AFTER_REFERENCE') AS af, bool_or(decision = 'TEMPORAL_REVIEW_REQUIRED') AS re FROM fi GROUP BY 1),
  oc AS (SELECT "case", supporting, refuting, mixed, decisive, CASE WHEN supporting > 0 AND refuting > 0 THEN 'UNRESOLVED_OPPOSING_EVIDENCE' WHEN supporting > 1 THEN 'MULTI_FAMILY_SUPPORT_UNVERIFIED'
    WHEN refuting > 1 THEN 'MULTI_FAMILY_REFUTATION_UNVERIFIED' WHEN supporting = 1 THEN 'SINGLE_FAMILY_SUPPORT' WHEN refuting = 1 THEN 'SINGLE_FAMILY_REFUTATION' ELSE 'NO_DECISIVE_EVIDENCE' END AS outcome,
    concat_ws(';', 'INDEPENDENT_REPORTING_NOT_ESTABLISHED', 'NOT_A_CLAIM_TRUTH_PROBABILITY', CASE WHEN af THEN 'EVIDENCE_PUBLISHED_AFTER_REFERENCE_REVIEW_CONTEXT' END, CASE WHEN re THEN 'TEMPORAL_REVIEW_REQUIRED' END,
      CASE WHEN supporting > 0 AND refuting > 0 THEN 'OPPOSING_EVIDENCE_NEEDS_REVIEW' END, CASE WHEN mixed > 0 THEN 'OPPOSING_EVIDENCE_WITHIN_SAME_FAMILY' END) AS warnings FROM vo JOIN fl USING ("case"))"""
_PASSAGES = """tx AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}\\x{85}]')),
  ps AS (SELECT doc_id, -1 AS ordinal, 0 AS s, 0 AS e FROM tx UNION ALL
    SELECT doc_id, ordinal + 1, e, CASE WHEN n - e <= 800 THEN n WHEN least(b1, b2) > 400 THEN e + 800 ELSE e + 801 - least(b1, b2) END FROM (
      SELECT ps.doc_id, ps.ordinal, ps.e, n, CASE strpos(reverse(substring(text, ps.e + 1, 800)), ' ') WHEN 0 THEN 9999 ELSE strpos(reverse(substring(text, ps.e + 1, 800)), ' ') END AS b1,
        CASE strpos(reverse(substring(text, ps.e + 1, 800)), chr(10)) WHEN 0 THEN 9999 ELSE strpos(reverse(substring(text, ps.e + 1, 800)), chr(10)) END AS b2
      FROM ps JOIN tx ON tx.doc_id = ps.doc_id WHERE ps.e < n)),
  pa AS (SELECT ps.doc_id, ordinal, s AS start_offset, e AS end_offset, substring(text, s + 1, e - s) AS part FROM ps JOIN tx ON tx.doc_id = ps.doc_id WHERE ordinal >= 0)"""

_EXPANDED = f"""{_PAGES}, {_anchors('q', 'qid')}, sub AS (SELECT qid, qid || '#' || query_order AS sid, query_order, query FROM (SELECT qid, unnest(range(len(searches))) AS query_order, unnest(searches) AS query FROM an)),
      {_field('title', 'sub', 'sid', 'query', 'x')}, {_field('body', 'sub', 'sid', 'query', 'x')},
      {_top('fx', 'SELECT sid, page_id, 3.0 * score AS score FROM xtitle_s UNION ALL SELECT sid, page_id, score FROM xbody_s', 10, 'sid')},
      al AS (SELECT qid, page_id, 0 AS o, rank FROM pt UNION ALL SELECT sub.qid, fx.page_id, query_order + 1, fx.rank FROM fx JOIN sub USING (sid)),
      pl AS (SELECT qid, page_id, min(o * 1000 + rank) AS place FROM al GROUP BY ALL), rk AS (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY place, page_id) AS rank FROM pl),
      ex AS (SELECT rk.* FROM rk JOIN (SELECT qid, greatest(count(*), 32) AS most FROM pt GROUP BY 1) USING (qid) WHERE rank <= most)"""
_HYBRID = _EXPANDED + _SENT[len(_PAGES) :].replace("FROM pt JOIN st", "FROM ex JOIN st").replace("WHERE rank <= 50)", "WHERE rank <= 100)")


def _pad(byte: int, key: bytes = b"key of the test") -> str:
    """The key of an HMAC with every byte of its block changed, in hex."""
    return bytes(x ^ byte for x in key.ljust(64, b"\0")).hex()


def _grid(n: int, low: str, high: str) -> str:
    """CTEs that end in ``b{n}``: the temperature of least loss on a grid in its logarithm, and the step."""
    top = "greatest(a, b, c) / t"
    return f"""t{n} AS (SELECT exp({low} + ({high} - {low}) * i / 600) AS t, ({high} - {low}) / 600 AS step FROM range(601) r(i)),
  n{n} AS (SELECT t, any_value(step) AS step, avg(-ln(greatest(exp((CASE g WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / t - {top}) / (exp(a / t - {top}) + exp(b / t - {top}) + exp(c / t - {top})), 1e-15))) AS loss
    FROM lg CROSS JOIN t{n} GROUP BY t), b{n} AS (SELECT ln(first(t ORDER BY loss, t)) AS x, any_value(step) AS step FROM n{n})"""


_LOW, _HIGH = "ln(0.05::DOUBLE)", "ln(10.0::DOUBLE)"
_near = lambda n: (f"greatest((SELECT x - step FROM b{n}), {_LOW})", f"least((SELECT x + step FROM b{n}), {_HIGH})")

SQL = {
    "hybrid_retrieval": f"""WITH {_HYBRID},
      dv AS (SELECT * FROM (SELECT qid, page_id, sentence_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id, sentence_id) AS rank
        FROM (SELECT qid, page_id, sentence_id, round(coalesce({_REVERSE}, 0.0), 6) AS score FROM ca)) WHERE rank <= 100),
      rf AS (SELECT qid, page_id, sentence_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM (SELECT qid, page_id, sentence_id, rank FROM sr UNION ALL
        SELECT qid, page_id, sentence_id, rank FROM dv) GROUP BY ALL),
      rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, page_id, sentence_id) AS input_rank FROM rf) WHERE input_rank <= 50),
      fi AS (SELECT rr.*, CAST({_OVERLAP} AS FLOAT) AS f FROM rr JOIN ca USING (qid, page_id, sentence_id))
      SELECT * FROM (SELECT fi.qid, fi.page_id, fi.sentence_id, row_number() OVER (PARTITION BY fi.qid ORDER BY f DESC, input_rank) AS rank, input_rank, rrf_score,
        sr.score AS bm25_score, dv.score AS dense_score FROM fi LEFT JOIN sr USING (qid, page_id, sentence_id) LEFT JOIN dv USING (qid, page_id, sentence_id)) WHERE rank <= 10""",
    "failure_rows": f"""WITH {_HITS}
      SELECT ju.qid, claim, label, predicted, CASE WHEN predicted = 'CONFLICT' THEN 'CONFLICTING_PREDICTION' WHEN predicted IN ('SUPPORTS', 'REFUTES') THEN 'WRONG_DECISIVE_VERDICT'
        WHEN label <> 'NOT ENOUGH INFO' THEN 'ABSTENTION_ON_DECISIVE_GOLD' ELSE 'NEI_ABSTENTION' END AS failure_type,
        concat_ws(';', CASE WHEN NOT any_page THEN 'GOLD_PAGE_NOT_ASSESSED' WHEN NOT any_sentence THEN 'GOLD_SENTENCE_NOT_ASSESSED' WHEN NOT complete_set THEN 'GOLD_SET_INCOMPLETE_IN_ASSESSED' END,
          CASE WHEN NOT coalesce(yes, false) THEN 'NO_ACCEPTED_DECISIVE_NLI' END, CASE WHEN no THEN 'DECISIVE_LABEL_BELOW_THRESHOLD' END, CASE WHEN variant THEN 'ENTITY_VARIANT_FILTER_APPLIED' END) AS flags,
        any_sentence AS gold_sentence_assessed, complete_set AS gold_set_assessed, coalesce(assessed_count, 0) AS assessed_count, coalesce(excluded_count, 0) AS excluded_count
      FROM ju LEFT JOIN hi USING (qid) LEFT JOIN ev USING (qid) WHERE label <> predicted""",
    "benchmark_summary": f"""WITH {_HITS}, k AS (SELECT l AS label, count(*) FILTER (ju.label = l) AS support, count(*) FILTER (predicted = l) AS p,
        count(*) FILTER (ju.label = l AND predicted = l) AS tp FROM ju CROSS JOIN (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT ENOUGH INFO')) v(l) GROUP BY l),
      m AS (SELECT label, support, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS re FROM k)
      SELECT count(*) AS total, {_RATE.format("predicted IN ('SUPPORTS', 'REFUTES')")} AS decision_coverage,
        round(count(*) FILTER (predicted IN ('SUPPORTS', 'REFUTES') AND label = predicted) / nullif(count(*) FILTER (predicted IN ('SUPPORTS', 'REFUTES')), 0), 6) AS decided_accuracy,
        count(*) FILTER (predicted NOT IN ('SUPPORTS', 'REFUTES')) AS abstained, count(*) FILTER (predicted = 'CONFLICT') AS conflicting, {_RATE.format("label = predicted")} AS label_agreement,
        (SELECT round(avg(round(CASE WHEN round(pr, 6) + round(re, 6) > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6)), 6) FROM m) AS macro_f1,
        (SELECT count(*) FROM hi JOIN ju USING (qid)) AS gold_annotated, (SELECT {_RATE.format("any_page")} FROM hi JOIN ju USING (qid)) AS any_page_rate,
        (SELECT {_RATE.format("any_sentence")} FROM hi JOIN ju USING (qid)) AS any_sentence_rate, (SELECT {_RATE.format("complete_set")} FROM hi JOIN ju USING (qid)) AS complete_set_rate,
        (SELECT round(avg(coalesce(assessed_count, 0)), 3) FROM ju LEFT JOIN ev USING (qid)) AS mean_assessed,
        (SELECT string_agg(label || '=' || n, ';' ORDER BY label) FROM (SELECT label, count(*) AS n FROM ju GROUP BY 1)) AS gold_labels,
        (SELECT coalesce(string_agg(decision || '=' || n, ';' ORDER BY decision), '') FROM (SELECT decision, count(*) AS n FROM sd WHERE decision NOT IN ('SELECTED', 'UNUSED') GROUP BY 1)) AS exclusions FROM ju""",
    "claim_verification": f"""WITH {_verdict(_CHAIN, 'ch')}, c1 AS (SELECT qid, count(*) AS retrieved_count, count(*) FILTER (decision = 'SELECTED') AS assessed_count,
        count(*) FILTER (decision = 'UNUSED') AS unused_count, count(*) FILTER (decision NOT IN ('SELECTED', 'UNUSED')) AS excluded_count FROM sd GROUP BY 1),
      c2 AS (SELECT qid, count(*) FILTER (reason = 'SUBJECT_NOT_GROUNDED') AS blocked_count, count(*) FILTER (starts_with(role, 'PRIMARY')) AS primary_count FROM ch GROUP BY 1)
      SELECT vv.*, CASE verdict WHEN 'CONFLICTING_EVIDENCE' THEN 'OPPOSING_EVIDENCE' WHEN 'SUPPORTING_EVIDENCE' THEN 'SUPPORT_ONLY' WHEN 'REFUTING_EVIDENCE' THEN 'REFUTATION_ONLY' ELSE 'NO_DECISIVE_EVIDENCE' END AS basis,
        coalesce(retrieved_count, 0) AS retrieved_count, coalesce(assessed_count, 0) AS assessed_count, coalesce(unused_count, 0) AS unused_count, coalesce(excluded_count, 0) AS excluded_count,
        coalesce(blocked_count, 0) AS blocked_count, coalesce(primary_count, 0) AS primary_count FROM vv LEFT JOIN c1 USING (qid) LEFT JOIN c2 USING (qid)""",
    "claim_decisions": f"""WITH {_CHAIN} SELECT sd.qid, sd.rank, sd.page_id, sd.sentence_id, sd.decision, ch.nli_label, ch.confidence, ch.accepted, ch.reason, ch.role
      FROM sd LEFT JOIN ch ON sd.qid = ch.qid AND sd.rank = ch.rank""",
    "evidence_screening_windowed": f"WITH {_SCREENED} SELECT qid, rank, page_id, sentence_id, decision FROM sd",
    "grounded_evidence": f"WITH {_SCORED} SELECT qid, rank, grounded, externally_grounded FROM r3",
    "subject_anchors": f"WITH {_CLAIMS}, {_anchors('uc', 'claim_id, split')} SELECT claim_id, split, anchor, array_to_string(searches, ';') AS searches FROM an",
    "pair_relations": f"""WITH {_CASES} SELECT *, relation IN ('SAME_PUBLISHER', 'DECLARED_COMMON_ORIGIN', 'IDENTICAL_TEXT') AS group_together,
      CASE WHEN relation = 'SAME_PUBLISHER' THEN 'same_registered_source_id' WHEN relation = 'DECLARED_COMMON_ORIGIN' THEN 'matching_reported_origin_with_observation_urls'
        WHEN relation = 'IDENTICAL_TEXT' THEN 'identical_normalized_full_snapshot_text' WHEN relation = 'POSSIBLE_TEXT_REUSE' THEN 'five_word_shingle_similarity_review'
        WHEN similarity IS NULL THEN 'insufficient_evidence_of_shared_or_independent_reporting' ELSE 'no_strong_reuse_signal' END AS basis FROM pr2""",
    "family_warnings": f"""WITH {_CASES} SELECT "case", concat_ws(';', 'INDEPENDENCE_NOT_PROVEN', 'NO_CLAIM_TRUTH_INFERENCE', CASE WHEN bool_or(relation = 'POSSIBLE_TEXT_REUSE') THEN 'POSSIBLE_SYNDICATION_REQUIRES_REVIEW' END,
      CASE WHEN bool_or(relation = 'DECLARED_COMMON_ORIGIN') THEN 'ORIGIN_ATTRIBUTION_NOT_INDEPENDENTLY_VERIFIED' END) AS warnings FROM pr2 GROUP BY 1""",
    "source_families": f"WITH RECURSIVE {_FAMILIES} SELECT * FROM fa",
    "corroboration": f"WITH RECURSIVE {_VOTES} SELECT * FROM oc",
    "corroboration_violations": f"""WITH RECURSIVE {_VOTES} SELECT "case", supporting, refuting, mixed + 1 AS mixed, outcome FROM oc WHERE ends_with("case", '#5')""",
    "passages": f"WITH RECURSIVE {_PASSAGES} SELECT doc_id, ordinal, start_offset, end_offset, sha256(part) AS sha256 FROM pa",
    "snapshot_integrity": f"""WITH RECURSIVE {_PASSAGES} SELECT CASE WHEN doc_id % 7 = 0 THEN 'CONTENT_HASH' WHEN doc_id % 5 = 0 AND end_offset + 1000 > n THEN 'BOUNDS'
        WHEN substring(text, start_offset + 1, end_offset + CASE WHEN doc_id % 5 = 0 THEN 1000 ELSE 0 END - start_offset) <> CASE WHEN doc_id % 3 = 0 THEN lower(part) ELSE part END THEN 'TEXT'
        WHEN doc_id % 2 = 0 THEN 'PASSAGE_HASH' END AS problem, count(*) AS passages, count(DISTINCT doc_id) AS docs FROM pa JOIN tx USING (doc_id) GROUP BY 1""",
    "quota_windows": """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1 UNION ALL
        SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 1 HOUR GROUP BY w.user_id),
      x AS (SELECT event_id, e.user_id, CAST(row_number() OVER (PARTITION BY e.user_id, w.s ORDER BY e.ts, event_id) AS INT) AS hit FROM events e ASOF JOIN w ON e.user_id = w.user_id AND e.ts >= w.s)
      SELECT *, hit <= 3 AS allowed FROM x""",
    "expanded_pages": f"WITH {_EXPANDED} SELECT * FROM ex",
    "parsed_page_lines": r"""SELECT row_id, page_id, source_member, CAST(regexp_extract(raw_line, '^\s*([+-]?\d+)\s*\t', 1) AS INT) AS sentence_id,
      regexp_replace(regexp_extract(raw_line, '^[^\t]*\t([^\t\n]*)', 1), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS text FROM wiki_sentences WHERE regexp_matches(raw_line, '^\s*[+-]?\d+\s*\t')""",
    "latency_medians": "SELECT event_type, count(*) AS n, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY 1",
    "first_seen_pages": "SELECT page_id, min(row_id) AS first_position FROM wiki_sentences GROUP BY 1",
    "ranking_differences": f"""WITH {_Q}, {_CANON}, {_PG}, {_field('title')}, {_field('body')}, {_top('a', 'SELECT * FROM title_s', 5)}, {_top('b', 'SELECT * FROM body_s', 5)},
      n AS (SELECT 'title' AS field, count(*) AS hits FROM a UNION ALL SELECT 'body', count(*) FROM b)
      SELECT (SELECT count(*) FROM a FULL JOIN b USING (qid, rank) WHERE a.page_id IS DISTINCT FROM b.page_id OR abs(a.score - b.score) > 1e-5) AS places,
        (SELECT min(field) FROM n WHERE hits = (SELECT max(hits) FROM n)) AS field, (SELECT max(hits) FROM n) AS hits""",
    "checked_observations": """SELECT CASE WHEN i % 7 = 0 THEN 'PROVIDER' WHEN i % 11 = 0 THEN 'STATUS' WHEN i % 4 <> 0 AND i % 5 = 0 THEN 'FETCHED_WITHOUT_VERSION' WHEN i % 9 = 0 THEN 'DOCUMENT_OWNER'
      WHEN i % 5 <> 0 AND i % 13 = 0 THEN 'VERSION_OWNER' END AS problem, count(*) AS n FROM (SELECT doc_id AS i FROM documents) GROUP BY 1""",
    "attached_provenance": """WITH d AS (SELECT doc_id AS i FROM documents), x AS (SELECT i, t, i % 6 = 0 AS other, i % 10 = 0 AS blank, (i + 1) IN (SELECT i FROM d) AS nx FROM d CROSS JOIN (VALUES (0), (1)) v(t))
      SELECT CASE WHEN blank THEN 'METHOD' WHEN other AND NOT nx THEN 'UNKNOWN' WHEN other THEN 'OTHER_DOCUMENT' WHEN i % 8 = 4 THEN 'OTHER_VERSION' WHEN i % 8 = 0 OR t = 1 THEN 'EXISTING' ELSE 'ATTACH' END AS action, count(*) AS n FROM x GROUP BY 1""",
    "table_manifest": """WITH g AS (SELECT split, nli_label, count(*) AS n, sum(('0x' || substr(md5(concat_ws(chr(31), example_id::VARCHAR, split, nli_label)), 1, 15))::BIGINT::HUGEINT) AS x FROM nli_pairs_final GROUP BY ALL)
      SELECT '{"name":"nli_pairs_final","rows":' || sum(n) || ',"fingerprint":"' || sum(x)::HUGEINT || '","distribution":[' ||
        string_agg('{"split":"' || split || '","nli_label":"' || nli_label || '","n":' || n || '}', ',' ORDER BY split, nli_label) || ']}' AS manifest FROM g""",
    "first_claims_evidence": "SELECT evidence_row_id, claim_id FROM evidence WHERE claim_id IN (SELECT DISTINCT claim_id FROM evidence ORDER BY claim_id LIMIT 100)",
    "upserted_pages": """SELECT page_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at, row_id) AS k FROM wiki_sentences WHERE loaded_at >= TIMESTAMP '2023-04-01')
      WHERE k = 1 AND page_id NOT IN (SELECT page_id FROM wiki_sentences WHERE loaded_at < TIMESTAMP '2023-04-01' AND page_id IS NOT NULL)""",
    "connector_hits": """WITH o AS (SELECT * FROM (SELECT source, doc_id, retrieved_at, lower(title) AS canonical_url, row_number() OVER (PARTITION BY source, lower(title) ORDER BY retrieved_at, doc_id) AS k
      FROM documents WHERE title IS NOT NULL) WHERE k = 1)
      SELECT * FROM (SELECT source, doc_id, canonical_url, row_number() OVER (PARTITION BY source ORDER BY retrieved_at, doc_id) AS rank FROM o) WHERE rank <= 5""",
    "discovered_articles": rf"""WITH h AS (SELECT source AS connector, doc_id, retrieved_at, 'https://news.example.org/' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS url,
        left(trim(regexp_replace(title, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')), 1000) AS title FROM documents WHERE title IS NOT NULL AND doc_id % 10 <> 0),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connector, url ORDER BY retrieved_at, doc_id) AS k FROM h WHERE title <> '') WHERE k = 1)
      SELECT * FROM (SELECT connector, doc_id, url, 'news.example.org' AS publisher_domain, connector AS publisher_name, title, 1714550400 AS published,
        row_number() OVER (PARTITION BY connector ORDER BY retrieved_at, doc_id) AS rank FROM o) WHERE rank <= 5""",
    "page_bm25": f"WITH {_PAGES} SELECT * FROM pt",
    "sentence_bm25": f"WITH {_SENT} SELECT * FROM sr",
    "dense_top": """SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank
      FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0) WHERE rank <= 10""",
    "fused_pages": f"""WITH {_Q}, {_CANON}, {_PG}, {_field('title')}, {_field('body')}, {_top('a', 'SELECT * FROM body_s', 50)}, {_top('b', 'SELECT * FROM title_s', 50)},
      s AS (SELECT qid, page_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, page_id) AS rank FROM s) WHERE rank <= 50""",
    "page_metrics": _summary(),
    "sentence_metrics": f"""WITH {_GOLD}, {_SENT.replace(_CANON + ", ", "")}, g AS (SELECT DISTINCT q.qid, wiki_page AS page_id, sentence_id FROM gold JOIN q USING (claim_id, split))
      SELECT qid, count(*) AS gold, min(rank) AS first_rank, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank,
        CASE WHEN count(*) FILTER (rank <= 10) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_10, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10
      FROM g LEFT JOIN sr USING (qid, page_id, sentence_id) GROUP BY qid""",
    "reranked": f"WITH {_SCORED} SELECT qid, page_id, sentence_id, rank, confidence FROM r3",
    "contribution_roles": f"WITH {_SCORED} SELECT qid, page_id, sentence_id, rank, accepted, reason, {_ROLE} FROM r3",
    "page_verdicts": f"WITH {_verdict(_SCORED, 'r3')} SELECT * FROM vv",
    "verdict_confusion": f"""WITH {_JUDGED}, grid AS (SELECT * FROM (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT ENOUGH INFO')) g(gold)
      CROSS JOIN (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT ENOUGH INFO'), ('CONFLICT')) p(predicted))
      SELECT gold, grid.predicted, (SELECT count(*) FROM ju WHERE ju.label = gold AND ju.predicted = grid.predicted) AS n FROM grid""",
    "verdict_classes": f"""WITH {_JUDGED}, k AS (SELECT l AS label, count(*) FILTER (ju.label = l) AS support, count(*) FILTER (predicted = l) AS p,
        count(*) FILTER (ju.label = l AND predicted = l) AS tp FROM ju CROSS JOIN (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT ENOUGH INFO')) v(l) GROUP BY l),
      m AS (SELECT label, support, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS re FROM k)
      SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM m""",
    "verdict_selective": f"""WITH {_JUDGED} SELECT count(*) AS total, round(count(*) FILTER (predicted IN ('SUPPORTS', 'REFUTES')) / count(*), 6) AS decision_coverage,
      round(count(*) FILTER (predicted IN ('SUPPORTS', 'REFUTES') AND label = predicted) / nullif(count(*) FILTER (predicted IN ('SUPPORTS', 'REFUTES')), 0), 6) AS decided_accuracy,
      count(*) FILTER (predicted NOT IN ('SUPPORTS', 'REFUTES')) AS abstained, count(*) FILTER (predicted = 'CONFLICT') AS conflicting FROM ju""",
    "gold_set_hits": f"WITH {_HITS} SELECT * FROM hi",
    "softmax_labels": f"""WITH {_PROB} SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, CASE WHEN p0 = greatest(p0, p1, p2) THEN 'ENTAILMENT'
      WHEN p1 = greatest(p0, p1, p2) THEN 'CONTRADICTION' ELSE 'NEUTRAL' END AS top, abs(p0 + p1 + p2 - 1) <= 1e-4 AS ok FROM pr""",
    "probability_scores": f"""WITH {_PROB} SELECT count(*) AS n, round(avg(-ln(greatest(CASE gold_id WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15))), 6) AS nll,
      round(avg((p0 - (gold_id = 0)::INT) ** 2 + (p1 - (gold_id = 1)::INT) ** 2 + (p2 - (gold_id = 2)::INT) ** 2), 6) AS brier,
      round(avg(greatest(p0, p1, p2)), 6) AS mean_confidence, round(avg(correct::INT), 6) AS accuracy FROM pc""",
    "calibration_bins": f"WITH {_BINS} SELECT bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM bi",
    "calibration_error": f"WITH {_BINS} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bi",
    "selective_accuracy": f"""WITH {_PROB} SELECT t::DOUBLE AS threshold, count(*) FILTER (confidence >= t) AS accepted, round(count(*) FILTER (confidence >= t) / count(*), 6) AS coverage,
      round(count(*) FILTER (confidence >= t AND correct) / nullif(count(*) FILTER (confidence >= t), 0), 6) AS accuracy
      FROM pc CROSS JOIN (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(t) GROUP BY t""",
    "fitted_temperature": f"""WITH lg AS (SELECT label % 3 AS g, embedding[1]::DOUBLE * 10 AS a, embedding[2]::DOUBLE * 10 AS b, embedding[3]::DOUBLE * 10 AS c FROM embeddings),
      {_grid(1, _LOW, _HIGH)}, {_grid(2, *_near(1))}, {_grid(3, *_near(2))} SELECT round(exp(x), 4) AS temperature FROM b3""",
    "balanced_sample": """WITH RECURSIVE c AS (SELECT count(*) FILTER (nli_label = 'ENTAILMENT') AS a1, count(*) FILTER (nli_label = 'CONTRADICTION') AS a2, count(*) FILTER (nli_label = 'NEUTRAL') AS a3 FROM nli_pairs_final),
      b AS (SELECT *, least(900, a1 + a2 + a3) // 3 AS t, least(900, a1 + a2 + a3) AS most FROM c),
      d AS (SELECT a1, a2, a3, least(t, a1) AS q1, least(t, a2) AS q2, least(t, a3) AS q3, most FROM b UNION ALL
        SELECT a1, a2, a3, q1 + (q1 < a1)::INT, q2 + (q2 < a2 AND most - q1 - q2 - q3 > (q1 < a1)::INT)::INT, q3 + (q3 < a3 AND most - q1 - q2 - q3 > (q1 < a1)::INT + (q2 < a2)::INT)::INT, most FROM d WHERE q1 + q2 + q3 < most),
      e AS (SELECT * FROM d WHERE q1 + q2 + q3 = most LIMIT 1)
      SELECT l AS nli_label, n, n AS ids FROM (SELECT unnest(['ENTAILMENT', 'CONTRADICTION', 'NEUTRAL']) AS l, unnest([q1, q2, q3]) AS n FROM e) WHERE n > 0""",
    "actor_fingerprints": f"""SELECT substr(sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode('user:' || user_id)))), 1, 24) AS actor, n
      FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""",
    "label_halves": "SELECT nli_label, count(*) AS n, count(*) // 2 AS first_half FROM nli_pairs_final GROUP BY 1",
    "document_context": """WITH c AS (SELECT doc_id, published_at AS p, retrieved_at AS r, TIMESTAMP '2023-01-10' AS a, TIMESTAMP '2022-06-01' AS f FROM documents),
      s AS (SELECT *, CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p::DATE < f::DATE THEN 'BEFORE_REFERENCE' WHEN p::DATE > f::DATE THEN 'AFTER_REFERENCE' ELSE 'SAME_REFERENCE_DAY' END AS relation,
        CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p > a THEN 'FUTURE_DATED' WHEN floor((epoch_us(a) - epoch_us(p)) / 1000000 / 86400) > 365 THEN 'OLDER_THAN_WINDOW' ELSE 'WITHIN_WINDOW' END AS freshness FROM c)
      SELECT doc_id, relation, freshness, concat_ws(';', CASE WHEN p IS NULL THEN 'PUBLICATION_TIME_UNKNOWN' END, CASE WHEN p > r THEN 'PUBLICATION_AFTER_RETRIEVAL' END,
        CASE WHEN p > a THEN 'PUBLICATION_AFTER_ASSESSMENT' END, CASE WHEN relation = 'AFTER_REFERENCE' THEN 'EVIDENCE_POSTDATES_REFERENCE_REVIEW_REQUIRED' END,
        CASE WHEN freshness = 'OLDER_THAN_WINDOW' THEN 'OUTSIDE_CALLER_FRESHNESS_WINDOW' END, CASE WHEN freshness = 'FUTURE_DATED' THEN 'FUTURE_DATED_METADATA_REVIEW_REQUIRED' END) AS warnings FROM s""",
    "latest_as_of": """SELECT f.event_id AS fact_id, f.user_id, o.event_id, o.event_type FROM (SELECT * FROM events WHERE event_type = 'purchase') f
      LEFT JOIN LATERAL (SELECT event_id, event_type FROM events e WHERE e.user_id = f.user_id AND e.event_type <> 'purchase' AND e.ts <= f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) o ON true""",
    "version_history": """SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b""",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256, length(text) AS chars FROM documents",
    "daily_usage": f"WITH {_USED} SELECT user_id, day, requests, successful, failed, limited, round(latency_sum, 4) AS latency_sum FROM df",
    "usage_summary": f"""WITH {_USED} SELECT user_id, sum(requests)::BIGINT AS requests, sum(successful)::BIGINT AS successful, sum(failed)::BIGINT AS failed, sum(limited)::BIGINT AS limited,
      round(CASE WHEN sum(requests) > 0 THEN sum(latency_sum) / sum(requests) END, 6) AS mean_latency FROM df GROUP BY user_id""",
    "latency_percentiles": """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50,
      quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""",
    "log_counters": """SELECT regexp_extract(props, '"k":\\s*(\\d)\\d*', 1) AS found, count(*) AS n FROM events WHERE regexp_matches(props, '"k":\\s*(\\d)\\d*') GROUP BY 1""",
    "status_outcomes": """SELECT event_id, CASE event_id % 600 WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' WHEN 422 THEN 'invalid_request' WHEN 429 THEN 'rate_limited'
      WHEN 503 THEN 'unavailable' ELSE CASE WHEN event_id % 600 >= 500 THEN 'server_error' WHEN event_id % 600 >= 400 THEN 'client_error' WHEN event_id % 600 >= 300 THEN 'redirect' ELSE 'success' END END AS outcome FROM events""",
    "retained_events": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1",
    "shingle_counts": f"""WITH w AS (SELECT doc_id, {_tok('text')} AS w FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(CASE WHEN len(w) >= 5 THEN len(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) ELSE 0 END AS INT) AS shingles FROM w""",
    "canonical_claims": rf"""SELECT example_id, array_to_string({_tok(_unmark('claim'))}, ' ') AS canonical,
      trim(regexp_replace(regexp_replace({_unmark('premise', 'g')}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) AS clean FROM nli_pairs""",
    "page_titles": rf"""WITH p AS (SELECT page_id, replace({_unmark('page_id')}, '_', ' ') AS t FROM (SELECT DISTINCT page_id FROM wiki_sentences))
      SELECT page_id, array_to_string({_tok(r"CASE WHEN m THEN regexp_extract(t, '^(.*?)\s*\(([^()]*)\)\s*$', 1) ELSE t END")}, ' ') AS base,
        CASE WHEN m THEN array_to_string({_tok(r"regexp_extract(t, '^(.*?)\s*\(([^()]*)\)\s*$', 2)")}, ' ') END AS qualifier,
        regexp_matches(lower(t), '\(\s*disambiguation\s*\)$') AS disambiguation FROM (SELECT *, regexp_matches(t, '^(.*?)\s*\(([^()]*)\)\s*$') AS m FROM p)""",
    "public_urls": """WITH h AS (SELECT doc_id, lower(replace(source, '_', '-')) || '.example.org' AS host FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://' ELSE 'http://' END || host || CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN ':443' ELSE '' END || '/a/' || doc_id || '?x=1' AS url,
        CASE WHEN doc_id % 2 = 0 THEN host END AS domain FROM h""",
}

# Queries over all claims.
WHOLE = ["claim_decisions", "verdict_confusion", "verdict_selective", "failure_rows", "benchmark_summary", "gold_set_hits", "grounded_evidence", "reranked", "hybrid_retrieval"]
SQL |= {x: SQL[x].replace(_SOME, "") for x in WHOLE}
