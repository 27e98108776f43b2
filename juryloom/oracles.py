"""DuckDB SQL for the registered queries, written with windows and joins where the queries use array functions."""

from __future__ import annotations

from .config import BUCKETS, ITEMS, ScoringConfig
from .functions.text import ARTIFACT, ASIDE, BRACKETED, META_PHRASES
from .operators.corpus import KEYWORDS
from .operators.digests import LEAF_LINES
from .queries import CONFIG, NA_DIGITS

_C: ScoringConfig = CONFIG


def _q(text: str) -> str:
    return text.replace("'", "''")


def _bucket(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in BUCKETS.items()) + " END"


def _values(rows: list[str], names: str) -> str:
    return f"(VALUES {', '.join(rows)}) AS v({names})"


def _split(c: str) -> str:
    h = f"sha256({c})"
    ten = f"((6 * list_sum(list_transform(string_split(left({h}, 63), ''), lambda d: instr('0123456789abcdef', d) - 1)) + instr('0123456789abcdef', right({h}, 1)) - 1) % 10)"
    return f"CASE WHEN {ten} <= 7 THEN 'train' WHEN {ten} = 8 THEN 'dev' ELSE 'test' END"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TIDY = [(r"[ \t]{2,}", " "), (r"[ \t]+\n", chr(10)), (r"\n[ \t]+", chr(10)), (r"\s+([,.;:!?])", r"\1"), (r"\.\.(\s|$)", r".\1")]
_tidied = "cut"
for _p, _to in _TIDY:
    _tidied = f"regexp_replace({_tidied}, '{_p}', '{_to}', 'g')"
_WORDS = r"len(regexp_extract_all({}, '\S+'))"
_META = " OR ".join([r"starts_with(low, ',')", *(f"contains(low, '{m}')" for m in META_PHRASES)])

DIALOGUES = f"""
dialogues AS (
  SELECT 'conv' || CASE WHEN length(conv_id::VARCHAR) < 6 THEN lpad(conv_id::VARCHAR, 6, '0') ELSE conv_id::VARCHAR END AS file_id,
         CASE WHEN conv_id % 2 = 0 THEN 'mdd' ELSE 'control' END AS condition,
         string_agg(line, chr(10) ORDER BY turn, role, line) AS dialogue
  FROM (SELECT *, CASE role WHEN 'user' THEN 'Client: ' WHEN 'assistant' THEN 'Therapist: ' ELSE 'System: ' END || coalesce(text, '') AS line FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), dialogues_split AS (SELECT *, {_split('file_id')} AS computed_split FROM dialogues)"""

UTTERANCES = rf"""{DIALOGUES}, ln AS (
  SELECT file_id, pos, regexp_replace(line, '^\s+', '') AS line FROM (
    SELECT file_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
    FROM (SELECT file_id, string_split_regex(dialogue, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM dialogues))
  WHERE regexp_replace(line, '^\s+', '') <> ''
), lab AS (
  SELECT *, regexp_matches(line, '^(?i:therapist|client)\s*:') AS is_label,
         NOT regexp_matches(line, '^(?i:therapist|client)\s*:') AND regexp_matches(line, '^[^:]{{1,32}}\s*:\s+') AS is_other FROM ln
), seg AS (SELECT *, sum(is_label::INT) OVER (PARTITION BY file_id ORDER BY pos) AS seg FROM lab WHERE NOT is_other
), u0 AS (
  SELECT file_id, seg, max(CASE WHEN is_label THEN lower(left(line, 1)) END) AS s,
         string_agg(CASE WHEN is_label THEN regexp_extract(line, '^(?i:therapist|client)\s*:\s*(.*)$', 1) ELSE {_STRIP.format('line')} END, chr(10) ORDER BY pos) AS joined
  FROM seg WHERE seg > 0 GROUP BY file_id, seg
), u1 AS (SELECT *, {_STRIP.format('joined')} AS raw FROM u0
), u2 AS (SELECT *, regexp_replace(raw, '(?i){_q(ARTIFACT)}', '', 'g') AS cut FROM u1 WHERE raw <> ''
), u3 AS (SELECT *, CASE WHEN cut = raw THEN raw ELSE {_STRIP.format(_tidied)} END AS a FROM u2
), u4 AS (SELECT *, regexp_replace(a, '(?i){BRACKETED}', '', 'g') AS b FROM u3
), u5 AS (SELECT *, regexp_replace(b, '(?is){ASIDE}', '') AS c0 FROM u4
), u6 AS (SELECT *, CASE WHEN c0 = b THEN b ELSE regexp_replace(c0, '\s+$', '') END AS c1 FROM u5
), u7 AS (SELECT *, c1 <> raw AS changed, {_STRIP.format('c1')} AS t, lower({_STRIP.format('c1')}) AS low FROM u6
), u8 AS (SELECT *, t <> '' AND ({_META}) AS meta, length(t) > 4000 OR {_WORDS.format('t')} > 200 AS long FROM u7
), u9 AS (
  SELECT file_id, seg, CASE WHEN s = 't' THEN 'therapist' ELSE 'client' END AS speaker, changed OR meta AS meta_removed, long AND NOT meta AS truncated,
         CASE WHEN t = '' OR meta THEN NULL WHEN long THEN regexp_replace(left(regexp_extract(t, '^\s*\S+(?:\s+\S+){{0,199}}'), 4000), '\s+$', '') ELSE t END AS text FROM u8
), utt AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seg) - 1 AS INTEGER) AS utt_no, speaker, text, truncated FROM u9 WHERE text IS NOT NULL)"""

VIEWS = f"""{UTTERANCES}, q AS (
  SELECT *, lag(speaker) OVER w AS before, lag(text) OVER w AS asked FROM utt WINDOW w AS (PARTITION BY file_id ORDER BY utt_no)
), v AS (
  SELECT file_id, string_agg(upper(left(speaker, 1)) || substring(speaker, 2) || ': ' || text, chr(10) ORDER BY utt_no) AS dialogue_clean,
         string_agg(text, chr(10) ORDER BY utt_no) FILTER (speaker = 'client') AS client_only_text,
         string_agg(CASE WHEN before = 'therapist' THEN 'Therapist: ' || asked || chr(10) ELSE '' END || 'Client: ' || text, chr(10) ORDER BY utt_no) FILTER (speaker = 'client') AS client_qa_text,
         count(*) FILTER (speaker = 'client') AS nc, count(*) FILTER (speaker <> 'client') AS nt, count(*) FILTER (speaker = 'client' AND {_WORDS.format('text')} < 5) AS ns
  FROM q GROUP BY file_id
), vc AS (SELECT file_id, count(*) FILTER (truncated) AS trunc, count(*) FILTER (meta_removed) AS metas FROM u9 GROUP BY file_id
), lc AS (SELECT file_id, count(*) FILTER (is_other) AS others FROM lab GROUP BY file_id
), oc AS (SELECT file_id, count(*) FILTER (seg = 0) AS orphans FROM seg GROUP BY file_id
), views AS (
  SELECT d.file_id, d.condition, d.computed_split, {_STRIP.format("coalesce(dialogue_clean, '')")} AS dialogue_clean, {_STRIP.format("coalesce(client_only_text, '')")} AS client_only_text,
         {_STRIP.format("coalesce(client_qa_text, '')")} AS client_qa_text, CAST(coalesce(nc, 0) AS INTEGER) AS client_utterance_count, CAST(coalesce(nt, 0) AS INTEGER) AS therapist_utterance_count,
         CAST(coalesce(ns, 0) AS INTEGER) AS short_answer_count, CAST(coalesce(trunc, 0) AS INTEGER) AS truncated_utterance_count, CAST(coalesce(metas, 0) AS INTEGER) AS meta_text_removed_count,
         CAST(coalesce(others, 0) AS INTEGER) AS unknown_speaker_count, CAST(coalesce(orphans, 0) AS INTEGER) AS orphan_line_count
  FROM dialogues_split d LEFT JOIN v USING (file_id) LEFT JOIN vc USING (file_id) LEFT JOIN lc USING (file_id) LEFT JOIN oc USING (file_id)
)"""

_HEX = "instr('0123456789abcdef', substring(h, {}, 1)) - 1"
VOTES = f"""{VIEWS}, jurors AS (SELECT * FROM {_values([f"('{m}', {r})" for m, r in _C.jurors], 'model_id, run_number')}),
items AS (SELECT * FROM {_values([f"({i}, '{x}')" for i, x in enumerate(ITEMS)], 'item_idx, item')}),
hashed AS (SELECT file_id, condition, computed_split, model_id, run_number, item_idx, item, client_qa_text AS text, sha256(model_id || '|' || run_number || '|' || item || '|' || client_qa_text) AS h FROM views, jurors, items),
votes AS (SELECT *, CAST(({_HEX.format(64)}) % 4 AS INTEGER) AS plain, ({_HEX.format(63)}) IN ({', '.join(map(str, NA_DIGITS))}) AS skipped FROM hashed),
na AS (SELECT *, CASE WHEN NOT skipped THEN plain END AS score FROM votes)"""


def _item_agg(source: str) -> str:
    low, high = _C.ambiguity_band
    return f"""
c AS (SELECT file_id, condition, computed_split, item_idx, item, {', '.join(f'count(*) FILTER (score = {k}) AS c{k}' for k in range(4))}, count(score) AS nn, count(*) AS n,
      max(score) - min(score) AS vote_range, sum(coalesce(score, 0)) / count(*) AS vote_mean FROM {source} GROUP BY ALL),
p AS (SELECT *, {', '.join(f'CASE WHEN nn > 0 THEN (c{k} + {_C.alpha}::DOUBLE) / (nn + {4 * _C.alpha}::DOUBLE) END AS p{k}' for k in range(4))},
      CASE WHEN nn > 0 THEN CASE WHEN c0 >= greatest(c1, c2, c3) THEN 0 WHEN c1 >= greatest(c2, c3) THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END END AS mode FROM c),
ia AS (SELECT *, p1 + 2 * p2 + 3 * p3 AS expected, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) AS entropy, p2 + p3 AS clinical_prob, n - nn AS na_count, (n - nn) / n AS p_na,
       CASE WHEN 2 * (n - nn) > n OR mode IS NULL THEN NULL ELSE mode END AS consensus FROM p),
ib AS (SELECT *, CASE WHEN consensus IS NULL THEN 'not_mentioned' WHEN mode = 0 THEN 'denied' ELSE 'present' END AS said,
       coalesce(nn > 0 AND na_count >= {_C.na_count_threshold}, false) AS r0, coalesce(greatest(p0, p1, p2, p3) < {_C.max_prob_threshold}::DOUBLE, false) AS r1, coalesce(entropy > {_C.entropy_threshold}::DOUBLE, false) AS r2,
       coalesce(clinical_prob BETWEEN {low}::DOUBLE AND {high}::DOUBLE, false) AS r3, coalesce(vote_range >= {_C.range_threshold}, false) AS r4 FROM ia),
agg AS (SELECT *, r0 OR r1 OR r2 OR r3 OR r4 AS needs FROM ib)"""


def _scored(source: str) -> str:
    steps = []
    masses = "CASE WHEN consensus IS NULL THEN CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END END"
    steps.append(f"mass AS (SELECT file_id, item_idx, k, {masses} AS p FROM agg, (SELECT unnest([0, 1, 2, 3]) AS k)), d0 AS (SELECT file_id, k AS t, p FROM mass WHERE item_idx = 0)")
    steps += [f"d{i} AS (SELECT a.file_id, a.t + b.k AS t, sum(a.p * b.p) AS p FROM d{i - 1} a JOIN mass b ON a.file_id = b.file_id AND b.item_idx = {i} GROUP BY 1, 2)" for i in range(1, 8)]
    joined = ", ".join(steps)
    return f"""{joined},
cum AS (SELECT *, sum(p) OVER (PARTITION BY file_id ORDER BY t) AS cdf FROM d7),
dist AS (SELECT file_id, sum(t * p) AS m, min(t) FILTER (cdf >= 0.05) AS lo, min(t) FILTER (cdf >= 0.95) AS hi, sum(t * t * p) AS m2 FROM cum GROUP BY file_id),
jt AS (SELECT file_id, model_id, run_number, sum(coalesce(score, 0))::DOUBLE AS x FROM {source} GROUP BY ALL),
jm AS (SELECT file_id, avg(x) AS m FROM jt GROUP BY ALL),
js AS (SELECT file_id, sqrt(sum((x - m) * (x - m)) / count(*)) AS s FROM jt JOIN jm USING (file_id) GROUP BY file_id),
tot AS (SELECT file_id, condition, computed_split, CAST(sum(coalesce(consensus, 0)) AS INTEGER) AS total, CAST(count(consensus) AS INTEGER) AS nd, bool_or(needs) AS any_item, avg(coalesce(entropy, NULL)) AS mean_entropy, max(vote_range) AS max_range FROM agg GROUP BY ALL),
sc AS (SELECT tot.*, m, sqrt(m2 - m * m) AS sd, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, s, s >= {_C.total_std_threshold} AS wide, any_item OR s >= {_C.total_std_threshold} AS triggered,
       CASE WHEN nd >= 7 THEN CAST(floor(total / nd * 8 + 0.5) AS INTEGER) END AS pro FROM tot JOIN dist USING (file_id) JOIN js USING (file_id)),
co AS (SELECT agg.*, agg.needs OR sc.wide AS contested, CAST(least(3, greatest(0, round_even(agg.vote_mean, 0))) AS INTEGER) AS verdict FROM agg JOIN sc USING (file_id)),
fi AS (SELECT *, CASE WHEN contested THEN verdict ELSE consensus END AS final FROM co),
ft AS (SELECT file_id, condition, computed_split, CAST(sum(coalesce(final, 0)) AS INTEGER) AS total, CAST(count(final) AS INTEGER) AS nd, bool_or(contested) AS judged, string_agg(coalesce(final, 0)::VARCHAR, ',' ORDER BY item_idx) AS scores FROM fi GROUP BY ALL)"""


_VA = f"{VOTES},{_item_agg('na')}"
_SC = f"{_VA}, {_scored('na')}"
_PLAIN = f"{VOTES}, pv AS (SELECT *, plain AS score FROM votes),{_item_agg('pv')}, {_scored('pv')}"
_NAMES = list(BUCKETS)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _covered(extra: str = "") -> str:
    low = "lower(coalesce(text, ''))"
    hits = ", ".join(f"CAST(len(regexp_extract_all({low}, '{_q(a)}')) + len(regexp_extract_all({low}, '{_q(b)}')) AS INTEGER) AS {i}" for i, (a, b) in KEYWORDS.items())
    said = " + ".join(f"({i} > 0)::INTEGER" for i in ITEMS)
    return f"k0 AS (SELECT doc_id, {extra} {hits}, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS INTEGER) AS word_count FROM documents), k AS (SELECT *, CAST({said} AS INTEGER) AS mentioned_count, ({said}) / 8.0::DOUBLE AS coverage FROM k0)"


def _alpha(by: str) -> str:
    """Ordinal alpha by joins over values; by is '' or 'item'."""
    k = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""
units{by} AS (SELECT {k} nn, v, w, (CASE v WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) * ((CASE w WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) - (v = w)::INT) / (nn - 1) AS o
  FROM agg, (SELECT unnest([0, 1, 2, 3]) AS v), (SELECT unnest([0, 1, 2, 3]) AS w) WHERE nn >= 2),
o{by} AS (SELECT {k} v, w, sum(o) AS o FROM units{by} GROUP BY ALL),
n{by} AS (SELECT {k} v AS g, sum(o) AS n FROM o{by} GROUP BY ALL),
t{by} AS (SELECT {k} sum(n) AS total FROM n{by} {'GROUP BY item' if by else ''}),
d{by}x AS (SELECT o.*, a.n AS nv, b.n AS nw, (SELECT sum(c.n) FROM n{by} c WHERE c.g BETWEEN least(o.v, o.w) AND greatest(o.v, o.w) {'AND c.item = o.item' if by else ''}) - (a.n + b.n) / 2 AS d
  FROM o{by} o JOIN n{by} a ON a.g = o.v {'AND a.item = o.item' if by else ''} JOIN n{by} b ON b.g = o.w {'AND b.item = o.item' if by else ''}),
a{by}x AS (SELECT {k} 1 - (max(total) - 1) * sum(o * d * d) / sum(nv * nw * d * d) AS alpha FROM d{by}x JOIN t{by} {on} {'GROUP BY item' if by else ''})"""


_HUMAN = f"hu AS (SELECT file_id, (total + regexp_replace(file_id, 'conv', '')::INT % 5) % 25 AS human, total AS own, 'ann' || (regexp_replace(file_id, 'conv', '')::INT % 3) AS annotator FROM ft), hb AS (SELECT *, {_bucket('human')} AS truth, {_bucket('own')} AS predicted FROM hu)"
_PLACE = "list_position([" + ", ".join(f"'{b}'" for b in _NAMES) + "], {}) - 1"
_CELLS = f"{_HUMAN}, g AS (SELECT {_PLACE.format('truth')} AS t, {_PLACE.format('predicted')} AS p FROM hb), cell AS (SELECT CAST(a AS INTEGER) AS t, CAST(b AS INTEGER) AS p, count(g.t) AS n FROM range(5) x(a) CROSS JOIN range(5) y(b) LEFT JOIN g ON g.t = a AND g.p = b GROUP BY ALL)"
_LABELS = (
    "lb AS (SELECT file_id, "
    + ", ".join(f"CASE WHEN num % 3 = 0 AND num % 8 = {i} THEN NULL ELSE string_split(scores, ',')[{i + 1}]::INT END AS {x}" for i, x in enumerate(ITEMS))
    + ", total + (num % 7 = 0)::INT AS total, (total0 >= 10)::INT AS \"binary\" FROM (SELECT *, total AS total0, regexp_replace(file_id, 'conv', '')::INT AS num FROM ft)), "
    + "lc2 AS (SELECT *, " + " + ".join(f"({x} IS NULL)::INT" for x in ITEMS) + " AS missing, total - (" + " + ".join(f"coalesce({x}, 0)" for x in ITEMS) + ") AS lack FROM lb), "
    + "lp AS (SELECT *, CASE WHEN missing > 1 THEN 'several items missing' WHEN missing = 1 AND lack NOT BETWEEN 0 AND 3 THEN 'missing item out of range' WHEN missing = 0 AND lack <> 0 THEN 'items do not sum to the total' WHEN \"binary\" <> (total >= 10)::INT THEN 'binary label does not match' END AS problem FROM lc2)"
)

# Each fourth dialogue again with other labels and blank lines, and one answer that each fifth id shares.
_REPEATED = """more AS (
  SELECT file_id, condition, dialogue FROM dialogues
  UNION ALL SELECT file_id || '-b', condition, replace(dialogue, 'Client: ', chr(10) || 'CLIENT :  ') FROM dialogues WHERE right(file_id, 6)::INT % 4 = 0
  UNION ALL SELECT file_id || '-h', condition, 'Client: yes' FROM dialogues WHERE right(file_id, 6)::INT % 5 = 0
), dialogues_split AS ("""
_REPEATED_VIEWS = VIEWS.replace("FROM dialogues)", "FROM more)").replace("dialogues_split AS (", _REPEATED, 1)


def _pages(key: str, page: int) -> str:
    """Members m(content_hash, key) as pages."""
    return f"""
r AS (SELECT *, count(*) OVER (PARTITION BY content_hash) AS members, (row_number() OVER (PARTITION BY content_hash ORDER BY {key}) - 1) // {page} AS page FROM m)
SELECT content_hash, members, page, string_agg({key}::VARCHAR, ',' ORDER BY {key}) AS ids FROM r WHERE members > 1 GROUP BY ALL"""


def _tree(source: str, leaf: int, levels: int = 6) -> str:
    """Nodes of the digest tree over lines (key, text); levels above the leaves, as many as any test table needs."""
    steps = [
        f"WITH l AS (SELECT sha256(coalesce(key, '') || ':' || sha256(coalesce(text, ''))) AS line, count(*) AS n FROM ({source}) GROUP BY 1)",
        f"d AS (SELECT CASE {' '.join(f'WHEN count(*) <= {leaf * 16**k} THEN {k}' for k in range(levels + 1))} END AS depth FROM l)",
        "t0 AS (SELECT left(line, depth) AS prefix, sum(n)::BIGINT AS n_rows, sha256(string_agg(line || ':' || n, chr(10) ORDER BY line)) AS digest FROM l, d GROUP BY 1)",
        *(f"t{k} AS (SELECT left(prefix, length(prefix) - 1) AS prefix, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM t{k - 1} WHERE prefix <> '' GROUP BY 1)" for k in range(1, levels + 1)),
    ]
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(levels + 1))


ORACLES: dict[str, str] = {
    "digest_tree": _tree("SELECT doc_id::VARCHAR AS key, text FROM documents", LEAF_LINES),
    "changed_ranges": f"""WITH a AS ({_tree("SELECT doc_id::VARCHAR AS key, text FROM documents", LEAF_LINES)}),
b AS ({_tree("SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 97 = 5 THEN coalesce(text, '') || '.' ELSE text END AS text FROM documents UNION ALL SELECT 'new' || doc_id, text FROM documents WHERE doc_id % 89 = 7", LEAF_LINES)}),
lv AS (SELECT least((SELECT max(length(prefix)) FROM a), (SELECT max(length(prefix)) FROM b)) AS depth)
SELECT prefix, coalesce(a.n_rows, 0) AS left_rows, coalesce(b.n_rows, 0) AS right_rows
FROM (SELECT a.* FROM a, lv WHERE length(prefix) = depth) a FULL JOIN (SELECT b.* FROM b, lv WHERE length(prefix) = depth) b USING (prefix) WHERE a.digest IS DISTINCT FROM b.digest""",
    "line_rejects": """SELECT outcome, count(*) AS n, sum(CASE WHEN outcome = 'read' THEN turn END)::BIGINT AS turns, sum(CASE WHEN outcome = 'read' THEN length(coalesce(text, '')) END)::BIGINT AS chars
FROM (SELECT *, CASE (coalesce(conv_id, 0) * 31 + coalesce(turn, 0)) % 11 WHEN 1 THEN 'not JSON' WHEN 3 THEN 'not an object: ARRAY' WHEN 5 THEN 'wrong type' WHEN 7 THEN 'not an object: BIGINT' ELSE 'read' END AS outcome FROM conversations) GROUP BY 1""",
    "content_pages": f"WITH m AS (SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash, doc_id FROM documents WHERE doc_id IS NOT NULL), {_pages('doc_id', 4)}",
    "dialogue_groups": f"WITH {_REPEATED_VIEWS.strip()}, m AS (SELECT DISTINCT sha256(dialogue_clean) AS content_hash, file_id FROM views), {_pages('file_id', 8)}",
    "corpus_integrity": _with(VIEWS, "SELECT count(*) AS total, count(DISTINCT file_id) AS distinct_ids, count(*) - count(DISTINCT file_id) AS repeated_ids, 0::BIGINT AS leaking_ids, count(*) FILTER (computed_split = 'train') AS n_train, count(*) FILTER (computed_split = 'dev') AS n_dev, count(*) FILTER (computed_split = 'test') AS n_test, count(*) FILTER (condition = 'control') AS n_control, count(*) FILTER (condition = 'mdd') AS n_mdd, count(*) FILTER (trim(dialogue) = '') AS empty_dialogues, (SELECT count(*) FROM views WHERE unknown_speaker_count + orphan_line_count > 0) AS unknown_speaker_dialogues FROM dialogues_split"),
    "split_counts": _with(DIALOGUES, "SELECT c AS condition, s AS computed_split, count(file_id) AS n FROM (SELECT unnest(['control', 'mdd']) AS c) CROSS JOIN (SELECT unnest(['train', 'dev', 'test']) AS s) LEFT JOIN dialogues_split d ON d.condition = c AND d.computed_split = s GROUP BY ALL"),
    "content_groups": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS least_id, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "document_splits": f"SELECT {_split('doc_id::VARCHAR')} AS computed_split, count(*) AS n FROM documents GROUP BY 1",
    "utterances": _with(UTTERANCES, "SELECT * FROM utt"),
    "dialogue_views": _with(VIEWS, "SELECT * EXCLUDE (condition, computed_split), client_only_text = '' AS has_empty_client_text, unknown_speaker_count + orphan_line_count > 0 AS has_unknown_speaker FROM views"),
    "keyword_coverage": _with(_covered(), "SELECT * FROM k"),
    "corpus_stats": _with(_covered("source,"), "SELECT source, count(*) AS corpus_size, " + ", ".join(f"round(avg(({i} > 0)::INT::DOUBLE), 6) AS {i}_rate" for i in ITEMS) + ", round(avg(coverage), 6) AS avg_coverage, min(word_count) AS words_min, max(word_count) AS words_max, round(avg(word_count), 6) AS words_mean, list_sort(list(word_count))[len(list(word_count)) // 2 + 1] AS words_median FROM k GROUP BY source"),
    "corpus_comparison": _with(_covered("lang,"), "SELECT item, round(l, 6) AS left_rate, round(r, 6) AS right_rate, round(l - r, 6) AS delta, abs(l - r) > 0.15 AS flagged, CASE WHEN abs(l - r) < 0.1 THEN 'close' WHEN abs(l - r) < 0.2 THEN 'moderate' ELSE 'far' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS item, avg(({i} > 0)::INT::DOUBLE) FILTER (lang = 'en') AS l, avg(({i} > 0)::INT::DOUBLE) FILTER (lang = 'de') AS r FROM k" for i in ITEMS) + ")"),
    "fake_votes": _with(VOTES, r"SELECT file_id, model_id, run_number, item, plain AS score, CASE WHEN plain = 0 THEN 'denied' ELSE 'present' END AS assertion, CASE WHEN text = '' THEN 'Client: (no snippet)' ELSE array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 20), ' ') END AS snippet FROM votes"),
    "vote_violations": _with(VOTES, f"SELECT item, count(*) AS n FROM na WHERE (item = 'sleep' AND (skipped OR plain <> 0)) OR (item = 'guilt' AND NOT skipped) GROUP BY item"),
    "item_posteriors_na": _with(_VA, "SELECT file_id, item, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, mode, round(expected, 6) AS expected, round(entropy, 6) AS entropy, round(clinical_prob, 6) AS clinical_prob, vote_range, CAST(na_count AS INTEGER) AS na_count, round(p_na, 6) AS p_not_mentioned, consensus AS consensus_score, said AS consensus_assertion, needs AS needs_arbitration FROM agg"),
    "trigger_reasons_na": _with(_VA, "SELECT reason, n FROM (SELECT 'high_na_count' AS reason, count(*) FILTER (r0) AS n FROM agg UNION ALL SELECT 'low_max_prob', count(*) FILTER (r1) FROM agg UNION ALL SELECT 'high_entropy', count(*) FILTER (r2) FROM agg UNION ALL SELECT 'clinical_ambiguity', count(*) FILTER (r3) FROM agg UNION ALL SELECT 'vote_range', count(*) FILTER (r4) FROM agg) WHERE n > 0"),
    "total_posterior_na": _with(_SC, "SELECT file_id, CAST(t AS INTEGER) AS total, round(p, 6) AS p FROM d7"),
    "scored_na": _with(_SC, f"SELECT file_id, condition, computed_split, round(m, 6) AS total_expected, round(sd, 6) AS total_std, lo AS ci_low, hi AS ci_high, total AS total_imputed, nd AS discussed_count, round(nd / 8.0::DOUBLE, 6) AS item_coverage, nd >= 7 AS proration_valid, pro AS total_prorated_rounded, {_bucket('pro')} AS phq_like_bucket, round(s, 6) AS juror_total_std, triggered AS triggered_arbitration, total AS final_total, {_bucket('total')} AS final_bucket FROM sc"),
    "severity": _with(_PLAIN, f"SELECT condition, {_bucket('total')} AS final_bucket, count(*) AS dialogues, round(avg(total), 6) AS mean_total FROM ft GROUP BY ALL"),
    "judged_totals_na": _with(_SC, f"SELECT file_id, total AS total_imputed, nd AS discussed_count, total AS final_total, {_bucket('total')} AS final_bucket, CASE WHEN judged THEN 'judge_override' ELSE 'jury_mode' END AS final_source, scores AS final_scores FROM ft"),
    "token_usage_na": _with(_SC, "SELECT file_id, CAST(600 + 50 * c AS BIGINT) AS input_tokens, CAST(300 + 25 * c AS BIGINT) AS output_tokens, CAST(60 + 5 * c AS BIGINT) AS reasoning_tokens, CAST(960 + 80 * c AS BIGINT) AS total_tokens FROM (SELECT file_id, count(*) FILTER (contested) AS c FROM co GROUP BY file_id)"),
    "krippendorff_na": _with(f"{_VA},{_alpha('item')},{_alpha('')}", "SELECT item, round(alpha, 6) AS alpha FROM aitemx UNION ALL SELECT 'all', round(alpha, 6) FROM ax"),
    "icc_sums_na": _with(_VA, ", x AS (SELECT file_id || item AS u, model_id || run_number AS j, coalesce(score, 0)::DOUBLE AS x FROM na), z AS (SELECT *, avg(x) OVER () AS g, avg(x) OVER (PARTITION BY u) AS r, avg(x) OVER (PARTITION BY j) AS c FROM x) SELECT count(DISTINCT u) AS n, CAST(count(DISTINCT j) AS INTEGER) AS k, round(sum((r - g) * (r - g)), 6) AS ss_rows, round(sum((c - g) * (c - g)), 6) AS ss_cols, round(sum((x - g) * (x - g)), 6) AS ss_total FROM z"),
    "cronbach_na": _with(_SC, ", iv AS (SELECT item, var_samp(coalesce(consensus, 0)) AS v FROM agg GROUP BY item) SELECT round(8.0 / 7 * (1 - (SELECT sum(v) FROM iv) / (SELECT var_samp(total) FROM sc)), 6) AS alpha"),
    "item_total_na": _with(_SC, "SELECT item, round(corr(coalesce(consensus, 0), sc.total), 6) AS r FROM agg JOIN sc USING (file_id) GROUP BY item"),
    "coverage_na": _with(_SC, "SELECT n_dialogues, CAST(n_dialogues * 8 AS BIGINT) AS total_cells, CAST(na_cells AS BIGINT) AS na_cells, round(na_cells / (n_dialogues * 8), 6) AS corpus_na_rate, round(lo, 6) AS min_item_coverage, round(hi, 6) AS max_item_coverage, dialogues_with_min_coverage, dialogues_with_proration_valid, round(dm, 6) AS dialogue_coverage_mean, round(ds, 6) AS dialogue_coverage_std FROM (SELECT count(*) AS n_dialogues, count(*) FILTER (nd >= 4) AS dialogues_with_min_coverage, count(*) FILTER (nd >= 7) AS dialogues_with_proration_valid, avg(nd / 8.0::DOUBLE) AS dm, stddev_pop(nd / 8.0::DOUBLE) AS ds FROM sc), (SELECT sum(z) AS na_cells, min(1 - z / t) AS lo, max(1 - z / t) AS hi FROM (SELECT item, count(*) FILTER (consensus IS NULL) AS z, count(*) AS t FROM agg GROUP BY item))"),
    "coverage_histogram_na": _with(_SC, "SELECT CAST(a AS INTEGER) AS discussed_count, count(sc.file_id) AS dialogues FROM range(9) r(a) LEFT JOIN sc ON sc.nd = a GROUP BY a"),
    "assertion_distribution_na": _with(VOTES, ", va AS (SELECT item, CASE WHEN score IS NULL THEN 'not_mentioned' WHEN score = 0 THEN 'denied' ELSE 'present' END AS assertion FROM na), f AS (SELECT i.item, k.assertion, count(va.item) AS votes FROM items i CROSS JOIN (SELECT unnest(['present', 'denied', 'possible', 'not_mentioned']) AS assertion) k LEFT JOIN va ON va.item = i.item AND va.assertion = k.assertion GROUP BY ALL) SELECT * FROM f UNION ALL SELECT 'all', assertion, CAST(sum(votes) AS BIGINT) FROM f GROUP BY assertion"),
    "separation_na": _with(_SC, "SELECT basis, condition, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT 'imputed' AS basis, condition, total::DOUBLE AS x FROM sc UNION ALL SELECT 'prorated', condition, total / nd * 8 FROM sc WHERE nd >= 7) GROUP BY ALL"),
    "arbitration_rates_na": _with(_SC, "SELECT item, count(*) FILTER (contested) AS contested, round(count(*) FILTER (contested) / count(*), 6) AS rate FROM co GROUP BY item UNION ALL SELECT 'overall', count(*) FILTER (triggered), round(count(*) FILTER (triggered) / count(*), 6) FROM sc"),
    "judge_agreement_na": _with(_SC, "SELECT count(*) AS comparable, count(*) FILTER (mode = verdict) AS agreeing, round(count(*) FILTER (mode = verdict) / count(*), 6) AS agreement FROM co WHERE contested AND mode IS NOT NULL"),
    "confusion_na": _with(f"{_SC}, {_CELLS}", "SELECT * FROM cell"),
    "agreement_na": _with(f"{_SC}, {_CELLS}", ", m AS (SELECT *, sum(n) OVER (PARTITION BY t) AS rt, sum(n) OVER (PARTITION BY p) AS cp, sum(n) OVER () AS tot FROM cell), s AS (SELECT max(tot) AS tot, sum(n) FILTER (t = p) / max(tot) AS po, sum(rt * cp / tot) FILTER (t = p) / max(tot) AS pe, sum(((t - p) / 4) ** 2 * n) AS seen, sum(((t - p) / 4) ** 2 * rt * cp / tot) AS chance FROM m) SELECT CAST(tot AS BIGINT) AS n, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa, round(1 - seen / chance, 6) AS weighted_kappa FROM s"),
    "class_metrics_na": _with(f"{_SC}, {_CELLS}", ", r AS (SELECT t AS k, CAST(sum(n) AS BIGINT) AS support, sum(n) FILTER (t = p) AS hit FROM cell GROUP BY t), c2 AS (SELECT p AS k, sum(n) AS called FROM cell GROUP BY p), pr AS (SELECT k, support, CASE WHEN called > 0 THEN hit / called ELSE 0.0::DOUBLE END AS pre, CASE WHEN support > 0 THEN hit / support ELSE 0.0::DOUBLE END AS rec FROM r JOIN c2 USING (k)) SELECT [" + ", ".join(f"'{b}'" for b in _NAMES) + "][k + 1] AS bucket, round(pre, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END, 6) AS f1, support FROM pr"),
    "bias_na": _with(f"{_SC}, {_HUMAN}", "SELECT round(avg(own - human), 6) AS bias, string_agg(DISTINCT annotator, ',' ORDER BY annotator) AS annotators FROM hu"),
    "annotation_sample_na": _with(
        _SC,
        """, f10 AS (SELECT file_id FROM sc WHERE triggered OR mean_entropy > 1 OR max_range >= 2 ORDER BY triggered DESC, coalesce(mean_entropy, 0) DESC, max_range DESC, file_id DESC LIMIT 10),
rest AS (SELECT file_id FROM sc WHERE file_id NOT IN (SELECT file_id FROM f10) ORDER BY sha256('42:' || file_id), file_id LIMIT 20 - (SELECT count(*) FROM f10))
SELECT file_id FROM f10 UNION ALL SELECT file_id FROM rest""",
    ),
    "uncertain_na": _with(_SC, "SELECT file_id, triggered AS triggered_arbitration, round(coalesce(mean_entropy, 0), 6) AS mean_entropy, CAST(coalesce(max_range, 0) AS INTEGER) AS max_range FROM sc WHERE triggered OR mean_entropy > 1 OR max_range >= 2 ORDER BY triggered DESC, mean_entropy DESC, max_range DESC, file_id DESC LIMIT 10"),
    "best_jurors_na": _with(_VA, "SELECT file_id, item, b.model_id, b.run_number, 0.7::DOUBLE AS confidence, consensus AS consensus_score FROM (SELECT agg.file_id, agg.item, agg.consensus, min(struct_pack(model_id := na.model_id, run_number := na.run_number)) AS b FROM agg JOIN na ON na.file_id = agg.file_id AND na.item = agg.item AND na.score = agg.consensus GROUP BY ALL)"),
    "flat_export_na": _with(_SC, "SELECT ft.file_id AS dialogue_id, ft.condition, " + ", ".join(f"string_split(scores, ',')[{i}]::INT AS phq8_item_{i}" for i in range(1, 9)) + f", total AS phq8_total, {_bucket('total')} AS severity_bucket, client_qa_text, 'run' AS run_id, '{_C.prompt_version}' AS prompt_version FROM ft JOIN views USING (file_id) WHERE client_qa_text <> ''"),
    "nested_export_na": _with(_SC, "SELECT file_id AS dialogue_id, condition, computed_split AS split, " + ", ".join(f"max(final) FILTER (item = '{i}') AS {i}" for i in ITEMS) + ", CAST(sum(coalesce(final, 0)) AS INTEGER) AS total_imputed, 2 AS runs_per_model, CASE WHEN bool_or(contested) THEN 'judge' END AS judge_model FROM fi GROUP BY ALL"),
    "label_repair_na": _with(f"{_SC}, {_LABELS}", "SELECT file_id, " + ", ".join(f"coalesce({x}, lack)::INT AS {x}" for x in ITEMS) + ", total, \"binary\" FROM lp WHERE problem IS NULL"),
    "label_problems_na": _with(f"{_SC}, {_LABELS}", "SELECT file_id, problem FROM lp WHERE problem IS NOT NULL"),
    "judge_violations_na": _with(_SC, "SELECT item, count(*) AS n FROM co WHERE contested AND (item = 'sleep' OR nn = 0) GROUP BY item"),
    "judge_inputs_na": _with(
        _SC,
        "SELECT file_id, item, string_agg(coalesce(na.score::VARCHAR, 'not_mentioned'), ',' ORDER BY model_id, run_number) AS juror_votes, "
        "string_agg(CASE WHEN na.score IS NULL THEN 'not_mentioned' WHEN na.score = 0 THEN 'denied' ELSE 'present' END, ',' ORDER BY model_id, run_number) AS juror_assertions, "
        "CAST(count(*) - count(na.score) AS INTEGER) AS na_count, CAST(round_even(100.0 * (count(*) - count(na.score)) / count(*), 0) AS INTEGER) AS na_percent, "
        "CAST(least(5, count(na.score)) AS INTEGER) AS snippets FROM na JOIN co USING (file_id, item) WHERE contested GROUP BY file_id, item",
    ),
    "self_harm": _with(
        VOTES,
        "SELECT file_id, bool_or(plain = 3) AS mentions_self_harm, "
        "coalesce(string_agg(CASE WHEN plain = 3 THEN model_id || '/' || run_number END, ',' ORDER BY model_id, run_number), '') AS self_harm_evidence "
        "FROM votes WHERE item = 'guilt' GROUP BY file_id",
    ),
    "view_violations": _with(DIALOGUES, "SELECT file_id, 'short_answer_count' AS problem FROM dialogues WHERE regexp_replace(file_id, 'conv', '')::INT % 4 = 0"),
    "aggregate_violations_na": _with(
        _SC,
        "SELECT file_id, 'final total is not the sum; final total is not the imputed one' || CASE WHEN total = 24 THEN '; bucket does not match' ELSE '' END AS problem "
        "FROM ft WHERE regexp_replace(file_id, 'conv', '')::INT % 5 = 0",
    ),
    "report_na": _with(
        f"{_SC},{_alpha('')}",
        ", xs AS (SELECT file_id || item AS u, model_id || run_number AS j, coalesce(score, 0)::DOUBLE AS x FROM na), zs AS (SELECT *, avg(x) OVER () AS g, avg(x) OVER (PARTITION BY u) AS r, avg(x) OVER (PARTITION BY j) AS c FROM xs), "
        "ms AS (SELECT count(DISTINCT u) AS n, count(DISTINCT j) AS k, sum((r - g) * (r - g)) / (count(DISTINCT u) - 1) AS msr, sum((c - g) * (c - g)) / (count(DISTINCT j) - 1) AS msc, "
        "sum((x - r - c + g) * (x - r - c + g)) / ((count(DISTINCT u) - 1) * (count(DISTINCT j) - 1)) AS mse FROM zs), "
        "cb AS (SELECT 8.0 / 7 * (1 - (SELECT sum(v) FROM (SELECT var_samp(coalesce(final, 0)) AS v FROM fi GROUP BY item)) / (SELECT var_samp(total) FROM ft)) AS cronbach), "
        "cv AS (SELECT avg(z) AS na_rate, min(1 - z) AS least FROM (SELECT item, avg((consensus IS NULL)::INT) AS z FROM agg GROUP BY item)), "
        "sp AS (SELECT condition, count(*) AS n, avg(total) AS m, var_samp(total) AS v FROM ft GROUP BY condition), "
        "ss AS (SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t FROM sp a, sp b WHERE a.condition = 'mdd' AND b.condition = 'control'), "
        "ja AS (SELECT count(*) FILTER (mode = verdict) / count(*) AS agreed FROM co WHERE contested AND mode IS NOT NULL), ar AS (SELECT avg(triggered::INT) AS rate, (SELECT avg((nd >= 4)::INT) FROM ft) AS enough FROM sc), "
        "it AS (SELECT string_agg(printf('%.4f', r), ',' ORDER BY item_idx) AS item_total FROM (SELECT item_idx, corr(coalesce(final, 0), ft.total) AS r FROM fi JOIN ft USING (file_id) GROUP BY item_idx)) "
        "SELECT (SELECT count(*) FROM ft) AS n_dialogues, round(alpha, 6) AS alpha, round((msr - mse) / (msr + (k - 1) * mse), 6) AS icc3, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc2, round(cronbach, 6) AS cronbach, "
        "round(na_rate, 6) AS corpus_na_rate, round(least, 6) AS min_item_coverage, round(agreed, 6) AS judge_agreement, round(rate, 6) AS arbitration_rate, round(d, 6) AS cohens_d, round(t, 6) AS t_statistic, item_total, "
        "alpha >= 0.67 AS gate_alpha, cronbach >= 0.7 AS gate_cronbach, least >= 0.5 AND na_rate <= 0.25 AND enough >= 0.9 AS gate_coverage, rate < 0.3 AS gate_arbitration FROM ax, ms, cb, cv, ss, ja, ar, it",
    ),
    "line_types_na": _with(
        DIALOGUES,
        "SELECT file_id AS dialogue_id, CASE regexp_replace(file_id, 'conv', '')::INT % 4 WHEN 1 THEN '$.scoring_metadata.runs_per_model is BOOLEAN, not int' WHEN 2 THEN '$.condition is BIGINT, not string; unknown keys at $: extra' "
        "ELSE '$.totals.discussed_count is STRING, not int' END AS problem FROM dialogues WHERE regexp_replace(file_id, 'conv', '')::INT % 4 <> 0",
    ),
    "csv_corpus": _with(DIALOGUES, "SELECT file_id, condition, 'test' AS client_model, 'test' AS therapist_model, dialogue FROM dialogues"),
    "numbered_turns": "SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS line_no, conv_id, turn, role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations",
    "last_lines": "SELECT conv_id || '/' || coalesce(role, 'none') AS key, turn, CAST(length(coalesce(text, '')) AS INTEGER) AS size FROM conversations WHERE conv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1",
    "reported_na": _with(
        _SC,
        ", rp AS (SELECT file_id, sum(length(client_qa_text) * run_number) AS i, sum(CASE WHEN model_id <> 'model-b' THEN 7 END) AS o, sum(length(client_qa_text) + run_number) AS t, "
        "string_agg(CASE WHEN model_id = 'model-a' AND length(client_qa_text) % 2 = 0 THEN model_id || '/' || run_number END, ',' ORDER BY model_id, run_number) AS e FROM views, jurors GROUP BY file_id), "
        "jc AS (SELECT file_id, count(*) FILTER (contested) AS c FROM co GROUP BY file_id) "
        "SELECT file_id, e IS NOT NULL AS mentions_self_harm, coalesce(e, '') AS self_harm_evidence, CAST(i + 50 * c AS BIGINT) AS input_tokens, CAST(o + 25 * c AS BIGINT) AS output_tokens, "
        "CAST(5 * c AS BIGINT) AS reasoning_tokens, CAST(t + 80 * c AS BIGINT) AS total_tokens FROM rp JOIN jc USING (file_id)",
    ),
    "bad_dialogues_na": _with(
        VOTES,
        "SELECT file_id, 'contract' AS error_code, CASE regexp_replace(file_id, 'conv', '')::INT % 5 WHEN 0 THEN 'model-a/1/mood: unknown item' WHEN 1 THEN 'model-b/2: 7 of 8 items answered, 7 votes' "
        "WHEN 2 THEN 'model-c/1: 8 of 8 items answered, 9 votes' ELSE 'model-a/2/guilt: unknown assertion' || CASE WHEN skipped THEN '; mentioned but not discussed; confidence missing or out of range; evidence missing' ELSE '' END END AS error_message "
        "FROM na WHERE item = 'guilt' AND model_id = 'model-a' AND run_number = 2 AND regexp_replace(file_id, 'conv', '')::INT % 5 <> 4",
    ),
    "pending_jobs": _with(DIALOGUES, "SELECT file_id FROM dialogues WHERE regexp_replace(file_id, 'conv', '')::INT % 3 <> 0"),
}
ORACLES = {k: v.replace(")\n, ", "), ").replace("\n, ", ", ") for k, v in ORACLES.items()}
