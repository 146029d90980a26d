"""DuckDB SQL that gives the same rows as the queries of the same name. Written from the rules, not from the plans."""

from __future__ import annotations

_NL = "chr(10)"
_NORM = "lower(regexp_replace(translate({0}, '，。！？；：（）“”‘’【】《》—％', ',.!?;:()\"\"''''[]<>-%'), '\\s+', '', 'g'))"
_HEAD = "regexp_matches(line, '^(#{1,3}\\s|第[一二三四五六七八九十百]+[章节部分]|[(（]?([一二三四五六七八九十]|[0-9]{1,2})[)）]、?\\s*\\S)')"


def _norm(x: str) -> str:
    return _NORM.format(x)


def _sentences(name: str, source: str) -> str:
    """CTEs that end in ``name``: doc_id, idx, norm, start_at, end_at, display. source: rows of doc_id, text."""
    return f"""
{name}_l AS (SELECT doc_id, line_no, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line,
  coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS raw, generate_subscripts(string_split(text, {_NL}), 1) AS line_no FROM ({source}))),
{name}_c AS (SELECT doc_id, line_no, line, pos, {_HEAD} AS head,
  CASE WHEN {_HEAD} THEN [line] ELSE string_split(regexp_replace(line, '([。！？!?；;])', '\\1' || {_NL}, 'g'), {_NL}) END AS parts
  FROM {name}_l WHERE line <> ''),
{name}_p AS (SELECT doc_id, line_no, head, pos, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_no FROM {name}_c),
{name}_o AS (SELECT *, pos + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, line_no ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at,
  {_norm('part')} AS norm FROM {name}_p),
{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part_no) - 1 AS idx, norm, start_at, start_at + length(part) AS end_at,
  regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS display FROM {name}_o WHERE (head AND part <> '') OR length(norm) >= 6)"""


_DOCS = "SELECT doc_id, text FROM documents"
_ITEMS = "SELECT item_id AS doc_id, text FROM benchmark"
_LIB = _sentences("lib", _DOCS)
_ASK = _sentences("ask", _ITEMS)

_GRAMS = "CASE WHEN length(norm) >= 2 THEN list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2)) WHEN length(norm) = 1 THEN [norm] ELSE [] END"
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(hex(encode(g))) // 2), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::INT::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""


def _fingerprints(norms: str) -> str:
    """CTEs that end in fps: norm, u (unsigned), fp (signed). norms: rows of norm."""
    return f"""
norms AS (SELECT DISTINCT norm FROM ({norms})),
grams AS (SELECT norm, unnest({_GRAMS}) AS g FROM norms),
dict AS (SELECT g, {_FNV} AS h FROM (SELECT DISTINCT g FROM grams)),
bits AS (SELECT g, b, CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END AS v FROM dict, range(0, 64) AS r(b)),
counted AS (SELECT norm, g, count(*) AS n FROM grams GROUP BY ALL),
votes AS (SELECT norm, b, sum(n * v) AS s FROM counted JOIN bits USING (g) GROUP BY ALL),
fps AS (SELECT norm, sum(CASE WHEN s > 0 THEN 1::HUGEINT << b ELSE 0 END)::HUGEINT AS u FROM votes GROUP BY norm)"""


_SIGNED = "CASE WHEN u >= 9223372036854775808::HUGEINT THEN (u - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END"
_BOTH = _LIB + "," + _ASK + "," + _fingerprints("SELECT norm FROM lib UNION SELECT norm FROM ask")
_BLOCKS = "SELECT norm, u, b AS block, ((u >> (16 * b)) & 65535)::INT AS v FROM fps, range(0, 4) AS r(b) WHERE u <> 0"
_PAIRS = f"""
blk AS ({_BLOCKS}),
qb AS (SELECT * FROM blk WHERE norm IN (SELECT norm FROM ask)),
lb AS (SELECT * FROM blk WHERE norm IN (SELECT norm FROM lib)),
cand AS (SELECT q.norm AS q_norm, l.norm AS norm, bit_count(xor(q.u, l.u))::INT AS distance, min(q.block)::INT AS min_block
  FROM qb q JOIN lb l USING (block, v) WHERE bit_count(xor(q.u, l.u)) <= 4 GROUP BY ALL)"""
# edit distance counts bytes: letters beyond ASCII become single ones that normal forms lack
_ONE = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_DIST = f"levenshtein({_ONE.format('q_norm')}, {_ONE.format('norm')})"
_MATCH = f"""
dist AS (SELECT *, greatest(length(q_norm), length(norm)) AS m FROM cand WHERE 20 * abs(length(q_norm) - length(norm)) < 9 * greatest(length(q_norm), length(norm))),
edit AS (SELECT q_norm, norm, min_block, m, {_DIST} AS d FROM dist),
tiers AS (SELECT *, CASE WHEN 5 * d <= m THEN 'copy' WHEN 20 * d <= 7 * m THEN 'near' WHEN 20 * d <= 9 * m THEN 'suspect' END AS tier, round_even(1 - d / m, 3) AS sim FROM edit),
lit AS (SELECT a.doc_id AS q_doc, a.idx AS q_idx, l.doc_id AS doc_id, l.idx AS s_idx, t.d, t.m, t.sim, t.tier, 0.0 AS cos, t.min_block
  FROM tiers t JOIN lib l USING (norm) JOIN ask a ON a.norm = t.q_norm WHERE t.tier IS NOT NULL),
pend AS (SELECT * FROM ask WHERE length(norm) >= 10 AND (doc_id, idx) NOT IN (SELECT (q_doc, q_idx) FROM lit)),
qg AS (SELECT DISTINCT q_norm, g FROM (SELECT norm AS q_norm, unnest({_GRAMS}) AS g FROM (SELECT DISTINCT norm FROM pend))),
lg AS (SELECT DISTINCT norm, g FROM (SELECT norm, unnest({_GRAMS}) AS g FROM (SELECT DISTINCT norm FROM lib))),
qn AS (SELECT q_norm, count(*) AS n FROM qg GROUP BY 1), ln AS (SELECT norm, count(*) AS n FROM lg GROUP BY 1),
share AS (SELECT q_norm, norm, count(*) / least(any_value(qn.n), any_value(ln.n)) AS score FROM qg JOIN lg USING (g) JOIN qn USING (q_norm) JOIN ln USING (norm) GROUP BY 1, 2),
con AS (SELECT p.doc_id AS q_doc, p.idx AS q_idx, p.norm AS q_norm, l.doc_id AS doc_id, l.idx AS s_idx, l.norm AS norm, s.score,
  row_number() OVER (PARTITION BY p.doc_id, p.idx ORDER BY s.score DESC, l.doc_id, l.idx) AS rank
  FROM pend p JOIN share s ON s.q_norm = p.norm JOIN lib l ON l.norm = s.norm WHERE s.score >= 0.35),
top AS (SELECT *, greatest(length(q_norm), length(norm)) AS m, {_DIST} AS d FROM con WHERE rank <= 3),
fall AS (SELECT q_doc, q_idx, doc_id, s_idx, d, m, CASE WHEN 20 * d > 9 * m THEN 0.0 ELSE round_even(1 - d / m, 3) END AS sim,
  CASE WHEN 5 * d <= m THEN 'copy' WHEN 20 * d <= 7 * m THEN 'near' WHEN 20 * d <= 9 * m THEN 'suspect' WHEN score >= 0.75 THEN 'semantic' END AS tier, round_even(score, 3) AS cos, NULL::INT AS min_block FROM top),
found AS (SELECT * FROM lit UNION ALL SELECT * FROM fall WHERE tier IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_doc, q_idx ORDER BY sim DESC, cos DESC, min_block NULLS LAST, doc_id, s_idx) AS rn FROM found),
best AS (SELECT * FROM ranked WHERE rn = 1)"""
_ALL = f"WITH {_BOTH},{_PAIRS},{_MATCH}"
_BODY = "body AS (SELECT doc_id AS q_doc, sum(length(norm)) AS body_chars FROM ask GROUP BY 1)"
_CHARS = "hit AS (SELECT b.*, length(a.norm) AS chars FROM best b JOIN ask a ON a.doc_id = b.q_doc AND a.idx = b.q_idx)"

# ---- grading ----

_PAPERS = "papers AS (SELECT 'doc-' || doc_id || '.txt' AS path, text FROM documents)"
_DIMS = "dims AS (SELECT * FROM (VALUES (0, 'topic', 20), (1, 'content', 25), (2, 'argument', 25), (3, 'structure', 15), (4, 'writing', 15)) AS t(dim_no, name, weight))"
_HEADS = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(#{1,3}\\s|第[一二三四五六七八九十]+[章节部分]|[(（]?([一二三四五六七八九十]|[0-9]{1,2})[)）]、?\\s*\\S)') AND length(regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^#+', ''), '^\\s+|\\s+$', '', 'g')) BETWEEN 3 AND 40))"
_SCORES = f"""WITH {_PAPERS}, {_DIMS},
base AS (SELECT path, text, dim_no, name, weight, (md5_number_text(path || ':' || name)) AS h FROM papers, dims),
quoted AS (SELECT path, text, list_filter(list_transform(string_split(regexp_replace(text, '[。！？]', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) BETWEEN 31 AND 89) AS s,
  (CASE WHEN regexp_matches(text, '摘\\s*要') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)参考\\s*文献|References') THEN 2 ELSE 0 END)
  + least(3, least(30, {_HEADS}) // 4) + (CASE WHEN length(text) > 12000 THEN 2 WHEN length(text) < 3000 THEN -8 ELSE 0 END)
  - (CASE WHEN regexp_matches(text, '\\[[0-9]+\\]|\\([\\pL\\pN_]+ et al\\.?,? [0-9]{{4}}\\)') THEN 0 ELSE 3 END) AS bonus FROM papers),
scores AS (SELECT b.path, b.dim_no, b.name, b.weight, greatest(35, least(96, 62 + (h % 30)::INT + q.bonus))::DOUBLE AS score,
  round_even(0.6 + (h % 30)::INT / 100, 2) AS confidence, q.s, h,
  CASE WHEN regexp_matches(b.text, '参考\\s*文献') THEN '' ELSE '未识别到参考文献列表' END AS suspicions,
  '【mock 试运行，非真实评分】' || b.name || '维度：' || CASE WHEN q.bonus >= 0 THEN '结构要素基本齐全，' ELSE '结构要素有明显缺失，' END || '按启发式规则给出参考分 ' || greatest(35, least(96, 62 + (h % 30)::INT + q.bonus))::INT || '。配置 API Key 后将调用大模型给出真实批改。' AS comment FROM base b JOIN quoted q USING (path))""".replace("md5_number_text(path || ':' || name)", "('0x' || md5(path || ':' || name))::UHUGEINT")
_TOTALS = f"{_SCORES}, totals AS (SELECT path, round_even(sum(score * weight) / 100, 1) AS total, round_even(least(1.0, avg(confidence)), 2) AS confidence FROM scores GROUP BY path)"
_BAND = "CASE WHEN total >= 90 THEN '优秀' WHEN total >= 80 THEN '良好' WHEN total >= 70 THEN '中等' WHEN total >= 60 THEN '及格' ELSE '不及格' END"
_MAIL = "regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[已脱敏]', 'g')"


def _digits(x: str, core: str) -> str:
    """Replace ``core`` where no digit stands beside it; run twice, as one digit may part two matches."""
    once = f"regexp_replace({x}, '(^|[^0-9])({core})($|[^0-9])', '\\1[已脱敏]\\3', 'g')"
    return f"regexp_replace({once}, '(^|[^0-9])({core})($|[^0-9])', '\\1[已脱敏]\\3', 'g')"


_REDACT = _digits(_digits(_digits(_MAIL, "[0-9]{17}[0-9Xx]"), "(?:\\+?86[-\\s]?)?1[3-9][0-9]{9}"), "[0-9]{3}-[0-9]{4}-[0-9]{4}")
_REDACT = f"regexp_replace({_REDACT}, '(?:学号|工号|学籍号)[:：\\s]*[A-Za-z0-9]{{6,20}}', '[已脱敏]', 'g')"

_ABSTRACT = "'本文第 ' || doc_id || ' 号材料研究河流沉积物的来源与搬运过程，比较三种取样方法，讨论潮汐对河口盐度分布的影响及其多年变化，并给出误差的估计。'"
_PARTS = f"SELECT item_id AS doc_id, '## part one' || {_NL} || text || {_NL} || '## part two' || {_NL} || 'This closing line of number ' || item_id || ' has no source anywhere.' AS text FROM benchmark"

ORACLE_SQL: dict[str, str] = {
    "doc_sentences": f"WITH {_LIB} SELECT doc_id, idx::INT AS idx, norm, start_at::INT AS start_at, end_at::INT AS end_at FROM lib",
    "normalize_text": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5, length({_norm('text')})::INT AS norm_chars FROM documents",
    "body_chars": f"WITH {_LIB} SELECT doc_id, sum(length(norm))::BIGINT AS body_chars, count(*) AS n_sentences FROM lib GROUP BY 1",
    "ref_cut": "SELECT doc_id, length('  References ' || chr(10) || '[1] ' || source || chr(10))::INT AS excluded_ref_chars FROM documents",
    "char_bigrams": f"WITH {_LIB} SELECT g AS bigram, count(*) AS n FROM (SELECT unnest({_GRAMS}) AS g FROM lib) GROUP BY 1",
    "fnv1a64_bigrams": f"WITH {_LIB}, gg AS (SELECT DISTINCT g FROM (SELECT unnest({_GRAMS}) AS g FROM lib)) SELECT g AS bigram, lpad(lower(to_hex(({_FNV})::UBIGINT)), 16, '0') AS fnv FROM gg",
    "sentence_simhash": f"WITH {_LIB},{_fingerprints('SELECT norm FROM lib')} SELECT norm, {_SIGNED} AS fp FROM fps",
    "lsh_blocks": f"WITH {_LIB},{_fingerprints('SELECT norm FROM lib')} SELECT norm, block::INT AS block_idx, v AS block_key FROM ({_BLOCKS})",
    "bucket_histogram": f"WITH {_LIB},{_fingerprints('SELECT norm FROM lib')} SELECT block::INT AS block_idx, v AS block_key, count(*) AS n FROM ({_BLOCKS}) GROUP BY 1, 2",
    "lsh_candidates": f"WITH {_BOTH},{_PAIRS} SELECT q_norm, norm, distance, min_block FROM cand",
    "edit_matches": f"{_ALL} SELECT q_norm, norm, d::INT AS d, m::INT AS m, sim, tier FROM tiers WHERE tier IS NOT NULL",
    "tier_histogram": f"{_ALL} SELECT tier, count(*) AS n, count(DISTINCT (q_doc, q_idx)) AS sentences FROM lit GROUP BY 1",
    "containment_top3": f"{_ALL} SELECT q_doc, q_idx::INT AS q_idx, doc_id, s_idx::INT AS s_idx, round_even(score, 6) AS score, rank::INT AS rank FROM con WHERE rank <= 3",
    "fallback_matches": f"{_ALL} SELECT q_doc, q_idx::INT AS q_idx, doc_id, s_idx::INT AS s_idx, tier, cos AS contain FROM fall WHERE tier IS NOT NULL",
    "best_match": f"{_ALL} SELECT q_doc, q_idx::INT AS q_idx, doc_id, s_idx::INT AS s_idx, sim, tier FROM best",
    "check_summary": f"""{_ALL}, {_BODY}, {_CHARS},
src AS (SELECT q_doc, doc_id, sum(chars) AS c FROM hit GROUP BY 1, 2),
tot AS (SELECT q_doc, sum(c) AS matched, max(c) AS most FROM src GROUP BY 1)
SELECT q_doc AS doc_id, body_chars::BIGINT AS body_chars, coalesce(matched, 0)::BIGINT AS matched_chars, round_even(coalesce(matched, 0) / body_chars, 4) AS total_ratio,
  round_even(coalesce(most, 0) / body_chars, 4) AS single_max_ratio,
  CASE WHEN round_even(coalesce(matched, 0) / body_chars, 4) * 100 >= 30 THEN '高' WHEN round_even(coalesce(matched, 0) / body_chars, 4) * 100 >= 15 THEN '中' ELSE '低' END AS level
FROM body LEFT JOIN tot USING (q_doc)""",
    "source_stats": f"""{_ALL}, {_BODY}, {_CHARS},
src AS (SELECT q_doc, doc_id, sum(chars) AS c, count(*) AS n, min(q_idx) AS f FROM hit GROUP BY 1, 2)
SELECT q_doc, doc_id, doc_id::VARCHAR AS name, c::BIGINT AS matched_chars, n AS n_matches, round_even(c / body_chars, 4) AS ratio, row_number() OVER (PARTITION BY q_doc ORDER BY c DESC, f)::INT AS rank FROM src JOIN body USING (q_doc)""",
    "match_spans": f"""{_ALL}, u AS (SELECT DISTINCT q_doc, q_idx FROM found),
s AS (SELECT q_doc, q_idx, sum(nw) OVER (PARTITION BY q_doc ORDER BY q_idx) AS span FROM (SELECT *, CASE WHEN q_idx - lag(q_idx) OVER (PARTITION BY q_doc ORDER BY q_idx) > 2 THEN 1 ELSE 0 END AS nw FROM u))
SELECT q_doc, span::BIGINT AS span, min(q_idx)::INT AS q_start, max(q_idx)::INT AS q_end, count(*) AS n_matches FROM found JOIN s USING (q_doc, q_idx) GROUP BY 1, 2""",
    "evidence_top3": f"{_ALL} SELECT q_doc, q_idx::INT AS q_idx, string_agg(doc_id || ':' || s_idx || ':' || tier, ',' ORDER BY rn) AS evidence FROM ranked WHERE rn <= 3 GROUP BY 1, 2",
    "cosine_top3": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS q_id, l.vec_id AS id, list_cosine_similarity(q.e, l.e) AS score FROM v q, v l WHERE q.vec_id % 100 = 0)
SELECT q_id, id, round_even(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""",
    "library_dedup": "SELECT doc_id, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)",
    "known_doc_skip": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')",
    "library_stats": f"WITH {_LIB} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(n_chars)::BIGINT FROM documents) AS n_chars, (SELECT count(*) FROM lib) AS sentences",
    "library_text": f"WITH {_LIB} SELECT doc_id, md5(string_agg(display, '' ORDER BY idx)) AS text_md5 FROM lib GROUP BY 1",
    "params_key": f"WITH {_LIB} SELECT substr(sha256('true|' || (SELECT count(*) FROM documents) || '|' || (SELECT sum(n_chars)::BIGINT FROM documents) || '|' || (SELECT count(*) FROM lib)), 1, 16) AS params_key",
    "report_cache_latest": "SELECT sha256(user_id::VARCHAR) AS query_sha256, event_type AS params_key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "report_latest_wins": "SELECT 'R' || (event_id % 500) AS report_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "task_retention": "SELECT event_id, ts FROM events WHERE date_diff('second', date_trunc('second', ts), (SELECT date_trunc('second', max(ts)) FROM events)) <= 7200 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "stored_matches": f"""{_ALL},
own AS (SELECT l.*, sha256(d.text) AS sha FROM lit l JOIN documents d USING (doc_id))
SELECT q_doc, q_idx::INT AS q_idx, max(sim) AS sim, count(DISTINCT (sha, s_idx)) AS n_matches, count(DISTINCT sha) AS n_sources FROM own GROUP BY 1, 2""",
    "report_upserts": """SELECT 'R' || (event_id % 500) AS report_no, sha256(user_id::VARCHAR) AS query_sha256, event_id, value
FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id % 3 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "task_states": """
WITH e AS (SELECT event_type AS desk, user_id::VARCHAR AS task_id, event_id % 4 AS k, ts, event_id FROM events),
c AS (SELECT desk, task_id, max((ts, event_id)) AS born FROM e WHERE k = 0 GROUP BY ALL),
d AS (SELECT desk, max(ts) AS now FROM e GROUP BY desk),
h AS (SELECT c.*, row_number() OVER (PARTITION BY desk ORDER BY born DESC) AS n FROM c JOIN d USING (desk) WHERE epoch_us(born[1]) >= epoch_us(now) - 86400000000),
u AS (SELECT h.desk, h.task_id, max((e.ts, e.event_id, e.k)) AS x FROM h JOIN e ON e.desk = h.desk AND e.task_id = h.task_id AND (e.ts, e.event_id) >= h.born WHERE n <= 20 GROUP BY ALL)
SELECT u.desk, u.task_id, ['queued', 'running', 'done', 'error'][x[3] + 1] AS status, ['排队中', '解析', '完成', '失败'][x[3] + 1] AS stage, ([0, 5, 100, 100][x[3] + 1])::INT AS pct, x[2] AS seq, epoch_us(born[1]) AS created_us
FROM u JOIN h USING (desk, task_id)""",
    "pii_redaction": f"SELECT doc_id, md5({_REDACT}) AS redacted_md5, length({_REDACT})::INT AS redacted_chars FROM documents",
    "paper_meta": f"""WITH papers AS (SELECT doc_id, '摘要：' || {_ABSTRACT} || chr(10) || '关键词：河流；沉积；编号' || doc_id || chr(10) || text AS text FROM documents)
SELECT CASE doc_id % 3 WHEN 0 THEN '毕业论文-' WHEN 1 THEN 'journal-' ELSE '' END || doc_id || '.txt' AS path, '摘要：' || {_ABSTRACT} AS title, {_ABSTRACT} AS abstract, '河流；沉积；编号' || doc_id AS keywords,
  least(30, {_HEADS})::INT AS n_headings, length(text)::INT AS n_chars, CASE doc_id % 3 WHEN 0 THEN 'thesis' WHEN 1 THEN 'journal' ELSE 'course' END AS ptype FROM papers""",
    "text_chunks": f"""WITH RECURSIVE {_PAPERS},
l AS (SELECT path, replace(text, {_NL}, {_NL} || {_NL}) AS whole, list_filter(list_transform(string_split(text, {_NL}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS own FROM papers),
p AS (SELECT path, CASE WHEN len(own) > 0 THEN own WHEN whole <> '' THEN [whole] ELSE [] END AS ps FROM l),
f AS (SELECT path, 1 AS i, 0 AS no, ps[1] AS buf FROM p WHERE len(ps) > 0
  UNION ALL SELECT f.path, f.i + 1, CASE WHEN length(f.buf) + length(p.ps[f.i + 1]) > 1000 THEN f.no + 1 ELSE f.no END,
    CASE WHEN length(f.buf) + length(p.ps[f.i + 1]) > 1000 THEN p.ps[f.i + 1] ELSE f.buf || {_NL} || {_NL} || p.ps[f.i + 1] END FROM f JOIN p USING (path) WHERE f.i < len(p.ps))
SELECT path, no::INT AS chunk_no, length(arg_max(buf, i))::INT AS chars, md5(arg_max(buf, i)) AS chunk_md5 FROM f GROUP BY path, no""",
    "chapter_heat": f"""{_ALL.replace(_ITEMS, _PARTS)},
src AS (SELECT item_id AS doc_id, length('## part one' || {_NL} || text || {_NL}) AS mid FROM benchmark),
chap AS (SELECT doc_id, 0 AS ch_no, 'part one' AS title, 0 AS lo, mid AS hi FROM src UNION ALL SELECT doc_id, 1, 'part two', mid, 2147483647 FROM src),
heat AS (SELECT c.doc_id, c.ch_no, c.title, coalesce(sum(length(a.norm)), 0) AS chars, coalesce(sum(CASE WHEN b.q_idx IS NOT NULL THEN length(a.norm) END), 0) AS hit
  FROM chap c LEFT JOIN ask a ON a.doc_id = c.doc_id AND a.start_at >= c.lo AND a.start_at < c.hi LEFT JOIN best b ON b.q_doc = a.doc_id AND b.q_idx = a.idx GROUP BY ALL)
SELECT doc_id, ch_no, title, chars::BIGINT AS chars, hit::BIGINT AS hit_chars, ratio, CASE WHEN ratio >= 0.4 THEN '#c0392b' WHEN ratio >= 0.2 THEN '#e67e22' WHEN ratio > 0 THEN '#f1c40f' ELSE '#2ecc71' END AS color
FROM (SELECT *, CASE WHEN chars > 0 THEN round_even(hit / chars, 4) ELSE 0.0 END AS ratio FROM heat)""",
    "sample_excerpt": f"""WITH {_PAPERS} SELECT path, md5(CASE WHEN length(text) <= 3600 THEN text ELSE substr(text, 1, 1800) || chr(10) || chr(10) || '……（中略）……' || chr(10) || chr(10)
|| substr(text, length(text) // 2 - 299, 1000) || chr(10) || chr(10) || '……（后略）……' || chr(10) || chr(10) || right(text, 800) END) AS excerpt_md5 FROM papers""",
    "mock_scores": f"""{_SCORES}, two AS (SELECT *, len(s) AS n, CASE WHEN len(s) > 0 THEN (h % len(s)::UHUGEINT)::INT END AS a, CASE WHEN len(s) > 0 THEN ((h // len(s)::UHUGEINT) % len(s)::UHUGEINT)::INT END AS b0 FROM scores),
three AS (SELECT *, CASE WHEN a = b0 AND n > 1 THEN (a + 1) % n ELSE b0 END AS b FROM two)
SELECT path, name, score, confidence, CASE WHEN n = 0 THEN '' WHEN a = b THEN s[a + 1] ELSE s[least(a, b) + 1] || '|' || s[greatest(a, b) + 1] END AS evidence, comment, suspicions FROM three""",
    "weighted_totals": f"{_TOTALS} SELECT path, total, {_BAND} AS band, confidence, CASE WHEN confidence < 0.6 THEN '置信度偏低，建议人工复评' ELSE '' END AS flags FROM totals",
    "band_distribution": f"{_TOTALS} SELECT {_BAND} AS band, count(*) AS n FROM totals GROUP BY 1",
    "batch_stats": f"{_TOTALS} SELECT count(*) AS n, round_even(avg(total), 1) AS average, max(total) AS highest, min(total) AS lowest FROM totals",
    "grade_pivot": f"{_SCORES} SELECT path, max(score) FILTER (name = 'topic') AS topic, max(score) FILTER (name = 'content') AS content, max(score) FILTER (name = 'argument') AS argument, max(score) FILTER (name = 'structure') AS structure, max(score) FILTER (name = 'writing') AS writing FROM scores GROUP BY path",
    "grade_ranking": f"{_TOTALS} SELECT path, total, row_number() OVER (ORDER BY total DESC, path)::INT AS rank FROM totals",
    "low_confidence_flags": f"{_SCORES} SELECT path, c AS confidence FROM (SELECT path, round_even(least(1.0, avg(confidence - 0.2)), 2) AS c FROM scores GROUP BY path) WHERE c < 0.6",
    "loose_json_scores": "SELECT event_id, md5(props) AS json_md5 FROM events WHERE props IS NOT NULL AND json_valid(props)",
    "cache_validity": "SELECT coalesce(n_chars % 3 <> 0 AND n_chars % 5 <> 0, true) AS hit, count(*) AS n FROM documents GROUP BY 1",
    "grade_replies": f"""WITH {_PAPERS}, t AS (SELECT path, length(text)::INT AS n_chars, CASE WHEN length(text) > 3000 THEN 79.0::DOUBLE ELSE 69.0::DOUBLE END AS total, CASE WHEN length(text) > 3000 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM papers)
SELECT path, n_chars, total, {_BAND} AS band, confidence, 5 AS n_dims, 'read' AS overall_comment, 'i' AS improvements, CASE WHEN confidence < 0.6 THEN '置信度偏低，建议人工复评' ELSE '' END AS flags, NULL::VARCHAR AS error FROM t""",
    "vector_matches": f"""{_ALL},
vec AS (SELECT norm, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(norm) - length(replace(norm, c, '')))::DOUBLE) AS v FROM (SELECT DISTINCT norm FROM lib UNION SELECT DISTINCT norm FROM pend)),
near AS (SELECT a.norm AS q_norm, b.norm AS norm, list_cosine_similarity(a.v, b.v) AS score FROM vec a JOIN (SELECT DISTINCT norm FROM pend) p ON p.norm = a.norm, vec b WHERE b.norm IN (SELECT norm FROM lib) AND list_sum(a.v) > 0 AND list_sum(b.v) > 0),
vtop AS (SELECT p.doc_id AS q_doc, p.idx AS q_idx, p.norm AS q_norm, l.doc_id AS doc_id, l.idx AS s_idx, l.norm AS norm, s.score, row_number() OVER (PARTITION BY p.doc_id, p.idx ORDER BY round(s.score, 12) DESC, l.doc_id, l.idx) AS rank
  FROM pend p JOIN near s ON s.q_norm = p.norm JOIN lib l ON l.norm = s.norm WHERE s.score >= 0.55),
vd AS (SELECT *, greatest(length(q_norm), length(norm)) AS m, {_DIST} AS d FROM vtop WHERE rank <= 3),
vt AS (SELECT *, CASE WHEN 5 * d <= m THEN 'copy' WHEN 20 * d <= 7 * m THEN 'near' WHEN 20 * d <= 9 * m THEN 'suspect' WHEN score >= 0.72 THEN 'semantic' END AS tier FROM vd)
SELECT q_doc, q_idx::INT AS q_idx, doc_id, s_idx::INT AS s_idx, tier, round_even(score, 3) AS cos FROM vt WHERE tier IS NOT NULL""",
}
