"""DuckDB counterparts of the catalogue's queries."""

from __future__ import annotations

from ..config import SPARSE_BUCKETS, STOPWORDS
from ..functions import text as fx
from ..operators import casebook as cb
from ..operators import context as cx
from .fixtures import GATE_ROWS, GOLDEN_DOCS, GOLDEN_QUERIES, RULE_QUERIES, RULE_SENTENCES

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_IDENTITY = "local:local-hash-embedding"


def _tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9_/\\-]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda t: NOT list_contains({_STOP}, t))"


def _spread(column: str) -> str:
    """Terms with the bigrams of long CJK runs, as ``tokenize`` gives them."""
    bigrams = "list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS BIGINT), 2))"
    return f"flatten(list_transform({_tok(column)}, lambda r: CASE WHEN regexp_full_match(r, '[\\x{{4e00}}-\\x{{9fff}}]{{4,}}') THEN list_concat([r], {bigrams}) ELSE [r] END))"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _points(sentence: str, query: str, terms: str) -> str:
    """The rules that score a sentence against a query."""
    says = lambda c, pattern: f"regexp_matches({c}, {_text(pattern)})"
    when = lambda condition, n: f"CASE WHEN {condition} THEN {n} ELSE 0 END"
    timed = f"{when(says(sentence, fx.TIME_STRONG), fx.TIME_STRONG_POINTS)} + {when(f'NOT {says(sentence, fx.TIME_STRONG)} AND {says(sentence, fx.TIME_WEAK)}', fx.TIME_WEAK_POINTS)}"
    timed += f" + {when(f'contains({sentence}, {_text(fx.TIME_EXCESS)})', fx.TIME_EXCESS_POINTS)}"
    topics = " + ".join(when(f"{says(query, asked)} AND {says(sentence, told)}", n) for asked, told, n in fx.TOPIC_RULES)
    code = when(f"len(list_filter({terms}, lambda t: regexp_matches(t, {_text(fx.CODE_TERM)}) AND contains(lower({sentence}), t))) > 0", fx.CODE_POINTS)
    return f"(len(list_intersect({terms}, {_spread(sentence)})) + {code} + {when(says(query, fx.TIME_QUERY), f'({timed})')} + {topics})"


def _ood(query: str) -> str:
    return f"(regexp_matches({query}, {_text(fx.OUT_OF_DOMAIN)}, 'i') AND NOT regexp_matches({query}, {_text(fx.IN_DOMAIN)}, 'i'))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0b}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0b}}]+$', '', 'g')"


def _key(column: str) -> str:
    return f"CAST(round(({column}) * 1000000) AS BIGINT)"


_NORMAL = lambda c: _strip(f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")

_HI = lambda t: f"CAST('0x' || substr(sha256({t}), 1, 8) AS BIGINT)"
_LO = lambda t: f"CAST('0x' || substr(sha256({t}), 9, 8) AS BIGINT)"
_BUCKET = lambda t: f"((({_HI(t)} % {SPARSE_BUCKETS}) * 2 + {_LO(t)}) % {SPARSE_BUCKETS})"
_SIGN = lambda t: f"CASE WHEN CAST('0x' || substr(sha256({t}), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"

_HASH = f"sha256('{_IDENTITY}' || chr(0) || '1024' || chr(0) || text)"

_DT = f"dt AS (SELECT doc_id, {_tok('text')} AS terms FROM documents)"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf, max(n) AS length FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM dt) GROUP BY doc_id, term)"
_STATS = "stats AS (SELECT count(*) AS n_rows, avg(len(terms)) AS mean_length FROM dt)"
_QT = f"qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY query_id, term)"
_ACC = """acc AS (
  SELECT *, list_filter(regexp_split_to_array(permission_scope, '[,;\\s]+'), lambda s: s <> '') AS scopes,
         CASE WHEN effective_from = '' THEN 0 ELSE CAST(replace(effective_from, '-', '') AS INT) END AS from_day,
         CASE WHEN effective_to = '' THEN 99991231 ELSE CAST(replace(effective_to, '-', '') AS INT) END AS to_day
  FROM (SELECT doc_id, text,
    CASE doc_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'internal, partner_support' WHEN 3 THEN 'finance_restricted' ELSE '' END AS permission_scope,
    CASE WHEN doc_id % 7 = 0 THEN '2027-01-01' ELSE '' END AS effective_from,
    CASE WHEN doc_id % 11 = 0 THEN '2026-01-31' ELSE '' END AS effective_to FROM documents))"""
_ALLOWED = "list_has_any(scopes, ['internal', 'public'])"
_VALID = "(from_day <= 20260607 AND to_day >= 20260607)"
_ASKER = lambda key, k: f"""ask AS (SELECT {key} AS query_id, CASE {k} % 4 WHEN 0 THEN ['public'] WHEN 1 THEN ['internal', 'partner_support'] WHEN 2 THEN ['finance_restricted'] ELSE ['internal', 'public'] END AS allowed,
  CASE {k} % 3 WHEN 0 THEN 20260607 WHEN 1 THEN 20250101 ELSE 20280101 END AS as_of"""  # noqa: E731
_ASK = f"{_ASKER('item_id', 'item_id')} FROM benchmark)"
_MET = "list_has_any(scopes, allowed)"
_SEEN = f"({_MET} AND from_day <= as_of AND to_day >= as_of)"


def _bm25(variant: str, among: str = "") -> str:
    k1 = {"plain": 1.5, "fts5": 1.2}[variant]
    odds = "ln({0}(n_rows - df + 0.5) / (df + 0.5))"
    idf = odds.format("1 + ") if variant == "plain" else f"CASE WHEN {odds.format('')} <= 0 THEN 1e-6 ELSE {odds.format('')} END"
    return f"""df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(times * ({idf}) * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean_length)))) AS score
  FROM post JOIN qt USING (term) JOIN df USING (term), stats {among} GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 12)"""


def _sparse(k: int, among: str = "") -> str:
    return f"""sb AS (SELECT doc_id, {_BUCKET('term')} AS bucket, sum(tf) AS tf FROM post GROUP BY 1, 2),
qb AS (SELECT query_id, {_BUCKET('term')} AS bucket, sum(times) AS times FROM qt GROUP BY 1, 2),
df AS (SELECT bucket, count(*) AS df FROM sb GROUP BY bucket),
sc AS (SELECT query_id, doc_id, sum(times * tf * ln((n_rows - df + 0.5) / (df + 0.5) + 1)) AS score
  FROM sb JOIN qb USING (bucket) JOIN df USING (bucket), stats {among} GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


_HW = lambda name, source, key: f"""{name}_r AS (SELECT {key}, {_HI('term')} % 1024 AS idx, sum({_SIGN('term')}) AS raw FROM {source} GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(raw * raw)) AS size FROM {name}_r GROUP BY 1),
{name} AS (SELECT {key}, idx, raw / size AS weight FROM {name}_r JOIN {name}_n USING ({key}) WHERE raw <> 0)"""  # noqa: E731

_DENSE = f"""{_HW('dw', '(SELECT doc_id, unnest(terms) AS term FROM dt)', 'doc_id')},
{_HW('qw', f"(SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark)", 'query_id')},
ds AS (SELECT query_id, doc_id, sum(qw.weight * dw.weight) AS score FROM dw JOIN qw USING (idx) GROUP BY 1, 2),
da AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN ds ON ds.query_id = b.item_id AND ds.doc_id = d.doc_id),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, doc_id) AS rank FROM da) WHERE rank <= 12)"""

_FUSED = f"""WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')}, {_DENSE},
fus AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS bm25_rank,
  coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf_score
  FROM den a FULL JOIN lex b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)"""

_RERANKED = f"""{_FUSED},
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('rerank_score')} DESC, {_key('rrf_score')} DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank
  FROM (SELECT *, ((doc_id * 7919 + query_id * 104729) % 1000) / 1000.0::DOUBLE AS rerank_score FROM fus)) WHERE rank <= 12)"""

_TRUNCATED = f"""{_RERANKED},
tp AS (SELECT *, row_number() OVER w AS position, lag(rerank_score) OVER w - rerank_score >= 0.28 AS wide, doc_id % 300 + 20 AS tokens
  FROM rr WHERE rerank_score >= 0.12 WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
tr AS (SELECT *, sum(tokens) OVER w AS running_tokens, coalesce(max(CASE WHEN wide THEN 1 ELSE 0 END) OVER w, 0) AS cut
  FROM tp WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
ts AS (SELECT *, cut = 0 AND position <= 5 AND running_tokens <= 900 AS selected FROM tr)"""

_SELECTED = f"""{_TRUNCATED},
se AS (SELECT ts.query_id, ts.doc_id, ts.position, ts.rerank_score, ts.bm25_rank, ts.tokens, 'E' || ts.position AS citation_id, d.text, d.source,
  CASE WHEN ts.position = 1 THEN 'primary' WHEN regexp_matches(d.text, '{cx.EXCEPTION_WORDS}') THEN 'exception' ELSE 'supporting' END AS evidence_role
  FROM ts JOIN documents d USING (doc_id) WHERE selected)"""

_QD = f"qd AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark), qn AS (SELECT query_id, count(*) AS n_terms FROM qd GROUP BY 1)"

_BLOCKED = f"""{_ACC}, {_QD},
bh AS (SELECT DISTINCT doc_id, unnest({_tok('text')}) AS term FROM acc WHERE NOT {_ALLOWED}),
bm AS (SELECT query_id, doc_id, count(*) AS n_matched, bool_or(regexp_matches(term, '\\d|[-_/]') OR length(term) >= 4) AS telling, string_agg(term, ' ' ORDER BY term) AS matched_terms
  FROM qd JOIN bh USING (term) GROUP BY 1, 2),
bo AS (SELECT bm.*, CAST(round(n_matched / n_terms, 4) * 10000 AS BIGINT) AS ratio_key, round(n_matched / n_terms, 4) AS overlap_ratio FROM bm JOIN qn USING (query_id) WHERE n_matched / n_terms >= 0.25 OR telling),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap_ratio DESC, n_matched DESC, doc_id) AS rank FROM bo) WHERE rank <= 5)"""

_JUDGED = f"""{_SELECTED}, {_BLOCKED},
sh AS (SELECT DISTINCT query_id, unnest({_tok('text')}) AS term FROM se),
sm AS (SELECT query_id, count(*) AS n_met FROM qd JOIN sh USING (query_id, term) GROUP BY 1),
sb AS (SELECT query_id, count(*) AS n_selected, max(rerank_score) AS best FROM se GROUP BY 1),
bb AS (SELECT query_id, count(*) AS n_blocked, max(overlap_ratio) AS ratio FROM bl GROUP BY 1),
jc AS (SELECT b.item_id AS query_id, b.text AS query, coalesce(n_selected, 0) AS n_selected, coalesce(best, 0) AS best, coalesce(n_met, 0) / greatest(1, coalesce(n_terms, 0)) AS coverage,
  coalesce(n_blocked, 0) AS n_blocked, coalesce(ratio, 0) AS ratio
  FROM benchmark b LEFT JOIN qn ON qn.query_id = b.item_id LEFT JOIN sm ON sm.query_id = b.item_id LEFT JOIN sb ON sb.query_id = b.item_id LEFT JOIN bb ON bb.query_id = b.item_id),
ju AS (SELECT *, CASE WHEN {_ood('query')} THEN 'out_of_domain_query' WHEN n_selected = 0 AND n_blocked > 0 THEN 'permission_denied' WHEN n_selected = 0 THEN 'no_selected_evidence'
  WHEN ratio >= 0.45 AND ratio >= coverage + 0.15 THEN 'permission_denied'
  WHEN best >= 0.12 AND (coverage >= 0.18 OR best >= 0.35) THEN 'pass' ELSE 'low_query_evidence_overlap' END AS reason FROM jc)"""

_ANSWERED = f"""{_JUDGED},
ss AS (SELECT query_id, position, citation_id, i, {_strip('p')} AS sentence FROM (
  SELECT query_id, position, citation_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT query_id, position, citation_id, regexp_extract_all(text, '[^。！？!?]*[。！？!?]|[^。！？!?]+') AS ps FROM se))),
sq AS (SELECT item_id AS query_id, text AS query, list_distinct({_spread('text')}) AS qterms FROM benchmark),
sp AS (SELECT ss.*, {_points('sentence', 'query', 'qterms')} AS points
  FROM ss JOIN sq USING (query_id) WHERE sentence <> ''),
sf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY points DESC, i) AS n FROM sp) WHERE n = 1),
sc2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS m FROM sf) WHERE m <= 2),
sa AS (SELECT query_id, string_agg(sentence || ' [' || citation_id || ']', chr(10) ORDER BY m) AS answer, string_agg(citation_id, ',' ORDER BY m) AS citations FROM sc2 GROUP BY 1),
an AS (SELECT query_id, CASE WHEN reason = 'pass' THEN 'extractive' ELSE 'refusal' END AS mode,
  CASE WHEN reason = 'pass' AND answer IS NOT NULL THEN answer WHEN reason = 'permission_denied' THEN '{cx.PERMISSION_ANSWER}' ELSE '{cx.REFUSAL_ANSWER}' END AS answer,
  CASE WHEN reason = 'pass' THEN coalesce(citations, '') ELSE '' END AS citations FROM ju LEFT JOIN sa USING (query_id))"""

_PROMPTS = f"""pb AS (SELECT query_id, string_agg({" || chr(10) || ".join(("'[' || citation_id || ']'", "'doc_id: ' || doc_id", "'title_path: ' || source", "'source_path: ' || source", "'version: v1'", "'role: ' || evidence_role", "'text:'", "text"))},
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS blocks FROM se GROUP BY 1),
pp AS (SELECT query_id, array_to_string([{_text(cx.PROMPT_QUESTION)}, query, '', {_text(cx.PROMPT_EVIDENCE)}, coalesce(blocks, ''), '', {_text(cx.PROMPT_RULES)}, {', '.join(_text(r) for r in cx.PROMPT_RULE_LINES)}], chr(10) || chr(10)) AS prompt
  FROM ju LEFT JOIN pb USING (query_id))"""

_REL = "rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text))"

_lines = lambda text: f"list_filter(list_transform(string_split({_NORMAL(text)}, chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"


def _folded(paras: str, parent: str, chars: int = 280, overlap: int = 60) -> str:
    """``chunks`` from ``paras``, SQL for (doc_id, source, ps): paragraphs folded into chunks of ``chars`` with an overlap."""
    return f"""para AS ({paras}),
fold(doc_id, source, ps, i, cur, out) AS (
  SELECT doc_id, source, ps, 1, '', CAST([] AS VARCHAR[]) FROM para
  UNION ALL
  SELECT doc_id, source, ps, i + 1,
    CASE WHEN length(cand) <= {chars} THEN cand WHEN cur <> '' THEN {_strip(f"right(cur, {overlap}) || chr(10) || chr(10) || p")} ELSE substr(p, {chars - overlap + 1}) END,
    CASE WHEN length(cand) <= {chars} THEN out WHEN cur <> '' THEN list_append(out, cur) ELSE list_append(out, left(p, {chars})) END
  FROM (SELECT *, ps[i] AS p, CASE WHEN cur <> '' THEN {_strip("cur || chr(10) || chr(10) || ps[i]")} ELSE ps[i] END AS cand FROM fold WHERE i <= len(ps))),
done AS (SELECT doc_id, source, CASE WHEN cur <> '' THEN list_append(out, cur) ELSE out END AS cs FROM fold WHERE i = len(ps) + 1),
ch AS (SELECT doc_id, source, {parent} AS parent_id, unnest(cs) AS text, generate_subscripts(cs, 1) - 1 AS chunk_no FROM done),
chunks AS (SELECT *, parent_id || ':chunk_' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(2, length(CAST(chunk_no AS VARCHAR))) AS INT), '0') AS chunk_id, greatest(1, length(text) // 2) AS token_count FROM ch)"""


# paragraphs of normalised texts, a line each
_FOLD = _folded(f"SELECT doc_id, source, {_lines('text')} AS ps FROM documents", "source || ':' || doc_id")

# paragraphs beyond 240 characters are packed by sentence first; a reduction starts from its first element, and sentences are not empty
_SENTENCES = f"list_filter(list_transform(regexp_extract_all(p, '[^。！？!?]*[。！？!?]|[^。！？!?]+'), lambda x: {_strip('x')}), lambda x: x <> '')"
_PACKED = f"""list_reduce(list_transform({_SENTENCES}, lambda x: {{'o': x, 'd': CAST([] AS VARCHAR[])}}), lambda a, b:
  CASE WHEN length(a.o) + length(b.o) <= 240 THEN {{'o': a.o || b.o, 'd': a.d}} ELSE {{'o': b.o, 'd': list_append(a.d, a.o)}} END)"""
_PLAIN = f"""SELECT doc_id, source, list(piece ORDER BY i, j) AS ps FROM (
  SELECT doc_id, source, i, unnest(parts) AS piece, generate_subscripts(parts, 1) AS j FROM (
    SELECT doc_id, source, i, CASE WHEN length(p) <= 240 THEN [p] WHEN len({_SENTENCES}) = 0 THEN [left(p, 240)] ELSE list_append(pk.d, pk.o) END AS parts FROM (
      SELECT doc_id, source, i, p, CASE WHEN len({_SENTENCES}) > 0 THEN {_PACKED} END AS pk FROM (
        SELECT doc_id, source, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, source, {_lines('text')} AS ps FROM documents))))) GROUP BY doc_id, source"""



def _greedy(weight: float, duplicate: float, limit: int) -> str:
    """The greedy choice as a recursion over ``s`` (query_id, ids, near: similarities by place, rel): a step drops near copies of what is chosen, then takes the best of the rest."""
    nearest = "list_max(list_transform(chosen, lambda c: near[i][c]))"
    return f"""r(query_id, ids, near, rel, lef, chosen, gains, drops, dups) AS (
  SELECT query_id, ids, near, rel, range(1, len(ids) + 1), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM s
  UNION ALL
  SELECT query_id, ids, near, rel, CASE WHEN len(rest) > 0 THEN list_filter(rest, lambda i: i <> best) ELSE rest END,
    CASE WHEN len(rest) > 0 THEN list_append(chosen, best) ELSE chosen END, CASE WHEN len(rest) > 0 THEN list_append(gains, list_max(g)) ELSE gains END,
    list_concat(drops, gone), list_concat(dups, list_transform(gone, lambda i: chosen[list_position(list_transform(chosen, lambda c: near[i][c]), {nearest})]))
  FROM (SELECT *, rest[list_position(g, list_max(g))] AS best FROM (
    SELECT *, list_transform(rest, lambda i: {weight}::DOUBLE * coalesce(rel[i], 1) - (1 - {weight}::DOUBLE) * CASE WHEN len(chosen) > 0 THEN {nearest} ELSE 0 END) AS g FROM (
      SELECT *, list_filter(lef, lambda i: len(chosen) = 0 OR {nearest} < {duplicate}) AS rest, list_filter(lef, lambda i: len(chosen) > 0 AND {nearest} >= {duplicate}) AS gone
      FROM r WHERE len(lef) > 0 AND len(chosen) < {limit})))),
f AS (SELECT * FROM r WHERE len(lef) = 0 OR len(chosen) = {limit})"""


_MMR = f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, e.v, list_inner_product(q.v, e.v) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_key('list_inner_product(q.v, e.v)')} DESC, e.vec_id) AS rank FROM e q, e WHERE q.vec_id % 100 = 0) WHERE rank <= 12),
m AS (SELECT a.query_id, a.rank AS i, list(list_inner_product(a.v, b.v) ORDER BY b.rank) AS near FROM t a JOIN t b USING (query_id) GROUP BY 1, 2),
s AS (SELECT t.query_id, list(vec_id ORDER BY rank) AS ids, list(near ORDER BY rank) AS near, list(score / nullif(top, 0) ORDER BY rank) AS rel
  FROM t JOIN m ON m.query_id = t.query_id AND m.i = t.rank JOIN (SELECT query_id, max(abs(score)) AS top FROM t GROUP BY 1) x ON x.query_id = t.query_id GROUP BY 1),
{_greedy(0.65, 0.3, 8)}"""

_EXPAND = f"""WITH RECURSIVE {_FOLD},
lst AS (SELECT parent_id, arg_max(chunk_id, chunk_no) AS own FROM chunks GROUP BY 1),
sib AS (SELECT parent_id, list(struct_pack(id := chunk_id, t := text, k := token_count) ORDER BY chunk_id) AS s FROM chunks GROUP BY 1),
ex(own, s, i, ids, txt, tokens) AS (
  SELECT own, s, 1, CAST([] AS VARCHAR[]), '', 0 FROM lst JOIN sib USING (parent_id)
  UNION ALL
  SELECT own, s, i + 1, CASE WHEN ok THEN list_append(ids, s[i].id) ELSE ids END, CASE WHEN ok THEN cand ELSE txt END, CASE WHEN ok THEN tokens + s[i].k ELSE tokens END
  FROM (SELECT *, length(cand) <= 1200 OR s[i].id = own AS ok FROM (
    SELECT *, CASE WHEN len(ids) > 0 THEN txt || chr(10) || chr(10) || s[i].t ELSE s[i].t END AS cand FROM ex WHERE i <= len(s))))
SELECT own AS chunk_id, array_to_string(ids, ',') AS expanded_ids, CAST(tokens AS BIGINT) AS expanded_tokens, sha256(txt) AS text_sha256 FROM ex WHERE i = len(s) + 1"""

_NOW = f"""v1 AS (SELECT doc_id, text, {_HASH} AS content_hash FROM documents),
v2 AS (SELECT doc_id, text, {_HASH} AS content_hash FROM (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 17 = 0)),
df AS (SELECT coalesce(v1.doc_id, v2.doc_id) AS doc_id, CASE WHEN v1.doc_id IS NULL THEN 'added' WHEN v2.doc_id IS NULL THEN 'removed'
  WHEN v1.content_hash = v2.content_hash THEN 'same' ELSE 'changed' END AS change FROM v1 FULL JOIN v2 ON v1.doc_id = v2.doc_id)"""

_LINES = lambda *items: " || chr(10) || ".join(items)
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_CLEAN = lambda c: _strip(f"regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')")
_CASEBOOK = f"""WITH cs AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS talk FROM conversations GROUP BY conv_id),
c AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS n,
  CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'Area ' || (conv_id % 4) END AS area, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Category x' END AS cat,
  CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'Sub ' || conv_id END AS sub FROM cs),
k AS (SELECT n // 12 + 1 AS doc_no, n % 12 + 1 AS case_no, CASE WHEN area = '' THEN {_Q(cb.DEFAULT_AREA)} ELSE area END AS head_area,
  {_LINES("'## Case ' || (n % 12 + 1) || ': ' || CASE WHEN sub <> '' THEN sub WHEN cat <> '' THEN cat ELSE area END", "''",
          "'- Issue area: ' || area", "'- Issue category: ' || cat", "'- Issue sub-category: ' || sub", "'- Product category: Goods'",
          "'- Product sub-category: '", "'- Issue complexity: low'", "''", "'### Normalized knowledge'", "''",
          f"CASE conv_id % 5 WHEN 0 THEN {_Q(cb.NO_QA)} WHEN 1 THEN '- Q1: {cb.ORIGINAL_QA}' || chr(10) || '  Resolution: no json here' ELSE '- Q1: Case ' || conv_id || chr(10) || '  Resolution: Done twice' END",
          "''", "'### Source conversation'", "''", _CLEAN('talk'), "''", "'### RAG notes'", "''", _Q(cb.NOTES))} AS body FROM c),
g AS (SELECT doc_no, arg_min(head_area, case_no) AS area, string_agg(body, chr(10) ORDER BY case_no) AS cases FROM k GROUP BY doc_no),
h AS (SELECT *, '{cb.ID_PREFIX}_' || lpad(CAST(doc_no AS VARCHAR), 3, '0') || '_' || lower(replace(area, ' ', '_')) AS doc_id,
  '{cb.TITLE} ' || lpad(CAST(doc_no AS VARCHAR), 3, '0') || ': ' || area AS title FROM g)
SELECT doc_id || '.md' AS filename, doc_id, title, sha256({_LINES("'---'", "'doc_id: ' || doc_id", "'title: ' || title",
  *[_Q(f"{k}: {v}") for k, v in (*cb.FRONTMATTER, ("dataset_source", ""), ("dataset_license", "MIT"))],
  "'---'", "''", "'# ' || title", "''", _Q(cb.INTRO), "''", "cases", "''")}) AS content_sha256 FROM h"""

# the index of what the corpus is now: a title of one letter, a section a document
_INDEXED = f"""{_NOW}, {_folded(f"SELECT doc_id, 't t' AS source, {_lines('text')} AS ps FROM v2 WHERE text <> ''", "doc_id || ':sec_00'")},
ct AS (SELECT chunk_id, doc_id, {_spread("'t t ' || text")} AS terms FROM chunks),
cp AS (SELECT chunk_id, term, count(*) AS tf, max(n) AS length FROM (SELECT chunk_id, len(terms) AS n, unnest(terms) AS term FROM ct) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n_rows, avg(len(terms)) AS mean_length FROM ct)"""
# the whole engine on literal documents: sections, recall by both routes, fusion, diversity, the gate, answers
#: The whole engine on literal documents; tests compare it with ``catalogue.hybrid_golden``.
GOLDEN_SQL = f"""WITH RECURSIVE raw(k, raw) AS (VALUES {', '.join(f"({k}, {_text(t)})" for k, t in enumerate(GOLDEN_DOCS))}),
hd AS (SELECT k, regexp_extract(raw, '(?s)\\A---\n(.*?)\n---', 1) AS head, {_strip("regexp_replace(raw, '(?s)\\A---\n.*?\n---', '')")} AS body FROM raw),
dc AS (SELECT regexp_extract(head, 'doc_id: ([^\n]*)', 1) AS doc_id, regexp_extract(head, 'title: ([^\n]*)', 1) AS title, regexp_extract(head, 'permission_scope: ([^\n]*)', 1) AS scope,
  string_split(replace(body, chr(10) || '## ', chr(1) || '## '), chr(1)) AS ps FROM hd),
sc0 AS (SELECT doc_id, title, scope, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS n FROM dc),
sec AS (SELECT doc_id, scope, doc_id || ':sec_' || lpad(CAST(n AS VARCHAR), 2, '0') AS parent_id, title || ' ' || CASE WHEN starts_with(p, '## ') THEN {_strip("regexp_extract(p, '^## ([^\n]*)', 1)")} ELSE title END AS titled, {_NORMAL('p')} AS text FROM sc0),
{_folded(f"SELECT doc_id, parent_id AS source, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM sec", "source")},
ct AS (SELECT c.chunk_id, c.doc_id, c.text, c.token_count, scope IN ('internal', 'public') AS seen, {_spread("titled || ' ' || c.text")} AS terms FROM chunks c JOIN sec USING (parent_id)),
gq(query_id, query) AS (VALUES {', '.join(f"('{k}', {_text(q)})" for k, q in GOLDEN_QUERIES)}),
qa AS (SELECT query_id, query, {_spread('query')} AS terms FROM gq),
{_HW('dw', '(SELECT chunk_id, unnest(terms) AS term FROM ct)', 'chunk_id')},
{_HW('qw', '(SELECT query_id, unnest(terms) AS term FROM qa)', 'query_id')},
ds AS (SELECT query_id, chunk_id, sum(qw.weight * dw.weight) AS score FROM qw JOIN dw USING (idx) GROUP BY 1, 2),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM gq CROSS JOIN ct LEFT JOIN ds USING (query_id, chunk_id) WHERE seen)) WHERE rank <= 12),
post AS (SELECT chunk_id AS doc_id, term, count(*) AS tf, max(n) AS length FROM (SELECT chunk_id, len(terms) AS n, unnest(terms) AS term FROM ct) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n_rows, avg(len(terms)) AS mean_length FROM ct),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(terms) AS term FROM qa) GROUP BY 1, 2),
{_bm25('plain', 'WHERE doc_id IN (SELECT chunk_id FROM ct WHERE seen)')},
fus AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.doc_id) AS chunk_id, a.rank AS dense_rank, b.rank AS bm25_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
  FROM den a FULL JOIN lex b ON a.query_id = b.query_id AND a.chunk_id = b.doc_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM fus) WHERE rank <= 12),
sm AS (SELECT a.chunk_id AS a, b.chunk_id AS b, sum(a.weight * b.weight) AS near FROM dw a JOIN dw b USING (idx) GROUP BY 1, 2),
m AS (SELECT x.query_id, x.rank AS i, list(coalesce(near, 0) ORDER BY y.rank) AS near FROM t x JOIN t y USING (query_id) LEFT JOIN sm ON sm.a = x.chunk_id AND sm.b = y.chunk_id GROUP BY 1, 2),
s AS (SELECT t.query_id, list(chunk_id ORDER BY rank) AS ids, list(near ORDER BY rank) AS near, list(score / nullif(top, 0) ORDER BY rank) AS rel
  FROM t JOIN m ON m.query_id = t.query_id AND m.i = t.rank JOIN (SELECT query_id, max(abs(score)) AS top FROM t GROUP BY 1) x ON x.query_id = t.query_id GROUP BY 1),
{_greedy(0.72, 0.92, 12)},
ch2 AS (SELECT query_id, ids[i] AS chunk_id, n FROM (SELECT query_id, ids, unnest(chosen) AS i, generate_subscripts(chosen, 1) AS n FROM f)),
ps2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY n) AS position, sum(token_count) OVER (PARTITION BY c.query_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS tokens, ct.doc_id, ct.text, ct.terms, t.bm25_rank
  FROM ch2 c JOIN ct USING (chunk_id) JOIN t ON t.query_id = c.query_id AND t.chunk_id = c.chunk_id),
se AS (SELECT *, 'E' || position AS citation_id FROM ps2 WHERE position <= 5 AND tokens <= 900),
qd AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM qa), qn AS (SELECT query_id, count(*) AS n_terms FROM qd GROUP BY 1),
sh AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM se WHERE bm25_rank IS NOT NULL),
nm AS (SELECT query_id, count(*) AS n_met FROM qd JOIN sh USING (query_id, term) GROUP BY 1),
nl AS (SELECT query_id, count(*) AS n_selected, count(bm25_rank) AS n_lexical FROM se GROUP BY 1),
bh AS (SELECT DISTINCT chunk_id, unnest(terms) AS term FROM ct WHERE NOT seen),
bo AS (SELECT query_id, chunk_id, round(count(*) / max(n_terms), 4) AS ratio FROM qd JOIN bh USING (term) JOIN qn USING (query_id) GROUP BY 1, 2
  HAVING count(*) / max(n_terms) >= 0.25 OR bool_or(regexp_matches(term, '\\d|[-_/]') OR length(term) >= 4)),
bb AS (SELECT query_id, max(ratio) AS ratio FROM bo GROUP BY 1),
jd AS (SELECT query_id, query, coalesce(n_met, 0) / greatest(1, coalesce(n_terms, 0)) AS coverage, coalesce(n_selected, 0) AS n_selected, coalesce(n_lexical, 0) AS n_lexical, ratio
  FROM gq LEFT JOIN qn USING (query_id) LEFT JOIN nm USING (query_id) LEFT JOIN nl USING (query_id) LEFT JOIN bb USING (query_id)),
ju AS (SELECT *, CASE WHEN {_ood('query')} THEN 'out_of_domain_query' WHEN n_selected = 0 AND ratio IS NOT NULL THEN 'permission_denied' WHEN n_selected = 0 THEN 'no_selected_evidence'
  WHEN ratio >= 0.45 AND ratio >= coverage + 0.15 THEN 'permission_denied' WHEN coverage >= 0.18 THEN 'pass' WHEN n_lexical = 0 THEN 'rrf_only_missing_lexical_signal' ELSE 'low_query_evidence_overlap' END AS reason FROM jd),
st AS (SELECT query_id, position, citation_id, i, {_strip('p')} AS sentence FROM (SELECT query_id, position, citation_id, unnest(pp) AS p, generate_subscripts(pp, 1) AS i FROM (
  SELECT query_id, position, citation_id, regexp_extract_all(regexp_replace(text, '(?m)^#+\\s+.*$', '', 'g'), '[^。！？!?]*[。！？!?]|[^。！？!?]+') AS pp FROM se))),
sp AS (SELECT st.*, {_points('sentence', 'query', 'list_distinct(terms)')} AS points FROM st JOIN qa USING (query_id) WHERE sentence <> ''),
sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY points DESC, i) AS n FROM sp) WHERE n = 1 AND points > -1),
sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS m FROM sb) WHERE m <= 2),
sa AS (SELECT query_id, string_agg(sentence || ' [' || citation_id || ']', chr(10) ORDER BY m) AS answer, string_agg(citation_id, ',' ORDER BY m) AS citations FROM sl GROUP BY 1)
SELECT query_id, CASE WHEN reason = 'pass' THEN 'extractive' ELSE 'refusal' END AS mode, reason,
  CASE WHEN reason = 'pass' AND answer IS NOT NULL THEN answer WHEN reason = 'permission_denied' THEN '{cx.PERMISSION_ANSWER}' ELSE '{cx.REFUSAL_ANSWER}' END AS answer,
  CASE WHEN reason = 'pass' THEN coalesce(citations, '') ELSE '' END AS citations, true AS citation_valid FROM ju LEFT JOIN sa USING (query_id)"""
_RULE_ROWS = lambda rows: ", ".join(f"({k}::BIGINT, {_text(r)})" for k, r in enumerate(rows))
_GATE = ", ".join("(" + ", ".join("NULL" if v is None else _text(v) if isinstance(v, str) else f"{v}::DOUBLE" for v in (k, *r)) + ")" for k, r in enumerate(GATE_ROWS))
_GATED = lambda policy: f"""CASE WHEN {_ood('query')} THEN 'out_of_domain_query' WHEN n_selected = 0 AND ratio IS NOT NULL THEN 'permission_denied' WHEN n_selected = 0 THEN 'no_selected_evidence'
  WHEN ratio >= 0.45 AND ratio >= coverage + 0.15 THEN 'permission_denied' {policy} ELSE 'low_query_evidence_overlap' END"""  # noqa: E731

_PIECES = "string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ')"

SQL = {
    "tokenize_terms": f"WITH {_DT} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, sha256(array_to_string(terms, ' ')) AS terms_sha256 FROM dt",
    "tokenize_literals": f"""SELECT id, array_to_string(flatten(list_transform({_tok('q')}, lambda r: CASE WHEN regexp_full_match(r, '[\\x{{4e00}}-\\x{{9fff}}]{{4,}}')
  THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS BIGINT), 2))) ELSE [r] END)), ' ') AS terms
  FROM (SELECT doc_id AS id, (['跨境订单退款多久到账？', 'SKU-A17 是否支持无理由退货？', '用户 可以 的', 'refund Refund policy'])[doc_id % 4 + 1] || ' ' || source AS q FROM documents)""",
    "sql_terms": f"WITH {_DT} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, sha256(array_to_string(terms, ' ')) AS terms_sha256 FROM dt",
    "sql_access": f"""WITH {_ACC} SELECT doc_id, CASE WHEN NOT {_ALLOWED} THEN 'permission_scope' WHEN from_day > 20260607 THEN 'not_yet_effective' WHEN to_day < 20260607 THEN 'expired' END AS reason,
  {_ALLOWED} AND {_VALID} AS visible, array_to_string(scopes, ',') AS scopes FROM acc""",
    "sql_chunks": f"WITH RECURSIVE {_FOLD} SELECT doc_id, chunk_no, length(text) AS n_chars, sha256(text) AS text_sha256 FROM chunks",
    "term_stats": f"WITH {_DT}, {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"WITH {_DT}, {_STATS} SELECT n_rows, {_key('mean_length')} AS mean_length_key FROM stats",
    "hash_embedding": f"WITH {_DT}, {_HW('dw', '(SELECT doc_id, unnest(terms) AS term FROM dt)', 'doc_id')} SELECT doc_id, idx, {_key('weight')} AS weight_key FROM dw",
    "sparse_vector": f"WITH {_DT}, {_POST} SELECT doc_id, {_BUCKET('term')} AS bucket, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY 1, 2",
    "content_hash": f"SELECT doc_id, {_HASH} AS content_hash FROM documents",
    "normalize_text": f"""SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT doc_id,
  {_NORMAL("' ' || chr(9) || replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)) || chr(13) || chr(10) || ' '")} AS t FROM documents)""",
    "scalar_text": """SELECT doc_id, array_to_string(list_sort(list_distinct([source, lang, 'x'])), '|') AS split, 'ber_' || source || '_' || lang AS slug,
  'ber_' || source || '_' || lang AS path_slug, 'a ' || source || ' b' AS clean, 'local' || lang || ':' || source AS identity, greatest(1, length(text) // 2) AS token_count FROM documents""",
    "sortable_day": "SELECT doc_id AS id, ([20260607, 99991231, 20260131, 20251231, 99991231, 99991231])[doc_id % 6 + 1]::BIGINT AS day FROM documents",
    "access_reasons": f"WITH {_ACC} SELECT doc_id, CASE WHEN NOT {_ALLOWED} THEN 'permission_scope' WHEN from_day > 20260607 THEN 'not_yet_effective' WHEN to_day < 20260607 THEN 'expired' END AS reason FROM acc",
    "access_reasons_by_text": f"""WITH {_ACC} SELECT doc_id, CASE WHEN NOT {_ALLOWED} THEN 'permission_scope' WHEN effective_from <> '' AND effective_from > '2026-06-07' THEN 'not_yet_effective'
  WHEN effective_to <> '' AND effective_to < '2026-06-07' THEN 'expired' END AS reason FROM acc""",
    "access_counts": f"""WITH {_ACC} SELECT count(*) FILTER ({_ALLOWED} AND {_VALID}) AS visible, count(*) FILTER (NOT {_ALLOWED}) AS permission_scope,
  count(*) FILTER ({_ALLOWED} AND from_day > 20260607) AS not_yet_effective, count(*) FILTER ({_ALLOWED} AND from_day <= 20260607 AND to_day < 20260607) AS expired FROM acc""",
    "visible_docs": f"WITH {_ACC} SELECT doc_id, array_to_string(scopes, ',') AS scopes, CAST(from_day AS BIGINT) AS from_day, CAST(to_day AS BIGINT) AS to_day FROM acc WHERE {_ALLOWED} AND {_VALID}",
    "access_store_split": f"WITH {_ACC} SELECT doc_id, CASE WHEN NOT {_ALLOWED} THEN 'blocked' WHEN from_day > 20260607 THEN 'not_yet_effective' WHEN to_day < 20260607 THEN 'expired' ELSE 'visible' END AS part FROM acc",
    "access_remote_split": f"""WITH {_ACC} SELECT doc_id, 'visible' AS part FROM acc WHERE {_ALLOWED} AND {_VALID} UNION ALL SELECT doc_id, 'blocked' FROM acc WHERE NOT {_ALLOWED} AND {_VALID}
  UNION ALL SELECT doc_id, 'not_yet_effective' FROM acc WHERE {_ALLOWED} AND from_day > 20260607 UNION ALL SELECT doc_id, 'expired' FROM acc WHERE {_ALLOWED} AND to_day < 20260607""",
    "blocked_matches": f"WITH {_BLOCKED} SELECT query_id, doc_id, rank, n_matched, ratio_key, matched_terms FROM bl",
    "blocked_recall": f"WITH {_ACC}, {_DT}, {_POST}, {_STATS}, {_QT}, {_sparse(5, f'WHERE doc_id IN (SELECT doc_id FROM acc WHERE NOT {_ALLOWED} AND {_VALID})')} SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM lex",
    "bm25_topk": f"WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')} SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM lex",
    "bm25_fts5_topk": f"WITH {_ACC}, {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('fts5', f'WHERE doc_id IN (SELECT doc_id FROM acc WHERE {_ALLOWED} AND {_VALID})')} SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM lex",
    "visible_by_asker": f"""WITH {_ACC}, {_ASK} SELECT query_id, count(*) FILTER ({_SEEN}) AS visible, count(*) FILTER (NOT {_MET}) AS permission_scope, count(*) FILTER ({_MET} AND from_day > as_of) AS not_yet_effective,
  count(*) FILTER ({_MET} AND from_day <= as_of AND to_day < as_of) AS expired, CAST(coalesce(sum(doc_id) FILTER ({_SEEN}), 0) AS BIGINT) AS ids FROM acc, ask GROUP BY query_id""",
    "bm25_by_asker": f"""WITH {_ACC}, {_ASK}, {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain', f'WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM acc, ask WHERE {_SEEN})')}
SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM lex""",
    "dense_by_asker": f"""WITH {_ACC.replace('doc_id, text,', 'vec_id AS doc_id, embedding,').replace('doc_id %', 'vec_id %').replace('FROM documents', 'FROM embeddings')}, {_ASKER('vec_id', '(vec_id // 100)')}, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, doc_id AS vec_id, {_key('list_inner_product(v, CAST(embedding AS DOUBLE[]))')} AS score_key FROM acc, ask WHERE {_SEEN})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_key DESC, vec_id) AS rank FROM s) WHERE rank <= 12""",
    "sparse_idf_topk": f"WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_sparse(12)} SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM lex",
    "hash_dense_topk": f"WITH {_DT}, {_DENSE} SELECT query_id, doc_id, rank, {_key('score')} AS score_key FROM den",
    "dense_topk": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {_key('list_inner_product(q.v, e.v)')} AS score_key FROM e q, e WHERE q.vec_id % 100 = 0)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_key DESC, vec_id) AS rank FROM s) WHERE rank <= 12""",
    "clustered_exact": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {_key('list_inner_product(q.v, e.v)')} AS score_key FROM e q, e WHERE q.vec_id % 100 = 0)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_key DESC, vec_id) AS rank FROM s) WHERE rank <= 12""",
    "cosine_topk_minscore": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
  SELECT query_id, vec_id, rank, {_key('score')} AS score_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('score')} DESC, vec_id) AS rank FROM s WHERE score >= 0.25) WHERE rank <= 4""",
    "rrf_fused": f"{_FUSED} SELECT query_id, doc_id, dense_rank, bm25_rank, {_key('rrf_score')} AS rrf_key FROM fus",
    "rerank_skip": f"""{_FUSED} SELECT query_id, doc_id, rank, {_key('rrf_score')} AS score_key, 'rerank_skipped:no_configured_model' AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('rrf_score')} DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM fus) WHERE rank <= 12""",
    "rerank_scores": f"{_RERANKED} SELECT query_id, doc_id, rank, {_key('rerank_score')} AS score_key, 'external_reranker:stand-in' AS reason FROM rr",
    "rerank_response": f"""WITH s AS (SELECT conv_id AS request_id, turn AS index, CASE WHEN length(text) % 3 <> 0 THEN length(text) / 1000.0::DOUBLE ELSE 0 END AS score FROM conversations)
  SELECT request_id, index, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, index) AS rank, {_key('score')} AS score_key FROM s""",
    "dynamic_truncate": f"{_TRUNCATED} SELECT query_id, doc_id, position, CAST(running_tokens AS BIGINT) AS running_tokens, selected FROM ts",
    "hydrate": f"WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')} SELECT doc_id, lang, length(text) AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM lex)",
    "section_split": f"""SELECT doc_id, i - 1 AS section_no, doc_id || ':sec_' || lpad(CAST(i - 1 AS VARCHAR), CAST(greatest(2, length(CAST(i - 1 AS VARCHAR))) AS INT), '0') AS parent_id,
  sha256(CASE WHEN i = 1 THEN source ELSE {_strip('p')} END) AS title_sha256, sha256({_NORMAL("CASE WHEN i = 1 THEN p ELSE '## ' || p END")}) AS text_sha256
  FROM (SELECT doc_id, source, unnest({_PIECES}) AS p, generate_subscripts({_PIECES}, 1) AS i FROM documents WHERE text <> '')""",
    "chunk_fold": f"WITH RECURSIVE {_FOLD} SELECT doc_id, chunk_no, length(text) AS n_chars, sha256(text) AS text_sha256 FROM chunks",
    "chunk_rows": f"WITH RECURSIVE {_FOLD} SELECT chunk_id, parent_id, doc_id, token_count, CAST(len({_tok("source || ' ' || text")}) AS BIGINT) AS n_terms FROM chunks",
    "parent_expand": _EXPAND,
    "siblings": f"""WITH RECURSIVE {_FOLD}, a AS (SELECT DISTINCT parent_id FROM chunks UNION ALL SELECT 'none:' || doc_id FROM documents)
  SELECT a.parent_id, count(chunk_id) AS n, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id), '') AS ids FROM a LEFT JOIN chunks USING (parent_id) GROUP BY 1""",
    "sync_diff": f"WITH {_NOW} SELECT doc_id, change FROM df",
    "upsert_merge": f"""WITH {_NOW} SELECT doc_id, content_hash FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM df WHERE change IN ('added', 'changed'))
  UNION ALL SELECT doc_id, content_hash FROM v2 WHERE doc_id IN (SELECT doc_id FROM df WHERE change IN ('added', 'changed'))""",
    "delete_docs": f"WITH {_NOW} SELECT doc_id, content_hash FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM df WHERE change = 'removed')",
    "manifest_first": f"WITH RECURSIVE {_FOLD} SELECT doc_id, parent_id || '/' || arg_min(chunk_no, chunk_id) AS source_path, sha256(arg_min(text, chunk_id)) AS content_hash FROM chunks GROUP BY doc_id, parent_id",
    "sufficiency": f"{_JUDGED} SELECT query_id, {_key('coverage')} AS coverage_key, n_selected, reason, reason = 'pass' AS enough FROM ju",
    "sufficiency_rrf_only": f"""{_FUSED}, {_QD},
t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('rrf_score')} DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM fus) WHERE rank <= 5),
hl AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM t5 JOIN dt USING (doc_id) WHERE bm25_rank IS NOT NULL),
nm AS (SELECT query_id, count(*) AS n_met FROM qd JOIN hl USING (query_id, term) GROUP BY 1),
nl AS (SELECT query_id, count(*) AS n_selected, count(bm25_rank) AS n_lexical FROM t5 GROUP BY 1),
cv AS (SELECT item_id AS query_id, coalesce(n_met, 0) / greatest(1, coalesce(n_terms, 0)) AS coverage, coalesce(n_lexical, 0) AS n_lexical, coalesce(n_selected, 0) AS n_selected
  FROM benchmark LEFT JOIN nm ON nm.query_id = item_id LEFT JOIN qn ON qn.query_id = item_id LEFT JOIN nl ON nl.query_id = item_id),
ju AS (SELECT *, CASE WHEN n_selected = 0 THEN 'no_selected_evidence' WHEN coverage >= 0.18 THEN 'pass' WHEN n_lexical = 0 THEN 'rrf_only_missing_lexical_signal' ELSE 'low_query_evidence_overlap' END AS reason FROM cv)
SELECT query_id, {_key('coverage')} AS coverage_key, n_lexical, reason, reason = 'pass' AS enough FROM ju""",
    "context_evidence": f"{_SELECTED} SELECT query_id, doc_id, citation_id, evidence_role, tokens FROM se",
    "extractive_answer": f"{_ANSWERED} SELECT query_id, mode, sha256(answer) AS answer_sha256, citations FROM an",
    "citation_validation": """WITH s AS (SELECT conv_id AS query_id, 'E' || count(*) AS e FROM conversations GROUP BY 1), u AS (SELECT query_id, list_sort(list_distinct([e, 'E1'])) AS used FROM s)
  SELECT query_id, array_to_string(used, ',') AS used, array_to_string(list_filter(used, lambda c: c NOT IN ('E1', 'E2', 'E4')), ',') AS missing, len(list_filter(used, lambda c: c NOT IN ('E1', 'E2', 'E4'))) = 0 AS citation_valid FROM u""",
    "prompts": f"{_JUDGED}, {_PROMPTS} SELECT query_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM pp",
    "numbered_context": f"""WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')},
nc AS (SELECT query_id, string_agg('[' || rank || '] source=' || source || ' chunk=' || doc_id || ' score=' || format('{{:.4f}}', score) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM lex JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id)
SELECT query_id, length(context) AS n_chars, sha256(context) AS context_sha256 FROM nc""",
    "result_summary": f"WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')} SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS chunk_id, source || ' > ' || lang AS title_path, CAST(round(score * 10000) AS BIGINT) AS score_key FROM lex JOIN documents USING (doc_id) WHERE rank <= 5",
    "casebook_render": _CASEBOOK,
    "retrieval_metrics": f"""WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')}, {_REL},
h AS (SELECT query_id, min(rank) AS first FROM lex JOIN rel USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS n_queries, count(first) AS n_hit, {_key('avg(coalesce(1.0::DOUBLE / first, 0))')} AS mrr_key FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN h USING (query_id)""",
    "eval_report": f"""{_ANSWERED}, {_REL}, ex AS (SELECT query_id, min(doc_id) AS expected FROM rel GROUP BY 1), sd AS (SELECT query_id, list(doc_id) AS docs FROM se GROUP BY 1)
SELECT 'case' || an.query_id AS case_id, CASE WHEN an.query_id % 4 = 0 THEN mode = 'refusal'
  ELSE (expected IS NULL OR coalesce(list_contains(docs, expected), false)) AND contains(answer, left(b.text, 3)) END AS passed
FROM an JOIN benchmark b ON b.item_id = an.query_id LEFT JOIN ex USING (query_id) LEFT JOIN sd USING (query_id)""",
    "monitoring_event": f"""WITH {_DT}, {_POST}, {_STATS}, {_QT}, {_bm25('plain')}, f AS (SELECT query_id, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS docs FROM lex WHERE rank <= 5 GROUP BY 1)
SELECT item_id AS query_id, 'ok' AS status, left(sha256(text), 16) AS query_hash, length(text) AS query_chars, item_id % 3 = 0 AS permission_denied, coalesce(n, 0) AS bm25_hits, coalesce(n, 0) AS selected_count, coalesce(docs, '') AS selected_doc_ids
FROM benchmark LEFT JOIN f ON f.query_id = item_id""",
    "monitoring_rollup": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS total_key, CAST(round(max(value) * 1000000) AS BIGINT) AS most_key FROM events GROUP BY 1, 2""",
    "fallback_summary": "SELECT n_name AS component, 'local' AS mode, '' AS reason, '' AS error, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS attempts FROM nation WHERE n_nationkey % 3 = 0",
    "mmr_selected": f"{_MMR} SELECT query_id, CAST(ids[i] AS VARCHAR) AS chunk_id, n AS mmr_rank, CAST(round(gain * 1000000) AS BIGINT) AS mmr_key FROM (SELECT query_id, ids, unnest(chosen) AS i, unnest(gains) AS gain, generate_subscripts(chosen, 1) AS n FROM f)",
    "mmr_dropped": f"{_MMR} SELECT query_id, CAST(ids[i] AS VARCHAR) AS chunk_id, CAST(ids[o] AS VARCHAR) AS duplicate_of FROM (SELECT query_id, ids, unnest(drops) AS i, unnest(dups) AS o FROM f)",
    "plain_chunks": f"""WITH RECURSIVE {_folded(_PLAIN, "CAST(doc_id AS VARCHAR)", 240)}
SELECT doc_id || '#chunk-' || chunk_no AS chunk_id, chunk_no AS position, length(text) AS n_chars, sha256(text) AS text_sha256 FROM chunks""",
    "rerank_fallback": f"""{_FUSED}, rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_key('value')} DESC, {_key('rrf_score')} DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank
  FROM (SELECT *, CASE WHEN query_id % 3 = 0 THEN rrf_score ELSE ((doc_id * 7919 + query_id * 104729) % 1000) / 1000.0::DOUBLE END AS value FROM fus))
SELECT query_id, doc_id, rank, {_key('value')} AS score_key, CASE WHEN query_id % 3 = 0 THEN 'rerank_skipped:reranker_error' ELSE 'external_reranker:stand-in' END AS reason FROM rr WHERE rank <= 12""",
    "vector_expressions": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {_key('list_inner_product(a, b)')} AS dot_key, {_key('list_inner_product(a[1:32], b[1:32])')} AS short_key, {_key('list_cosine_similarity(a, b)')} AS cosine_key,
  {_key('sqrt(list_inner_product(b[1:32], b[1:32]))')} AS norm_key, 0::BIGINT AS none_key FROM p""",
    "scope_keys": f"WITH {_ACC} SELECT doc_id, sha256(array_to_string(list_sort(scopes), chr(31))) AS key_sha256 FROM acc",
    "frontmatter": f"""WITH raw AS (SELECT doc_id AS k, 'p/' || doc_id AS source_path, 'f' || doc_id AS name, CASE doc_id % 3
  WHEN 0 THEN '---' || chr(10) || 'title: first' || chr(10) || 'source : ' || source || ' : x' || chr(10) || 'no colon' || chr(10) || 'doc_id: d' || doc_id || chr(10) || 'title: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text || chr(10)
  WHEN 1 THEN '---' || chr(10) || 'title: open' || chr(10) || text ELSE text END AS raw FROM documents WHERE text IS NOT NULL),
fm AS (SELECT *, regexp_extract(raw, '(?s)\\A---\n(.*?)\n---', 1) AS block FROM raw),
ln AS (SELECT k, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS i FROM fm WHERE block <> ''),
kv AS (SELECT k, trim(split_part(line, ':', 1)) AS key, arg_max(trim(substr(line, strpos(line, ':') + 1)), i) AS value FROM ln WHERE contains(line, ':') GROUP BY 1, 2),
md AS (SELECT k, string_agg(key || '=' || value, '|' ORDER BY key || '=' || value) AS metadata, max(value) FILTER (key = 'doc_id') AS doc_id, max(value) FILTER (key = 'title') AS title FROM kv GROUP BY k)
SELECT coalesce(md.doc_id, name) AS doc_id, coalesce(md.title, name) AS title, source_path, 'internal' AS permission_scope, '' AS effective_to, coalesce(metadata, '') AS metadata,
  sha256(CASE WHEN block <> '' THEN {_strip("regexp_replace(raw, '(?s)\\A---\n.*?\n---', '')")} ELSE raw END) AS body_sha256 FROM fm LEFT JOIN md USING (k)""",
    "payloads": f"""WITH RECURSIVE {_FOLD}, {_ACC} SELECT chunk_id, parent_id, chunks.doc_id, source AS title_path, token_count, CAST(from_day AS BIGINT) AS from_day, CAST(to_day AS BIGINT) AS to_day,
  array_to_string(list_sort(scopes), ',') AS scopes FROM chunks JOIN acc USING (doc_id)""",
    "sentence_points": f"""SELECT q, s, CAST({_points('sentence', 'query', 'terms')} AS BIGINT) AS points
FROM (SELECT q, query, list_distinct({_spread('query')}) AS terms FROM (SELECT * FROM (VALUES {_RULE_ROWS(RULE_QUERIES)}) a(q, query) UNION ALL SELECT 1000 + item_id, text FROM benchmark)), (VALUES {_RULE_ROWS(RULE_SENTENCES)}) b(s, sentence)""",
    "out_of_domain": f"""SELECT query_id, {_ood('query')} AS out_of_domain FROM (SELECT -1 - q AS query_id, query FROM (VALUES {_RULE_ROWS(RULE_QUERIES)}) a(q, query) UNION ALL SELECT item_id, text FROM benchmark)""",
    "sufficiency_rules": f"""SELECT CAST(item_id * 100 + query_id AS BIGINT) AS query_id,
  {_GATED("WHEN best >= 0.12 AND (coverage >= 0.18 OR best >= 0.35) THEN 'pass'")} AS by_score,
  {_GATED("WHEN coverage >= 0.18 THEN 'pass' WHEN n_lexical = 0 THEN 'rrf_only_missing_lexical_signal'")} AS by_rank
FROM (VALUES {_GATE}) g(query_id, query, coverage, n_selected, best, n_lexical, ratio), benchmark""",
    "index_manifest": f"WITH {_NOW} SELECT doc_id, 'p/' || doc_id AS source_path, {_HASH.replace("'1024'", "'64'")} AS content_hash, '{_IDENTITY}' AS embedding_model FROM v2 WHERE text IS NOT NULL",
    "index_chunks": f"WITH RECURSIVE {_INDEXED} SELECT chunk_id, parent_id, c.doc_id, token_count, CAST(len(terms) AS BIGINT) AS n_terms, sha256(text) AS text_sha256 FROM chunks c JOIN ct USING (chunk_id) WHERE c.doc_id % 5 = 0",
    "index_postings": f"WITH RECURSIVE {_INDEXED} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, CAST(sum(length) AS BIGINT) AS lengths FROM cp GROUP BY term",
    "index_vectors": f"""WITH RECURSIVE {_INDEXED}, w AS (SELECT chunk_id, {_HI('term')} % 64 AS idx, sum({_SIGN('term')}) AS raw FROM (SELECT chunk_id, unnest(terms) AS term FROM ct) GROUP BY 1, 2),
z AS (SELECT chunk_id, sqrt(sum(raw * raw)) AS size FROM w GROUP BY 1) SELECT chunk_id, count(*) AS n, CAST(round(sum(raw / size * (idx + 1)) * 1000) AS BIGINT) AS weight_key FROM w JOIN z USING (chunk_id) WHERE raw <> 0 GROUP BY chunk_id""",
    "index_counts": f"WITH RECURSIVE {_INDEXED} SELECT n_rows, {_key('mean_length')} AS mean_length_key, n_rows AS n_chunks FROM stats",
    "index_recall": f"""WITH RECURSIVE {_INDEXED.replace(' df AS ', ' dif AS ').replace(chr(10) + 'df AS ', chr(10) + 'dif AS ')}, {_QT}, post AS (SELECT chunk_id AS doc_id, term, tf, length FROM cp), {_bm25('plain')}
SELECT query_id, doc_id AS chunk_id, rank, {_key('score')} AS score_key FROM lex WHERE rank <= 5""",
    "sync_counts": f"""WITH {_NOW}, live AS (SELECT count(*) AS n FROM v1 WHERE text IS NOT NULL), ch AS (SELECT change FROM df)
SELECT 0::BIGINT AS step, n AS added, 0::BIGINT AS changed, 0::BIGINT AS removed, true AS there FROM live
UNION ALL SELECT 1, count(*) FILTER (change = 'added'), count(*) FILTER (change = 'changed'), count(*) FILTER (change = 'removed'), true FROM ch
UNION ALL SELECT 2, 0, 0, 0, true UNION ALL SELECT 3, 0, 0, 0, false""",
    "sync_access": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'public,partner_support' WHEN doc_id % 5 = 0 THEN 'public' ELSE 'closed' END AS scopes,
  CASE WHEN doc_id % 6 = 0 THEN 20260131 ELSE 99991231 END AS to_day, CASE WHEN doc_id % 10 = 0 THEN 'v2' ELSE 'v1' END AS version, {_strip('text')} <> '' AS told,
  doc_id % 4 = 0 OR doc_id % 6 = 0 OR doc_id % 10 = 0 AS other FROM documents WHERE text IS NOT NULL)
SELECT doc_id, scopes AS chunk_scopes, scopes AS vector_scopes, CAST(to_day AS BIGINT) AS to_day, CAST(to_day AS BIGINT) AS vector_to_day, version, (SELECT count(*) FROM x WHERE other) AS restated, 0::BIGINT AS changed FROM x WHERE told""",
    "mirror_manifest": f"""WITH RECURSIVE {_INDEXED}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT doc_id, {_HASH.replace("'1024'", "'64'")} AS content_hash, coalesce(n, 0) AS n_chunks, coalesce(n, 0) AS n_vectors FROM v2 LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL""",
    "eval_cases": """SELECT 'c' || item_id AS case_id, sha256(text) AS query_sha256, CAST(item_id AS VARCHAR) AS expected_doc_id, 'true' AS must_answer, 'a, "b"' AS expected_terms FROM benchmark""",
    "index_of_a_model": """SELECT 'n' AS embedding_model, 'n2:' || doc_id AS chunk_id, 'm,n,m' AS built FROM documents UNION ALL SELECT 'm', 'm3:' || doc_id, 'm,n,m' FROM documents""",
    "event_log": "SELECT item_id AS query_id, left(sha256(text), 16) AS query_hash, 'ok' AS status, 2::BIGINT AS n, length(text) AS query_chars FROM benchmark",
    "embedder_vectors": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS n_blanks FROM documents",
    "llm_answers": f"""{_ANSWERED}, {_PROMPTS}, j AS (SELECT an.*, reason = 'pass' AS asked, length(prompt) AS n FROM an JOIN ju USING (query_id) JOIN pp USING (query_id))
SELECT query_id, CASE WHEN asked AND n % 3 <> 0 THEN 'llm' ELSE mode END AS mode, sha256(CASE WHEN asked AND n % 3 <> 0 THEN 'told in ' || n || ' [E1]' ELSE answer END) AS answer_sha256,
  CASE WHEN asked AND n % 3 <> 0 THEN 'E1' ELSE citations END AS citations, CAST(CASE WHEN NOT asked THEN 0 WHEN n % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN asked AND n % 3 = 0 THEN 'llm_error' END AS fallback_reason FROM j""",
    "component_status": """SELECT k, component, mode, configured, fell AS fallback_used, reason, error, attempts FROM (VALUES
  ('a', 'embedding', 'hash_fallback', false, false, 'not_configured', '', 0::BIGINT), ('b', 'embedding', 'hash_fallback', true, true, 'embedding_error', 'down', 3), ('c', 'embedding', 'external', true, false, 'configured_model', '', 0),
  ('d', 'reranker', 'skipped', false, false, 'not_configured', '', 0), ('e', 'reranker', 'external', true, false, 'configured_model', '', 0), ('f', 'reranker', 'skipped', true, true, 'reranker_error', 'down', 3),
  ('g', 'vector_store', 'local', false, false, 'not_configured', '', 0), ('h', 'vector_store', 'local', true, true, 'store_error', 'down', 3), ('i', 'vector_store', 'primary', true, false, 'configured_backend', '', 0),
  ('j', 'llm', 'extractive', false, false, 'not_configured', '', 0), ('k', 'llm', 'external', true, false, 'configured_model', '', 0)) t(k, component, mode, configured, fell, reason, error, attempts)""",
    "response_scores": """WITH q AS (SELECT item_id AS query_id, text, length(text) % 5 + 1 AS n FROM benchmark)
SELECT query_id, CAST(n * (n - 1) * 100 / 8 AS BIGINT) AS listed, CAST(coalesce(list_sum(list_transform(list_filter(range(n), lambda i: i % 2 = 1), lambda i: i * 50)), 0) AS BIGINT) AS by_place, 'a' || left(text, n) AS text FROM q""",
}
