"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)" for i in range(8) for s in (15, 10, 5, 0))

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM component c
"""


def op6(weights: dict, share: float, epochs: int, seed: int) -> str:
    def case(level: str) -> str:
        given = weights.get(level, {})
        whens = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in given.items() if k != "*")
        return f"CASE{whens} ELSE {given.get('*', 1)} END" if whens else str(given.get("*", 1))

    def split(name: str, parents: str, level: str, source: str) -> str:
        part = f"PARTITION BY {parents} " if parents else ""
        return f"""
{name}_w AS (SELECT *, ({case(level)})::HUGEINT AS w FROM ({source})),
{name}_f AS (SELECT *, coalesce(sum(c) OVER ({part}ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
  sum(w) OVER ({part}ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS remaining FROM {name}_w),
{name}_u AS (SELECT *, filled * w + c * remaining <= pb * w AS is_full FROM {name}_f),
{name} AS (SELECT *, CASE WHEN is_full THEN c ELSE ((pb - coalesce(sum(c) FILTER (is_full) OVER ({part.strip()}),
  0))::HUGEINT * w) // (sum(w) FILTER (NOT is_full) OVER ({part.strip()}))::HUGEINT END::BIGINT AS b FROM {name}_u)"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n,
  CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE 'other' END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS t, (sum(n) * {epochs})::HUGEINT AS c FROM d GROUP BY ALL),
{split("l0", "", "domain", f"SELECT domain, sum(c)::HUGEINT AS c, (SELECT least(floor(sum(t) * {share}), sum(t) * {epochs})::HUGEINT FROM leaf) AS pb FROM leaf GROUP BY domain")},
{split("l1", "domain", "lang", "SELECT leaf.domain, lang, sum(leaf.c)::HUGEINT AS c, any_value(l0.b)::HUGEINT AS pb FROM leaf JOIN l0 USING (domain) GROUP BY leaf.domain, lang")},
{split("l2", "domain, lang", "source", "SELECT leaf.domain, leaf.lang, source, leaf.c, leaf.t, l1.b::HUGEINT AS pb FROM leaf JOIN l1 ON leaf.domain = l1.domain AND leaf.lang = l1.lang")},
plan AS (SELECT domain, lang, source, b // t AS whole, b % t AS rest FROM l2 WHERE t > 0),
r AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id), doc_id::VARCHAR,
  n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, whole + (upto <= rest)::BIGINT AS times FROM r)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(0, times))::INTEGER AS epoch FROM taken WHERE times > 0
"""


OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  ELSE [array_to_string(words, ' ')] END) AS g FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8::DOUBLE * (x.n + y.n - m) - 1e-9),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = doc_id)::BIGINT AS n_links FROM class
"""

OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\#<:]')) + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 14 AS chars,
  CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars,
  string_agg(code, '' ORDER BY turn NULLS FIRST, role, text) AS codes
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars, regexp_full_match(codes, 's?(ua)+') AS valid FROM g
"""


OP11 = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    from .queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS

    return {"op3_warc": OP3, "op4_embedding_near_dedup": OP4, "op6_mixing": op6(MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED), "op9_ngram_jaccard_join": OP9, "op10_chat_formatting": OP10, "op11_hard_negatives": OP11}
