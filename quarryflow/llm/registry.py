"""Queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .bpe_lexicon import op6_bpe
from .conversation_repair import op12_conversation_repair
from .exact_dedup import op9_exact_dedup
from .fingerprints import op4_fingerprints
from .mixing import op3_mixing
from .ngram_join import op5_ngram_jaccard
from .spelling import op13_spelling_variants
from .substring_dedup import op2_substring_dedup
from .tag_paths import op1_html_extraction
from .token_rollups import op10_token_rollups
from .token_shards import op11_token_ids
from .toxicity import op8_toxicity
from .warc import op7_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_rollups": op10_token_rollups,
    "op11_token_ids": op11_token_ids,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

# crc32 in SQL: a table of 256 entries by its rule, then a byte at a time
_BITS = "bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc32(s: str) -> str:
    each = f"list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit(letter: str, cost: str, rest: str) -> str:
    """A path's weight as text, six digits of cost and then its letters, with one more edit before it."""
    return f"lpad((substr({rest}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || '{letter}' || substr({rest}, 7)"


def _put(state: str) -> str:
    return _edit("I", "3", state)


_STAY = "(CASE WHEN short THEN 3 ELSE 0 END)"
_WAYS = [
    f"least({_edit('D', '4', f'v{q}')}, CASE WHEN NOT lost THEN {_edit('R', f'3 + {_STAY}', f'v{to}')} END, "
    + ", ".join(f"CASE WHEN NOT lost AND c = '{c}' THEN {_edit('K', _STAY, f'v{v}')} END" for c, v in keeps)
    + f") AS n{q}"
    for q, to, keeps in ((0, 2, [("s", 1), ("u", 2)]), (1, 2, [("u", 2)]), (2, 3, [("a", 3)]), (3, 2, [("u", 2)]))
]
_REPAIR = rf"""
WITH RECURSIVE {_BITS},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT conv_id, turn, r, x, {_crc32("s")} % 20 AS kind FROM k, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text, n AS copy
  FROM h, range(2) z(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') AS open
  FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND open AS short, blank OR again AS lost, substr(role, 1, 1) AS c,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b
  FROM o),
stats AS (
  SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
w AS (
  SELECT conv_id, m AS i, '000000' AS v0, '000006II' AS v1, '000003I' AS v2, '000000' AS v3 FROM stats
  UNION ALL
  SELECT conv_id, i - 1, least(n0, {_put("n2")}, {_put(f"({_put('n3')})")}), least(n1, {_put("n2")}, {_put(f"({_put('n3')})")}), least(n2, {_put("n3")}), least(n3, {_put("n2")})
  FROM (SELECT w.conv_id, w.i, {", ".join(_WAYS)} FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i)),
best AS (SELECT conv_id, substr(v0, 1, 6)::BIGINT AS cost, substr(v0, 7) AS audit FROM w WHERE i = 0),
e AS (SELECT conv_id, p, substr(audit, p, 1) AS a FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
g AS (SELECT conv_id, p, a, sum((a <> 'I')::INT) OVER u AS i, sum((a <> 'D')::INT) OVER u AS j FROM e WINDOW u AS (PARTITION BY conv_id ORDER BY p)),
y AS (
  SELECT g.conv_id, p, a, j, f.role, CASE WHEN a = 'I' THEN '' ELSE f.text END AS text,
    max((j = 1 AND a = 'K' AND f.c = 's')::INT) OVER (PARTITION BY g.conv_id) AS system
  FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i WHERE a <> 'D'),
r AS (
  SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired
  FROM y GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id"""

_VARIANTS = rf"""
WITH RECURSIVE {_BITS},
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT w, count(*) AS n, id || ':' || w AS s FROM d WHERE length(w) >= 7 GROUP BY id, w),
h AS (SELECT w, n, {_crc32("s")} AS h FROM g, bits),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, c.word, c.n FROM words a JOIN cut c ON c.s = a.word
  UNION SELECT c.word, a.word, a.n FROM words a JOIN cut c ON c.s = a.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS k, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS p FROM near),
forms AS (SELECT words.word, n, coalesce(k, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best ON best.word = words.word AND p = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON chain.word = forms.word JOIN forms e ON e.word = chain.root WHERE e.form IS NULL"""

ORACLES = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM bad, range(0, 50) AS t(k)),
words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS s
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, octet_length(encode(h)) >= 1000 AS long,
    max(page_id) OVER (PARTITION BY h) AS m, row_number() OVER (PARTITION BY h, page_id) AS k
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN long AND (m <> page_id OR k > 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN long AND (m <> page_id OR k > 1) THEN m END AS refers_to
FROM q""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n, length(coalesce(text, '')) AS c FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY c DESC, doc_id)""",
    "op12_conversation_repair": _REPAIR,
    "op13_spelling_variants": _VARIANTS,
}
