"""DuckDB SQL for the queries that SQL can express on whole tables.

None for 4 (a tokenizer), 5 and 7 (trained models), 6 (bytes cut within characters), 8 (a pseudorandom draw) and 10 (an inferred
grammar): tests hold those against plain versions, exact targets or held-out accuracy.
"""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles(words: str, k: int) -> str:
    """The shingles of a list of words; the whole of fewer than k."""
    many = f"list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i:i + {k - 1}], ' '))"
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {k} THEN ['short ' || array_to_string({words}, ' ')] ELSE {many} END"


def components(nodes: str, edges: str) -> str:
    """reach(a, component_id) from nodes(a) and edges(a, b) in both directions."""
    return f"r(a, b) AS (SELECT a, a FROM {nodes} UNION SELECT r.a, e.b FROM r JOIN {edges} e ON r.b = e.a), reach AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)"


OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({shingles("w", 3)}) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), v AS (SELECT doc_id AS a FROM documents), {components("v", "e")}
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, component_id, (SELECT count(*) FROM e WHERE e.a = reach.a) AS n_links FROM reach LEFT JOIN n ON n.doc_id = a"""

WORDS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
OP2 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({shingles("w", 5)}) AS h FROM d UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: 'short ' || array_to_string(w[i:i + m - 1], ' '))) FROM d, (SELECT DISTINCT len(w) AS m FROM i WHERE len(w) BETWEEN 1 AND 4)), s AS (SELECT DISTINCT item_id, unnest({shingles("w", 5)}) AS h FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_common FROM ds JOIN s USING (h) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles"""

OP3 = rf"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, {LOW.format(r"regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.last IS NOT NULL AND k.last <> doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id AS a, label, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(x, lambda z: z <> 0)) > 0),
e AS (SELECT p.a, q.a AS b FROM f p JOIN f q ON p.label = q.label AND p.a <> q.a WHERE list_cosine_similarity(p.x, q.x) >= 0.93::DOUBLE), {components("v", "e")}
SELECT a AS vec_id, (SELECT count(*) FROM e WHERE e.a = reach.a) AS n_links, component_id, a = component_id AS kept FROM reach"""


OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOW.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE words > 1),
k AS (SELECT lang, phrase, a, 1 AS k, x[1] AS lp, array_to_string(x[2:], ' ') AS rp FROM c UNION ALL SELECT lang, phrase, a, 2, x[1] || ' ' || x[2], x[3] FROM c WHERE words = 3),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.lp JOIN f r ON r.lang = k.lang AND r.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, x[1] || ' ' || x[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM c WHERE words = 3),
h AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000"""


OP12 = rf"""WITH RECURSIVE b AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS x),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT doc_id, {LOW.format("run")} AS run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
y AS (SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] ELSE [192 + (unicode(z) >> 6)::BIGINT, 128 + (unicode(z) & 63)::BIGINT] END)) AS y FROM l),
h AS (SELECT run, c, xor(list_reduce(y, lambda s, z: xor(s >> 8, x[(xor(s, z) & 255) + 1]), 4294967295), 4294967295) AS h FROM y, b),
q AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM q WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS less FROM i),
e AS (SELECT d.word AS a, d.n AS an, w.word AS b, w.n AS bn FROM d JOIN w ON d.less = w.word UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.less = w.word
  UNION ALL SELECT x.word, x.n, z.word, z.n FROM i x JOIN i z ON x.i = z.i AND x.word[:x.i - 1] = z.word[:z.i - 1] AND x.word[x.i + 1:] = z.word[z.i + 1:] AND x.word <> z.word),
f AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS form, max(bn) AS form_n, any_value(an) AS an FROM e GROUP BY a),
g AS (SELECT a, n_near, CASE WHEN form_n >= 10 * an THEN form END AS form, CASE WHEN form_n >= 10 * an THEN form_n END AS form_n FROM f),
t AS (SELECT a AS word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.a = t.root WHERE g.form IS NOT NULL),
o AS (SELECT t.word, arg_max(t.root, w.n) AS root FROM t JOIN w ON w.word = t.root GROUP BY t.word)
SELECT w.word, form, coalesce(o.root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN g ON g.a = w.word LEFT JOIN o ON o.word = w.word"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op2_decontamination": OP2, "op3_line_dedup": OP3, "op9_embedding_near_dedup": OP9, "op11_phrase_collocations": OP11, "op12_spelling_variants": OP12}
