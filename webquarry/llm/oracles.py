"""SQL twins for the checking engine of those queries whose results SQL can express."""

from __future__ import annotations

from webquarry.llm import mixing

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) s FROM w
), n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, r) AS (SELECT x, y FROM both_ways UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, COALESCE(m.r, d.doc_id))::BIGINT AS component_id, COALESCE(m.r, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(r) r FROM reach GROUP BY 1) m USING (doc_id)
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) h, octet_length(encode(COALESCE(text, '')))::BIGINT nb FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, nb - 49)) p FROM d WHERE nb >= 50),
strings AS (SELECT doc_id, p, h[p + 1:p + 50] s FROM places),
least_doc AS (SELECT s, min(doc_id) m FROM strings GROUP BY 1),
held AS (SELECT strings.doc_id, p FROM strings JOIN least_doc USING (s) WHERE m < strings.doc_id),
steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END fresh FROM held),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) g FROM steps),
runs AS (SELECT doc_id, min(p) a, max(p) + 50 b FROM islands GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) x, a y FROM runs
  UNION ALL SELECT doc_id, max(b), any_value(nb) FROM runs JOIN d USING (doc_id) GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(CASE WHEN y > x THEN hex(h[x + 1:y]) ELSE '' END, '' ORDER BY x) k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT n_removed, count(*) n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, nb AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans, sha256(COALESCE(unhex(k), h)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_STEP = "list_sum(list_transform(list_zip(v.x, t.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _clusters(rounds: int = 5, k: int = 40, dim: int = 64) -> str:
    """Lloyd's rounds one after the other, every vector against every centroid, in whole numbers."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})",
        f"t0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, min(({_STEP}, t.c)) AS m FROM v, t{r} t GROUP BY vec_id, v.x)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, sum(x[i])::BIGINT s, count(*) n FROM (SELECT m[2] c, x, unnest(range(1, {dim + 1})) i FROM a{r}) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) x FROM s{r} GROUP BY c)")
            parts.append(f"t{r + 1} AS MATERIALIZED (SELECT c, COALESCE(m{r}.x, t{r}.x) x FROM t{r} LEFT JOIN m{r} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m[2]::INT AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(t.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t{rounds} t ON t.c = a.m[2]"""


CLUSTERS = _clusters()

#: The checking engine's edit distance counts bytes: each letter from U+00C0 on stands as one byte that is no letter a to z.
_ONE_BYTE = ("".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97))).replace("'", "''"))

#: crc32 byte by byte over a table that is made here from its polynomial; letters are one byte, or two from U+00C0 on.
SPELLING = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) tab FROM range(256) r(b)
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2
), bytes AS (
  SELECT run, k, list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))) b FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, z: xor(c >> 8, tab[(xor(c, z) & 255) + 1])), 4294967295) h FROM bytes, crc
), w AS MATERIALIZED (
  SELECT word, translate(word, '<two>', '<one>') e, sum(k)::BIGINT n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5
), near AS MATERIALIZED (
  SELECT a.word, b.word other, b.n FROM w a JOIN w b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word
    AND (left(a.word, 3) = left(b.word, 3) OR right(a.word, 3) = right(b.word, 3)) WHERE levenshtein(a.e, b.e) = 1
), best AS MATERIALIZED (
  SELECT w.word, w.n, COALESCE(x.n_near, 0)::BIGINT n_near, CASE WHEN x.m[1] <= -5 * w.n THEN x.m[2] END form, CASE WHEN x.m[1] <= -5 * w.n THEN -x.m[1] END form_n
  FROM w LEFT JOIN (SELECT word, count(*) n_near, min((-n, other)) m FROM near GROUP BY 1) x USING (word)
), ends(word, last) AS (SELECT word, word FROM best UNION ALL SELECT e.word, b.form FROM ends e JOIN best b ON b.word = e.last WHERE b.form IS NOT NULL)
SELECT b.word, b.form, e.last AS root, b.n, b.n_near, b.form_n::BIGINT AS form_n
FROM best b JOIN (SELECT e.word, e.last FROM ends e JOIN best l ON l.word = e.last WHERE l.form IS NULL) e ON e.word = b.word
""".replace("\\u00C0-\\u00FF", "\u00C0-\u00FF").replace("<two>", _ONE_BYTE[0]).replace("<one>", _ONE_BYTE[1])

ORACLE = {"op3_minhash_dedup": NEAR_DUPLICATES, "op4_substring_dedup": SUBSTRINGS, "op5_mixing": mixing.SQL, "op11_clusters": CLUSTERS, "op13_spelling": SPELLING}
