"""DuckDB SQL for the queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"
#: The words of a text, null texts without any.
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

OP5 = rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""

OP7 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM v) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP9 = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = vec_id AS kept FROM e JOIN r ON r.a = vec_id GROUP BY vec_id"""

#: Variants are told apart by their words, replaced ones by the place too.
OP10 = rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(lower(x), '{_SPACE}', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
j AS (SELECT *, string_split(t, ' ') AS w FROM l WHERE len(string_split(t, ' ')) >= 3),
o AS (SELECT DISTINCT t, w, first_value((doc_id, line_no)) OVER (PARTITION BY t ORDER BY doc_id, line_no) AS p FROM j),
v AS (SELECT t, p, 'r' || i || ':' || array_to_string(list_concat(w[: i - 1], w[i + 1 :]), ' ') AS g, array_to_string(list_concat(w[: i - 1], w[i + 1 :]), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM o WHERE len(w) >= 8)),
near AS (SELECT DISTINCT a.t, b.p FROM v a JOIN v b ON a.g = b.g AND a.t <> b.t UNION SELECT DISTINCT a.t, b.p FROM v a JOIN o b ON a.s = b.t AND len(b.w) >= 8 UNION SELECT DISTINCT b.t, a.p FROM v a JOIN o b ON a.s = b.t AND len(b.w) >= 8),
best AS (SELECT t, min(p) AS q FROM near GROUP BY t)
SELECT j.doc_id, j.line_no::INTEGER AS line_no, (CASE WHEN q < p THEN q ELSE p END)[1] AS of_doc_id, (CASE WHEN q < p THEN q ELSE p END)[2]::INTEGER AS of_line_no, (coalesce(q < p, false))::INTEGER AS edits
FROM j JOIN o USING (t) LEFT JOIN best USING (t) WHERE (CASE WHEN q < p THEN q ELSE p END) < (j.doc_id, j.line_no)"""

_FEATURES = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: CRC-32 as a fold over the bytes of each different word, by a table made from its polynomial.
OP12 = rf"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT doc_id, {_FEATURES} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS x FROM d),
b AS (SELECT unnest({_FEATURES}) AS x FROM benchmark),
h AS (SELECT x, xor(list_reduce(list_transform(range(len(hex(x)) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', hex(x)[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(x)[2 * i + 2]) - 1)::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM (SELECT x FROM f UNION SELECT x FROM b), crc),
s AS (SELECT k, count(*) AS n FROM f JOIN h USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN h USING (x) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
v AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN h USING (x) JOIN g USING (k) GROUP BY doc_id),
r AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN v USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT r.*, o.rank FROM r LEFT JOIN (SELECT * FROM o WHERE rank <= (SELECT 10 * count(*) // 100 FROM o)) o USING (doc_id)"""


def _centroids(rounds: int) -> str:
    """The rounds one after the other: a* puts vectors to centroids c*, which moves those."""
    steps = ["k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)"]
    steps.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM k ORDER BY h LIMIT 8))")
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min((d, j)) AS best FROM (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{i}) GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT best[2] AS j, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT j, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY j UNION ALL SELECT j, c FROM c{i} WHERE j NOT IN (SELECT j FROM s{i}))")
    return f"WITH {', '.join(steps)} SELECT vec_id, j::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best[2] = j"


OP13 = _centroids(10)

ORACLES = {
    "op3_parity_sketch_join": OP3,
    "op5_extendible_hash_dedup": OP5,
    "op7_fixed_block_anchors": OP7,
    "op9_pivot_permutation": OP9,
    "op10_line_neighbourhood": OP10,
    "op12_csr_importance": OP12,
    "op13_exact_centroids": OP13,
}
