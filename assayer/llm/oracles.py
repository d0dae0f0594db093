"""DuckDB SQL of those queries that SQL can express."""

#: The smallest node reachable from each of ``nodes(id)`` by ``edges(a, b)``, which holds both directions.
_REACHED = """reached(id, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, e.b FROM reached r JOIN edges e ON r.root = e.a),
roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id)"""

#: Each text with the next one's start in place of its last quarter, cut into pieces, digested and put into a tree.
_FINGERPRINTS = r"""WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS pos, count(*) OVER () AS n FROM documents),
texts AS MATERIALIZED (
  SELECT a.pos, a.doc_id, 'own' AS kind, a.t FROM docs a
  UNION ALL SELECT a.pos, a.doc_id, 'next', b.t FROM docs a JOIN docs b ON b.pos = a.pos % a.n + 1
  UNION ALL SELECT a.pos, a.doc_id, 'edited', left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4)
  FROM docs a JOIN docs b ON b.pos = a.pos % a.n + 1),
cut AS MATERIALIZED (
  SELECT pos, kind, t, regexp_extract_all(t, '(?s).{0,62}?(?:\n|[.,:;!?] )|.{1,64}') AS p FROM texts),
hashed AS (SELECT pos, kind, t, p, list_transform(p, lambda x: {'h': sha256(x), 'e': ends_with(x, chr(10))}) AS h FROM cut),
marked AS MATERIALIZED (
  SELECT pos, kind, t, p, list_transform(h, lambda x: x.h[:8]) AS leaves, list_transform(h, lambda x: {'h': x.h, 'm':
    CASE WHEN NOT x.e AND x.h[1] <> '0' THEN '' WHEN x.h[2] IN ('0', '1', '2', '3') THEN ';' ELSE ',' END}) AS m FROM hashed),
joined AS (
  SELECT *, array_to_string(list_transform(m, lambda x: x.h || x.m), '') AS body,
    array_to_string(list_transform(m, lambda x: x.h[:8] || x.m), '') AS short FROM marked),
trees AS MATERIALIZED (
  SELECT pos, kind, t, p, leaves, sha256(array_to_string(list_transform(
    list_filter(string_split(body, ';'), lambda s: s <> ''), lambda s: sha256(array_to_string(list_transform(
      list_filter(string_split(s, ','), lambda q: q <> ''), lambda q: sha256(q)), ','))), ';')) || ':' || short AS print FROM joined),
counts AS MATERIALIZED (
  SELECT pos, kind, leaf, count(*) AS c FROM (SELECT pos, kind, unnest(leaves) AS leaf FROM trees) GROUP BY ALL),
shared AS (
  SELECT a.pos, b.kind, sum(least(a.c, b.c)) AS c FROM counts a JOIN counts b ON a.pos = b.pos AND a.leaf = b.leaf
  WHERE a.kind = 'own' AND b.kind <> 'own' GROUP BY ALL),
near AS (
  SELECT a.pos, b.kind, CASE WHEN a.print = b.print THEN 1.0::DOUBLE
    ELSE least(2 * coalesce(s.c, 0)::BIGINT / (len(a.p) + len(b.p)), 1 - 1 / (len(a.p) + len(b.p))) END AS likeness
  FROM trees a JOIN trees b ON a.pos = b.pos AND a.kind = 'own' AND b.kind <> 'own' LEFT JOIN shared s ON s.pos = a.pos AND s.kind = b.kind),
places AS (
  SELECT a.pos, a.p, least(len(a.p), len(b.p)) AS most,
    len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.leaves[:i] = b.leaves[:i])) AS lead,
    len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.leaves[-i:] = b.leaves[-i:])) AS tail
  FROM trees a JOIN trees b ON a.pos = b.pos AND a.kind = 'own' AND b.kind = 'edited')
SELECT d.doc_id, length(d.t) AS n_chars, sha256(e.t) AS edited_sha256, o.print AS fingerprint, e.print AS edited_fingerprint,
  ne.likeness AS near_edited, nn.likeness AS near_next,
  length(array_to_string(o.p[:l.lead], '')) AS edit_start,
  length(array_to_string(o.p[:len(o.p) - least(l.tail, l.most - l.lead)], '')) AS edit_end
FROM docs d JOIN trees o ON o.pos = d.pos AND o.kind = 'own' JOIN trees e ON e.pos = d.pos AND e.kind = 'edited'
JOIN near ne ON ne.pos = d.pos AND ne.kind = 'edited' JOIN near nn ON nn.pos = d.pos AND nn.kind = 'next'
JOIN places l ON l.pos = d.pos"""


def _clustered(k: int, rounds: int) -> str:
    """Centroids in whole numbers, each round by two steps of its own: nearest centroid, then means rounded down."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS cluster, x FROM kept
  QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v.row, v.vec_id, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT, 'c': c.cluster}}) AS best
  FROM kept v, c{r} c GROUP BY v.row, v.vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT a.best.c AS cluster, i, count(*)::HUGEINT AS n, sum(v.x[i])::HUGEINT AS s
  FROM a{r} a JOIN kept v ON a.row = v.row, range(1, 65) t(i) GROUP BY a.best.c, i),
m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
  sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.cluster"""


ORACLES: dict[str, str] = {
    "op2_ngram_join": rf"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram
  FROM texts, range(1, greatest(len(words) - 3, 1) + 1) t(i) WHERE len(words) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT DISTINCT a AS id FROM edges),
{_REACHED}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN roots r ON d.doc_id = r.id""",
    "op9_embedding_dedup": f"""WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND a.vec_id < b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 ELSE false END),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT DISTINCT a AS id FROM edges),
{_REACHED},
degrees AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(r.root, e.vec_id) AS component_id, e.vec_id = coalesce(r.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN roots r ON e.vec_id = r.id LEFT JOIN degrees d ON e.vec_id = d.id""",
    "op10_mixing": r"""WITH sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS total, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(total * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
  WINDOW o AS (ORDER BY total * 2.0::DOUBLE / weight, source NULLS LAST)),
targets AS MATERIALIZED (SELECT source, total, least(total * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 16 + ((size * 16) >> length(bin(size))),
    coalesce(((doc_id % 1000003 * 48271) % s.n + s.n) % s.n, 0), size, doc_id NULLS FIRST) AS rank
  FROM sized, (SELECT count(*) // 50000 + 1 AS n FROM documents) s),
rated AS (
  SELECT r.doc_id, r.source, r.size, r.rank, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, least(floor(rate * rank + start) - floor(rate * (rank - 1) + start), 2)::BIGINT AS copies FROM rated)
SELECT doc_id, source, size, total AS source_size, target, copies, copies * size AS taken FROM taken""",
    "op11_fingerprints": _FINGERPRINTS,
    "op13_centroids": _clustered(8, 10),
}
