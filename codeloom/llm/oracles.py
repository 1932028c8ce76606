"""SQL for DuckDB that gives the same rows as the queries of this subpackage, over the whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, word: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{word}')"


#: Integer products stay below 2 ** 53 here, so sums of doubles are exact.
TOPK = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM whole WHERE vec_id % 50 = 0) q JOIN whole c ON c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Byte places count from 1; a window is told by its 100 bytes.
SUFFIXES = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY b[i:i + 99] ORDER BY doc_id, i) AS k FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM texts)
), starts AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM windows WHERE k > 1
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM starts
), spans AS (
  SELECT doc_id, span, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, e AS s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), 1000000000) AS e FROM spans
  UNION ALL SELECT t.doc_id, 1, coalesce(min(x.s), 1000000000) FROM texts t LEFT JOIN spans x ON x.doc_id = t.doc_id GROUP BY t.doc_id
), kept AS (
  SELECT t.doc_id, string_agg(hex(b[g.s:least(g.e - 1, n)]), '' ORDER BY g.s) AS h FROM texts t JOIN gaps g ON g.doc_id = t.doc_id WHERE g.s <= n AND g.s < g.e GROUP BY t.doc_id
)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM texts t LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS runs FROM spans GROUP BY doc_id) r ON r.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

#: Near items: of a window's different terms, all but two among twelve words; items of ten words or more.
DECONTAMINATION = rf"""
WITH dw AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_words("coalesce(text, '')", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents)
), bw AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_words("coalesce(text, '')", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark)
), wins AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, least(n, 10) AS size FROM (SELECT *, unnest(range(1, greatest(n - 8, 2))) AS i FROM bw WHERE n > 0)
), places AS (
  SELECT doc_id, i, unnest([w[i:i + size - 1] for size in (SELECT list(DISTINCT size) FROM wins)]) AS part FROM (SELECT doc_id, w, n, unnest(range(1, n + 1)) AS i FROM dw)
), found AS (
  SELECT p.doc_id, p.i, x.item_id, x.size FROM places p JOIN wins x ON x.win = p.part
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), sets AS (
  SELECT row_number() OVER () AS k, item_id, list_distinct(win) AS s FROM wins WHERE size = 10
), terms AS (
  SELECT k, len(s) AS held, unnest(s) AS term FROM sets
), toks AS (
  SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(w) AS term FROM dw
), stretches AS (
  SELECT doc_id, k, held, count(DISTINCT term) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c FROM toks JOIN terms USING (term)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT doc_id, k FROM stretches WHERE held > 2 AND c >= held - 2) JOIN sets USING (k)
  WHERE (doc_id, item_id) NOT IN (SELECT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, {_words("coalesce(text, '')", "[^\\x20\\x09-\\x0D]+")} AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM dw WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes o ON o.doc_id = y WHERE 100 * c >= 85 * (m.n + o.n - c)
), ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM ways UNION SELECT r.a, w.y FROM reach r JOIN ways w ON w.x = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, c.m), d.doc_id) AS component_id, d.doc_id = coalesce(least(d.doc_id, c.m), d.doc_id) AS kept
FROM dw d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

#: The checksum takes a byte's eight steps as eight elements of a list, the byte itself in the first.
SHARDS = """
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, ''))[1:16] AS h, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents
), summed AS (
  SELECT doc_id, size, h, xor(4294967295, list_reduce(flatten(list_transform(pairs, lambda p: [CAST(concat('0x', p) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295)) AS text_crc32 FROM sized
), placed AS (
  SELECT doc_id, size, text_crc32, h, row_number() OVER o - 1 AS rank, CAST(sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM summed WINDOW o AS (ORDER BY text_crc32, size, h, doc_id)
), spans AS (
  SELECT *, min(start) OVER g AS s, max(start + size) OVER g AS e FROM placed WINDOW g AS (PARTITION BY text_crc32, size, h)
), targets AS (
  SELECT total * i // 8 AS t FROM (SELECT DISTINCT total FROM placed), range(1, 8) r(i)
), crossed AS (
  SELECT t, CASE WHEN e - s > 0.02 * total / 8 THEN start ELSE s END AS s, CASE WHEN e - s > 0.02 * total / 8 THEN start + size ELSE e END AS e FROM targets JOIN spans ON start <= t AND t < start + size
), cuts AS (
  SELECT CASE WHEN t - s <= e - t THEN s ELSE e END AS c FROM crossed
), sharded AS (
  SELECT *, CAST((SELECT count(*) FROM cuts WHERE c <= start) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded
"""

#: Weights by doubles, all else by whole numbers; a window over the documents gives their number and that of all terms.
RANKED = rf"""
WITH dw AS (
  SELECT doc_id, {_words("coalesce(text, '')", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents
), lens AS (
  SELECT row_number() OVER () AS k, doc_id, w, len(w) AS n, count(*) OVER () AS docs, CAST(sum(len(w)) OVER () AS BIGINT) AS terms FROM dw WHERE len(w) > 0
), held AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM lens) GROUP BY k, term
), asked AS (
  SELECT DISTINCT item_id, unnest({_words("coalesce(text, '')", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS v FROM held JOIN lens USING (k) GROUP BY term
), scored AS (
  SELECT item_id, k, CAST(sum(v * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lens USING (k) GROUP BY item_id, k
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored JOIN lens USING (k) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL = {"op13_ranked_search": RANKED, "op1_topk": TOPK, "op5_shards": SHARDS, "op3_suffix_dedup": SUFFIXES, "op8_decontamination": DECONTAMINATION, "op9_minhash": NEAR_DUPLICATES}
