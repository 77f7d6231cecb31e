"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


JACCARD = f"""
WITH RECURSIVE listed AS (SELECT doc_id, {_words('[^ \\t-\\r]+')} AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM listed WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN size m ON m.doc_id = a.doc_id JOIN size n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 90 * (m.n + n.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY ALL"""

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
item AS (SELECT item_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
phrase AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc CROSS JOIN (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)),
met AS (SELECT doc_id, item, place.n, i FROM place JOIN phrase USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

LEXICAL = f"""
WITH doc AS (
    SELECT doc_id, {_words('[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
posting AS (
    SELECT doc_id, t, count(*) AS tf, any_value(n) AS n
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM doc) GROUP BY doc_id, t),
whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM doc WHERE len(w) > 0),
word AS (
    SELECT t, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
    FROM posting GROUP BY t),
asked AS (
    SELECT item_id, t, count(*) AS times
    FROM (SELECT item_id, unnest({_words('[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')}) AS t FROM benchmark)
    GROUP BY item_id, t),
scored AS (
    SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf)
        // (1000 * tf + 8 * (25 + (75 * n * (SELECT docs FROM whole)) // (SELECT terms FROM whole)))))::BIGINT AS score
    FROM asked JOIN word USING (t) JOIN posting USING (t) GROUP BY item_id, doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

EXACT = r"""
WITH held AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
grouped AS (
    SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size FROM held)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM grouped"""

#: CRC-32 of every feature, byte by byte over a table that is made here
RESAMPLING = f"""
WITH RECURSIVE step AS (
    SELECT i AS id, i::BIGINT AS c, 0 AS n FROM range(256) r(i)
    UNION ALL
    SELECT id, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
crc AS (SELECT list(c ORDER BY id) AS crcs FROM step WHERE n = 8),
listed AS (
    SELECT 0 AS kind, doc_id AS id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents
    UNION ALL SELECT 1, item_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} FROM benchmark),
feature AS (
    SELECT kind, id, array_to_string(w[i : i + k - 1], ' ') AS f
    FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM listed CROSS JOIN range(1, 4) r(k) WHERE len(w) >= k)),
coded AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS x,
                 list_transform(range(1, length(x), 2), lambda p: ('0x' || x[p : p + 1])::BIGINT) AS bytes
          FROM (SELECT DISTINCT f FROM feature)) CROSS JOIN crc),
held AS (SELECT kind, id, bucket FROM feature JOIN coded USING (f)),
counts AS (
    SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM held GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts)::DOUBLE + 10000)
        / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts)::DOUBLE + 10000))))::BIGINT AS gain FROM counts),
weighed AS (
    SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM held JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
    SELECT l.id AS doc_id, len(l.w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features,
           coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || sha256('42:' || l.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM listed l LEFT JOIN weighed USING (id) WHERE l.kind = 0),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place,
           count(*) FILTER (n_words >= 20) OVER () AS enough FROM scored)
SELECT doc_id, n_words, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (5 * enough) // 100 THEN place END AS rank FROM ranked"""

ORACLE: dict[str, str] = {
    "op5_jaccard_join": JACCARD,
    "op7_decontamination": DECONTAMINATION,
    "op11_importance_resampling": RESAMPLING,
    "op12_lexical_search": LEXICAL,
    "op13_exact_dedup": EXACT,
}
