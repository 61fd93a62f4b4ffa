"""The queries of this subpackage that SQL can express, for DuckDB."""

from __future__ import annotations

from .decontaminate import FEW, LEAST, NAME, NO_NAME, NUMBER, SAYS, UNIT, WINDOW
from .hnsw import THRESHOLD
from .line_dedup import MIN_CHARS
from .minhash_mih import PERCENT
from .substring_dedup import WINDOW as WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length('### ' || role || ': ' || regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10)) AS chars FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

#: Every vector with every other; components by reachability.
VECTORS = f"""
WITH RECURSIVE good AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), degree AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN degree d USING (vec_id)"""

#: Shared shingles of all pairs; components by reachability.
NEAR = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""

#: All variants of all lines; documents are told apart by doc_id here.
LINES = rf"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
), lines AS (SELECT *, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS norm, doc_id * 1000000 + k AS place FROM raw
), distinct_lines AS (SELECT norm, min(place) AS place FROM lines WHERE length(norm) >= 1 GROUP BY norm
), long_lines AS (SELECT * FROM distinct_lines WHERE length(norm) >= {MIN_CHARS}
), less AS (
    SELECT norm, place, i, left(norm, i - 1) || substr(norm, i + 1) AS v FROM (SELECT norm, place, CAST(unnest(range(1, length(norm) + 1)) AS INT) AS i FROM long_lines)
), hashed AS (SELECT hash(v) AS v, i, hash(norm) AS norm, place FROM less
), swaps AS (SELECT h.norm, h.place, g.best FROM hashed h JOIN (SELECT v, i, min(place) AS best FROM hashed GROUP BY v, i HAVING count(*) > 1) g ON h.v = g.v AND h.i = g.i
), inserts AS (SELECT h.norm, h.place, hash(d.norm) AS other, d.place AS other_place FROM hashed h JOIN long_lines d ON h.v = hash(d.norm)
), near AS (
    SELECT norm FROM (SELECT norm, place, best FROM swaps UNION ALL SELECT norm, place, other_place FROM inserts UNION ALL SELECT other, other_place, place FROM inserts) GROUP BY norm, place HAVING min(best) < place
), marked AS (
    SELECT l.*, n.norm IS NOT NULL AS near, d.place IS NOT NULL AND d.place <> l.place AND n.norm IS NULL AS again
    FROM lines l LEFT JOIN distinct_lines d ON l.norm = d.norm LEFT JOIN near n ON hash(d.norm) = n.norm
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.k) FILTER (WHERE NOT m.near AND NOT m.again), '') END AS text,
    count(m.k) AS n_lines, count(*) FILTER (WHERE m.again) AS n_exact, count(*) FILTER (WHERE m.near) AS n_near
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text"""

_SOLID = r"[^\x20\x09-\x0D]+"
_BARE = r"lower(regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"
_MARK = rf"""list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '{NUMBER}') THEN '<num>' WHEN regexp_full_match(x, '{UNIT}') THEN '<unit>'
        WHEN regexp_full_match(x, '{NAME}') AND NOT regexp_full_match(x, '{NO_NAME}') THEN '<name>' ELSE lower(x) END)"""

TEMPLATES = rf"""
WITH docs AS (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS low, {_MARK} AS t FROM (SELECT doc_id, regexp_extract_all(text, '{_SOLID}') AS w FROM documents WHERE text IS NOT NULL)
), items AS (
    SELECT item_id, w, list_transform(w, lambda x: lower(x)) AS low, {_MARK} AS t, CASE WHEN len(w) < {LEAST} THEN len(w) ELSE least(len(w), {WINDOW}) END AS size
    FROM (SELECT item_id, regexp_extract_all(text, '{_SOLID}') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), item_spans AS (SELECT item_id, size, t, low, unnest(range(1, len(t) - size + 2)) AS item_at FROM items
), windows AS (
    SELECT item_id, size, item_at, form, array_to_string(CASE WHEN form = 0 THEN t[item_at:item_at + size - 1] ELSE low[item_at:item_at + size - 1] END, ' ') AS x, count(*) OVER (PARTITION BY item_id) AS item_windows
    FROM (SELECT *, CASE WHEN len(t) < {FEW} THEN 2 WHEN len(t) < {LEAST} THEN 1 WHEN CASE WHEN size < {WINDOW} THEN 2 * literal >= size ELSE literal >= {SAYS} END THEN 0 ELSE 1 END AS form
        FROM (SELECT *, len(list_filter(t[item_at:item_at + size - 1], lambda y: y NOT IN ('<num>', '<unit>', '<name>'))) AS literal FROM item_spans))
), doc_spans AS (SELECT doc_id, s.size, s.form, t, low, unnest(range(1, len(t) - s.size + 2)) AS k FROM docs CROSS JOIN (SELECT DISTINCT size, form FROM windows) s WHERE s.form < 2 OR len(t) = s.size
), hits AS (
    SELECT d.doc_id, w.item_id, w.size, w.item_windows, w.item_at, d.k - w.item_at AS shift
    FROM (SELECT doc_id, size, form, k, array_to_string(CASE WHEN form = 0 THEN t[k:k + size - 1] ELSE low[k:k + size - 1] END, ' ') AS x FROM doc_spans) d JOIN windows w ON d.x = w.x AND d.size = w.size AND d.form = w.form
), spots AS (SELECT DISTINCT doc_id, item_id, shift, unnest(range(item_at, item_at + size)) AS p FROM hits
), slots AS (
    SELECT s.doc_id, s.item_id, s.shift, s.p, d.t[s.p + s.shift] AS kind, {_BARE.format("i.w[s.p]")} AS item, {_BARE.format("d.w[s.p + s.shift]")} AS doc
    FROM spots s JOIN docs d USING (doc_id) JOIN items i USING (item_id) WHERE d.t[s.p + s.shift] IN ('<num>', '<unit>', '<name>')
), steady AS (
    SELECT h.doc_id, h.item_id, h.shift, h.item_at, any_value(h.size) AS size, any_value(h.item_windows) AS item_windows FROM hits h
    LEFT JOIN slots s ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.shift = s.shift AND s.p BETWEEN h.item_at AND h.item_at + h.size - 1
    GROUP BY h.doc_id, h.item_id, h.shift, h.item_at HAVING count(DISTINCT (kind, item)) FILTER (s.p IS NOT NULL) = count(DISTINCT (kind, item, doc)) FILTER (s.p IS NOT NULL)
), shifts AS (
    SELECT h.doc_id, h.item_id, h.shift, count(DISTINCT (kind, item, doc)) FILTER (item <> doc) AS changed FROM steady h
    LEFT JOIN slots s ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.shift = s.shift AND s.p BETWEEN h.item_at AND h.item_at + h.size - 1 GROUP BY ALL
)
SELECT doc_id, item_id, CAST(any_value(item_windows) AS BIGINT) AS item_windows, CAST(count(DISTINCT item_at) AS BIGINT) AS covered_windows, CAST(min(changed) AS BIGINT) AS changed_slots
FROM steady JOIN shifts USING (doc_id, item_id, shift) GROUP BY doc_id, item_id HAVING 2 * count(DISTINCT item_at) >= any_value(item_windows)"""

#: Each window by its words; the first of equal ones stays.
PASSAGES = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM docs
), spans AS (
    SELECT doc_id, j, n, word, concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER d" for i in range(1, WORDS))}) AS x FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY j)
), windows AS (
    SELECT doc_id, j, word, j + {WORDS - 1} <= n AND rank() OVER (PARTITION BY x, j + {WORDS - 1} <= n ORDER BY doc_id, j) > 1 AS again FROM spans
), marked AS (
    SELECT doc_id, j, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM windows
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

#: CRC-32 is linear: the exclusive or of a value for each byte and its distance from the end, and of one for the length.
DRAWN = rf"""
WITH RECURSIVE byte AS (SELECT range AS b, range AS v, 0 AS k FROM range(256)
), step8 AS (
    SELECT b, v, k FROM byte
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step8 WHERE k < 8
), base AS MATERIALIZED (SELECT b, v FROM step8 WHERE k = 8
), texts AS (
    SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), split AS (
    SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS MATERIALIZED (
    SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM split
), names AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, strlen(f) AS size FROM (SELECT DISTINCT f FROM grams)
), far AS (
    SELECT b, v, 0 AS k FROM base
    UNION ALL SELECT far.b, xor(far.v >> 8, base.v), far.k + 1 FROM far JOIN base ON base.b = far.v & 255 WHERE far.k < (SELECT max(size) FROM names)
), start AS (
    SELECT 4294967295 AS v, 0 AS k
    UNION ALL SELECT xor(start.v >> 8, base.v), start.k + 1 FROM start JOIN base ON base.b = start.v & 255 WHERE start.k < (SELECT max(size) FROM names)
), codes AS (
    SELECT f, h, size, unnest(range(size)) AS i FROM names
), summed AS (
    SELECT codes.f, any_value(codes.size) AS size, bit_xor(far.v) AS x FROM codes JOIN far ON far.b = CAST('0x' || substr(codes.h, 2 * codes.i + 1, 2) AS BIGINT) AND far.k = codes.size - 1 - codes.i GROUP BY codes.f
), hashed AS MATERIALIZED (
    SELECT f, xor(xor(summed.x, start.v), 4294967295) % 10000 AS bucket FROM summed JOIN start ON start.k = summed.size
), found AS MATERIALIZED (SELECT r, side, bucket, count(*) AS n FROM grams JOIN hashed USING (f) GROUP BY ALL
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM found GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM totals) AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM totals) AS DOUBLE) + 10000)))) AS gain FROM totals
), weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM found JOIN gains USING (bucket) WHERE side = 's' GROUP BY r
), scores AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM split LEFT JOIN weights USING (r) WHERE side = 's'
), noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scores
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT noisy.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN CAST(place AS BIGINT) END AS rank
FROM noisy LEFT JOIN ranked ON noisy.doc_id = ranked.doc_id"""

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": TEMPLATES, "op7_hnsw": VECTORS, "op8_line_dedup": LINES, "op9_minhash_mih": NEAR, "op10_chat_format": CHAT, "op11_substring_dedup": PASSAGES, "op13_resampling": DRAWN}
