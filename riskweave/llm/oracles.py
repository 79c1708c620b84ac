"""DuckDB SQL for the operators that SQL can express; written from their contracts, without the library's code."""

from __future__ import annotations

NEIGHBOURS = """
WITH vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x for x in embedding if x <> 0]) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
    UNION ALL SELECT *, NULL FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                                          (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|'))
        + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, own
"""

LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth
    FROM documents),
cut AS (
    SELECT *, string_split_regex(trim(regexp_replace(line, '\S*[0-9]\S*', '<*>', 'g')), '\s+') AS t FROM lines),
keyed AS (
    SELECT doc_id, nth, CASE WHEN len(t) >= 20 THEN 2 ELSE 3 END AS least, unnest(CASE
        WHEN length(trim(line)) = 0 THEN []
        WHEN len(t) < 8 THEN [array_to_string(t, ' ')]
        ELSE [concat_ws(' ', i, len(t), array_to_string(t[1:3 + floor((len(t) - 3) * i / 5)::INT], ' '), chr(10),
            array_to_string(t[4 + floor((len(t) - 3) * (i + 1) / 5)::INT:], ' ')) for i in [0, 1, 2, 3, 4]]
        END) AS template FROM cut
    UNION ALL SELECT doc_id, nth, 2, concat('exact', chr(10), trim(line)) FROM cut
    WHERE len(t) >= 8 AND len([x for x in string_split_regex(trim(line), '\s+') if regexp_matches(x, '\pL')]) >= 8),
recurring AS (
    SELECT template, min(doc_id) AS first FROM keyed GROUP BY template HAVING count(DISTINCT doc_id) >= min(least)),
gone AS (SELECT DISTINCT doc_id, nth FROM keyed JOIN recurring USING (template) WHERE doc_id <> first)
SELECT doc_id, count(*) AS n_lines, count(gone.nth) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY lines.nth) FILTER (gone.nth IS NULL), '') AS text
FROM lines LEFT JOIN gone USING (doc_id, nth) GROUP BY doc_id
"""

LEAKS = r"""
WITH texts AS MATERIALIZED (
    SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
    UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark),
asked AS (SELECT DISTINCT least(len(w), 5) AS n FROM texts WHERE side = 1 AND len(w) >= 3 UNION SELECT 5),
words AS (SELECT side, id, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
runs AS MATERIALIZED (
    SELECT side, id, total, i, word AS g1, word || ' ' || lead(word, 1) OVER w AS g2, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS g3,
      word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS g4,
      word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS g5
    FROM words WINDOW w AS (PARTITION BY side, id ORDER BY i)),
grams AS MATERIALIZED (
    SELECT side, id, g5 AS gram FROM runs WHERE g5 IS NOT NULL
    UNION SELECT side, id, CASE total WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 ELSE g4 END FROM runs WHERE total < 5 AND i = 1
    UNION SELECT side, id, g3 FROM runs WHERE side = 0 AND g3 IS NOT NULL AND 3 IN (SELECT n FROM asked)
    UNION SELECT side, id, g4 FROM runs WHERE side = 0 AND g4 IS NOT NULL AND 4 IN (SELECT n FROM asked)),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM (SELECT * FROM grams WHERE side = 1) i JOIN (SELECT * FROM grams WHERE side = 0) d ON d.gram = i.gram JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""

VARIANTS = r"""
WITH RECURSIVE bits AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
told AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END
            for x in string_split(id || ':' || run, '')])),
        lambda c, b: xor(t[(xor(c, b::BIGINT) & 255) + 1], c >> 8))) AS h
    FROM counted, bits),
vocabulary AS MATERIALIZED (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
        sum(n)::BIGINT AS n FROM told GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
places AS MATERIALIZED (
    SELECT word, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
shorter AS (SELECT DISTINCT p.word, v.word AS other FROM places p JOIN vocabulary v ON v.word = p.head || p.tail),
near AS (
    SELECT a.word, b.word AS other FROM places a JOIN places b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT word, other FROM shorter UNION SELECT other, word FROM shorter),
best AS (
    SELECT near.word, count(*) AS n_near, (array_agg(other ORDER BY v.n DESC, other))[1] AS other, max(v.n) AS best_n
    FROM near JOIN vocabulary v ON v.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (
    SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN other END AS form,
        CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
    FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain USING (word) JOIN formed e ON e.word = chain.at AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_int8_neighbours": NEIGHBOURS, "op4_chat_trees": CHATS, "op5_line_templates": LINES,
            "op8_benchmark_containment": LEAKS, "op11_spelling_variants": VARIANTS}
