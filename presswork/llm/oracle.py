"""DuckDB SQL for those registered queries that SQL can express."""

OP9 = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM per),
weighed AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size::DOUBLE * 2 AS cap FROM placed),
ranked AS (SELECT *, cap / weight AS ratio, sum(source_size::DOUBLE) OVER () * 1.5 AS wanted, sum(weight) OVER () AS all_weights FROM weighed),
levels AS (SELECT *, (wanted - coalesce(sum(cap) OVER b, 0)) / (all_weights - coalesce(sum(weight) OVER b, 0)) AS own_level FROM ranked
           WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(own_level, (ratio, place)) AS level FROM levels WHERE own_level <= ratio),
target AS (SELECT l.source, l.source_size, least(l.cap, coalesce(l.weight * f.level, l.cap)) AS target FROM levels l, found f),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM target),
drawn AS (SELECT s.doc_id, s.size, r.*, k, ('0x' || substr(sha256(coalesce(s.doc_id::VARCHAR, '')), 1 + 8 * k, 8))::BIGINT / 4294967296.0 AS u
          FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, range(8) AS d(k)),
sums AS (SELECT source, k::INTEGER AS k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS off
         FROM drawn GROUP BY source, k),
best AS (SELECT source, arg_min(k, (off, k)) AS k FROM sums GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (floor(d.rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (floor(d.rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""

OP5 = """
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, lens WHERE len(w) >= k)),
hit AS (SELECT p.doc_id, p.i, p.k, n.item_id FROM pos p JOIN win n ON p.k = n.k AND p.g = n.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP1 = """
WITH raw AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations),
m AS (SELECT conv_id, turn, speaker, words, count(*) AS n FROM raw GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, speaker, substr(md5(words), 1, 2), words) - 1 AS place FROM m),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
said AS (SELECT p.*, (p.place // 1024)::BIGINT AS part, q.perspective,
                CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
         FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id),
sized AS (SELECT *, head || words || '<|end|>' || chr(10) AS line FROM said),
context AS (SELECT conv_id, '<|system|>' || chr(10) || words || '<|end|>' || chr(10) AS lead
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, words) AS k FROM m WHERE speaker = 'system') WHERE k = 1),
led AS (SELECT s.*, CASE WHEN s.part = 0 THEN '' ELSE coalesce(c.lead, '') END AS lead FROM sized s LEFT JOIN context c ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
spans AS (SELECT *, length(lead) + coalesce(sum(length(line)) OVER (PARTITION BY conv_id, part, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM led)
SELECT conv_id, part, perspective, any_value(lead) || string_agg(line, '' ORDER BY place) AS text,
       flatten(list(CASE WHEN speaker = perspective THEN [(begun + length(head))::BIGINT, (begun + length(line))::BIGINT] ELSE [] END ORDER BY place)) AS mask,
       count(*) AS n_messages, sum(n)::BIGINT AS n_rows
FROM spans GROUP BY conv_id, part, perspective
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS p, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS q, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(p, q) AS a, greatest(p, q) AS b, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || substr(x, 1, a) || '<S>' || substr(x, b + 1) || '<M>' || substr(x, a + 1, b - a)
              ELSE '<S>' || substr(x, b + 1) || '<P>' || substr(x, 1, a) || '<M>' || substr(x, a + 1, b - a) END AS y FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(y) AS output_sha256, sha256(x) AS restored_sha256 FROM o
"""

#: crc32 of a decimal number: a byte at a time, a bit at a time.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
)

OP12 = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn ASC NULLS FIRST, substr(sha256(length(r)::VARCHAR || ':' || r || x), 1, 32)) AS t FROM said GROUP BY conv_id),
drawn AS (SELECT *, {_CRC} % 9 AS h FROM own),
built AS (SELECT d.conv_id, list_concat(coalesce(b.t[1:d.h], []), d.t[d.h + 1:]) AS t FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 5),
deep AS (SELECT conv_id, t, unnest(range(len(t) + 1)) AS depth FROM built),
node AS (SELECT t[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (WHERE len(t) = depth) AS ends FROM deep GROUP BY 1, 2),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.k[n.depth].x) END AS own FROM node n LEFT JOIN kids c ON c.k = n.k),
up AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved AS saved_tokens, sha256(coalesce(array_to_string(v.ends, ','), '')) AS ends_sha256
FROM valued v JOIN up u ON u.k = v.k LEFT JOIN node p ON v.depth > 0 AND p.k = v.k[1:v.depth - 1] AND p.depth = v.depth - 1
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f)
SELECT page_id, url, n AS payload_bytes, h AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

ORACLE_SQL = {"op1_chat_rotation": OP1, "op5_fm_index": OP5, "op9_mix_sources": OP9, "op11_fill_in_middle": OP11, "op12_conversation_trie": OP12, "op13_zip_warc": OP13}
