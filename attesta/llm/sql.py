"""The queries that SQL can express, for DuckDB. All values are spelled out once more here."""

from __future__ import annotations

_STOP = (
    "'a','and','as','at','be','by','for','from','in','is','it','of','on','that','the','this','to','was',"
    "'with','au','avec','dans','des','du','en','est','et','la','le','les','par','pour','que','qui','sur',"
    "'un','une','auf','das','dem','den','der','die','ein','eine','ist','mit','nicht','und','von','zu',"
    "'con','de','del','el','los','no','para','por','se','su','y'"
)

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), word AS (
  SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
), win AS (
  SELECT rid, i, lead(w, 4) OVER o AS last, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o,
    lead(w, 3) OVER o, lead(w, 4) OVER o) AS win
  FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM win WHERE last IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid
), base AS (
  SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters,
    len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop,
    len(list_filter(lines, lambda l: regexp_matches(rtrim(l), '(\.\.\.|…)$'))) AS n_ellipsis
  FROM split LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_words >= 10 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 12.0)
        THEN 'mean_word_length' END,
      CASE WHEN n_words >= 10 AND n_symbols / n_words > 0.25 THEN 'symbols_per_word' END,
      CASE WHEN n_words >= 20 AND n_letters / word_chars < 0.5 THEN 'letters' END,
      CASE WHEN n_words >= 50 AND n_stop / n_words < 0.01 THEN 'stop_words' END,
      CASE WHEN n_words >= 10 AND n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END,
      CASE WHEN n_words >= 10 AND n_ellipsis / n_lines > 0.5 THEN 'ellipsis_lines' END
    ) AS broken
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken = '' AS kept, broken
FROM judged
"""

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
  FROM (SELECT unnest([0, 1]) AS n)
), sized AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS head
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
    sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1) AS n
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(trained) AS loss_chars,
  sha256(trained) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM joined
"""

# The pages of the test tables have one article element each; its blocks are paragraphs and headings.
PAGES = r"""
WITH cut AS (
  SELECT page_id, url, string_split_regex(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS pieces
  FROM pages
), plain AS (
  SELECT page_id, url, list_filter(list_transform(pieces, lambda b: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(b, '<br>|</?b>', ' ', 'g'), '&quot;?', '"', 'g'),
      '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks
  FROM cut
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text,
  CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars,
  CAST(len(blocks) AS BIGINT) AS n_blocks
FROM plain
"""

# The rest of a CRC-32 by its bits: 3988292384 is its polynomial, reversed.
TRIE = r"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)) AS bytes
  FROM placed GROUP BY conv_id
), hashed AS (
  SELECT conv_id, n, base, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, list_reduce(
    [0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c & 255, b))),
    CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM counted
), plan AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken,
    least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length
  FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.base
), turns AS (
  SELECT conv_id, p - h + taken AS d, role, text, length FROM placed JOIN plan USING (conv_id) WHERE p > h
  UNION ALL
  SELECT c.conv_id, t.p, t.role, t.text, c.length
  FROM plan c JOIN placed t ON t.conv_id = c.base AND t.p <= c.taken
), path AS (
  SELECT conv_id, d, length, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY d) AS k
  FROM turns
  UNION ALL
  SELECT conv_id, 0, length, 0, '' FROM plan
), above AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM path
), node AS (
  SELECT k, d AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = length) AS ends
  FROM above GROUP BY k, d
), child AS (
  SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children, CAST(child.n IS NULL AS BIGINT) AS leaf,
    (n_convs - 1) * words AS saved
  FROM node LEFT JOIN child USING (k, depth)
), total AS (
  SELECT path.k, path.d AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved
  FROM own JOIN path ON path.conv_id = own.conv_id AND path.d <= own.depth GROUP BY ALL
)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children,
  CAST(total.n_leaves AS BIGINT) AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN total USING (k, depth) LEFT JOIN node up ON up.k = own.up AND up.depth = own.depth - 1
"""

ORACLE_SQL = {
    "op3_quality_rules": QUALITY,
    "op8_chat_format": CHATS,
    "op12_html_extract": PAGES,
    "op13_prefix_trie": TRIE,
}
