"""DuckDB SQL that gives the rows of the operators' queries."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

URLS = r"""
WITH parsed AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT rid, rule_host || rule_path AS rule, verdict FROM parsed, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (rid)
"""

RULES = rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANK}) <> '') AS lines
  FROM documents),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(body) - length(regexp_replace(body, '\p{{Lu}}', '', 'g')) AS n_capitals
  FROM split LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * n_symbols > 40 * n_words
            OR 2 * n_capitals > word_chars OR 100 * n_dup_lines > 30 * (n_dup_lines + n_words / 10)) AS kept
FROM judged
"""

MIX = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(len({WORDS}) AS BIGINT) AS size, source IS NULL AS missing,
         coalesce(source, '') AS name, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place
  FROM documents),
sources AS (
  SELECT missing, name, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY missing, name COLLATE C) - 1 AS source_no
  FROM sized GROUP BY missing, name),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][source_no % 3 + 1]::DOUBLE AS weight, 2 * source_size AS most FROM sources),
ranked AS (
  SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) AS goal,
         coalesce(sum(most) OVER before, 0) AS full_before, sum(weight) OVER onward AS weight_left
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT (goal - full_before) / weight_left AS level FROM ranked
  WHERE (goal - full_before) / weight_left * weight <= most ORDER BY most / weight, source_no LIMIT 1),
targets AS (
  SELECT source_no, missing, name, source_size, greatest(1, ceil(source_size / 262144.0))::BIGINT AS n_shards,
         least(level * weight, most::DOUBLE) AS target
  FROM weighed, level),
source_quota AS (
  SELECT source_no, count(*) AS quota FROM (
    SELECT source_no FROM (SELECT source_no, target, unnest(range(0, floor(target)::BIGINT + 2)) AS k FROM targets)
    QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source_no, k)
            <= (SELECT floor(sum(target) + 0.5) FROM targets))
  GROUP BY source_no),
placed AS (
  SELECT s.*, t.source_no, t.source_size, t.target, ('0x' || substr(place, 1, 8))::BIGINT % n_shards AS shard
  FROM sized s JOIN targets t ON s.missing = t.missing AND s.name = t.name),
shards AS (SELECT source_no, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM placed GROUP BY ALL),
shard_quota AS (
  SELECT source_no, shard, count(*) AS quota FROM (
    SELECT source_no, shard FROM (
      SELECT source_no, shard, shard_size, quota AS seats, unnest(range(0, quota + 1)) AS k
      FROM shards JOIN source_quota USING (source_no))
    WHERE shard_size > 0
    QUALIFY row_number() OVER (PARTITION BY source_no ORDER BY shard_size / (2 * k + 1) DESC, shard, k) <= seats)
  GROUP BY source_no, shard),
laid AS (
  SELECT p.*, shard_size, shard_size // 64 AS n_whole, least(coalesce(quota, 0), 2 * shard_size) AS quota,
         ('0x' || substr(md5('17:' || source_no || ':' || shard), 1, 8))::BIGINT AS shift,
         CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)
              AS BIGINT) - size AS start
  FROM placed p JOIN shards USING (source_no, shard) LEFT JOIN shard_quota USING (source_no, shard)),
blocks AS (
  SELECT *, least(64, greatest(0, quota % shard_size - 64 * CASE WHEN j < n_whole THEN (j * 2147483647 + shift)
                               % greatest(n_whole, 1) ELSE n_whole END)) AS more
  FROM (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS j FROM laid WHERE size > 0)),
taken AS (
  SELECT rid, CAST(sum((least((j + 1) * 64, start + size) - greatest(j * 64, start)) * (quota // shard_size)
                       + greatest(0, least(j * 64 + more, start + size) - greatest(j * 64, start))) AS BIGINT) AS taken
  FROM blocks GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (rid)
"""


_ESCAPED = ("replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), "
            "'</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]')")

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, role AS r, text AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
plain AS (SELECT *, coalesce(r, '') AS role, coalesce(t, '') AS text FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(concat('<s>[INST] ', {_ESCAPED.format('role')}, ' [/INST]', chr(10), {_ESCAPED.format('text')},
                              '</s>', chr(10)))) AS BIGINT) AS formatted_chars
FROM plain GROUP BY conv_id
"""

DIGEST_PARTS = " || ".join(
    "[{0}, {1}, {2}, {3}]".format(*(f"('0x' || substr(hex, {{at}}, 5))::BIGINT // {32 ** k} % 32" for k in (3, 2, 1, 0)))
    .replace("{at}", str(1 + 5 * i)) for i in range(8))

WARC = rf"""
WITH sums AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM sums)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform({DIGEST_PARTS}, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)),
                      'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN first_id END AS refers_to
FROM firsts
"""

VECTORS = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN degrees USING (vec_id)
"""


LEXICAL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
asked AS (
  SELECT iid, item_id, term, count(*) AS times
  FROM (SELECT iid, item_id, unnest(regexp_extract_all(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark))
  GROUP BY iid, item_id, term),
totals AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS lt FROM split WHERE len(ts) > 0),
postings AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM split)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scored AS (
  SELECT iid, item_id, rid, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // lt))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
  GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


def build() -> dict[str, str]:
    return {"op3_url_filter": URLS, "op4_quality_rules": RULES, "op6_chat_format": CHAT, "op7_source_mix": MIX, "op9_warc": WARC,
            "op10_near_vectors": VECTORS, "op11_lexical_search": LEXICAL}
