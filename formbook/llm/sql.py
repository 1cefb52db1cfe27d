"""Equivalent DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from formbook.llm.licenses import postings_values

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_WARC = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)),
           'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

OP2_EXACT_DEDUP = f"""
WITH rows AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM rows JOIN groups USING (text_sha256)
"""

#: Targets by the other road: sources in order of size per unit of weight, the smallest stop first.
OP3_MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM sources),
ordered AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS held,
         (sum(source_size) OVER ())::BIGINT AS total,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS free
  FROM ranked
  WINDOW before AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(total - held, source_size / weight::DOUBLE) AS words, arg_min(free, source_size / weight::DOUBLE) AS free,
         min(source_size / weight::DOUBLE) AS from_ratio
  FROM ordered WHERE ((total - held) * weight)::DOUBLE / free <= 3 * source_size),
planned AS (
  SELECT source, source_size,
         CASE WHEN source_size / weight::DOUBLE < from_ratio OR (words * weight)::DOUBLE / level.free > 3 * source_size
              THEN (3 * source_size)::DOUBLE ELSE (words * weight)::DOUBLE / level.free END AS target
  FROM ordered, level),
running AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, floor(p.target / nullif(p.source_size, 0))::BIGINT AS whole,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h) AS upto,
         sum(r.size) OVER (PARTITION BY r.source, r.h) AS tied
  FROM rows r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source),
budgets AS (SELECT *, target - whole * source_size AS budget FROM running)
SELECT doc_id, size, source_size, target,
       (coalesce(whole, 0) * size + CASE WHEN upto < budget
         OR (upto - tied < budget AND 2 * (budget - (upto - tied)) > tied) THEN size ELSE 0 END)::BIGINT AS taken
FROM budgets
"""

#: Every place of every document against every template; no index.
OP8_LICENSES = rf"""
WITH postings(template, label, is_base, nth, word, is_key) AS ({postings_values()}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
hits AS (SELECT r, pos - 1 AS pos, words[pos] AS word FROM texts, unnest(range(1, len(words) + 1)) AS u(pos)),
seen AS (SELECT word, count(DISTINCT r) AS df FROM hits GROUP BY word),
weights AS (
  SELECT p.*, ln(1 + (SELECT count(*) FROM texts) / greatest(coalesce(df, 1), 1)::DOUBLE) AS idf
  FROM postings p LEFT JOIN seen USING (word)),
totals AS (SELECT template, sum(idf) AS weight, count(*) FILTER (WHERE is_key) AS keys FROM weights GROUP BY template),
placed AS (
  SELECT r, template, label, is_base, pos - nth AS place, sum(idf) AS there, count(*) FILTER (WHERE is_key) AS keys_there
  FROM hits JOIN weights USING (word) GROUP BY ALL),
found AS (
  SELECT p.*, there / weight AS share FROM placed p JOIN totals t USING (template) WHERE keys_there = keys),
folded AS (
  SELECT r, count(*) FILTER (WHERE is_base) AS n_base, min(place) FILTER (WHERE is_base) AS first_word,
         max(place) FILTER (WHERE is_base) AS last_word,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE is_base)), ','), '') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, round(max(share), 6) AS score
  FROM found GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN folded USING (r)
"""


#: Prefixes spelled out as lists; every node hands its values to all its prefixes. CRC-32 bit by bit.
OP12_PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(said ORDER BY nth) AS ts,
         xor(list_reduce(list_transform(range(8 * length(conv_id::VARCHAR)),
               lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0::BIGINT END),
             lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, o.h), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, depth, list_slice(ts, 1, depth) AS p, depth = len(ts) AS last FROM rebuilt, unnest(range(len(ts) + 1)) AS u(depth)),
nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, p),
children AS (SELECT depth - 1 AS depth, list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(n.p[-1].text), 0) AS saved
  FROM nodes n LEFT JOIN children USING (depth, p)),
totals AS (
  SELECT d AS depth, list_slice(p, 1, d) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM valued, unnest(range(depth + 1)) AS u(d) GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, t.n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals t USING (depth, p) LEFT JOIN nodes m ON m.depth = v.depth - 1 AND m.p = list_slice(v.p, 1, v.depth - 1)
"""

#: Every document's terms as rows, joined with every item's.
OP13_RANKED_SEARCH = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
corpus AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS length FROM texts WHERE len(words) > 0),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM texts) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, corpus GROUP BY term),
measured AS (SELECT r, doc_id, 50 + (50 * len(words)::BIGINT * docs) // length AS m FROM texts, corpus),
scored AS (
  SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN measured USING (r)
  GROUP BY i, item_id, doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""


def statements() -> dict[str, str]:
    return {name.lower(): text for name, text in globals().items() if name.startswith("OP") and name[2].isdigit()}
