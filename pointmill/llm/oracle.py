"""DuckDB SQL for the queries that SQL can express."""

OP6 = r"""
WITH words AS (
  SELECT doc_id, [v FOR v IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF v <> ''] AS w FROM documents
), places AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS words FROM places
), firsts AS (
  SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words
), covered AS (
  SELECT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (words) WHERE first_id < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT place) AS places FROM covered GROUP BY doc_id
)
SELECT words.doc_id,
  CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(places, k)] END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five // {32**k}) % 32 AS INT) + 1, 1)" for k in (3, 2, 1, 0))
OP9 = f"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), fives AS (
  SELECT page_id, i, CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) AS five FROM bodies, range(0, 8) t(i)
), digests AS (
  SELECT page_id, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest FROM fives GROUP BY page_id
), firsts AS (
  SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first_id FROM bodies
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts JOIN digests USING (page_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENSE_PHRASES = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), phrases(p, label) AS (
  VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')
), places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM words, phrases) WHERE w[i : i + len(p) - 1] = p
), found AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM words LEFT JOIN found USING (doc_id)
"""

URL_RULES = f"""
WITH places AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, verdict FROM places LEFT JOIN best USING (page_id)
"""

EDITED_TEXTS = """
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after FROM documents
)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(after, 1, length(t) // 3)) AS edited_sha256 FROM ordered
"""

ORACLE: dict[str, str] = {"op6_substring_dedup": OP6, "op9_warc": OP9, "license_phrases": LICENSE_PHRASES, "url_rules": URL_RULES, "edited_texts": EDITED_TEXTS}
