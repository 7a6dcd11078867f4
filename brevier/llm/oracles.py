"""SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from brevier.llm.licenses import TEMPLATES, template_rows

WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = f"""
WITH docs AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS g,
                   unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
marked AS (SELECT words.doc_id, words.i, w, max(later.i) OVER (PARTITION BY words.doc_id ORDER BY words.i
           ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
           FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH parted AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, rhost, rpath))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM parted LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""

OP5 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {WORDS.format("text")} AS ws,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g,
                   unnest(range(1, len(ws) - 6)) AS i FROM docs WHERE len(ws) >= 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT r, least(8, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8)) AS d FROM twice),
repeats AS (SELECT r, sum(d) AS n_repeat FROM gaps GROUP BY 1),
lines AS (SELECT r, doc_id, host, unnest(lines) AS body FROM docs),
normal AS (SELECT r, doc_id, host, trim(regexp_replace(regexp_replace(lower(body), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
                  len({WORDS.format("body")}) AS n FROM lines),
frequent AS (SELECT host, line FROM normal GROUP BY 1, 2 HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > 20),
removed AS (SELECT r, sum(n) AS n_removed FROM normal JOIN frequent ON frequent.line = normal.line AND frequent.host IS NOT DISTINCT FROM normal.host GROUP BY 1),
stats AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
                 coalesce(n_removed, 0)::BIGINT AS n_removed_words
          FROM docs LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT *, NOT base_failed AND n_removed_words <= 0.5 * n_words AS kept FROM judged
"""

OP7 = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(threshold: float = 0.8) -> str:
    values = ", ".join(f"({quoted(name)}, {k}, {quoted(body)})" for name, k, body in template_rows(TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH known AS (SELECT license_id, template, {words.format("body")} AS ws FROM (VALUES {values}) t(license_id, template, body)),
theirs AS (SELECT license_id, template, len(ws) - 1 AS m, g, count(*) AS c FROM (
             SELECT license_id, template, ws, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM known) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs),
units AS (SELECT r, doc_id, unnest(ls) AS body, unnest(range(len(ls)))::BIGINT AS unit FROM lines
          UNION ALL SELECT r, doc_id, text, -1 FROM docs WHERE contains(text, chr(10))),
split AS (SELECT r, doc_id, unit, {words.format("body")} AS ws FROM units),
sized AS (SELECT * FROM split WHERE len(ws) - 1 BETWEEN 1 AND 200),
ours AS (SELECT r, doc_id, unit, n, g, count(*) AS c FROM (
           SELECT r, doc_id, unit, len(ws) - 1 AS n, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM sized) GROUP BY ALL),
dice AS (SELECT r, doc_id, unit, license_id, template, 2 * sum(least(ours.c, theirs.c))::DOUBLE / (n + m) AS dice
         FROM ours JOIN theirs USING (g) GROUP BY r, doc_id, unit, license_id, template, n, m)
SELECT doc_id, license_id, count(DISTINCT (r, unit)) AS n_units, round(max(dice), 6) AS dice FROM dice WHERE dice >= {threshold} GROUP BY 1, 2
"""

#: The 256 entries of the CRC-32 table, and the CRC-32 of a text's UTF-8 bytes with it.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                 lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1))))"""
CRC_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::UBIGINT)"
CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, " + CRC_BYTES + "), lambda c, b: xor(c >> 8, {1}[((xor(c, b) & 255) + 1)::BIGINT])))"


def merkle_sql() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
    leaf = lambda size: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", size, "text")) + ")"
    above = "sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2"
    step = "sha256(CASE WHEN w.pos % 2 = 0 THEN own || coalesce(s.digest, '') ELSE s.digest || own END), proof || coalesce(s.digest, '')"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS branch, {leaf("n_chars")} AS leaf,
            CASE WHEN {CRC.format("doc_id::VARCHAR", "tab")} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS changed FROM documents, crc),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM leaves),
nodes(branch, lvl, pos, digest, n) AS (
  SELECT branch, 0, pos, leaf, count(*) OVER (PARTITION BY branch) FROM placed
  UNION ALL SELECT branch, lvl + 1, pos // 2, {above} FROM nodes WHERE n > 1 GROUP BY branch, lvl, pos // 2),
tops(lvl, pos, digest, n) AS (
  SELECT 0, row_number() OVER (ORDER BY branch) - 1, digest, count(*) OVER () FROM nodes WHERE n = 1
  UNION ALL SELECT lvl + 1, pos // 2, {above} FROM tops WHERE n > 1 GROUP BY lvl, pos // 2),
walk(r, branch, lvl, pos, own, proof) AS (
  SELECT r, branch, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL SELECT w.r, w.branch, w.lvl + 1, w.pos // 2, {step}
  FROM walk w JOIN nodes m ON m.branch = w.branch AND m.lvl = w.lvl AND m.pos = w.pos AND m.n > 1
       LEFT JOIN nodes s ON s.branch = w.branch AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)),
subroots AS (SELECT branch, digest AS subroot, row_number() OVER (ORDER BY branch) - 1 AS pos FROM nodes WHERE n = 1),
climb(r, lvl, pos, own, proof) AS (
  SELECT r, 0, b.pos, arg_max(own, lvl), arg_max(proof, lvl) FROM walk JOIN subroots b USING (branch) GROUP BY r, b.pos
  UNION ALL SELECT w.r, w.lvl + 1, w.pos // 2, {step}
  FROM climb w JOIN tops m ON m.lvl = w.lvl AND m.pos = w.pos AND m.n > 1 LEFT JOIN tops s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1)),
ended AS (SELECT r, arg_max(own, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM climb GROUP BY r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (branch) JOIN ended USING (r), (SELECT digest AS root FROM tops WHERE n = 1)
"""


OP12 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
marked AS (SELECT *, '<s>[INST] ' || regexp_replace(role, '(\\)|(<)(/?s>)|(\[)(/?INST\])', '\1\2\4\\\3\5', 'g') || ' [/INST] '
                  || regexp_replace(text, '(\\)|(<)(/?s>)|(\[)(/?INST\])', '\1\2\4\\\3\5', 'g') || '</s>' AS piece FROM rows),
joined AS (SELECT conv_id, count(*) AS n_turns, sum(length(piece))::BIGINT AS formatted_chars,
                  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt
           FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM joined
"""


OP13 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
runs AS (SELECT doc_id, w, count(*) AS c FROM (
           SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
         WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, c, {CRC.format("(doc_id || ':' || w)", "tab")} AS h FROM runs, crc),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
gone AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON b.word = a.s
         UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON b.word = a.s),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
judged AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
                        FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM judged
          UNION ALL SELECT chain.word, judged.form, k + 1 FROM chain JOIN judged ON judged.word = chain.root WHERE judged.form IS NOT NULL)
SELECT judged.word, form, arg_max(root, k) AS root, n, n_near, form_n FROM judged JOIN chain USING (word) GROUP BY ALL
"""


ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op2_url_filter": OP2,
    "op5_quality_rules": OP5,
    "op7_warc": OP7,
    "op9_license_scan": license_sql(),
    "op11_merkle_manifest": merkle_sql(),
    "op12_chat_format": OP12,
    "op13_spelling_variants": OP13,
}
