"""SQL twins of the queries, for DuckDB over the same tables."""

#: The words of a text with A-Z in lower case.
LOWER_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
)

NEAR_DEDUP = f"""
WITH RECURSIVE split AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) END) AS s FROM split),
hashed AS (SELECT doc_id, hash(s) AS h FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM hashed a JOIN hashed b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN components USING (doc_id)
"""

#: The measures of the quality rules. A word is repeated if one of the windows it lies in is.
MEASURES = r"""
split AS (SELECT doc_id, lang, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) > 2),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 2]) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS place FROM counted WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
measures AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM split LEFT JOIN repeats USING (doc_id)),
rules AS (SELECT * FROM (VALUES
  ('symbols', [800, 400, 200, 100, 50, 25]), ('dup_lines', [800, 600, 400, 300, 200, 100]),
  ('repeats', [450, 400, 350, 300, 250, 200]), ('long_words', [20000, 15000, 12000, 10000, 9000, 8000]))
  AS t(rule, cutoffs)),
ratios AS (
  SELECT doc_id, lang, base_failed, unnest([
    {'rule': 'symbols', 'a': n_symbols, 'b': word_chars}, {'rule': 'dup_lines', 'a': n_dup_lines, 'b': n_lines},
    {'rule': 'repeats', 'a': n_repeat_words, 'b': n_words},
    {'rule': 'long_words', 'a': word_chars, 'b': n_words}], recursive := true) FROM measures),
tests AS (
  SELECT rule, unnest(cutoffs) AS cutoff, unnest(range(1, 7)) AS step FROM rules),
good AS (SELECT lang, rule, a, b FROM ratios JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
cells AS (
  SELECT lang, rule, cutoff, step, count(*) AS n, count(*) FILTER (WHERE 1000 * a > cutoff * b) AS k
  FROM good JOIN tests USING (rule) GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k < 0.005 * n THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) ELSE 1 END AS p
  FROM cells),
passed AS (
  SELECT lang, rule, cutoff, step, bool_and(p <= 0.05 / (4 * (SELECT count(DISTINCT coalesce(lang, '')) FROM good)))
    OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM tails),
cutoffs AS (SELECT lang, rule, arg_max(cutoff, step) AS cutoff FROM passed WHERE ok GROUP BY lang, rule),
verdicts AS (
  SELECT ratios.doc_id, bool_or(1000 * a > cutoff * b) AS exceeded
  FROM ratios JOIN cutoffs ON ratios.rule = cutoffs.rule AND ratios.lang IS NOT DISTINCT FROM cutoffs.lang
  GROUP BY ratios.doc_id)
"""

QUALITY_RULES = f"""
WITH {MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(exceeded, false) AS kept
FROM measures LEFT JOIN verdicts USING (doc_id)
"""

#: Aliases by normal form and by links; then each URL's own rule, or else a block of its class.
URL_FILTERS = r"""
WITH RECURSIVE links AS (
  SELECT url, unnest([
    CASE WHEN contains(lower(html), 'canonical') THEN regexp_extract(regexp_extract(html,
      '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) END,
    CASE WHEN contains(lower(html), 'refresh') THEN regexp_extract(regexp_extract(html,
      '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END
  ]) AS link FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^:/?#]+)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^:/?#]+)://', 1) || '://'
      || lower(regexp_extract(url, '://([^/?#]*)', 1)) || link END AS target
  FROM links WHERE link <> ''),
linked AS (SELECT * FROM targets WHERE target IS NOT NULL),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT url FROM linked UNION SELECT target FROM linked),
parts AS (
  SELECT url, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*[^?#]*([^#]*)', 1), '^[?]', ''),
      '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM urls),
normal AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(path, '(/index\.html?)?/*$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS node FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT url, arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) AS best
  FROM normal JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY url),
edges AS (
  SELECT x.node AS a, y.node AS b FROM linked JOIN normal x ON x.url = linked.url JOIN normal y ON y.url = target
  WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
classes AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
judged AS (
  SELECT normal.url, best.rule AS rule, best.verdict AS own, coalesce(component, normal.node) AS alias_class
  FROM normal LEFT JOIN fitting USING (url) LEFT JOIN classes ON classes.node = normal.node),
blocked AS (SELECT DISTINCT alias_class FROM judged WHERE own = 'block' AND alias_class IS NOT NULL)
SELECT page_id, lower(coalesce(regexp_extract(pages.url, '://([^/?#]*)', 1), '')) AS host,
  coalesce(regexp_extract(pages.url, '://[^/?#]*([^?#]*)', 1), '') AS path, rule,
  coalesce(own, CASE WHEN blocked.alias_class IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  judged.alias_class AS alias_class
FROM pages LEFT JOIN judged USING (url) LEFT JOIN blocked ON blocked.alias_class = judged.alias_class
"""

#: Base 32 of SHA-1: 40 hex digits are 32 groups of five bits.
ZSTD_WARC = """
WITH read AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT *, sha1(payload) AS hex, octet_length(encode(payload)) AS payload_bytes FROM read),
tops AS (SELECT hex, max(page_id) AS top FROM digests GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ('0b' || substr(array_to_string(list_transform(range(1, 41), lambda j:
      substr('0000000100100011010001010110011110001001101010111100110111101111',
        4 * (instr('0123456789abcdef', substr(hex, j, 1)) - 1) + 1, 4)), ''), 5 * i + 1, 5))::INTEGER, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, NULL::VARCHAR AS error
FROM digests JOIN tops USING (hex)
"""

#: The given pages mark their article, which has headings, paragraphs, bold text and line breaks only.
HTML_EXTRACTION = r"""
WITH articles AS (
  SELECT page_id, url, regexp_split_to_array(replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(?:p|h1)>') AS blocks FROM pages),
decoded AS (
  SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(replace(replace(replace(
    regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS blocks
  FROM articles),
joined AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

#: Bigrams that occur once back off to their last word.
LM_SCORING = f"""
WITH split AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
tokens AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prior
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split)),
one AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
two AS (SELECT prior, word, count(*) AS n FROM tokens WHERE prior IS NOT NULL GROUP BY ALL),
scores AS (
  SELECT tokens.doc_id, CASE WHEN two.n >= 2 THEN ln(two.n / context.n)
    ELSE ln(one.n / (SELECT count(*) FROM tokens)) + CASE WHEN tokens.prior IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM tokens JOIN one ON one.word = tokens.word LEFT JOIN one AS context ON context.word = tokens.prior
    LEFT JOIN two ON two.prior = tokens.prior AND two.word = tokens.word),
sums AS (SELECT doc_id, sum(s) AS s FROM scores GROUP BY doc_id)
SELECT doc_id, len(w) AS n_tokens, round(coalesce(s, 0), 3) AS log_score FROM split LEFT JOIN sums USING (doc_id)
"""

#: Shortest edits row by row: per conversation and last initial the least (cost, audit), then up to two insertions.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(0, 8), lambda d, i:
        CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END, xor(c, b)), 4294967295::BIGINT),
      4294967295::BIGINT) % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
enter(prior, initial, role) AS (VALUES ('', 's', NULL), ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
edits AS (
  SELECT conv_id, i, prior, prior AS last, {'cost': 4, 'audit': 'D', 'lines': []::VARCHAR[]} AS edit
  FROM faulty, (VALUES (''), ('s'), ('u'), ('a')) AS t(prior)
  UNION ALL
  SELECT conv_id, i, prior, enter.initial, {'cost': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'audit': 'K', 'lines': [faulty.role || ':' || text]}
  FROM faulty JOIN enter USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, prior, enter.initial, {'cost': CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'audit': 'R', 'lines': [enter.role || ':' || text]}
  FROM faulty, enter WHERE enter.role IS NOT NULL AND fault NOT IN ('blank', 'duplicate')),
inserts AS (
  SELECT '' AS prior, '' AS last, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS edit
  UNION ALL SELECT unnest(['s', 'u', 'a']), unnest(['s', 'u', 'a']), {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}
  UNION ALL SELECT prior, initial, {'cost': 3, 'audit': 'I', 'lines': [role || ':']} FROM enter WHERE role IS NOT NULL
  UNION ALL SELECT x.prior, y.initial, {'cost': 6, 'audit': 'II', 'lines': [x.role || ':', y.role || ':']}
    FROM enter x JOIN enter y ON y.prior = x.initial WHERE x.role IS NOT NULL),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, last, edit AS best FROM counts, inserts WHERE prior = ''
  UNION ALL
  SELECT walk.conv_id, walk.i + 1, inserts.last, min({'cost': best.cost + edits.edit.cost + inserts.edit.cost,
    'audit': best.audit || edits.edit.audit || inserts.edit.audit,
    'lines': list_concat(best.lines, list_concat(edits.edit.lines, inserts.edit.lines))})
  FROM walk JOIN edits ON edits.conv_id = walk.conv_id AND edits.i = walk.i + 1 AND edits.prior = walk.last
    JOIN inserts ON inserts.prior = edits.last GROUP BY walk.conv_id, walk.i, inserts.last),
ends AS (
  SELECT walk.conv_id, min(best) AS best FROM walk JOIN counts ON counts.conv_id = walk.conv_id AND walk.i = n
  WHERE last IN ('', 'a') GROUP BY walk.conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id)
"""

#: Shares and prices in exact 128-bit integers, every kept term for every group.
SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
held AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY lang, source),
shares AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(held.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(held.n, 0) + 1) // (coalesce(totals.total, 0) + v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 1) // (sizes.total + v) AS q
  FROM groups JOIN kept ON kept.lang = groups.lang JOIN sizes ON sizes.lang = groups.lang
    LEFT JOIN totals ON totals.lang = groups.lang AND totals.source = groups.source
    LEFT JOIN held ON held.lang = groups.lang AND held.source = groups.source AND held.term = kept.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM groups x JOIN groups y ON y.lang = x.lang AND y.source <> x.source
    LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE = {
    "op1_url_filters": URL_FILTERS,
    "op2_lm_scoring": LM_SCORING,
    "op4_zstd_warc": ZSTD_WARC,
    "op7_html_extraction": HTML_EXTRACTION,
    "op8_quality_rules": QUALITY_RULES,
    "op10_near_dedup": NEAR_DEDUP,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_source_divergence": SOURCE_DIVERGENCE,
}
