"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from spendlens.llm import rules, urls
from spendlens.llm.queries import URL_RULES

ORACLE: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op1_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM split
), keys AS (
  SELECT doc_id, line, n, {LOWER.format(f"trim(line, {SPACE})")} AS key FROM keyed
), repeated AS (
  SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN repeated r USING (key)
GROUP BY doc_id
"""

WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, len(x) AS size, array_to_string(x, ' ') AS win
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS x
        FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT doc_id, p, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


# --- op2: templates level by level, to any depth ----------------------------------------------


def rule_cases(give: str) -> str:
    cases = []
    for rule, verdict in sorted(URL_RULES, key=lambda r: -len(r[0])):
        host, path = rule.split("/", 1)
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases.append(f"WHEN {fits} THEN '{rule if give == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END AS {give}"


PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
WEIGHT = urls.WEIGHT
ORACLE["op2_url_filters"] = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, {LOWER.format(f"regexp_extract(coalesce(url, ''), {PARTS}, 1)")} AS host,
         regexp_extract(coalesce(url, ''), {PARTS}, 2) AS path FROM pages
), p AS (SELECT *, {rule_cases("rule")}, {rule_cases("said")} FROM parts),
paths AS (
  SELECT host, path, count(*) AS pages, count(*) FILTER (said = 'block') AS blocked, count(said) AS labelled,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM p GROUP BY host, path
),
level AS (
  SELECT host, path, parts, CAST([] AS VARCHAR[]) AS done, pages, 1 AS k FROM paths
  UNION ALL
  SELECT host, path, parts, list_append(done, CASE WHEN many >= {urls.MANY} AND n < {urls.FEW_PAGES} * many THEN '*' ELSE own END), pages, k + 1
  FROM (SELECT *, count(DISTINCT own) FILTER (own <> '*') OVER w AS many, sum(pages) FILTER (own <> '*') OVER w AS n
        FROM (SELECT *, CASE WHEN regexp_matches(parts[k], '{urls.VARIABLE}') THEN '*' ELSE parts[k] END AS own
              FROM level WHERE k <= len(parts))
        WINDOW w AS (PARTITION BY host, done))
),
ends AS (SELECT host, path, done, blocked, labelled,
                list_max(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN done[i] <> '*' THEN i ELSE 0 END)) AS fixed
         FROM level JOIN paths USING (host, path) WHERE k = len(level.parts) + 1),
named AS (SELECT host, path, blocked, labelled, '/' || array_to_string(done, '/') AS template, '/' || array_to_string(
          list_transform(range(1, len(done) + 1), lambda i: CASE WHEN i = fixed THEN '{{}}' ELSE done[i] END), '/') AS branch FROM ends),
leaves AS (SELECT host, branch, template, sum(blocked) AS blocked, sum(labelled) AS labelled FROM named GROUP BY ALL),
near AS (SELECT *, sum(blocked) OVER w / nullif(sum(labelled) OVER w, 0) AS base FROM leaves WINDOW w AS (PARTITION BY host, branch)),
scored AS (SELECT *, coalesce((blocked - labelled * base) / sqrt(labelled * base * (1 - base) + 0.25), 0) AS z FROM near),
placed AS (SELECT *, CASE WHEN z > {urls.DIFFERENT} THEN 'more' WHEN z < -{urls.DIFFERENT} THEN 'less' ELSE 'alike' END AS kind FROM scored),
shares AS (
  SELECT *, sum(blocked) OVER (PARTITION BY host, branch, kind) AS mb, sum(labelled) OVER (PARTITION BY host, branch, kind) AS ml,
         sum(blocked) OVER (PARTITION BY host) AS hb, sum(labelled) OVER (PARTITION BY host) AS hl,
         sum(blocked) OVER () AS ab, sum(labelled) OVER () AS al FROM placed
),
purity AS (
  SELECT host, template, (mb + {WEIGHT} * (hb + {WEIGHT} * (ab + {WEIGHT} * {urls.PRIOR}) / (al + {WEIGHT})) / (hl + {WEIGHT}))
         / (ml + {WEIGHT}) AS purity FROM shares
)
SELECT page_id, p.host, p.path, rule,
       coalesce(said, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, n.template
FROM p JOIN named n ON p.host = n.host AND p.path = n.path JOIN purity u ON n.host = u.host AND n.template = u.template
"""

# --- op10: cutoffs by exact binomial tests ----------------------------------------

SHARE = rules.RISK / len(rules.RULES)
VALUES = " UNION ALL ".join(
    f"SELECT stratum, good, '{name}' AS rule, {value} AS value FROM m JOIN known USING (doc_id)" for name, (value, _) in rules.RULES.items()
)
GRID = " UNION ALL ".join(f"SELECT '{name}' AS rule, unnest({grid}::DOUBLE[]) AS cutoff" for name, (_, grid) in rules.RULES.items())
CUTS = ", ".join(f"max(cutoff) FILTER (rule = '{name}') AS cut_{name}" for name in rules.RULES)
BROKEN = ", ".join(f"CASE WHEN {value} > cut_{name} THEN '{name}' END" for name, (value, _) in rules.RULES.items())

ORACLE["op10_quality_rules"] = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM documents
),
wins AS (SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n
            FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM wins JOIN twice USING (doc_id, win)) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
v AS ({VALUES}),
tested AS (SELECT stratum, rule, cutoff, count(*) FILTER (good = 1 AND value > cutoff) AS good_out,
                  count(*) FILTER (good = 0 AND value > cutoff) AS bad_out, count(*) FILTER (good = 1) AS n
           FROM v JOIN ({GRID}) USING (rule) GROUP BY ALL),
proved AS (SELECT *, count(*) OVER () AS tests, CASE WHEN good_out < n * {SHARE} THEN list_sum(list_transform(range(0, good_out + 1),
             lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({SHARE}) + (n - i) * ln(1 - {SHARE}))))
             ELSE 1 END AS chance FROM tested),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_out - {rules.CAUTION} * good_out DESC, cutoff DESC) AS place
         FROM proved WHERE chance <= {rules.ERROR} / tests AND bad_out > {rules.CAUTION} * good_out),
cuts AS (SELECT stratum, {CUTS} FROM best WHERE place = 1 GROUP BY stratum),
judged AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  list_filter([{BROKEN}], lambda x: x IS NOT NULL) AS broken FROM m LEFT JOIN cuts USING (stratum))
SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(array_to_string(broken, ','), '') AS rejected_by, NOT base_failed AND len(broken) = 0 AS kept FROM judged
"""

# --- op12: trees of sixteen branches ----------------------------------------------


def merkle_field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def merkle_leaf(text: str) -> str:
    return f"sha256({' || '.join(map(merkle_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


CRC_TABLE = """(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"""
#: crc32 of the decimal doc_id, byte by byte through the usual table.
CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE crcs AS (SELECT {CRC_TABLE} AS crc_table),
rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {merkle_leaf("text")} AS leaf,
         CASE WHEN {CRC} % 5 = 0 THEN {merkle_leaf(LOWER.format("text"))} END AS altered FROM documents, crcs
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
                  count(*) OVER (PARTITION BY tree) AS n FROM rows),
nodes AS (
  SELECT tree, 0 AS level, k, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, k // 16, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY tree, level, k // 16
),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, k, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, k // 16, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, k // 16
),
-- the siblings on each row's way: before and behind its node, level by level
inner_steps AS (
  SELECT l.doc_id, l.tree, l.k AS place, x.level, coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (s.k < x.k), '') AS lft,
         coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (s.k > x.k), '') AS rgt
  FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.k = l.k // (16::BIGINT ** x.level)::BIGINT
  JOIN nodes s ON s.tree = x.tree AND s.level = x.level AND s.k // 16 = x.k // 16 GROUP BY ALL
),
outer_steps AS (
  SELECT r.tree, x.level, coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (s.k < x.k), '') AS lft,
         coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (s.k > x.k), '') AS rgt
  FROM subroots r JOIN top x ON x.n > 1 AND x.k = r.k // (16::BIGINT ** x.level)::BIGINT
  JOIN top s ON s.level = x.level AND s.k // 16 = x.k // 16 GROUP BY ALL
),
steps AS (
  SELECT tree, place, 0 AS part, level, lft, rgt FROM inner_steps
  UNION ALL SELECT l.tree, l.k, 1, o.level, lft, rgt FROM leaves l JOIN outer_steps o USING (tree)
),
ways AS (SELECT tree, place, list({{'lft': lft, 'rgt': rgt}} ORDER BY part, level) AS way,
                string_agg(lft || rgt, '' ORDER BY part, level) AS proof FROM steps GROUP BY tree, place),
folded AS (
  SELECT l.tree, l.k, 1 AS i, coalesce(altered, leaf) AS h, coalesce(way, []) AS way FROM leaves l LEFT JOIN ways w ON w.tree = l.tree AND w.place = l.k
  UNION ALL
  SELECT tree, k, i + 1, sha256(way[i].lft || h || way[i].rgt), way FROM folded WHERE i <= len(way)
),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots USING (tree) CROSS JOIN root LEFT JOIN ways w ON w.tree = l.tree AND w.place = l.k
JOIN folded f ON f.tree = l.tree AND f.k = l.k AND f.i = len(f.way) + 1
"""

# --- op13: every window by itself ---------------------------------------------------

ORACLE["op13_substring_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
wins AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS win
         FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS origin FROM wins GROUP BY win),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM wins JOIN firsts USING (win) WHERE origin < doc_id),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""
