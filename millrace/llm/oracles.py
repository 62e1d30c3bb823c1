"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables and texts."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PLAIN_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _prior(rule: str) -> str:
    """Mean and strength of the beta prior of a rule, by moments over hosts."""
    mean = f"least(greatest(sum({rule}) / sum(docs), 1e-4), 1 - 1e-4)"
    between = f"greatest(coalesce(var_samp({rule} / docs), 0.0) - ({mean}) * (1 - {mean}) * avg(1 / docs), 1e-9)"
    return f"{mean} AS m_{rule}, least(greatest({mean} * (1 - {mean}) / {between} - 1, 2.0), 1000.0) AS s_{rule}"


_RULES = ("short", "repeats", "symbols", "dup_lines")

QUALITY_RULES = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
features AS (
    SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
    FROM texts JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (
    SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, n_symbols > 0.3::DOUBLE * n_words AS symbols, n_dup_lines > 0.5 * n_lines AS dup_lines
    FROM features),
hosts AS (SELECT host, count(*)::DOUBLE AS docs, {", ".join(f"sum({r}::INT)::DOUBLE AS {r}" for r in _RULES)} FROM failed GROUP BY host),
prior AS (SELECT {", ".join(map(_prior, _RULES))} FROM hosts),
verdicts AS (SELECT host, {" OR ".join(f"({r} + m_{r} * s_{r}) / (docs + s_{r}) > least(greatest(m_{r} + 3.0::DOUBLE * sqrt(m_{r} * (1 - m_{r}) / (s_{r} + 1)), 0.2::DOUBLE), 0.5::DOUBLE)" for r in _RULES)} AS rejected FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    short OR repeats AS base_failed, NOT (short OR repeats) AND NOT rejected AS kept
FROM failed JOIN verdicts USING (host)"""

#: Documents of which some hosts have many that fail; the text is valid in both engines.
UNLIKE_HOSTS = "SELECT doc_id, source, CASE WHEN source IN ('src3', 'src7') AND doc_id % 4 < 3 THEN 'too short' ELSE text END AS text FROM documents"
QUALITY_OF_UNLIKE_HOSTS = QUALITY_RULES.replace("FROM documents)", f"FROM ({UNLIKE_HOSTS}))")

DECONTAMINATION = rf"""
WITH texts AS (SELECT doc_id, {_PLAIN_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_PLAIN_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
spans AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, n, i, item_id FROM spans JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS digest FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

JACCARD_JOIN = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, {_BLANK_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS s FROM texts),
classes AS MATERIALIZED (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
entries AS MATERIALIZED (SELECT class_id, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
    SELECT a.class_id AS a, b.class_id AS b
    FROM entries a JOIN entries b ON a.g = b.g AND a.class_id < b.class_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
least_reached AS (SELECT a AS class_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN least_reached USING (class_id)"""


LINK_COUNTS = (
    JACCARD_JOIN[: JACCARD_JOIN.index("reached AS (")]
    + """sizes AS (SELECT class_id, count(*) AS k FROM sets d JOIN classes c ON d.s = c.s GROUP BY class_id),
others AS (SELECT e.a AS class_id, sum(z.k) AS others FROM both_ways e JOIN sizes z ON e.b = z.class_id GROUP BY e.a)
SELECT d.doc_id, (coalesce(z.k - 1, 0) + coalesce(others, 0))::BIGINT AS n_links
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN sizes z ON c.class_id = z.class_id LEFT JOIN others o ON c.class_id = o.class_id"""
)

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _above(name: str, base: str) -> str:
    """Nodes of all levels above those of ``base`` (tree, pos, digest, n)."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, pos, digest, n FROM {base}
    UNION ALL
    SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n)"""


def _steps(name: str, base: str, nodes: str) -> str:
    """For each node of ``base`` the siblings before and after it on all levels."""
    on_level = "b.pos // (16 ** s.level)::BIGINT"
    return f"""{name} AS (
    SELECT tree, pos, list({{'b': before, 'a': after}} ORDER BY level) AS steps
    FROM (
        SELECT b.tree, b.pos, s.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < {on_level}), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > {on_level}), '') AS after
        FROM {base} b JOIN {nodes} s ON b.tree = s.tree AND s.n > 1 AND s.pos // 16 = b.pos // (16 ** (s.level + 1))::BIGINT
        GROUP BY b.tree, b.pos, s.level)
    GROUP BY tree, pos)"""


_NO_STEPS = "[]::STRUCT(b VARCHAR, a VARCHAR)[]"

MERKLE_MANIFEST = f"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1))) AS c FROM range(256) r(i))),
marked AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 5 = 0 AS hit
    FROM documents, crc),
rows_ AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '1' || source END AS tree, {_leaf("text")} AS digest, {_leaf(f"(CASE WHEN hit THEN {_LOWER.format('text')} ELSE text END)")} AS claim FROM marked),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{_above("nodes", "leaves")},
subroots AS MATERIALIZED (SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_above("upper_", "subroots")},
{_steps("low", "leaves", "nodes")},
{_steps("high", "subroots", "upper_")},
whole AS (
    SELECT doc_id, l.digest AS leaf, claim, s.digest AS subroot, r.digest AS root, coalesce(low.steps, {_NO_STEPS}) || coalesce(high.steps, {_NO_STEPS}) AS steps
    FROM leaves l JOIN subroots s ON l.tree = s.name JOIN (SELECT digest FROM upper_ WHERE n = 1) r ON true
    LEFT JOIN low ON l.tree = low.tree AND l.pos = low.pos LEFT JOIN high ON s.pos = high.pos),
folded AS (
    SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s.b || s.a), '')) AS proof_sha256,
        list_reduce(list_prepend({{'b': claim, 'a': ''}}, steps), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
    FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

LEXICAL_SEARCH = rf"""
WITH texts AS (SELECT doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM texts),
found AS (SELECT doc_id, n::BIGINT AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM texts) GROUP BY doc_id, n, term),
asked AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM found, totals GROUP BY term),
scores AS (
    SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN found USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""
