"""The same results in SQL, where SQL expresses them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

KEY = rf"trim(regexp_replace(lower(l), '{SPACES}', ' ', 'g'))"

LINE_DEDUP = rf"""
WITH pages AS (
  SELECT DISTINCT source, md5(text) AS content, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents
), rows AS (
  SELECT DISTINCT source, content, {KEY} AS line FROM pages WHERE regexp_matches(l, '{WORD}')
), totals AS (
  SELECT source, count(DISTINCT md5(text)) AS n FROM documents GROUP BY source
), drops AS (
  SELECT f.source, line FROM (SELECT source, line, count(*) AS c FROM rows GROUP BY ALL) f
  JOIN totals t ON f.source IS NOT DISTINCT FROM t.source WHERE c >= 3 AND c > 0.02 * t.n
), marks AS (
  SELECT r.source, content, list(r.line) AS dropped FROM rows r
  JOIN drops d ON r.source IS NOT DISTINCT FROM d.source AND r.line = d.line GROUP BY ALL
), split AS (
  SELECT d.*, string_split(coalesce(text, ''), chr(10)) AS own,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT (regexp_matches(l, '{WORD}')
      AND list_contains(coalesce(m.dropped, []), {KEY}))) AS left_lines
  FROM documents d LEFT JOIN marks m ON d.source IS NOT DISTINCT FROM m.source AND md5(d.text) = m.content
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(left_lines, chr(10)) END AS text, lang, source,
  CASE WHEN len(own) = len(left_lines) THEN n_chars
    ELSE length(array_to_string(left_lines, chr(10))) END AS n_chars,
  CAST(len(own) - len(left_lines) AS BIGINT) AS n_dropped
FROM split
"""


def _url_filters(steps: int = 10) -> str:
    spread = []
    for name, seed, src, dst in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        spread.append(
            f"{name}_seed AS (SELECT host, {seed} / (SELECT sum({seed}) FROM hosts) AS seed FROM hosts WHERE {seed} > 0)"
        )
        spread.append(
            f"{name}_flow AS (SELECT {src} AS a, {dst} AS b, links / sum(links) OVER (PARTITION BY {src}) AS share FROM edges)"
        )
        spread.append(f"{name}0 AS (SELECT host, seed AS rank FROM {name}_seed)")
        for i in range(1, steps + 1):
            spread.append(
                f"{name}{i} AS (SELECT host, sum(rank) AS rank FROM (SELECT host, seed * (1 - 0.85) AS rank FROM {name}_seed"
                f" UNION ALL SELECT b, share * rank * 0.85 FROM {name}_flow JOIN {name}{i - 1} ON a = host) GROUP BY host)"
            )
    return rf"""
WITH parts AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
), hosts AS (
  SELECT host, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS allowed,
    count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS blocked
  FROM ruled GROUP BY host
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''),
    '(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM parts
), edges AS (
  SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' GROUP BY ALL
), {", ".join(spread)}
SELECT page_id, r.host, path, rule, coalesce(t.rank, 0) AS trust, coalesce(d.rank, 0) AS distrust,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN coalesce(d.rank, 0) > coalesce(t.rank, 0)
      AND d.rank > 0.1 * (1 - 0.85) / (SELECT greatest(count(*), 1) FROM hosts WHERE blocked > 0) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN t{steps} t ON r.host = t.host LEFT JOIN d{steps} d ON r.host = d.host
"""


def _sketch(words: str) -> str:
    hashes = (
        f"list_transform(range(1, greatest(2, len({words}) - 3)),"
        f" lambda i: substr(md5(array_to_string(list_slice({words}, i, i + 4), ' ')), 1, 16))"
    )
    few = f"list_distinct(list_filter({hashes}, lambda h: h < '2'))"
    return (
        f"CASE WHEN len({words}) = 0 THEN [] WHEN len({few}) > 0 THEN list_sort({few})"
        f" ELSE [list_aggregate({hashes}, 'min')] END"
    )


def _like(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {shared} / (len({a}) + len({b}) - {shared}) END"


FINGERPRINTS = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), s AS (SELECT *, {_sketch("words")} AS sketch FROM d),
n AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
    coalesce(lead(sketch) OVER w, first_value(sketch) OVER w) AS next_sketch
  FROM s WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n
), f AS (SELECT *, regexp_extract_all(edited, '{WORD}') AS edited_words FROM e),
g AS (SELECT *, {_sketch("edited_words")} AS edited_sketch FROM f)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(sketch, '') AS fingerprint, array_to_string(edited_sketch, '') AS edited_fingerprint,
  CAST({_like("sketch", "edited_sketch")} AS DOUBLE) AS near_edited,
  CAST({_like("sketch", "next_sketch")} AS DOUBLE) AS near_next
FROM g
"""

MEASURED = rf"""
base AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, md5(text) AS content, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS own
  FROM documents
), wins AS (
  SELECT row_no, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 6)) AS i FROM base)
), twice AS (
  SELECT row_no, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY row_no, w) AS c FROM wins) WHERE c > 1
), repeats AS (SELECT row_no, count(DISTINCT p) AS n FROM twice GROUP BY row_no),
each_line AS (
  SELECT DISTINCT source, content, unnest(range(1, len(own) + 1)) AS pos, unnest(own) AS l FROM base
), keyed AS (
  SELECT source, content, pos, {KEY} AS line, len(regexp_extract_all(l, '{WORD}')) AS n FROM each_line
), removed AS (
  SELECT source, line FROM keyed GROUP BY ALL HAVING count(DISTINCT content) > 10
), lost AS (
  SELECT k.source, k.content, sum(k.n) AS n FROM keyed k
  JOIN removed r ON k.source IS NOT DISTINCT FROM r.source AND k.line = r.line GROUP BY ALL
), measured AS (
  SELECT b.*, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(words) - coalesce(l.n, 0) AS BIGINT) AS n_left_words
  FROM base b LEFT JOIN repeats r USING (row_no)
  LEFT JOIN lost l ON b.source IS NOT DISTINCT FROM l.source AND b.content = l.content
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
"""

QUALITY_RULES = f"""
WITH {MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words, base_failed,
  NOT base_failed AND n_left_words >= 20 AND n_left_words >= 0.3 * n_words AS kept
FROM judged
"""

SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""
WITH k AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {SOUND}
), scored AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM k a JOIN k b ON a.n <> b.n WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def _vector_codes(rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT n, part, min(struct_pack(far := far, entry := entry)) AS b FROM (
    SELECT p.n, p.part, e.entry, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS far
    FROM p JOIN e{k} e ON p.part = e.part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""e{k + 1} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{k} e LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS c FROM (
      SELECT p.part, a.b.entry AS entry, i, floor(sum(x[i]) / count(*)) AS mean
      FROM p JOIN a{k} a ON p.n = a.n AND p.part = a.part, range(1, (SELECT max(len(x)) FROM p) + 1) r(i) GROUP BY ALL
    ) GROUP BY ALL) m ON e.part = m.part AND e.entry = m.entry)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {SOUND})
), p AS MATERIALIZED (
  SELECT n, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM k, range(4) r(part)
), e0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS c FROM p WHERE n <= 256),
{", ".join(steps)},
coded AS (
  SELECT n, string_agg(format('{{:02x}}', b.entry), '' ORDER BY part) AS code, CAST(sum(b.far) AS BIGINT) AS error FROM a{rounds} GROUP BY n
), book AS (
  SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM e{rounds}, range(1, (SELECT max(len(x)) FROM p) + 1) r(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN coded USING (n), book
"""


WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), n AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS least
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN least END AS refers_to
FROM n
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_url_filters": _url_filters(),
    "op8_fingerprints": FINGERPRINTS,
    "op10_quality_rules": QUALITY_RULES,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_vector_codes": _vector_codes(),
    "op13_warc": WARC,
}
