"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLASS = r"[ \t\n\x0B\f\r]"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY = rf"""
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT r, doc_id, text,
        list_filter(string_split_regex(text, '{_CLASS}+'), lambda w: w <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS ls
    FROM base
), words AS (
    SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), windows AS (
    SELECT r, i, w, lag(w) OVER o AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2,
        lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4, lead(w, 5) OVER o AS w5,
        lead(w, 6) OVER o AS w6, lead(w, 7) OVER o AS w7
    FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), stutters AS (
    SELECT r, count(*) AS n FROM windows WHERE w = w0 GROUP BY r
), twice AS (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4, w5, w6, w7) AS n
        FROM windows WHERE w7 IS NOT NULL) WHERE n > 1
), covered AS (
    SELECT r, sum(CASE WHEN next IS NULL THEN 8 ELSE least(8, next - i) END) AS n FROM twice GROUP BY r
), counted AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(list_distinct(ws)) AS kinds,
        coalesce(t.n, 0) AS stutters,
        length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters
    FROM split LEFT JOIN covered c USING (r) LEFT JOIN stutters t USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_symbols > 0.05 * word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines,
        word_chars < 2 * n_words OR word_chars > 15 * n_words AS lengths, 20 * kinds < n_words AS few,
        10 * stutters > 3 * n_words AS stutter, 2 * letters < word_chars AS letterless
    FROM counted
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR symbols OR lines OR lengths OR few OR stutter OR letterless) AS kept
FROM judged
"""

LINES = f"""
WITH numbered AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM numbered
), keyed AS (
    SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT r, k.doc_id, i, line, coalesce(s.largest <> k.doc_id, false) AS dropped
    FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _urls(depth: int = 3) -> str:
    """The template tree level by level, as the operator's settings have it."""
    own = [f"t{k}" for k in range(depth)]
    shape = "host, " + ", ".join(f"s{k}" for k in range(depth)) + ", rest"
    leaf = "host, " + ", ".join(own) + ", rest"

    def forms(source: str, columns: str) -> str:
        parts = ", ".join(
            f"""CASE WHEN len(parts) <= {k} THEN ''
            WHEN regexp_full_match(parts[{k + 1}], '[0-9a-fA-F-]{{16,}}') THEN '*'
            ELSE regexp_replace(parts[{k + 1}], '[0-9]+', '#', 'g') END AS s{k}"""
            for k in range(depth)
        )
        return f"""SELECT {columns}, host, path, {parts}, CASE WHEN len(parts) > {depth} THEN '**' ELSE '' END AS rest
            FROM (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts
                FROM (SELECT *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
                    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
                    FROM (SELECT * REPLACE (coalesce(url, '') AS url) FROM {source})))"""

    steps = [
        f"pages_in AS ({forms('pages', 'page_id')})",
        """rated AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)""",
        """labelled AS (
            SELECT url, (quality = 1)::BIGINT AS good FROM (
                SELECT url, TRY_CAST(regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1),
                    '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM pages) JOIN rated USING (doc_id))""",
        f"""seen AS MATERIALIZED (
            SELECT {shape}, sum(n)::BIGINT AS n, sum(known)::BIGINT AS known, sum(good)::BIGINT AS good FROM (
                SELECT {shape}, 1 AS n, 0 AS known, 0 AS good FROM pages_in
                UNION ALL SELECT {shape}, 0, 1, good FROM ({forms('labelled', 'good')})) GROUP BY ALL)""",
    ]
    last = "seen"
    for k in range(depth):
        parent = ", ".join(["host", *own[:k]])
        steps.append(f"""wide{k} AS (SELECT {parent}, count(DISTINCT s{k}) AS kinds, sum(n) AS whole FROM {last} GROUP BY {parent})""")
        steps.append(f"""down{k} AS MATERIALIZED (
            SELECT {last}.*, CASE WHEN kinds >= 8 AND whole <= 4.0 * kinds THEN '*' ELSE s{k} END AS t{k}
            FROM {last} JOIN wide{k} USING ({parent}))""")
        last = f"down{k}"
    for k in reversed(range(depth)):
        place = ", ".join(["host", *[t for t in own if t != f"t{k}"], "rest"])
        steps.append(f"""branch{k} AS (SELECT {leaf}, sum(known) AS bl, sum(good) AS bg FROM {last} GROUP BY {leaf})""")
        steps.append(f"""pool{k} AS (SELECT {place}, sum(bl) AS pl, sum(bg) AS pg, count(*) AS branches FROM branch{k} GROUP BY {place})""")
        steps.append(f"""alike{k} AS (
            SELECT {leaf}, coalesce(branches > 1 AND pl > 0 AND (bl = 0 OR abs(bg / bl - pg / pl)
                <= 2.0 * sqrt(pg / pl * (1 - pg / pl) / nullif(bl, 0))), false) AS alike
            FROM branch{k} JOIN pool{k} USING ({place}))""")
        steps.append(f"""up{k} AS MATERIALIZED (
            SELECT {last}.* REPLACE (CASE WHEN alike THEN '*' ELSE t{k} END AS t{k})
            FROM {last} JOIN alike{k} USING ({leaf}))""")
        last = f"up{k}"
    filled = ", ".join([*own, "rest"])
    steps += [
        f"prior AS (SELECT coalesce(sum(good) / nullif(sum(known), 0), 1.0) AS p FROM {last})",
        f"""hosts AS (SELECT host, (sum(good) + 4.0 * any_value(p)) / (sum(known) + 4.0) AS hp
            FROM {last} CROSS JOIN prior GROUP BY host)""",
        f"""leaves AS (SELECT {leaf}, (sum(good) + 4.0 * any_value(hp)) / (sum(known) + 4.0) AS purity,
                host || '/' || array_to_string(list_filter([{filled}], lambda x: x <> ''), '/') AS template
            FROM {last} JOIN hosts USING (host) GROUP BY {leaf})""",
        f"known AS (SELECT {shape}, template, purity FROM {last} JOIN leaves USING ({leaf}))",
    ]
    rules = {"example.org/en/1": "block", "example.org/es/": "block", "com/de/": "block", "com/fr/": "allow", "org/": "allow"}
    fits = "".join(
        f" WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}'))"
        f" AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r in sorted(rules, key=lambda r: -len(r))
    )
    ruled = "".join(f" WHEN rule = '{r}' THEN '{v}'" for r, v in rules.items())
    return f"""WITH {', '.join(steps)}
        SELECT page_id, host, path, rule, CASE{ruled} WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
            template, round(purity, 9) AS purity
        FROM (SELECT *, CASE{fits} END AS rule FROM pages_in JOIN known USING ({shape}))"""


URLS = _urls()

JACCARD = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '{_CLASS}+'),
        lambda w: w <> '') AS ws
    FROM documents
), words AS (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split
), runs AS (
    SELECT doc_id, i, n, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sets AS MATERIALIZED (
    SELECT DISTINCT doc_id, w || ' ' || coalesce(w1, '') || ' ' || coalesce(w2, '') || ' ' || coalesce(w3, '') AS s
    FROM runs WHERE w3 IS NOT NULL OR (n < 4 AND i = 1)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inside
        FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * inside >= 85 * (p.n + q.n - inside)
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.root, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a) m USING (doc_id)
"""

HARD_NEGATIVES = """
WITH parts AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM parts a JOIN parts b ON a.id <> b.id WHERE a.id % 50 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""

def collocations(least: int = 100, top: int = 2000) -> str:
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS text
    FROM documents
), pieces AS (
    SELECT r, lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM texts
), split AS (
    SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces
), words AS (
    SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), runs AS (
    SELECT lang, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
    FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), counts AS MATERIALIZED (
    SELECT lang, phrase, size, count(*) AS f FROM (
        SELECT lang, w AS phrase, 1 AS size FROM runs
        UNION ALL SELECT lang, w || ' ' || w1, 2 FROM runs WHERE w1 IS NOT NULL
        UNION ALL SELECT lang, w || ' ' || w1 || ' ' || w2, 3 FROM runs WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, w || ' ' || w1 || ' ' || w2 || ' ' || w3, 4 FROM runs WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, w || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 5 FROM runs WHERE w4 IS NOT NULL)
    GROUP BY ALL HAVING count(*) >= {least}
), totals AS (
    SELECT lang, count(*) AS n FROM words GROUP BY lang
), longer AS (
    SELECT lang, f, string_split(phrase, ' ') AS ws FROM counts WHERE size > 2
), inside AS (
    SELECT DISTINCT lang, f, array_to_string(part, ' ') AS phrase
    FROM (SELECT lang, f, unnest([ws[:-2], ws[2:]]) AS part FROM longer)
), cuts AS (
    SELECT c.lang, phrase, f AS a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
    FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k
        FROM counts ANTI JOIN inside USING (lang, phrase, f) WHERE size > 1) c
), scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail
    JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
    a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= {top}
"""


COLLOCATIONS = collocations()
