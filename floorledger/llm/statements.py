"""Expected results of the numbered queries that SQL can express, as DuckDB statements.

Packing, language and quality have none: they search, or learn from data.
"""

from __future__ import annotations

from floorledger.llm import ranking, resampling, secrets
from floorledger.llm.decontamination import NEAR_SLACK as SLACK
from floorledger.llm.licenses import TEMPLATES, rivals, wider
from floorledger.llm.urls import RULES, SETTINGS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def words(text: str) -> str:
    return f"regexp_extract_all({lowered(f'COALESCE({text}, {chr(39) * 2})')}, '{WORD}')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


# ---- licenses -----------------------------------------------------------------------------------------------------

_STRIDE = max(len(template.words) for template in TEMPLATES)
_NUMBERS = lambda values: f"CAST([{', '.join(map(str, values))}] AS INTEGER[])"
_TEMPLATES = ", ".join(
    f"({n}, {text(t.label)}, {str(t.base).upper()}, {t.needed}, {texts(t.words)}, {texts(sorted(t.tokens))}, "
    f"{texts(sorted(t.runs))}, {t.run_words}, {t.needed_runs}, {_NUMBERS(near)}, {_NUMBERS(beyond)})"
    for n, (t, near, beyond) in enumerate(zip(TEMPLATES, rivals(TEMPLATES), wider(TEMPLATES), strict=True))
)
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words('text')} AS w FROM documents),
t(template, label, base, needed, phrase, tokens, runs, run_words, needed_runs, rivals, wider) AS (VALUES {_TEMPLATES}),
b AS (
    SELECT row, unnest(range(0, len(w), {_STRIDE})) AS pos,
           unnest(list_transform(range(0, len(w), {_STRIDE}), lambda i: w[i + 1:i + {2 * _STRIDE}])) AS block FROM d),
likely AS MATERIALIZED (
    SELECT row, pos, t.*, block, len(list_intersect(tokens, block)) / CAST(len(tokens) AS DOUBLE) AS share
    FROM b JOIN t ON len(list_intersect(tokens, block)) >= needed),
met AS (
    SELECT *, len(list_intersect(runs, list_transform(range(0, greatest(len(block) - run_words, 0) + 1),
        lambda i: array_to_string(block[i + 1:i + run_words], ' ')))) AS held FROM likely),
placed AS (
    SELECT *, held / CAST(len(runs) AS DOUBLE) AS run_share,
        CASE WHEN base THEN list_transform(list_filter(range(0, least({_STRIDE}, len(block))),
        lambda i: block[i + 1:i + len(phrase)] = phrase), lambda i: pos + i) END AS places FROM met WHERE held >= needed_runs),
hits AS (
    SELECT * FROM placed AS one WHERE (NOT base OR len(places) > 0) AND NOT EXISTS (
        SELECT 1 FROM placed AS other WHERE other.row = one.row AND abs(other.pos - one.pos) <= {_STRIDE}
            AND list_contains(one.rivals, other.template) AND (list_contains(one.wider, other.template)
                OR other.run_share > one.run_share AND NOT list_contains(other.wider, one.template)))),
found AS (
    SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(share) AS score,
           flatten(list(places) FILTER (base)) AS places
    FROM hits GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(places), 0) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (row)"""


# ---- URLs ---------------------------------------------------------------------------------------------------------

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _rule(column: str) -> str:
    cases = " ".join(
        f"WHEN (host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)}) "
        f"THEN {text(r.name if column == 'rule' else r.verdict)}"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    )
    return f"CASE {cases} END"


def _tree() -> str:
    s, parts = SETTINGS, []
    parts.append(f"""tree0 AS (
        SELECT host, path, paths, labelled, bad, '' AS template, CASE WHEN len(named) <= {s.levels} THEN named
            ELSE list_append(named[1:{s.levels - 1}], array_to_string(named[{s.levels}:], '\\')) END AS segments
        FROM (SELECT *, list_filter(string_split(replace(path, '*', '%2A'), '/'), lambda x: x <> '') AS named FROM paths))""")
    for n in range(s.levels):
        parts.append(f"""child{n} AS (
            SELECT host, template, segments[{n + 1}] AS segment, SUM(paths) AS own FROM tree{n}
            WHERE segments[{n + 1}] IS NOT NULL GROUP BY ALL)""")
        parts.append(f"""node{n} AS (
            SELECT host, template, SUM(own) AS whole, COUNT(*) AS kinds FROM child{n} GROUP BY ALL
            HAVING COUNT(*) >= {s.least_kinds} AND COUNT(*) >= {s.kinds_per_path}::DOUBLE * SUM(own))""")
        parts.append(f"""star{n} AS (
            SELECT host, template, segment, TRUE AS star FROM child{n} JOIN node{n} USING (host, template)
            WHERE own < greatest(2.0::DOUBLE, {s.own_share}::DOUBLE * whole))""")
        parts.append(rf"""tree{n + 1} AS (
            SELECT t.host, path, segments, paths, labelled, bad,
                CASE WHEN segments[{n + 1}] IS NULL THEN t.template
                     WHEN star THEN t.template || '/*' || regexp_extract(segments[{n + 1}], '(\.[A-Za-z][A-Za-z0-9]{{0,4}})$', 1)
                     ELSE t.template || '/' || segments[{n + 1}] END AS template
            FROM tree{n} t LEFT JOIN star{n} s
                ON s.host = t.host AND s.template = t.template AND s.segment = segments[{n + 1}])""")
    parts.append(f"""merge{s.levels} AS (
        SELECT host, template, SUM(labelled) AS labelled, SUM(bad) AS bad, template AS merged
        FROM tree{s.levels} GROUP BY host, template)""")
    for n in reversed(range(s.levels)):
        parts.append(f"""branch{n} AS (
            SELECT host, merged, SUM(labelled) AS labelled, SUM(bad) AS bad,
                CASE WHEN len(string_split(substr(merged, 2), '/')) > {n} THEN '/' || array_to_string(list_transform(
                    string_split(substr(merged, 2), '/'),
                    lambda p, i: CASE WHEN i = {n + 1} AND NOT starts_with(p, '*') THEN '*' ELSE p END), '/')
                ELSE merged END AS grp
            FROM merge{n + 1} GROUP BY host, merged)""")
        parts.append(f"""grp{n} AS (
            SELECT host, grp, SUM(labelled) AS all_labelled, SUM(bad) AS all_bad FROM branch{n} GROUP BY ALL
            HAVING COUNT(*) > 1)""")
        parts.append(f"""alike{n} AS (
            SELECT host, merged, grp FROM (
                SELECT *, CASE WHEN labelled > 0 AND all_labelled - labelled > 0 THEN
                    abs(CAST(bad AS DOUBLE) / labelled - CAST(all_bad - bad AS DOUBLE) / (all_labelled - labelled))
                    > {s.merge_errors}::DOUBLE * sqrt((CAST(all_bad AS DOUBLE) / all_labelled)
                        * (1 - CAST(all_bad AS DOUBLE) / all_labelled)
                        * (1.0::DOUBLE / labelled + 1.0::DOUBLE / (all_labelled - labelled))) END AS apart
                FROM branch{n} JOIN grp{n} USING (host, grp)) WHERE NOT COALESCE(apart, FALSE))""")
        parts.append(f"""named{n} AS (
            SELECT * FROM alike{n} WHERE (host, grp) IN (SELECT (host, grp) FROM alike{n} GROUP BY host, grp HAVING COUNT(*) > 1))""")
        parts.append(f"""merge{n} AS (
            SELECT m.host, template, labelled, bad, COALESCE(grp, m.merged) AS merged
            FROM merge{n + 1} m LEFT JOIN named{n} x ON x.host = m.host AND x.merged = m.merged)""")
    k = f"{s.smoothing}::DOUBLE"
    parts.append(f"""whole AS (SELECT CASE WHEN SUM(labelled) > 0 THEN CAST(SUM(bad) AS DOUBLE) / SUM(labelled) ELSE 0.0 END AS rate
        FROM merge0)""")
    parts.append(f"""host_rate AS (
        SELECT host, (SUM(bad) + {k} * any_value(rate)) / (SUM(labelled) + {k}) AS host_rate FROM merge0, whole GROUP BY host)""")
    parts.append(f"""judged AS (
        SELECT host, merged, (SUM(bad) + {k} * any_value(host_rate)) / (SUM(labelled) + {k}) AS purity
        FROM merge0 JOIN host_rate USING (host) GROUP BY host, merged)""")
    return ", ".join(parts)


URLS = rf"""
WITH parsed AS (
    SELECT page_id, {lowered(f"COALESCE(regexp_extract(url, '{_URL}', 1), '')")} AS host,
           COALESCE(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
marks AS (
    SELECT p.page_id, quality = 0 OR toxic = 1 AS bad FROM parsed p
    JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT)),
marked AS (SELECT page_id, COUNT(*) AS labelled, SUM(CAST(bad AS BIGINT)) AS bad FROM marks WHERE bad IS NOT NULL GROUP BY page_id),
paths AS (
    SELECT host, path, COUNT(*) AS paths, COALESCE(SUM(labelled), 0) AS labelled, COALESCE(SUM(bad), 0) AS bad
    FROM parsed LEFT JOIN marked USING (page_id) GROUP BY host, path),
{_tree()}
SELECT page_id, p.host, p.path, {_rule('rule').replace('host', 'p.host').replace('path,', 'p.path,')} AS rule,
       COALESCE({_rule('verdict').replace('host', 'p.host').replace('path,', 'p.path,')},
                CASE WHEN purity >= {SETTINGS.reject}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, m.merged AS template, purity
FROM parsed p JOIN tree{SETTINGS.levels} t ON t.host = p.host AND t.path = p.path
JOIN merge0 m ON m.host = t.host AND m.template = t.template
JOIN judged j ON j.host = m.host AND j.merged = m.merged"""


# ---- archives -----------------------------------------------------------------------------------------------------

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(f"substr('{_BASE32}', ((v >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
_FIVE_HEX = "list_reduce(list_transform(range(1, 6), lambda j: instr('0123456789abcdef', substr(sha, 5 * i + j, 1)) - 1), lambda a, b: 16 * a + b)"
ARCHIVES = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
s AS (SELECT page_id, octet_length(encode(payload)) AS bytes, sha1(encode(payload)) AS sha,
             MIN(page_id) OVER (PARTITION BY payload) AS original FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(list_transform(range(0, 8), lambda i: {_FIVE_HEX}), lambda v: {_LETTERS}), '') AS payload_digest,
       CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM s"""


# ---- search -------------------------------------------------------------------------------------------------------

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


# ---- decontamination ----------------------------------------------------------------------------------------------

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n,
        unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS terms
    FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
        unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS terms
    FROM d, sizes WHERE len(w) >= n),
met AS (SELECT doc_id, pos, n, item FROM places JOIN windows USING (n, terms)),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM met) GROUP BY doc_id),
named AS (
    SELECT doc_id, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM met GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
often AS (SELECT word, COUNT(*) AS places FROM tokens GROUP BY word),
kinds AS (SELECT DISTINCT terms, string_split(terms, ' ') AS phrase FROM windows),
rarest AS (
    SELECT * FROM (SELECT phrase, unnest(phrase) AS word, unnest(range(len(phrase))) AS off FROM kinds) LEFT JOIN often USING (word)
    QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY COALESCE(places, 0), off) = 1),
near AS (
    SELECT doc_id, COUNT(*) AS n_near FROM (
        SELECT doc_id, phrase, pos - off AS start FROM rarest JOIN tokens USING (word) WHERE pos - off >= -{SLACK}) JOIN d USING (doc_id)
    WHERE len(list_filter(range(len(phrase)), lambda i: list_contains(
            w[greatest(start + i + 1 - {SLACK}, 1):start + i + 1 + {SLACK}], phrase[i + 1]))) = len(phrase)
        AND NOT (start >= 0 AND w[greatest(start, 0) + 1:greatest(start, 0) + len(phrase)] = phrase)
    GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(listed, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated, CAST(COALESCE(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)"""


# ---- secrets ------------------------------------------------------------------------------------------------------


def _kind(number: int, kind: secrets.Kind) -> str:
    pattern = text(kind.pattern)
    extra = "".join(f" AND regexp_matches(matches[i], {text(also)})" for also in kind.also)
    return f"""SELECT doc_id, {number} AS kind, i,
            len(array_to_string(gaps[1:i], '')) + len(array_to_string(matches[1:i - 1], '')) AS start, len(matches[i]) AS size
        FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS matches,
                   regexp_extract_all(t, {pattern}, {kind.group}) AS vals FROM d WHERE regexp_matches(t, {pattern})))
        WHERE len(vals[i]) >= {kind.least}{extra}"""


def _numbers(test) -> str:
    return ", ".join(str(n) for n, kind in enumerate(secrets.KINDS) if test(kind))


def _sides(name: str, test) -> str:
    inside = f"kind IN ({_numbers(test)})"
    return f"""MAX(CASE WHEN {inside} THEN finish END) OVER before AS {name}_before,
        MIN(CASE WHEN {inside} THEN start END) OVER after AS {name}_after"""


def _beside(name: str, most: int) -> str:
    return f"(COALESCE(start - {name}_before <= {most}, FALSE) OR COALESCE({name}_after - finish <= {most}, FALSE))"


_NAMES = texts(kind.name for kind in secrets.KINDS)
_STRONG = _numbers(lambda kind: kind.strong)
_REACH = secrets.REACH
_LISTED = f"string_agg({_NAMES}[kind + 1] || ':' || start || ':' || finish, ',' ORDER BY start, kind, finish)"
SECRETS = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
parts AS (SELECT doc_id, kind, start, start + size AS finish FROM (
    {' UNION ALL '.join(_kind(n, kind) for n, kind in enumerate(secrets.KINDS))})),
swept AS (
    SELECT *, {_sides('identifier', lambda kind: kind.role == 'identifier')},
        {_sides('secret', lambda kind: kind.role == 'secret')}, {_sides('strong', lambda kind: kind.strong)}
    FROM parts WINDOW
        before AS (PARTITION BY doc_id ORDER BY start, kind, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (PARTITION BY doc_id ORDER BY start, kind, finish ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
judged AS (
    SELECT *, kind IN ({_STRONG}) OR (NOT COALESCE(strong_before >= finish, FALSE) AND CASE
        WHEN kind IN ({_numbers(lambda kind: kind.role == 'identifier')}) THEN {_beside('secret', _REACH)}
        WHEN kind IN ({_numbers(lambda kind: kind.role == 'secret')}) THEN {_beside('identifier', _REACH)}
        ELSE {_beside('secret', _REACH)} AND {_beside('identifier', _REACH)} END) AS reported
    FROM swept),
listed AS (
    SELECT doc_id, {_LISTED} FILTER (kind IN ({_STRONG})) AS base, {_LISTED} FILTER (reported) AS spans,
        {', '.join(f'COUNT(*) FILTER (kind = {n}) AS n_{kind.name}' for n, kind in enumerate(secrets.KINDS) if kind.strong)}
    FROM judged GROUP BY doc_id)
SELECT doc_id, {', '.join(f'COALESCE(n_{name}, 0) AS n_{name}' for name in secrets.STRONG)},
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


# ---- near-duplicates ----------------------------------------------------------------------------------------------

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({lowered("COALESCE(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
classes AS (SELECT list_sort(shingles) AS shingles, MIN(doc_id) AS node FROM sets WHERE len(shingles) > 0 GROUP BY 1),
postings AS (SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM classes),
links AS (
    SELECT a.node AS one, b.node AS two FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
reach(node, other) AS (
    SELECT node, node FROM classes UNION SELECT reach.node, links.two FROM reach JOIN links ON links.one = reach.other),
components AS (SELECT node, MIN(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, COALESCE(component, s.doc_id) AS component_id,
       COALESCE(component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.shingles = list_sort(s.shingles) LEFT JOIN components USING (node)"""


# ---- ranked search ------------------------------------------------------------------------------------------------

_TERMS = f"regexp_extract_all({lowered("COALESCE(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT COUNT(*) FILTER (len(w) > 0) AS docs, SUM(len(w)) AS terms FROM d),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (
    SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
    FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
measure AS (
    SELECT doc_id, CAST({ranking.LENGTH_BASE - ranking.LENGTH_SHARE}
        + ({ranking.LENGTH_SHARE} * CAST(len(w) AS HUGEINT) * docs) // terms AS BIGINT) AS m FROM d, totals WHERE len(w) > 0),
scored AS (
    SELECT item_id, doc_id, CAST(SUM(times * w * (({ranking.SCALE} * tf) // (1000 * tf + {ranking.SATURATION} * m))) AS BIGINT) AS score
    FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN measure USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= {ranking.TOP}"""


# ---- resampling ---------------------------------------------------------------------------------------------------

# CRC-32 by its table, which follows from the polynomial 0xEDB88320.
_CRC_TABLE = """list_transform(range(0, 256), lambda n: list_reduce(range(0, 8),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"""
_BYTES = "list_transform(range(0, octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT))"


def _features(table: str, id_: str) -> str:
    return f"""SELECT {id_}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
        FROM (SELECT {id_}, {words('text')} AS w FROM {table})"""


_B, _K = resampling.BUCKETS, resampling.SEED
RESAMPLED = f"""
WITH own AS ({_features('documents', 'doc_id')}), wanted AS ({_features('benchmark', 'item_id')}),
kinds AS (SELECT feature FROM own UNION SELECT feature FROM wanted),
crc AS (SELECT {_CRC_TABLE} AS t),
buckets AS (
    SELECT feature, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {_B} AS bucket
    FROM kinds, crc),
s AS (SELECT bucket, COUNT(*) AS s FROM own JOIN buckets USING (feature) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS t FROM wanted JOIN buckets USING (feature) GROUP BY bucket),
whole AS (SELECT (SELECT COUNT(*) FROM own) AS sum_s, (SELECT COUNT(*) FROM wanted) AS sum_t),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST((COALESCE(t, 0) + 1) * (sum_s + {_B}) AS DOUBLE)
        / CAST((s + 1) * (sum_t + {_B}) AS DOUBLE))) AS BIGINT) AS gain
    FROM s LEFT JOIN t USING (bucket), whole),
weights AS (
    SELECT doc_id, COUNT(*) AS n_features, CAST(SUM(gain) AS BIGINT) AS total
    FROM own JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len({words('text')}) AS n_words, COALESCE(n_features, 0) AS n_features,
        COALESCE((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        CAST('0x' || substr(sha256('{_K}:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM documents LEFT JOIN weights USING (doc_id)),
rows AS (
    SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
        n_words >= {resampling.LEAST_WORDS} AS able FROM scored),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER (PARTITION BY able) AS n FROM rows)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN able AND place <= n * {resampling.PERCENT} // 100 THEN place END AS rank
FROM placed"""


LLM_STATEMENTS: dict[str, str] = {
    "op1_license_scans": LICENSES,
    "op3_url_filters": URLS,
    "op4_warc_archives": ARCHIVES,
    "op5_exact_top_k": TOP_K,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op7_secret_scans": SECRETS,
    "op8_minhash_near_dedup": NEAR_DUPLICATES,
    "op12_ranked_lexical_search": RANKED,
    "op13_importance_resampling": RESAMPLED,
}
