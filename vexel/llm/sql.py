"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from vexel.llm import quality_rules as rules
from vexel.llm import secret_scan, sharding

_BLANK = r"[\x20\x09-\x0D]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_BLANK}+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAREST = """
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id,
            sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)))) AS score
        FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0))
WHERE rank <= 10
"""

JACCARD = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
    SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
    JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

ARCHIVE = """
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
    CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS size, sha256(coalesce(html, '')) AS digest FROM pages))
"""


def quality() -> str:
    """The quality rules, thresholds and word lists taken from their module."""

    def listed(words: list[str]) -> str:
        return "[" + ", ".join(map(_quoted, words)) + "]"

    choice = " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in rules.COMMON_WORDS.items())
    classes = ["[^a-z]", "[^A-Z]", "[^0-9]", "[^#*$%&|<>]", r"[^.,;:!?''\"()\-]", r"[a-zA-Z0-9#*$%&|<>.,;:!?''\"()\-]"]
    chars = ", ".join(f"len(regexp_replace(solid, '{c}', '', 'g'))" for c in classes)
    sums = {c: ", ".join(f"sum(floor(1000 * {c}[{k + 1}] / nullif(list_sum({c}), 0)))::DOUBLE" for k in range(n)) for c, n in (("chars", 6), ("common", 13))}

    def distance(p: str, q: str) -> str:
        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({x} + {y}) / 2)) ELSE 0 END"
        total = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(x)} + {part(y)}) / 2))"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({total}, 0)) ELSE 0 END"

    return f"""
WITH w AS (
    SELECT doc_id, text, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS tongue, {_words("text")} AS w FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) t(i) WHERE len(w) >= 8
), cover AS (
    SELECT doc_id, count(DISTINCT i + k) AS c FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), range(0, 8) t(k) GROUP BY doc_id
), h AS (
    SELECT *, len(w) AS n, array_to_string(w, '') AS solid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        CASE tongue {choice} ELSE {listed(rules.OTHER_WORDS)} END AS known FROM w
), f AS (
    SELECT *, [{chars}] AS chars, list_transform(known, lambda k: len(list_filter(w, lambda y: y = k OR y = upper(k[1]) || k[2:]))) AS hits FROM h
), c AS (SELECT f.*, list_append(hits, n - list_sum(hits)) AS common, coalesce(cover.c, 0) AS again FROM f LEFT JOIN cover USING (doc_id)
), r AS (
    SELECT tongue, [{sums["chars"]}] AS rc, [{sums["common"]}] AS rw FROM c
    WHERE NOT (n < {rules.MIN_WORDS} OR 100 * again > {rules.MAX_REPEAT_PERCENT} * n) GROUP BY tongue
), d AS (
    SELECT doc_id, n, solid, lines, chars, again, {distance("chars", "rc")} AS dc, {distance("common", "rw")} AS dw
    FROM c LEFT JOIN r USING (tongue)
)
SELECT doc_id, n::BIGINT AS n_words, len(solid)::BIGINT AS word_chars, chars[4]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    again::BIGINT AS n_repeat_words, n < {rules.MIN_WORDS} OR 100 * again > {rules.MAX_REPEAT_PERCENT} * n AS base_failed,
    NOT (n < {rules.MIN_WORDS} OR 100 * again > {rules.MAX_REPEAT_PERCENT} * n OR (n >= {rules.MIN_FOR_CHARS} AND dc > {rules.MAX_CHAR_DISTANCE}) OR (n >= {rules.MIN_FOR_WORDS} AND dw > {rules.MAX_WORD_DISTANCE})) AS kept
FROM d
"""


def secrets() -> str:
    """All rules over all texts, without an index."""
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        p = _quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(p[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT, 'n': len(m[i]), 'v': len(v[i])}})) AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {rule.value_group}) AS v, string_split_regex(text, {p}) AS p FROM documents WHERE regexp_matches(text, {p}))"
        )
    least = " ".join(f"WHEN {k} THEN {r.min_chars}" for k, r in enumerate(secret_scan.RULES))
    counts = ", ".join(f"count(*) FILTER (rank = {k})::BIGINT AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE))
    span = "kind || ':' || start || ':' || stop"
    return f"""
WITH f AS (SELECT doc_id, rank, kind, s.a AS start, s.a + s.n AS stop FROM ({" UNION ALL ".join(parts)}) WHERE s.v >= CASE rank {least} END)
SELECT d.doc_id, {counts},
    sha256(coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (rank < {len(secret_scan.BASE)}), '')) AS base_sha256,
    coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


def placement() -> str:
    """Look-ups in the table, which is filled outside of SQL and tested against a plain version."""
    owners = ",".join(map(str, sharding.lookup_table(list(sharding.SHARDS), sharding.SLOTS)))
    slot = f"(('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT % {sharding.SLOTS})"
    names = "[" + ", ".join(map(_quoted, sharding.SHARDS)) + "]"
    return f"WITH t AS (SELECT string_split('{owners}', ',') AS t, {names} AS names) SELECT doc_id, {slot} AS slot, names[t[{slot} + 1]::INTEGER + 1] AS shard FROM documents, t"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest_neighbours": NEAREST,
        "op2_jaccard_join": JACCARD,
        "op3_archive_pages": ARCHIVE,
        "op4_quality_rules": quality(),
        "op5_find_secrets": secrets(),
        "op8_shard_documents": placement(),
    }
