"""SQL for the rows of those registered queries that SQL can express."""

from __future__ import annotations

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
        FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM f
"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in fields) + ")"


def _tree(name: str, key: str, start: str) -> str:
    """Nodes of all levels of the trees that ``start`` gives the leaves of."""
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT {key}, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
        FROM {name} WHERE n > 1 GROUP BY {key}, lvl, pos // 16
    ), {name}_runs AS (
        SELECT {key}, lvl, pos // 16 AS parent, list(digest ORDER BY pos) AS digests FROM {name} WHERE n > 1 GROUP BY {key}, lvl, pos // 16
    )"""


_SIBLINGS = "r.digests[:c.pos % 16]", "r.digests[c.pos % 16 + 2:]"

#: crc32 of the decimal id, over a table of 256 values made on the spot.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def _climb(name: str, tree: str, key: str, start: str) -> str:
    before, after = _SIBLINGS
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT c.doc_id, c.source, c.lvl + 1, c.pos // 16,
               sha256(array_to_string({before} || [c.folded] || {after}, '')),
               c.proof || array_to_string({before} || {after}, '')
        FROM {name} c JOIN {tree}_runs r ON {key} AND c.lvl = r.lvl AND c.pos // 16 = r.parent
    )"""


MERKLE = f"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
    ), leaves AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE {_leaf("text")} END AS changed,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
        FROM documents, crc
    ), {_tree("nodes", "source", "SELECT source, 0 AS lvl, pos, leaf AS digest, n FROM leaves")}, subroots AS (
        SELECT source, digest, lvl, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), {_tree("tops", "tree", "SELECT 0 AS tree, 0 AS lvl, pos, digest, n FROM subroots")},
    {_climb("climb", "nodes", "c.source IS NOT DISTINCT FROM r.source", "SELECT doc_id, source, 0 AS lvl, pos, changed AS folded, '' AS proof FROM leaves")},
    {_climb("ascent", "tops", "r.tree = 0", '''SELECT c.doc_id, c.source, 0 AS lvl, s.pos, c.folded, c.proof
        FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source AND c.lvl = s.lvl''')}
    SELECT a.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = t.digest AS verified
    FROM ascent a JOIN (SELECT lvl, digest FROM tops WHERE n = 1) t ON a.lvl = t.lvl
    JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source JOIN leaves l ON a.doc_id = l.doc_id
"""

QUALITY = r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT doc_id, start, array_to_string(words[start + 1:start + 8], ' ') AS spelled
        FROM (SELECT doc_id, words, unnest(range(len(words) - 7)) AS start FROM t WHERE len(words) >= 8)
    ), repeated AS (
        SELECT doc_id, count(DISTINCT place) AS n
        FROM (SELECT doc_id, unnest(range(start, start + 8)) AS place
              FROM (SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, spelled) AS n FROM windows) WHERE n > 1)
        GROUP BY doc_id
    ), m AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM t LEFT JOIN repeated r USING (doc_id)
    ), f AS (
        SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
                  + 8 * (10 * n_symbols > n_words)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT + 32 * (word_chars > 10 * n_words)::BIGINT AS failed
        FROM m
    )
    SELECT *, failed & 3 = 0 AS kept_v1, failed & 15 = 0 AS kept_v2, failed & 63 = 0 AS kept_v3, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept
    FROM f
"""

LEXICAL = rf"""
    WITH d AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
    ), lengths AS (
        SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
    ), totals AS (
        SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
    ), normal AS (
        SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM lengths, totals
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
    ), scores AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
        FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN normal USING (doc_id) GROUP BY item_id, doc_id
    )
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
