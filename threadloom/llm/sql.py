"""DuckDB equivalents of the corpus queries that SQL can express on whole tables.

Classifiers, tokenizers, detectors of personal data, the annotator model and similarity joins have
none; their tests compare with brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from threadloom.llm.consensus import INTENTS
from threadloom.llm.leaks import WORDS
from threadloom.llm.spans import LENGTH

PAIRS = "applesupport_pairs"


def _alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


# Records by content: ordered keys, and order-free keys of texts made of three or more named fields.
_RECORDS = (
    f"WITH RECURSIVE t AS (SELECT row_id, {_alnum('\"customerTextClean\"')} AS k, [p FOR p IN string_split_regex(\"customerTextClean\", '[;|\\r\\n]') IF trim(p) <> ''] AS parts FROM {PAIRS}), "
    f"keyed AS (SELECT row_id, 'k' || k AS k, CASE WHEN len(parts) >= 3 AND len([p FOR p IN parts IF regexp_matches(p, '(?s)^\\s*[\\p{{L}}\\p{{N}}][^:]*:.*[\\p{{L}}\\p{{N}}]')]) = len(parts) "
    f"THEN 'f' || array_to_string(list_sort([{_alnum('p')} FOR p IN parts]), ' ') END AS f FROM t WHERE k <> ''), "
    "edge AS (SELECT DISTINCT k AS a, f AS b FROM keyed WHERE f IS NOT NULL), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), "
    "reach(n, r) AS (SELECT a, a FROM both_ways UNION SELECT x.b, reach.r FROM reach JOIN both_ways x ON x.a = reach.n), "
    "root AS (SELECT n, min(r) AS r FROM reach GROUP BY n), "
    "rec AS (SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(r, k)) AS first_row_id FROM keyed LEFT JOIN root ON n = k)"
)

_LABEL = "regexp_replace(regexp_replace(lower(trim({c})), '[\\s_\\-./]+', '_', 'g'), '^_+|_+$', '', 'g')"
_VOTES = (
    "WITH raw AS (SELECT trim(\"goldenId\") AS item, trim(annotator_a_id) AS ann, " + _LABEL.format(c='"annotatorA"') + " AS label, NULL::TIMESTAMP AS tm, NULL::BIGINT AS id FROM golden_agreement "
    "UNION ALL SELECT trim(\"goldenId\"), trim(annotator_b_id), " + _LABEL.format(c='"annotatorB"') + ", NULL, NULL FROM golden_agreement "
    "UNION ALL SELECT trim(golden_id), trim(annotator_id), " + _LABEL.format(c="vote_label") + ", voted_at, vote_id FROM golden_votes), "
    "vote AS (SELECT item, ann, label FROM raw WHERE item IS NOT NULL AND ann <> '' AND label IN (" + ", ".join(f"'{x}'" for x in INTENTS) + ") "
    "QUALIFY row_number() OVER (PARTITION BY item, ann ORDER BY tm DESC NULLS LAST, id DESC NULLS LAST, label DESC) = 1), "
    "per AS (SELECT item, sum(n) AS n, sum(n * (n - 1) / 2) AS agree FROM (SELECT item, label, count(*) AS n FROM vote GROUP BY ALL) GROUP BY item HAVING sum(n) >= 3)"
)

_WORDS = "regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
_GRAM = "SELECT {i}, array_to_string(w[j : j + " + str(WORDS - 1) + "], ' ') AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - " + str(WORDS - 2) + ")) AS j FROM (SELECT {i}, " + _WORDS + " AS w FROM {t}))"
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAM.format(i='doc_id', x='text', t='documents')}) JOIN ({_GRAM.format(i='item_id', x='item_text', t='eval_items')}) USING (g)"

_SPANS = (
    f"WITH w AS (SELECT doc_id, p - 1 AS a, substring(text, p, {LENGTH}) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - {LENGTH - 2})) AS p FROM documents WHERE length(text) >= {LENGTH})), "
    f"shared AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), hit AS (SELECT DISTINCT doc_id, a, a + {LENGTH} AS b FROM w JOIN shared USING (s)), "
    "isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hit)), "
    "span AS (SELECT doc_id, min(a) AS start_pos, max(b) AS end_pos FROM isle GROUP BY doc_id, g)"
)

_AT = (
    "CASE WHEN regexp_full_match(c, '\\d{13}') THEN CAST(c AS BIGINT) * 1000 WHEN regexp_full_match(c, '\\d{1,11}') THEN CAST(c AS BIGINT) * 1000000 "
    "WHEN regexp_matches(c, '^\\d{4}-') THEN epoch_us(TRY_CAST(c AS TIMESTAMPTZ)) ELSE epoch_us(try_strptime(c, '%a %b %d %H:%M:%S %z %Y')) END"
)
_CONVERSATIONS = (
    "WITH RECURSIVE src AS (SELECT row_id, trim(\"customerTweetId\") AS cid, nullif(trim(\"supportTweetId\"), '') AS sid, nullif(trim(\"customerInResponseToId\"), '') AS irt, "
    "coalesce(\"isInitialInquiry\", coalesce(trim(\"customerInResponseToId\"), '') = '') AS opens, "
    "coalesce(trim(\"supportTweetId\"), '') = '' OR regexp_replace(coalesce(\"customerTextClean\", ''), '\\s', '', 'g') = '' OR regexp_replace(coalesce(\"supportTextClean\", ''), '\\s', '', 'g') = '' AS bad, "
    f"trim(\"customerCreatedAt\") AS c FROM {PAIRS} WHERE coalesce(trim(\"customerTweetId\"), '') <> ''), "
    f"v AS (SELECT *, {_AT} AS tm0 FROM src QUALIFY row_number() OVER (PARTITION BY cid ORDER BY row_id) = 1), "
    "x AS (SELECT *, coalesce(tm0, -9223372036854775808) AS tm FROM v), "
    "link AS (SELECT a.cid, b.cid AS up, b.row_id AS up_row, a.opens FROM x a JOIN x b ON a.irt = b.sid), "
    "main AS (SELECT cid, arg_min(up, up_row) AS up FROM link GROUP BY cid), "
    "walk(cid, root, key) AS (SELECT cid, cid, [struct_pack(t := tm, r := row_id)] FROM x WHERE opens OR cid NOT IN (SELECT cid FROM main) "
    "UNION ALL SELECT x.cid, walk.root, list_concat([e FOR e IN walk.key IF e > struct_pack(t := x.tm, r := x.row_id)], [struct_pack(t := x.tm, r := x.row_id)]) FROM walk JOIN main ON main.up = walk.cid JOIN x ON x.cid = main.cid AND NOT x.opens), "
    "crossed AS (SELECT a.root AS r1, b.root AS r2 FROM link JOIN main USING (cid) LEFT JOIN walk a ON a.cid = link.cid LEFT JOIN walk b ON b.cid = link.up WHERE (link.opens OR link.up <> main.up) AND a.root IS DISTINCT FROM b.root), "
    "whole AS (SELECT root FROM walk JOIN x USING (cid) GROUP BY root HAVING NOT bool_or(bad) AND bool_or(opens AND x.cid = root)), "
    "placed AS (SELECT walk.*, sid, row_number() OVER (PARTITION BY root ORDER BY key) AS n FROM walk JOIN x USING (cid) WHERE root IN (SELECT root FROM whole) AND root NOT IN (SELECT r1 FROM crossed WHERE r1 IS NOT NULL UNION SELECT r2 FROM crossed WHERE r2 IS NOT NULL)) "
    "SELECT root AS root_tweet_id, 2 * n - 1 AS turn_no, cid AS tweet_id, 'customer' AS speaker FROM placed UNION ALL SELECT root, 2 * n, sid, 'support' FROM placed"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_RECORDS} SELECT first_row_id, row_id FROM rec WHERE row_id <> first_row_id",
        "p2_records": f"{_RECORDS} SELECT first_row_id, count(*) AS n_copies FROM rec GROUP BY first_row_id",
        "p3_agreement": f"{_VOTES} SELECT count(*) AS n_items, round(sum(agree) / sum(n * (n - 1) / 2), 4) AS pairwise_agreement, CAST(count_if(agree = n * (n - 1) / 2) AS BIGINT) AS n_unanimous FROM per",
        "p5_found": _CONVERSATIONS,
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p9_found": _LEAKS,
        "p9_items": f"SELECT item_id, count(*) AS n_docs FROM ({_LEAKS}) GROUP BY item_id",
        "p10_found": f"{_SPANS} SELECT doc_id, start_pos, end_pos FROM span",
        "p10_parts": f"{_SPANS}, per AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(end_pos - start_pos) AS BIGINT) AS shared_chars FROM span GROUP BY doc_id) "
        "SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, "
        "CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 4) ELSE 0.0 END AS shared_part FROM documents LEFT JOIN per USING (doc_id)",
    }
