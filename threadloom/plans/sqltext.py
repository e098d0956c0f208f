"""DuckDB spellings of the text functions, for the oracles."""

from __future__ import annotations

from threadloom.functions.text import ENTITIES, JOINED_BM25, JOINED_TFIDF, STOPWORDS, keyword_parts

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINK = r"https?://t\.co/[A-Za-z0-9]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def trim_all(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def blank(x: str) -> str:
    return f"(coalesce({trim_all(x)}, '') = '')"


def unescape(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a, b in ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def clean(x: str) -> str:
    x = sub(unescape(x), r"[\x{FE0F}\x{200D}\x{FFFD}]", "")
    for p in (LINK, r"@\w+", WS + "+"):
        x = sub(x, p, " ")
    return trim_all(x)


def norm(x: str) -> str:
    x = sub(f"lower(coalesce({x}, ''))", r'["\x{201C}\x{201D}]', " ")
    return sub(sub(x, r"[\x{2018}\x{2019}]", "'"), WS + "+", " ")


def true(x: str) -> str:
    return f"(coalesce(lower(trim({x})), '') = 'true')"


def ids(x: str) -> str:
    return f"(CASE WHEN trim(coalesce({x}, '')) = '' THEN []::VARCHAR[] ELSE string_split(trim({x}), ',') END)"


def tokens(x: str, joined: list[tuple[str, str]]) -> str:
    t = f"replace(lower(coalesce({x}, '')), '&amp;', '&')"
    for p in (LINK, r"@\w+", r'["\x{201C}\x{201D}]'):
        t = sub(t, p, " ")
    t = sub(sub(t, r"[\x{2018}\x{2019}]", "'"), r"[\x{FE0F}\x{200D}\x{FFFD}]", " ")
    for a, b in joined:
        t = sub(t, a, b)
    stop = ", ".join(map(q, STOPWORDS))
    return f"[w FOR w IN regexp_extract_all({t}, {q('[a-z0-9]+(?:' + chr(39) + '[a-z]+)?')}) IF (length(w) > 1 OR w = 'i') AND w NOT IN ({stop})]"


def tokens_bm25(x: str) -> str:
    return tokens(x, JOINED_BM25)


def tokens_tfidf(x: str) -> str:
    """Unigrams and bigrams of them, given the name of a column that holds the unigrams."""
    return f"list_concat({x}, [{x}[i] || '_' || {x}[i + 1] FOR i IN range(1, len({x}))])"


def unigrams(x: str) -> str:
    return tokens(x, JOINED_TFIDF)


def keyword(x: str, words: list[str]) -> str:
    inner, other = keyword_parts(words)
    parts = [f"(?:{inner})(?:[^A-Za-z0-9_]|$)"] * bool(inner) + [f"(?:{other})[A-Za-z0-9_]"] * bool(other)
    return f"regexp_matches(coalesce({x}, ''), {q('(?i)(?:^|[^A-Za-z0-9_])(?:' + '|'.join(parts) + ')')})"
