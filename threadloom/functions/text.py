"""Text cleaning, entities and tokens as column expressions.

Everything here is a plain Catalyst expression: no Python runs per row. Patterns that decide results
are ASCII where they must be (``\\w`` and ``[a-z0-9]``), and lengths count UTF-16 units where the
published thresholds do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order they are decoded, glitch code points, link and handle patterns.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
GLITCHES = "[\\uFE0F\\u200D\\uFFFD]"
LINK = "https?://t\\.co/[A-Za-z0-9]+"
HANDLE = "@\\w+"
SPACE = "(?U:\\s)+"
EDGES = "^(?U:\\s)+|(?U:\\s)+\\z"
# Function words that the retrieval and vector tokenizers leave out.
STOPWORDS = "the a an and or in on at to for of with by from as into like through after over between out against during without before under around among".split()
# Words written apart that are joined before tokenizing.
JOINED_TFIDF = [("wi-fi", "wifi"), ("apple\\s+id", "appleid"), ("app\\s+store", "appstore")]
JOINED_BM25 = [*JOINED_TFIDF, ("face\\s+id", "faceid"), ("touch\\s+id", "touchid")]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: str | Column) -> Column:
    """Trim of every Unicode white space, not only blanks."""
    return F.regexp_replace(_c(x), EDGES, "")


def unescape_html(x: str | Column) -> Column:
    """Decode the seven entities one after the other; null counts as empty."""
    out = F.coalesce(_c(x), F.lit(""))
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_text(x: str | Column) -> Column:
    """Decoded text without glitch code points, links and handles, white space collapsed."""
    out = F.regexp_replace(unescape_html(x), GLITCHES, "")
    for p in (LINK, HANDLE, SPACE):
        out = F.regexp_replace(out, p, " ")
    return trim_all(out)


def mentions(x: str | Column) -> Column:
    return F.regexp_extract_all(unescape_html(x), F.lit(HANDLE), F.lit(0))


def urls(x: str | Column) -> Column:
    return F.regexp_extract_all(unescape_html(x), F.lit(LINK), F.lit(0))


def entities(x: str | Column) -> Column:
    """Struct of mentions, links and two flags."""
    m, u = mentions(x), urls(x)
    return F.struct(m.alias("mentions"), u.alias("urls"), (F.size(u) > 0).alias("has_url"), (F.size(m) > 1).alias("has_multiple_mentions"))


def split_ids(x: str | Column) -> Column:
    """Ids of a comma list; blank gives an empty array."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ","))


def parse_bool(x: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))) == "true", F.lit(False))


def is_blank(x: str | Column) -> Column:
    return F.coalesce(trim_all(x), F.lit("")) == ""


def first_text(*xs: str | Column) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in xs], F.lit(""))


def pair_id(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws("_", F.lit("pair"), _c(a), _c(b))


def padded_id(prefix: str, n: str | Column, width: int = 3) -> Column:
    """Zero-padded ordinal; longer numbers are kept whole."""
    s = _c(n).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def utf16_length(x: str | Column) -> Column:
    return (F.octet_length(F.encode(_c(x), "UTF-16BE")) / 2).cast("int")


def norm_taxonomy(x: str | Column) -> Column:
    """Lower case, straight quotes, single blanks, not trimmed."""
    out = F.lower(F.coalesce(_c(x), F.lit("")))
    out = F.regexp_replace(out, '["\\u201C\\u201D]', " ")
    return F.regexp_replace(F.regexp_replace(out, "[\\u2018\\u2019]", "'"), SPACE, " ")


def norm_proposal(x: str | Column) -> Column:
    return trim_all(norm_taxonomy(x))


def _tokens(x: str | Column, joined: list[tuple[str, str]]) -> Column:
    t = F.replace(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("&amp;"), F.lit("&"))
    for p in (LINK, HANDLE, '["\\u201C\\u201D]'):
        t = F.regexp_replace(t, p, " ")
    t = F.regexp_replace(F.regexp_replace(t, "[\\u2018\\u2019]", "'"), GLITCHES, " ")
    for a, b in joined:
        t = F.regexp_replace(t, a, b)
    found = F.regexp_extract_all(t, F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))
    return F.filter(found, lambda w: ((F.length(w) > 1) | (w == "i")) & ~w.isin(STOPWORDS))


def tokens_bm25(x: str | Column) -> Column:
    return _tokens(x, JOINED_BM25)


def unigrams_tfidf(x: str | Column) -> Column:
    return _tokens(x, JOINED_TFIDF)


def bigrams(tokens: str | Column, sep: str = "_") -> Column:
    """Neighbouring tokens joined; none of fewer than two tokens."""
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(sep), b))


def tokens_tfidf(x: str | Column) -> Column:
    """Unigrams, then bigrams of what is left after the stop words."""
    t = unigrams_tfidf(x)
    return F.concat(t, bigrams(t))


def tokens_discovery(x: str | Column, stopwords: list[str] | None = None) -> Column:
    """ASCII words of more than two characters outside a given list."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9\\s]", " "), "\\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & (~w.isin(stopwords) if stopwords else F.lit(True)))


def strip_code_fence(x: str | Column) -> Column:
    """The trimmed text without one fence before it and one behind it; fences inside stay, null stays null."""
    return trim_all(F.regexp_replace(F.regexp_replace(_c(x), "(?i)^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*\\z", ""))


WORD = "[A-Za-z0-9_]"


def keyword_parts(words: list[str]) -> tuple[str, str]:
    """Alternatives that end in a word character, and those that do not and so are bounded by one that follows."""
    spelled = ["\\s+".join(re.escape(x).replace("\\-", "-") for x in w.split()) for w in words]
    inner = [x for x, w in zip(spelled, words) if re.search(WORD + "$", w)]
    return "|".join(inner), "|".join(x for x in spelled if x not in inner)


def keyword_pattern(words: list[str]) -> str:
    """One case-insensitive pattern that matches any of the words whole; blanks match any white space."""
    inner, other = keyword_parts(words)
    parts = [f"(?:{inner})(?!{WORD})"] * bool(inner) + [f"(?:{other})(?={WORD})"] * bool(other)
    return f"(?i)(?<!{WORD})(?:{'|'.join(parts)})"


SENSITIVE_KEYS = ["apikey", "api_key", "authorization", "bearer", "password", "secret", "token", "access_token", "gemini_api_key", "openai_api_key"]


def parsed_json(x: str | Column, schema: str) -> Column:
    """Struct of the fields of a JSON text (null where it is none) and, there, the ``error`` that says so."""
    c = F.trim(_c(x))
    bad = F.try_parse_json(c).isNull()
    error = F.when(c.isNull() | (c == ""), "empty").when(bad, "invalid")
    return F.struct(F.when(~bad, F.from_json(c, schema)).alias("value"), error.alias("error"))


def redact_json(x: str | Column, keys: list[str] | None = None, mask: str = "[REDACTED]") -> Column:
    """A JSON text with the simple values of sensitive keys masked at every depth, whatever the keys' case."""
    names = "|".join(k.replace(".", "\\.") for k in keys or SENSITIVE_KEYS)
    return F.regexp_replace(_c(x), rf'(?i)("(?:{names})"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)', rf'$1"{mask}"')


def redact_keys(x: str | Column, keys: list[str] = SENSITIVE_KEYS, mask: str = "[REDACTED]", depth: int = 1) -> Column:
    """A string map, or one nested ``depth`` maps deep, with the values of sensitive keys masked, whatever their case.

    Below a sensitive outer key every value is masked.
    """
    def masked(m: Column, level: int, inside: Column) -> Column:
        def value(k: Column, v: Column) -> Column:
            hit = inside | F.lower(k).isin([s.lower() for s in keys])
            return masked(v, level - 1, hit) if level > 1 else F.when(hit, F.lit(mask)).otherwise(v)

        return F.transform_values(m, value)

    return masked(_c(x), depth, F.lit(False))
