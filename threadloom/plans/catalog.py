"""Queries over the tables, each with the DuckDB statement it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import bulk, classify, metrics, pairing, ranking, retrieval, rules, sampling
from threadloom.plans import sqltext as S
from threadloom.session import Scratch, load
from threadloom.sources import files
from threadloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PAIRS, GOLDEN, AGREE, VOTES, DOCS = "applesupport_pairs", "golden_set", "golden_agreement", "golden_votes", "documents"
BRAND = "AppleSupport"
KS = [1, 3, 5, 10]
QUOTAS = {"account_icloud": 25, "apps_appstore": 20, "audio_media": 20, "battery_power": 40, "billing_subscriptions": 25, "connectivity_network": 18, "display_hardware": 18, "keyboard_typing": 16, "software_update": 10, "other_unclear": 8}
SEED = 20260909


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sources and sinks: written to the shared folder and read again.


@query("SELECT " + ", ".join(f"coalesce({c.split()[0]}, '') AS {c.split()[0]}" for c in files.TWEETS.split(", ")) + " FROM tweets")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    tweets = load(spark, d, "tweets")
    path = Scratch(spark, "csv").base
    files.write_csv(tweets, path)
    back = files.read_csv(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query(f'SELECT row_id, coalesce("customerTextRaw", \'\') AS raw, coalesce("isInitialInquiry", false) AS initial, CAST(len(entities."customerMentions") AS INTEGER) AS n_mentions FROM {PAIRS}')
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    pairs = load(spark, d, PAIRS)
    path = Scratch(spark, "jsonl").base
    files.write_jsonl(pairs, path, gzip=True)
    back = files.read_jsonl(spark, path, pairs.schema)
    return back.select("row_id", F.coalesce("customerTextRaw", F.lit("")).alias("raw"), F.coalesce("isInitialInquiry", F.lit(False)).alias("initial"), F.size("entities.customerMentions").alias("n_mentions"))


@query(f"SELECT count(*) AS n_pairs, count(DISTINCT \"customerAuthorId\") AS n_authors FROM {PAIRS}")
def sink_json_summary(spark: SparkSession, d: str) -> DataFrame:
    one = load(spark, d, PAIRS).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("customerAuthorId").alias("n_authors"))
    path = Scratch(spark, "summary").base
    one.write.json(path)
    return files.read_document(spark, path, one.schema)


_REPORT = 'SELECT "evaluationLabel" AS label, count(*) AS n FROM golden_set WHERE "evaluationLabel" IS NOT NULL GROUP BY 1'


@query(f"SELECT 1 AS line_no, '| label | n |' AS line UNION ALL SELECT 2, '| --- | --- |' UNION ALL SELECT 2 + row_number() OVER (ORDER BY label), '| ' || label || ' | ' || n || ' |' FROM ({_REPORT})")
def sink_markdown(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, GOLDEN).where("evaluationLabel is not null").groupBy(F.col("evaluationLabel").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return files.markdown_table(per, ["label"])


# Scalar text functions.


@query(f"SELECT row_id, {S.unescape('\"customerTextRaw\"')} AS text FROM {PAIRS}")
def unescape_html(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.unescape_html("customerTextRaw").alias("text"))


@query(f"SELECT row_id, {S.clean('\"customerTextRaw\"')} AS text FROM {PAIRS}")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.clean_text("customerTextRaw").alias("text"))


@query(
    f"SELECT row_id, array_to_string(m, ' ') AS mentions, array_to_string(u, ' ') AS urls, len(u) > 0 AS has_url, len(m) > 1 AS has_multiple_mentions FROM "
    f"(SELECT row_id, regexp_extract_all(t, '@\\w+') AS m, regexp_extract_all(t, {S.q(S.LINK)}) AS u FROM (SELECT row_id, {S.unescape('\"customerTextRaw\"')} AS t FROM {PAIRS}))"
)
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, PAIRS).select("row_id", T.entities("customerTextRaw").alias("e"))
    return e.select("row_id", F.array_join("e.mentions", " ").alias("mentions"), F.array_join("e.urls", " ").alias("urls"), "e.has_url", "e.has_multiple_mentions")


@query(f"SELECT i AS id, count(*) AS n FROM (SELECT unnest({S.ids('response_tweet_id')}) AS i FROM tweets) GROUP BY i")
def split_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tweets").select(F.explode(T.split_ids("response_tweet_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {S.true('inbound')} AS flag, count(*) AS n FROM tweets GROUP BY 1")
def parse_bool(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tweets").groupBy(T.parse_bool("inbound").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_id, coalesce(nullif(\"supportTextClean\", ''), nullif(\"supportTextRaw\", ''), '') AS text FROM {PAIRS}")
def coalesce_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.first_text("supportTextClean", "supportTextRaw").alias("text"))


@query(f"SELECT row_id, concat_ws('_', 'pair', \"customerTweetId\", \"supportTweetId\") AS id FROM {PAIRS}")
def concat_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.pair_id("customerTweetId", "supportTweetId").alias("id"))


@query(f"SELECT \"goldenId\" AS golden_id, 'GOLD-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS ordinal FROM (SELECT \"goldenId\", row_number() OVER (ORDER BY \"goldenId\") AS n FROM {GOLDEN})")
def pad_id(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.global_rank(load(spark, d, GOLDEN).select("goldenId"), ["goldenId"], "n")
    return ranked.select(F.col("goldenId").alias("golden_id"), T.padded_id("GOLD-", "n").alias("ordinal"))


@query(f"SELECT row_id, CAST(length(\"customerTextRaw\") + len(regexp_extract_all(\"customerTextRaw\", '[\\x{{10000}}-\\x{{10FFFF}}]')) AS INTEGER) AS n FROM {PAIRS}")
def char_length(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.utf16_length("customerTextRaw").alias("n"))


@query(f"SELECT row_id, {S.norm('\"customerTextClean\"')} AS text FROM {PAIRS}")
def norm_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.norm_taxonomy("customerTextClean").alias("text"))


@query(f"SELECT row_id, {S.trim_all(S.norm('\"customerTextClean\"'))} AS text FROM {PAIRS}")
def norm_proposal(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", T.norm_proposal("customerTextClean").alias("text"))


@query(f"SELECT row_id, array_to_string({S.tokens_bm25('\"customerTextClean\"')}, ' ') AS tokens FROM {PAIRS}")
def tokenize_bm25(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", F.array_join(T.tokens_bm25("customerTextClean"), " ").alias("tokens"))


@query(f"SELECT row_id, array_to_string({S.tokens_tfidf('t')}, ' ') AS tokens FROM (SELECT row_id, {S.unigrams('\"customerTextClean\"')} AS t FROM {PAIRS})")
def tokenize_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select("row_id", F.array_join(T.tokens_tfidf("customerTextClean"), " ").alias("tokens"))


_DISCOVERY = "[w FOR w IN string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF length(w) > 2]"


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_DISCOVERY}) AS term FROM {DOCS}) GROUP BY term")
def tokenize_discovery(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DOCS).select(F.explode(F.array_distinct(T.tokens_discovery("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS term FROM (SELECT doc_id, {_DISCOVERY} AS t FROM {DOCS})) GROUP BY term")
def bigrams_space(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DOCS).select(F.explode(F.array_distinct(T.bigrams(T.tokens_discovery("text"), " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, {S.trim_all('text')} AS body FROM {DOCS} WHERE text IS NOT NULL AND NOT contains(text, '```')")
def strip_code_fence(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, DOCS).where(F.col("text").isNotNull() & ~F.contains("text", F.lit("```")))
    return docs.select("doc_id", T.strip_code_fence(F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).alias("body"))


# The same over the whole table: fences inside a text stay, a null text has a null body.
@query(f"SELECT doc_id, {S.trim_all('text')} AS body FROM {DOCS}")
def strip_code_fence_all(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DOCS).select("doc_id", T.strip_code_fence(F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).alias("body"))


@query("SELECT event_id, length(props) AS n_chars FROM events WHERE json_valid(props)")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.length("props").cast("long").alias("n_chars"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN trim(coalesce(props, '')) = '' THEN 'empty' WHEN NOT json_valid(props) THEN 'invalid' END AS error FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", T.parsed_json("props", "k string").alias("j")).select("event_id", "j.value.k", "j.error")


_NESTED = "concat('{\"user\": {\"id\": ', cast(user_id as string), ', \"API_Key\": \"k-', cast(event_id as string), '\", \"note\": \"', event_type, '\"}, \"token\": ', cast(event_id as string), ', \"tokens\": 3}')"
_MASKED = "concat('{\"user\": {\"id\": ', cast(user_id as varchar), ', \"API_Key\": \"[REDACTED]\", \"note\": \"', event_type, '\"}, \"token\": \"[REDACTED]\", \"tokens\": 3}')"


@query(f"SELECT event_id, {_MASKED} AS props FROM events")
def redact_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", T.redact_json(F.expr(_NESTED)).alias("props"))


@query("SELECT event_id, '[REDACTED]' AS api_key, event_type AS kind FROM events")
def redact_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("API_Key"), F.concat(F.lit("s-"), F.col("user_id").cast("string")), F.lit("kind"), F.col("event_type"))
    masked = load(spark, d, "events").select("event_id", T.redact_keys(m, ["api_key", "token", "password", "secret", "authorization"]).alias("m"))
    return masked.select("event_id", F.col("m")["API_Key"].alias("api_key"), F.col("m")["kind"].alias("kind"))


# Filters.


@query(f"SELECT author_id, count(*) AS n FROM tweets WHERE NOT {S.true('inbound')} AND lower(trim(author_id)) = '{BRAND.lower()}' GROUP BY author_id")
def f_outbound_brand(spark: SparkSession, d: str) -> DataFrame:
    return pairing.outbound_of(load(spark, d, "tweets"), BRAND).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tweet_id, count(*) AS n FROM tweets WHERE {S.true('inbound')} AND contains(lower(coalesce(text, '')), '@{BRAND.lower()}') GROUP BY tweet_id")
def f_contains_ci(spark: SparkSession, d: str) -> DataFrame:
    return pairing.inbound(load(spark, d, "tweets")).where(F.lower(F.coalesce("text", F.lit(""))).contains("@" + BRAND.lower())).groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_id FROM {PAIRS} WHERE {S.keyword('\"customerTextClean\"', rules.KEYWORDS['display_touch'])}")
def f_keyword_any(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).where(F.coalesce("customerTextClean", F.lit("")).rlike(T.keyword_pattern(rules.KEYWORDS["display_touch"]))).select("row_id")


# The words whose samples are inspected.
_TRIGGERS = ["bill", "paid", "card", "lock screen", "screenshot", "repair"]


@query(" UNION ALL ".join(f"SELECT {S.q(w)} AS word, row_id, place FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS place FROM {PAIRS} WHERE \"isInitialInquiry\" AND {S.keyword('\"customerTextClean\"', [w])}) WHERE place <= 5" for w in _TRIGGERS))
def f_trigger_samples(spark: SparkSession, d: str) -> DataFrame:
    x = F.coalesce("customerTextClean", F.lit(""))
    named = F.array_compact(F.array(*[F.when(x.rlike(T.keyword_pattern([w])), F.lit(w)) for w in _TRIGGERS]))
    rows = load(spark, d, PAIRS).where("isInitialInquiry").select("row_id", F.explode(named).alias("word"))
    return ranking.first_n_per_key(rows, ["word"], ["row_id"], 5).select("word", "row_id", F.col("place").cast("long").alias("place"))


@query(f"SELECT count(*) AS n_rows, count_if({S.blank('\"customerInResponseToId\"')}) AS n_initial, count_if(length({S.clean('\"customerTextRaw\"')}) >= 3) AS n_long FROM {PAIRS}")
def f_initial_and_length(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(T.is_blank("customerInResponseToId")).alias("n_initial"), F.count_if(F.length(T.clean_text("customerTextRaw")) >= 3).alias("n_long"))


_TEXT = '"customerTextClean"'


@query(" UNION ALL ".join(f"SELECT '{k}' AS topic, count(*) AS n FROM {PAIRS} WHERE {S.keyword(_TEXT, w)} HAVING count(*) > 0" for k, w in rules.SUBTOPICS.items()))
def f_subtopics(spark: SparkSession, d: str) -> DataFrame:
    return rules.topic_counts(load(spark, d, PAIRS), "customerTextClean")


@query(
    f"SELECT row_id FROM {PAIRS} WHERE length(coalesce({_TEXT}, '')) + len(regexp_extract_all(coalesce({_TEXT}, ''), '[\\x{{10000}}-\\x{{10FFFF}}]')) < {rules.SHORT} OR "
    + " OR ".join(f"({S.keyword(_TEXT, a)} AND {S.keyword(_TEXT, b)})" for a, b in rules.BOUNDARY)
)
def f_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).where(rules.ambiguous("customerTextClean")).select("row_id")


@query("SELECT label, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {S.keyword(_TEXT, w)} THEN '{k}'" for k, w in rules.KEYWORDS.items()) + f" ELSE 'other_unclear' END AS label FROM {PAIRS}) GROUP BY label")
def c_taxonomy_v0(spark: SparkSession, d: str) -> DataFrame:
    label = rules.first_match("customerTextClean", list(rules.KEYWORDS), "other_unclear")
    return load(spark, d, PAIRS).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Joins.

_REPLIES = (
    f"(SELECT trim(in_response_to_tweet_id) AS customer_id, min(struct_pack(o := try_cast(trim(tweet_id) AS BIGINT), s := trim(tweet_id), t := text, c := created_at)) AS r, count(*) AS n_replies FROM tweets "
    f"WHERE NOT {S.true('inbound')} AND lower(trim(author_id)) = '{BRAND.lower()}' AND coalesce(trim(in_response_to_tweet_id), '') <> '' GROUP BY 1)"
)


@query(
    f"SELECT 'pair_' || c.customer_id || '_' || r.s AS pair_id, c.customer_id, c.clean AS customer_clean, c.initial AS is_initial, {S.clean('r.t')} AS support_clean, n_replies FROM "
    f"(SELECT trim(tweet_id) AS customer_id, {S.clean('text')} AS clean, {S.blank('in_response_to_tweet_id')} AS initial FROM tweets WHERE {S.true('inbound')}) c JOIN {_REPLIES} USING (customer_id) "
    "WHERE length(c.clean) + len(regexp_extract_all(c.clean, '[\\x{10000}-\\x{10FFFF}]')) >= 3"
)
def j_reply_pair(spark: SparkSession, d: str) -> DataFrame:
    return pairing.reply_pairs(load(spark, d, "tweets"), BRAND).select("pair_id", "customer_id", "customer_clean", "is_initial", "support_clean", "n_replies")


@query(f"SELECT row_id FROM {PAIRS} p WHERE NOT EXISTS (SELECT 1 FROM {GOLDEN} g WHERE trim(g.\"tweetId\") <> '' AND trim(g.\"tweetId\") = trim(p.\"customerTweetId\"))")
def j_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return pairing.quarantine(load(spark, d, PAIRS), load(spark, d, GOLDEN), "customerTweetId", "tweetId").select("row_id")


@query(f"SELECT \"goldenId\" AS golden_id FROM {GOLDEN} g WHERE EXISTS (SELECT 1 FROM {PAIRS} p WHERE trim(p.\"customerTweetId\") <> '' AND trim(g.\"tweetId\") = trim(p.\"customerTweetId\"))")
def j_golden_found(spark: SparkSession, d: str) -> DataFrame:
    return pairing.found_ids(load(spark, d, PAIRS), load(spark, d, GOLDEN), "customerTweetId", "tweetId").select(F.col("goldenId").alias("golden_id"))


_HELD = f"trim(\"customerTweetId\") IN (SELECT trim(\"tweetId\") FROM {GOLDEN} WHERE trim(\"tweetId\") <> '')"


@query(f"SELECT count(*) AS total, count_if({_HELD}) AS excluded, count_if(NOT {_HELD}) AS remaining, true AS adds_up FROM {PAIRS}")
def so_population_eq(spark: SparkSession, d: str) -> DataFrame:
    return pairing.population(load(spark, d, PAIRS), load(spark, d, GOLDEN), "customerTweetId", "tweetId")


@query('SELECT "goldenId" AS golden_id, "automaticCandidateLabel" AS left_value, "evaluationLabel" AS right_value FROM golden_set WHERE "automaticCandidateLabel" IS DISTINCT FROM "evaluationLabel"')
def j_run_compare(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, GOLDEN).select(F.col("goldenId").alias("golden_id"), "automaticCandidateLabel", "evaluationLabel")
    return pairing.run_difference(g.withColumnRenamed("automaticCandidateLabel", "v"), g.withColumnRenamed("evaluationLabel", "v"), ["golden_id"], "v")


# Aggregations.

_PROFILED = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count_if({S.blank(c)}) AS n_missing, round(count_if({S.blank(c)}) * 100 / count(*), 2) AS percent FROM tweets" for c in _PROFILED))
def a_dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    return pairing.missing_profile(load(spark, d, "tweets"), _PROFILED)


@query(f"SELECT author_id, count(*) AS n, count_if(NOT {S.blank('in_response_to_tweet_id')}) AS n_direct, count_if(len({S.ids('response_tweet_id')}) > 1) AS n_multi FROM tweets WHERE NOT {S.true('inbound')} GROUP BY author_id")
def a_brand_group(spark: SparkSession, d: str) -> DataFrame:
    return pairing.author_groups(load(spark, d, "tweets"))


_BRANDS = ["AppleSupport", "NordwaveHelp"]


@query(" UNION ALL ".join(f"SELECT '{b}' AS brand, count(*) AS n_mentions, count_if({S.blank('in_response_to_tweet_id')}) AS n_initial FROM tweets WHERE {S.true('inbound')} AND contains(lower(coalesce(text, '')), '@{b.lower()}') HAVING count(*) > 0" for b in _BRANDS))
def a_brand_inbound(spark: SparkSession, d: str) -> DataFrame:
    return pairing.brand_mentions(load(spark, d, "tweets"), _BRANDS)


@query(f"SELECT least(count(DISTINCT \"customerAuthorId\"), 500000) AS n_authors FROM {PAIRS}")
def a_capped_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).agg(F.least(F.countDistinct("customerAuthorId"), F.lit(500_000)).alias("n_authors"))


@query(
    f"SELECT count(*) AS n, count_if(\"isInitialInquiry\") AS n_initial, count_if(\"isInitialInquiry\" = false) AS n_follow_up, count_if(\"allSupportRepliesCount\" > 1) AS n_multi_reply, "
    f"count_if(regexp_matches(\"customerTextRaw\", '&[a-z#0-9]+;')) AS n_entity, count_if(regexp_matches(\"customerTextRaw\", 'https?://')) AS n_url, count_if(regexp_matches(\"customerTextRaw\", '@\\w+')) AS n_mention, count_if(regexp_matches(\"customerTextRaw\", '[\\x{{FE0F}}\\x{{200D}}\\x{{FFFD}}]')) AS n_glitch FROM {PAIRS}"
)
def a_pair_stats(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("customerTextRaw")
    return load(spark, d, PAIRS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("isInitialInquiry").alias("n_initial"), F.count_if(F.col("isInitialInquiry") == F.lit(False)).alias("n_follow_up"), F.count_if(F.col("allSupportRepliesCount") > 1).alias("n_multi_reply"),
        F.count_if(raw.rlike("&[a-z#0-9]+;")).alias("n_entity"), F.count_if(raw.rlike("https?://")).alias("n_url"), F.count_if(raw.rlike(T.HANDLE)).alias("n_mention"), F.count_if(raw.rlike(T.GLITCHES)).alias("n_glitch"),
    )


_MATCHED = "(SELECT list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {S.keyword('\"customerTextClean\"', w)} THEN '{k}' END" for k, w in rules.KEYWORDS.items()) + f"] IF x IS NOT NULL]) AS m FROM {PAIRS})"


@query(f"SELECT label, count(*) AS n, count_if(alone) AS n_exclusive FROM (SELECT unnest(m) AS label, len(m) = 1 AS alone FROM {_MATCHED}) GROUP BY label")
def a_intent_cov(spark: SparkSession, d: str) -> DataFrame:
    return rules.coverage(load(spark, d, PAIRS), "customerTextClean")


@query(f"SELECT count_if(len(m) = 0) AS n_none, count_if(len(m) = 1) AS n_single, count_if(len(m) > 1) AS n_multi FROM {_MATCHED}")
def a_intent_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_sizes(load(spark, d, PAIRS), "customerTextClean")


@query(f"SELECT array_to_string(m, ' + ') AS labels, count(*) AS n FROM {_MATCHED} WHERE len(m) > 1 GROUP BY 1 ORDER BY n DESC, labels LIMIT 10")
def a_cooccur(spark: SparkSession, d: str) -> DataFrame:
    return rules.combinations(load(spark, d, PAIRS), "customerTextClean", 10)


@query('SELECT "evaluationLabel" AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM golden_set), 4) AS share FROM golden_set GROUP BY 1')
def a_intent_dist(spark: SparkSession, d: str) -> DataFrame:
    return ranking.shares(load(spark, d, GOLDEN), "evaluationLabel")


_TF = f"(SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens_bm25('text')}) AS term FROM {DOCS}) GROUP BY ALL)"
_DL = f"(SELECT doc_id, CAST(len({S.tokens_bm25('text')}) AS BIGINT) AS dl FROM {DOCS})"
_N = f"(SELECT count(*) FROM {DOCS})"
_IDF = f"(SELECT term, count(*) AS df, greatest(0.0, ln(({_N} - count(*) + 0.5) / (count(*) + 0.5) + 1.0)) AS idf FROM {_TF} GROUP BY term HAVING count(*) >= 2)"


@query(f"SELECT * FROM {_TF}")
def a_tf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(retrieval.token_rows(load(spark, d, DOCS), "doc_id", "text"), "doc_id")


@query(f"SELECT * FROM {_DL}")
def a_doc_len(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fit(load(spark, d, DOCS)).docs


@query(f"SELECT term, df, round(idf, 6) AS idf FROM {_IDF}")
def a_idf_bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fit(load(spark, d, DOCS)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_TFIDF = (
    f"WITH tok AS (SELECT doc_id, lang, {S.tokens_tfidf('t')} AS tokens FROM (SELECT doc_id, lower(lang) AS lang, {S.unigrams('text')} AS t FROM {DOCS})), "
    "n AS (SELECT count(*) AS n FROM tok), "
    "vocab AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok), n GROUP BY term "
    "HAVING count(*) >= CASE WHEN any_value(n) <= 10 THEN 1 ELSE 3 END AND count(*) <= floor(any_value(n) * 0.85)), "
    "raw AS (SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) JOIN vocab USING (term) GROUP BY doc_id, term), "
    "vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"
)


@query(f"{_TFIDF} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def a_vocab_prune(spark: SparkSession, d: str) -> DataFrame:
    return classify.vocabulary(classify.term_table(load(spark, d, DOCS), "doc_id", "text")).select("term", "df", F.round("idf", 6).alias("idf"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    terms = classify.term_table(load(spark, d, DOCS), "doc_id", "text")
    return classify.vectors(terms, Scratch(spark, "vocabulary").save(classify.vocabulary(terms))).withColumnRenamed("key", "doc_id")


@query(f"{_TFIDF} SELECT doc_id, term, round(w, 5) AS w FROM vec")
def m_tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("doc_id", "term", F.round("w", 5).alias("w"))


@query(f"{_TFIDF} SELECT doc_id, count(*) AS n_terms, round(sum(w), 4) AS total, round(max(w), 4) AS top FROM vec GROUP BY doc_id")
def m_tfidf(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("w"), 4).alias("total"), F.round(F.max("w"), 4).alias("top"))


_NB = (
    _TFIDF + ", sums AS (SELECT lang AS label, term, sum(w) AS s FROM vec JOIN tok USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL), "
    "v AS (SELECT count(*) AS v FROM vocab), lab AS (SELECT DISTINCT lang AS label FROM tok WHERE lang IS NOT NULL), "
    "mass AS (SELECT label, coalesce(sum(s), 0) + 0.5 * any_value(v) AS mass FROM lab LEFT JOIN sums USING (label), v GROUP BY label), "
    "score AS (SELECT doc_id, label, -ln((SELECT count(*) FROM lab)) + sum(w * ln((coalesce(s, 0) + 0.5) / mass)) AS score FROM vec CROSS JOIN mass LEFT JOIN sums USING (label, term) GROUP BY doc_id, label), "
    "best AS (SELECT doc_id, label, 1 / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM score)), "
    "pred AS (SELECT tok.doc_id, tok.lang, coalesce(label, 'en') AS predicted, coalesce(round(p, 4), 0.5) AS confidence, label IS NULL AS oov FROM tok LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = tok.doc_id)"
)


def _lang_docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DOCS).select("doc_id", "text", F.lower("lang").alias("lang"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = _lang_docs(spark, d)
    terms = classify.term_table(docs, "doc_id", "text", "lang")
    return classify.predict_bayes(classify.fit_bayes(terms), terms, "doc_id", fallback="en").join(docs.select("doc_id", "lang"), "doc_id")


@query(f"{_NB} SELECT label, term, round(ln((s + 0.5) / mass), 4) AS logp FROM sums JOIN mass USING (label)")
def a_nb_logprob(spark: SparkSession, d: str) -> DataFrame:
    return classify.fit_bayes(_lang_docs(spark, d), "doc_id", "text", "lang").cells.select("label", "term", F.round("logp", 4).alias("logp"))


@query(f"{_NB} SELECT label, round(-ln((SELECT count(*) FROM lab)), 6) AS prior, round(ln(0.5 / mass), 4) AS default_logp FROM mass")
def a_class_prior(spark: SparkSession, d: str) -> DataFrame:
    return classify.fit_bayes(_lang_docs(spark, d), "doc_id", "text", "lang").classes.select("label", F.round("prior", 6).alias("prior"), F.round("default_logp", 4).alias("default_logp"))


@query(f"{_NB} SELECT doc_id, predicted, oov FROM pred")
def m_nb(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("doc_id", "predicted", "oov")


@query(f"{_NB} SELECT doc_id, predicted, round(confidence, 3) AS confidence, oov FROM pred")
def m_nb_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("doc_id", "predicted", F.round("confidence", 3).alias("confidence"), "oov")


@query(f"{_NB} SELECT doc_id, predicted FROM pred")
def sink_model(spark: SparkSession, d: str) -> DataFrame:
    """A model is fitted, written, read back and used."""
    docs = _lang_docs(spark, d)
    terms = classify.term_table(docs, "doc_id", "text", "lang")
    path = Scratch(spark, "model").base
    files.write_model(classify.fit_bayes(terms), path)
    return classify.predict_bayes(files.read_model(spark, path, classify.NaiveBayes), terms, "doc_id", fallback="en").select("doc_id", "predicted")


@query(f"{_NB} SELECT label, round(ln(count(*) / sum(count(*)) OVER ()), 6) AS prior FROM (SELECT lang AS label FROM tok WHERE lang IS NOT NULL) GROUP BY label")
def a_class_prior_empirical(spark: SparkSession, d: str) -> DataFrame:
    return classify.fit_bayes(_lang_docs(spark, d), "doc_id", "text", "lang", uniform=False).classes.select("label", F.round("prior", 6).alias("prior"))


@query(f"{_NB}, wrong AS (SELECT doc_id, lang AS truth, predicted FROM pred WHERE lang IS NOT NULL AND predicted <> lang) SELECT doc_id, truth, predicted, place, n_wrong FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY truth) AS n_wrong FROM wrong) WHERE place <= 20")
def a_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(_predictions(spark, d), "doc_id", "lang", "predicted").select("doc_id", "truth", "predicted", F.col("place").cast("long").alias("place"), "n_wrong")


@query(f"{_NB} SELECT coalesce(lang, '(all)') AS truth, coalesce(predicted, '(all)') AS predicted, count(*) AS n FROM (SELECT lang, predicted FROM pred WHERE lang IS NOT NULL) GROUP BY CUBE (lang, predicted)")
def a_pivot_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_totals(metrics.confusion(_predictions(spark, d), "lang", "predicted"))


_PRF = (
    "c AS (SELECT truth, predicted, count(*) AS n FROM {src} WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL), "
    "lab AS (SELECT truth AS label FROM c UNION SELECT predicted FROM c), "
    "x AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE truth = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = label), 0) AS claimed, coalesce((SELECT sum(n) FROM c WHERE truth = label AND predicted = label), 0) AS hit FROM lab), "
    "prf AS (SELECT label, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, CASE WHEN hit > 0 THEN 2 * hit / (claimed + support) ELSE 0 END AS f1, support, hit FROM x)"
)
_AUTO = '(SELECT "evaluationLabel" AS truth, "automaticCandidateLabel" AS predicted FROM golden_set)'


@query(f"WITH {_PRF.format(src=_AUTO)} SELECT truth, predicted, n FROM c")
def a_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(load(spark, d, GOLDEN), "evaluationLabel", "automaticCandidateLabel")


@query(f"WITH {_PRF.format(src=_AUTO)} SELECT label, round(p, 4) AS \"precision\", round(r, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM prf")
def a_prf(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.per_class(metrics.confusion(load(spark, d, GOLDEN), "evaluationLabel", "automaticCandidateLabel"))
    return per.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    f"WITH {_PRF.format(src=_AUTO)} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hit) / sum(support), 4) AS accuracy, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM prf"
)
def a_prf_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.confusion(load(spark, d, GOLDEN), "evaluationLabel", "automaticCandidateLabel"))


_CLASSES = ", ".join(f"'{c}'" for c in QUOTAS)


@query(
    f"WITH g AS (SELECT CASE WHEN \"evaluationLabel\" IN ({_CLASSES}) THEN \"evaluationLabel\" END AS t, CASE WHEN \"automaticCandidateLabel\" IN ({_CLASSES}) THEN \"automaticCandidateLabel\" END AS p FROM golden_set), "
    f"c AS (SELECT unnest([{_CLASSES}]) AS label), x AS (SELECT label, count_if(t = label) AS support, count_if(p = label) AS claimed, count_if(t = label AND p = label) AS hit FROM c CROSS JOIN g GROUP BY label) "
    "SELECT (SELECT count(*) FROM g) AS n, round(sum(hit) / (SELECT count(*) FROM g), 4) AS accuracy, round(avg(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END), 4) AS macro_precision, round(avg(CASE WHEN support > 0 THEN hit / support ELSE 0 END), 4) AS macro_recall, "
    "round(avg(CASE WHEN claimed + support > 0 THEN 2 * hit / (claimed + support) ELSE 0 END), 4) AS macro_f1 FROM x"
)
def a_prf_classes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_summary(load(spark, d, GOLDEN), "evaluationLabel", "automaticCandidateLabel", list(QUOTAS))


@query(
    "SELECT \"goldenId\" AS golden_id, CASE WHEN \"humanLabel\" IS NOT NULL AND annotator IS NOT NULL THEN \"humanLabel\" ELSE \"automaticProposedLabel\" END AS label, "
    "CASE WHEN \"humanLabel\" IS NOT NULL AND annotator IS NOT NULL THEN 'human_author (' || annotator || ')' ELSE 'automatic_proposal' END AS source FROM golden_set"
)
def c_eval_label(spark: SparkSession, d: str) -> DataFrame:
    label, source = classify.evaluation_label("humanLabel", "annotator", "automaticProposedLabel")
    return load(spark, d, GOLDEN).select(F.col("goldenId").alias("golden_id"), label.alias("label"), source.alias("source"))


_NORM_LABEL = "regexp_replace(lower(trim({c})), '[\\s-]+', '_', 'g')"


@query(
    "WITH p AS (SELECT " + _NORM_LABEL.format(c='"annotatorA"') + " AS a, " + _NORM_LABEL.format(c='"annotatorB"') + " AS b FROM golden_agreement WHERE \"annotatorA\" IS NOT NULL AND \"annotatorB\" IS NOT NULL), "
    "t AS (SELECT count(*) AS n, count_if(a = b) / count(*) AS po FROM p), na AS (SELECT a AS l, count(*) AS na FROM p GROUP BY a), nb AS (SELECT b AS l, count(*) AS nb FROM p GROUP BY b), "
    "e AS (SELECT coalesce(sum(na * nb / (SELECT n * n FROM t)), 0) AS pe FROM na JOIN nb USING (l)) "
    "SELECT n AS n_items, round(po, 4) AS observed, round(pe, 4) AS expected, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM t, e"
)
def a_kappa(spark: SparkSession, d: str) -> DataFrame:
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[\\s-]+", "_")
    a = load(spark, d, AGREE).select(norm("annotatorA").alias("a"), norm("annotatorB").alias("b"))
    return metrics.kappa(metrics.confusion(a, "a", "b"))


@query('SELECT "evaluationLabelSource" AS source, count(*) AS n, round(avg(CASE WHEN "evaluationLabel" = "automaticCandidateLabel" THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM golden_set GROUP BY 1')
def a_slice_acc(spark: SparkSession, d: str) -> DataFrame:
    hit = F.when(F.col("evaluationLabel") == F.col("automaticCandidateLabel"), 1.0).otherwise(0.0)
    return load(spark, d, GOLDEN).groupBy(F.col("evaluationLabelSource").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 4).alias("accuracy"))


@query(
    'SELECT count(*) AS n, count(*) - count(DISTINCT "goldenId") AS n_dup_ids, count(*) - count(DISTINCT ' + S.trim_all(S.norm('"customerTextClean"')) + ') AS n_dup_texts, count_if("humanLabel" IS NOT NULL AND annotator IS NULL) AS n_no_annotator, count_if("samplingStratum" IS NULL) AS n_no_stratum FROM golden_set'
)
def a_quality_audits(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return load(spark, d, GOLDEN).agg(
        n.alias("n"), (n - F.countDistinct("goldenId")).alias("n_dup_ids"), (n - F.countDistinct(T.norm_proposal("customerTextClean"))).alias("n_dup_texts"), F.count_if(F.col("humanLabel").isNotNull() & F.col("annotator").isNull()).alias("n_no_annotator"), F.count_if(F.col("samplingStratum").isNull()).alias("n_no_stratum")
    )


@query(
    'SELECT "automaticProposedLabel" AS label, "evaluationLabelSource" AS source, count(*) AS n, count_if("automaticConfidence" < 0.75) AS n_low, count_if("automaticProposedLabel" IS DISTINCT FROM "evaluationLabel") AS n_disagree FROM golden_set GROUP BY ALL'
)
def a_proposal_stats(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, GOLDEN).groupBy(F.col("automaticProposedLabel").alias("label"), F.col("evaluationLabelSource").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("automaticConfidence") < 0.75).alias("n_low"), F.count_if(~F.col("automaticProposedLabel").eqNullSafe(F.col("evaluationLabel"))).alias("n_disagree")
    )


_QS = [0.5, 0.9, 0.95]


@query(" UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS q, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE i = least(floor(n * {x}), n - 1)" for x in _QS))
def a_latency_pct(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sorted_place_quantiles(load(spark, d, "events"), "value", _QS)


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events")
def a_latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spread(load(spark, d, "events"), "value")


_FEED = f"(SELECT *, {S.true('inbound')} AS i, {S.blank('in_response_to_tweet_id')} AS b, NOT {S.true('inbound')} AND lower(trim(author_id)) = '{BRAND.lower()}' AS mine FROM tweets)"


@query(
    f"WITH f AS (SELECT count_if(coalesce(mine, false)) AS n_replies, count_if(coalesce(mine, false) AND b) AS n_without_parent, count(DISTINCT CASE WHEN mine AND NOT b THEN trim(in_response_to_tweet_id) END) AS n_answered_ids, count_if(i) AS n_inbound, count_if(i AND contains(lower(coalesce(text, '')), '@{BRAND.lower()}')) AS n_mentions FROM {_FEED}), "
    f"p AS (SELECT count(*) AS n_pairs, count_if(c.initial) AS n_initial, count_if(NOT c.initial) AS n_follow_up, count_if(n_replies > 1) AS n_multi FROM "
    f"(SELECT trim(tweet_id) AS customer_id, {S.clean('text')} AS clean, {S.blank('in_response_to_tweet_id')} AS initial FROM tweets WHERE {S.true('inbound')}) c JOIN {_REPLIES} USING (customer_id) WHERE length(c.clean) + len(regexp_extract_all(c.clean, '[\\x{{10000}}-\\x{{10FFFF}}]')) >= 3) "
    "SELECT f.*, p.*, n_replies - n_without_parent - n_answered_ids AS n_extra_replies, round(n_initial * 100 / n_pairs, 2) AS initial_percent, n_replies - n_pairs AS n_unmatched, n_mentions - n_pairs AS n_unmatched_mentions FROM f, p"
)
def a_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_statistics(load(spark, d, "tweets"), BRAND)


@query(
    f"WITH ids AS (SELECT DISTINCT trim(tweet_id) AS x FROM tweets WHERE trim(tweet_id) <> ''), r AS (SELECT i, CASE WHEN NOT b THEN trim(in_response_to_tweet_id) END AS up FROM {_FEED}) "
    "SELECT count(*) AS n_rows, count_if(i) AS n_inbound, count_if(NOT i) AS n_outbound, count(up) AS n_answers, count(x) AS n_linked, count(DISTINCT x) AS n_parents FROM r LEFT JOIN ids ON up = x"
)
def a_linkage(spark: SparkSession, d: str) -> DataFrame:
    return pairing.linkage(load(spark, d, "tweets"))


# Retrieval.

_BM25 = (
    f"WITH tf AS {_TF}, dl AS {_DL}, idf AS {_IDF}, avg_dl AS (SELECT avg(dl) AS a FROM dl), "
    "q AS (SELECT DISTINCT qid, term FROM (SELECT <qid> AS qid, unnest(<tok>) AS term FROM <src>)), "
    "s AS (SELECT qid, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 4) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), avg_dl WHERE idf > 0 <more> GROUP BY qid, doc_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS \"rank\" FROM s)"
)


def _bm25_sql(**parts: str) -> str:
    out = _BM25
    for name, value in parts.items():
        out = out.replace(f"<{name}>", value)
    return out


_EVAL = _bm25_sql(qid="item_id", tok=S.tokens_bm25("item_text"), src="eval_items", more="")
_SELF_ALL = _bm25_sql(qid="doc_id", tok=S.tokens_bm25("text"), src=f"{DOCS} WHERE doc_id % 100 = 0", more="AND doc_id <> qid")
_SELF = _bm25_sql(qid="doc_id", tok=S.tokens_bm25("text"), src=f"{DOCS} WHERE doc_id % 100 = 0 AND lang IS NOT NULL", more="AND doc_id <> qid")


@query(f"{_EVAL} SELECT qid AS item_id, doc_id, score, \"rank\" FROM r WHERE \"rank\" <= 5")
def r_search(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search(retrieval.fit(load(spark, d, DOCS)), load(spark, d, "eval_items"), "item_id", "item_text", 5)
    return hits.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_EVAL} SELECT qid AS item_id, \"rank\", doc_id, score, lang, source, suite FROM r JOIN {DOCS} USING (doc_id) JOIN eval_items ON item_id = qid WHERE \"rank\" <= 5")
def r_api(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, DOCS), load(spark, d, "eval_items")
    hits = retrieval.search(retrieval.fit(docs), items, "item_id", "item_text", 5)
    return hits.join(docs.select("doc_id", "lang", "source"), "doc_id").join(items.select("item_id", "suite"), "item_id").select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "lang", "source", "suite")


@query(f"{_EVAL} SELECT qid AS item_id, true AS ordered FROM r WHERE \"rank\" <= 5 GROUP BY qid")
def w_monotone_check(spark: SparkSession, d: str) -> DataFrame:
    return ranking.monotone(r_search(spark, d), "item_id", "rank", "score")


def _self_hits(spark: SparkSession, d: str, chosen: str = "doc_id % 100 = 0 and lang is not null") -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, DOCS)
    queries = docs.where(chosen).select(F.col("doc_id").alias("qid"), F.col("text").alias("q_text"), F.lower("lang").alias("q_lang"))
    scored = retrieval.scores(retrieval.fit(docs), queries, "qid", "q_text").where("doc_id <> qid")
    hits = retrieval.top_k(scored, "qid", max(KS)).join(queries.select("qid", "q_lang"), "qid").join(docs.select("doc_id", F.lower("lang").alias("lang")), "doc_id")
    return hits, queries.agg(F.count(F.lit(1)).alias("n_queries"))


@query(
    f"{_SELF}, h AS (SELECT k, qid, sum(CASE WHEN lower(d.lang) = lower(q.lang) THEN 1 ELSE 0 END) AS rel, count(*) AS got FROM r JOIN (SELECT unnest({KS}) AS k) ON \"rank\" <= k JOIN {DOCS} d ON d.doc_id = r.doc_id JOIN {DOCS} q ON q.doc_id = qid GROUP BY k, qid), "
    f"n AS (SELECT count(*) AS n FROM {DOCS} WHERE doc_id % 100 = 0 AND lang IS NOT NULL) "
    "SELECT CAST(k AS INTEGER) AS k, n AS n_queries, CAST(count_if(rel > 0) AS BIGINT) AS n_hit, CAST(sum(rel) AS BIGINT) AS relevant, CAST(sum(got) AS BIGINT) AS retrieved, round(count_if(rel > 0) / n, 4) AS recall, round(sum(rel) / sum(got), 4) AS \"precision\", round(sum(rel) / n, 4) AS hits_per_query FROM h, n GROUP BY k, n"
)
def a_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits, n = _self_hits(spark, d)
    return retrieval.recall_at(hits, n, "qid", F.coalesce(F.col("lang") == F.col("q_lang"), F.lit(False)), KS)


@query(f"{_SELF_ALL} SELECT (SELECT count(*) FROM {DOCS} WHERE doc_id % 100 = 0) AS n_queries, (SELECT count(*) FROM {DOCS} WHERE doc_id % 100 = 0) - count(DISTINCT qid) AS n_without_hits FROM r")
def a_zero_results(spark: SparkSession, d: str) -> DataFrame:
    hits, n = _self_hits(spark, d, "doc_id % 100 = 0")
    return n.crossJoin(hits.agg(F.countDistinct("qid").alias("hit"))).select("n_queries", (F.col("n_queries") - F.col("hit")).alias("n_without_hits"))


def _exact_dups(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """The query and hit ids of ``hits`` with their trimmed lower-case texts ``u`` and ``t``."""
    docs = load(spark, d, DOCS)
    norm = F.lower(F.trim("text"))
    return hits.select("qid", "doc_id").join(docs.select("doc_id", norm.alias("t")), "doc_id").join(docs.select(F.col("doc_id").alias("qid"), norm.alias("u")), "qid")


@query(
    f"{_SELF} SELECT count(DISTINCT qid) AS n_queries, count(DISTINCT CASE WHEN lower(trim(d.text)) = lower(trim(q.text)) THEN qid END) AS n_exact FROM r JOIN {DOCS} d ON d.doc_id = r.doc_id JOIN {DOCS} q ON q.doc_id = qid WHERE \"rank\" <= 10"
)
def a_exact_dup_rate(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = _self_hits(spark, d)
    return _exact_dups(spark, d, hits).agg(F.countDistinct("qid").alias("n_queries"), F.countDistinct(F.when(F.col("t") == F.col("u"), F.col("qid"))).alias("n_exact"))




# The same over every hundredth document, whatever its language; those without any hit are counted too.
@query(
    f"{_SELF_ALL} SELECT (SELECT count(*) FROM {DOCS} WHERE doc_id % 100 = 0) AS n_queries, count(DISTINCT CASE WHEN lower(trim(d.text)) = lower(trim(q.text)) THEN qid END) AS n_exact FROM r JOIN {DOCS} d ON d.doc_id = r.doc_id JOIN {DOCS} q ON q.doc_id = qid WHERE \"rank\" <= 10"
)
def a_exact_dup_rate_all(spark: SparkSession, d: str) -> DataFrame:
    hits, n = _self_hits(spark, d, "doc_id % 100 = 0")
    exact = _exact_dups(spark, d, hits).agg(F.countDistinct(F.when(F.col("t") == F.col("u"), F.col("qid"))).alias("n_exact"))
    return n.crossJoin(exact)


_PAIR_TEXT = f"FROM (SELECT row_id AS doc_id, \"customerTextClean\" AS text FROM {PAIRS})"
_FIELDS = ["customerTweetId", "supportTweetId", "customerCreatedAt", "supportCreatedAt", "customerTextClean", "customerTextRaw", "supportTextClean", "supportTextRaw", "allSupportRepliesCount", "isInitialInquiry"]
_OVER_PAIRS = _bm25_sql(qid="item_id", tok=S.tokens_bm25("item_text"), src="eval_items", more="").replace(f"FROM {DOCS}", _PAIR_TEXT)


@query(f"{_OVER_PAIRS} SELECT qid AS item_id, \"rank\", doc_id AS row_id, score, " + ", ".join(f'"{c}"' for c in _FIELDS) + f" FROM r JOIN {PAIRS} ON row_id = doc_id WHERE \"rank\" <= 3")
def r_api_fields(spark: SparkSession, d: str) -> DataFrame:
    """Search over the pairs with every stored field of a hit."""
    pairs = load(spark, d, PAIRS)
    index = retrieval.fit(pairs.select(F.col("row_id").alias("doc_id"), F.col("customerTextClean").alias("text")))
    hits = retrieval.search(index, load(spark, d, "eval_items"), "item_id", "item_text", 3)
    return hits.withColumnRenamed("doc_id", "row_id").join(pairs.select("row_id", *_FIELDS), "row_id").select("item_id", F.col("rank").cast("long").alias("rank"), "row_id", "score", *_FIELDS)


@query(f"SELECT count(*) AS n_docs, round(avg(dl), 4) AS avg_dl, (SELECT count(*) FROM {_IDF}) AS n_terms, (SELECT count(*) FROM {_TF}) AS n_postings FROM {_DL}")
def r_build(spark: SparkSession, d: str) -> DataFrame:
    """What an index build reports."""
    index = retrieval.fit(load(spark, d, DOCS))
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return index.stats.select("n_docs", F.round("avg_dl", 4).alias("avg_dl")).crossJoin(n(index.terms, "n_terms")).crossJoin(n(index.postings, "n_postings"))


_LEAK = _bm25_sql(qid='"goldenId"', tok=S.tokens_bm25('"customerTextClean"'), src="golden_set", more="").replace(f"FROM {DOCS}", f"FROM (SELECT row_id AS doc_id, \"customerTextClean\" AS text FROM {PAIRS})")


@query(f"{_LEAK} SELECT count(*) AS n_hits, count(DISTINCT qid) AS n_queries, count_if(\"customerTweetId\" = trim(\"tweetId\")) AS n_leaked FROM r JOIN {PAIRS} p ON p.row_id = r.doc_id JOIN golden_set g ON \"goldenId\" = qid WHERE \"rank\" <= 20")
def j_leak_search(spark: SparkSession, d: str) -> DataFrame:
    pairs, golden = load(spark, d, PAIRS), load(spark, d, GOLDEN)
    index = retrieval.fit(pairs.select(F.col("row_id").alias("doc_id"), F.col("customerTextClean").alias("text")))
    hits = bulk.search(index, golden, "goldenId", "customerTextClean", 20)
    both = hits.join(pairs.select(F.col("row_id").alias("doc_id"), "customerTweetId"), "doc_id").join(golden.select("goldenId", F.trim("tweetId").alias("held")), "goldenId")
    return both.agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("goldenId").alias("n_queries"), F.count_if(F.col("customerTweetId") == F.col("held")).alias("n_leaked"))


@query(f"SELECT count(*) AS n_shared FROM golden_set g WHERE EXISTS (SELECT 1 FROM {PAIRS} p WHERE trim(p.\"customerTweetId\") <> '' AND trim(g.\"tweetId\") = trim(p.\"customerTweetId\"))")
def j_leak_index(spark: SparkSession, d: str) -> DataFrame:
    return j_golden_found(spark, d).agg(F.count(F.lit(1)).alias("n_shared"))


# Windows, samples and sets.

_FIRST = f"(SELECT * FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY trim(\"customerTweetId\") ORDER BY row_id) = 1)"


@query(f"SELECT row_id FROM (SELECT row_id, {S.trim_all(S.norm('\"customerTextClean\"'))} AS t FROM {_FIRST}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY row_id) = 1")
def w_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, PAIRS).select("row_id", F.trim("customerTweetId").alias("id"), T.norm_proposal("customerTextClean").alias("t"))
    return ranking.dedupe_first(rows, [["id"], ["t"]], ["row_id"]).select("row_id")


@query(f"SELECT \"customerAuthorId\" AS author, row_id, row_number() OVER (PARTITION BY \"customerAuthorId\" ORDER BY row_id) AS place FROM {PAIRS} QUALIFY place <= 5")
def w_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, PAIRS).select(F.col("customerAuthorId").alias("author"), "row_id")
    return ranking.first_n_per_key(rows, ["author"], ["row_id"], 5).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT term, count(*) AS df FROM {_TF} GROUP BY term ORDER BY df DESC, term LIMIT 40")
def w_top_n_sort(spark: SparkSession, d: str) -> DataFrame:
    return a_tf(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(40)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def w_ring_last_n(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query('SELECT "goldenId" AS golden_id FROM golden_set ORDER BY "goldenId" LIMIT 50')
def w_page_first_n(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, GOLDEN).orderBy("goldenId").limit(50).select(F.col("goldenId").alias("golden_id"))


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY ingest_source ORDER BY md5(CAST(row_id AS VARCHAR) || '-{SEED}'), row_id) AS r FROM {PAIRS}) WHERE r <= 1000")
def w_class_cap(spark: SparkSession, d: str) -> DataFrame:
    return classify.class_cap(load(spark, d, PAIRS), "ingest_source", "row_id", 1000, SEED).select("row_id")


_QUOTA_VALUES = ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())


@query(
    f"WITH quota(s, q) AS (VALUES {_QUOTA_VALUES}), x AS (SELECT \"goldenId\" AS golden_id, s, q, coalesce(\"isAmbiguousCase\", false) AS f, row_number() OVER (PARTITION BY s, coalesce(\"isAmbiguousCase\", false) ORDER BY md5(\"goldenId\" || '-{SEED}'), \"goldenId\") AS r FROM golden_set JOIN quota ON s = \"samplingStratum\"), "
    "t AS (SELECT *, least(floor(q * 0.35 + 0.5), (SELECT count(*) FROM x y WHERE y.s = x.s AND y.f)) AS t FROM x) SELECT golden_id, s AS stratum FROM t WHERE CASE WHEN f THEN r <= t ELSE r <= q - t END"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(load(spark, d, GOLDEN), "samplingStratum", "isAmbiguousCase", "goldenId", QUOTAS, 0.35, SEED).select(F.col("goldenId").alias("golden_id"), F.col("samplingStratum").alias("stratum"))


_M = "4294967295::HUGEINT"
_SHUFFLE = (
    f"WITH RECURSIVE src AS (SELECT list(\"goldenId\" ORDER BY \"goldenId\") AS a, count(*) AS n FROM golden_set WHERE \"goldenId\" IS NOT NULL), "
    f"st(a, last, s) AS (SELECT a, n - 1, {SEED}::HUGEINT FROM src UNION ALL SELECT [CASE WHEN i = last + 1 THEN a[o + 1] WHEN i = o + 1 THEN a[last + 1] ELSE a[i] END FOR i IN range(1, len(a) + 1)], last - 1, s2 FROM "
    f"(SELECT a, last, s2, CAST(floor((xor(y, y >> 14) & {_M}) / 4294967296.0 * (last + 1)) AS BIGINT) AS o FROM "
    f"(SELECT a, last, s2, xor(x, (x + ((xor(x, x >> 7) * (x | 61)) & {_M})) & {_M}) AS y FROM "
    f"(SELECT a, last, s2, (xor(s2, s2 >> 15) * (s2 | 1)) & {_M} AS x FROM (SELECT a, last, (s + 1831565813) & {_M} AS s2 FROM st WHERE last > 0))))) "
    "SELECT a[i] AS \"goldenId\", i AS place FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM st WHERE last <= 0)"
)


@query(_SHUFFLE)
def shuffle_fy(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_shuffle(load(spark, d, GOLDEN), "goldenId", SEED)


@query('SELECT label, n, round(n / total, 4) AS share FROM (SELECT "evaluationLabel" AS label, count(*) AS n, min("goldenId") AS seen, sum(count(*)) OVER () AS total FROM golden_set WHERE "evaluationLabel" IS NOT NULL GROUP BY 1) ORDER BY n DESC, seen LIMIT 1')
def m_majority(spark: SparkSession, d: str) -> DataFrame:
    return classify.majority(load(spark, d, GOLDEN), "evaluationLabel", "goldenId")


_MAJORITY = 'SELECT label, round(n / total, 4) AS share FROM (SELECT "evaluationLabel" AS label, count(*) AS n, min("goldenId") AS seen, sum(count(*)) OVER () AS total FROM golden_set WHERE "evaluationLabel" IS NOT NULL GROUP BY 1) ORDER BY n DESC, seen LIMIT 1'


@query(f'SELECT "goldenId" AS golden_id, label AS predicted, share AS confidence FROM golden_set, ({_MAJORITY})')
def m_majority_predict(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, GOLDEN).withColumnRenamed("goldenId", "golden_id")
    return classify.predict_majority(classify.majority(g, "evaluationLabel", "golden_id"), g, "golden_id")


@query('SELECT label, count(*) AS n FROM (SELECT "evaluationLabel" AS label FROM golden_set UNION ALL SELECT "automaticCandidateLabel" FROM golden_set) GROUP BY label')
def so_union_all(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, GOLDEN)
    return g.select(F.col("evaluationLabel").alias("label")).union(g.select("automaticCandidateLabel")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT "evaluationLabel" AS label FROM golden_set UNION SELECT "automaticCandidateLabel" FROM golden_set')
def so_union_labels(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, GOLDEN)
    return g.select(F.col("evaluationLabel").alias("label")).union(g.select("automaticCandidateLabel")).distinct()


@query(f"SELECT trim(\"tweetId\") AS id FROM golden_set INTERSECT SELECT trim(\"customerTweetId\") FROM {PAIRS}")
def so_intersect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, GOLDEN).select(F.trim("tweetId").alias("id")).intersect(load(spark, d, PAIRS).select(F.trim("customerTweetId")))


@query(f"SELECT trim(\"customerTweetId\") AS id FROM {PAIRS} EXCEPT SELECT trim(\"tweetId\") FROM golden_set")
def so_except(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PAIRS).select(F.trim("customerTweetId").alias("id")).subtract(load(spark, d, GOLDEN).select(F.trim("tweetId")))


# Streams, run to the end of the available data.


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    batch = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    scratch = Scratch(spark, "stream")
    folder = f"{scratch.base}/in"
    batch.write.parquet(folder)
    stream = ingest.read_stream(spark, folder, batch, files_per_trigger=1000)
    counted = ingest.window_counts(stream, "ts", "event_type", "value", late="3650 days")
    out = f"{scratch.base}/out"
    q = counted.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, event_type, coalesce(props, '') AS props FROM events")
def stream_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream appended to JSON lines and read back."""
    batch = load(spark, d, "events").select("event_id", "event_type", "props")
    scratch = Scratch(spark, "jsonl-stream")
    batch.write.parquet(f"{scratch.base}/in")
    stream = ingest.read_stream(spark, f"{scratch.base}/in", batch, files_per_trigger=1000)
    ingest.write_jsonl_stream(stream, f"{scratch.base}/out", f"{scratch.base}/state").awaitTermination()
    return files.read_jsonl(spark, f"{scratch.base}/out", batch.schema).select("event_id", "event_type", F.coalesce("props", F.lit("")).alias("props"))
