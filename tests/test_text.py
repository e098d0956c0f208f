from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.times import created_micros


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("@AppleSupport  hi &amp;lt; you\n\nthere https://t.co/Ab1 ", "hi < you there"),
        ("a  b", "a b"),
        ("I️ am� ok", "I am ok"),
        ("https://example.com/x stays", "https://example.com/x stays"),
        (None, ""),
        ("", ""),
        ("   \t", ""),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, T.clean_text("x"), raw) == clean


def test_entities(spark):
    e = one(spark, T.entities("x"), "@a @b_1 see https://t.co/x1 and https://other.co/y")
    assert e.asDict() == {"mentions": ["@a", "@b_1"], "urls": ["https://t.co/x1"], "has_url": True, "has_multiple_mentions": True}


@pytest.mark.parametrize(("raw", "ids"), [("1,2", ["1", "2"]), (" ", []), (None, []), ("7", ["7"])])
def test_split_ids(spark, raw, ids):
    assert one(spark, T.split_ids("x"), raw) == ids


@pytest.mark.parametrize(("raw", "flag"), [(" TRUE ", True), ("False", False), ("1", False), (None, False)])
def test_parse_bool(spark, raw, flag):
    assert one(spark, T.parse_bool("x"), raw) is flag


def test_lengths_count_utf16(spark):
    assert one(spark, T.utf16_length("x"), "a😡") == 3


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [("The Wi-Fi on my Apple ID won't work, I x", ["wifi", "my", "appleid", "won't", "work", "i"]), ("", []), (None, []), ("!!! 😡", []), ("Face ID “now”", ["faceid", "now"])],
)
def test_tokens(spark, raw, tokens):
    assert one(spark, T.tokens_bm25("x"), raw) == tokens


def test_tfidf_tokens_join_fewer_words_and_add_bigrams(spark):
    assert one(spark, T.tokens_tfidf("x"), "face id broke") == ["face", "id", "broke", "face_id", "id_broke"]
    assert one(spark, T.tokens_tfidf("x"), "broke") == ["broke"]


def test_padding_keeps_long_numbers(spark):
    assert [one(spark, T.padded_id("G-", "x"), n, "long") for n in (7, 1234)] == ["G-007", "G-1234"]


def test_code_fence(spark):
    assert one(spark, T.strip_code_fence("x"), '```JSON\n{"a": 1}\n```\n') == '{"a": 1}'


def test_keywords_are_whole_words_also_in_accented_text(spark):
    p = T.keyword_pattern(["cran", "app store"])
    assert [one(spark, F.col("x").rlike(p), t) for t in ("le cran", "écrans", "App  Store", "xcran")] == [True, False, True, False]


@pytest.mark.parametrize(
    ("raw", "seconds"),
    [("Sun Oct 01 01:17:39 +0000 2017", 1506820659), ("2017-10-01T02:53:35Z", 1506826415), ("2017-10-01T02:20:19+02:00", 1506817219), ("1506805918", 1506805918), ("soon", None), (None, None), ("", None)],
)
def test_times(spark, raw, seconds):
    got = one(spark, created_micros("x"), raw)
    assert got == (None if seconds is None else seconds * 1_000_000)


def test_redaction_knows_all_keys_and_nested_maps(spark):
    flat = {"Bearer": "a", "openai_api_key": "b", "kind": "c"}
    assert one(spark, T.redact_keys("x"), flat, "map<string,string>") == {"Bearer": "[REDACTED]", "openai_api_key": "[REDACTED]", "kind": "c"}
    nested = {"secret": {"v": "a"}, "more": {"Access_Token": "b", "kind": "c"}}
    assert one(spark, T.redact_keys("x", depth=2), nested, "map<string,map<string,string>>") == {"secret": {"v": "[REDACTED]"}, "more": {"Access_Token": "[REDACTED]", "kind": "c"}}


def test_code_fences_by_hand(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "```\nx\n```  ": "x", "plain": "plain", "```json\nopen": "open", "a ```b``` c": "a ```b``` c", " ```JSON\nx ``` y\n``` ": "x ``` y", "": "", None: None}
    for text, want in cases.items():
        assert one(spark, T.strip_code_fence("x"), text) == want


def test_json_errors_and_masked_keys_by_hand(spark):
    j = T.parsed_json("x", "intent string, score double")
    assert one(spark, j["value"]["intent"], '{"intent": "battery", "score": 0.5}') == "battery"
    assert one(spark, j["value"]["score"], '{"intent": "battery", "score": 0.5}') == 0.5
    assert [one(spark, j["error"], t) for t in ('{"intent": 1}', "{oops", " ", None)] == [None, "invalid", "empty", "empty"]
    nested = '{"a": {"Password": "x \\" y", "b": [{"token": 5}, {"tokens": 6}]}, "apiKey": null, "text": "token: abc"}'
    assert one(spark, T.redact_json("x"), nested) == '{"a": {"Password": "[REDACTED]", "b": [{"token": "[REDACTED]"}, {"tokens": 6}]}, "apiKey": "[REDACTED]", "text": "token: abc"}'


def test_keywords_that_end_in_no_letter(spark):
    p = T.keyword_pattern(["waiting...", "app store"])
    assert [one(spark, __import__("pyspark").sql.functions.col("x").rlike(p), t) for t in ("waiting...now", "waiting... now", "the App  Store!", "app stores")] == [True, False, True, False]
