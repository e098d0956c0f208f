"""Encoding, leaks, shared spans, personal data, abuse: exact checks and edge cases."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import abuse, leaks, pii
from threadloom.llm import encoding as E
from threadloom.llm import spans as S

needs_vocabulary = pytest.mark.skipif(not Path(E.VOCABULARY).exists(), reason="no vocabulary file here")


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sdlrvem \n\t1!?.é😡  漢<|>"), max_size=80), st.sampled_from([1, 2, 3, 7, 20]))
def test_tree_encoding_equals_plain_encoding(text, leaf):
    e = E.encoder(leaf=leaf)
    assert e.encode(text) == e.plain.encode_ordinary(text)
    assert e.decode(e.encode(text)) == text


@needs_vocabulary
def test_encoding_edge_cases(spark):
    long = "x" * 20_000 + " y" * 5_000 + "   \n" * 500
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (4, "<|endoftext|>", 0), (5, long, 0), (5, long, 0)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in E.encode_corpus(df).collect()]
    plain = E.encoder().plain.encode_ordinary
    assert sorted(got) == sorted([(1, []), (2, []), (3, plain(" ")), (4, plain("<|endoftext|>")), (5, plain(long)), (5, plain(long))])
    assert E.encode_corpus(df.limit(0)).count() == 0
    back = sorted((r.doc_id, r.text) for r in E.decode_corpus(E.encode_corpus(df)).collect())
    assert back == [(1, ""), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, long), (5, long)]


@pytest.mark.parametrize("bound", [leaks.MAX_WINDOWS, 0])
def test_leaks(spark, bound):
    twelve = "One two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"start {twelve.lower().replace(' ', ', ')}! end"), (2, twelve.replace("six", "6")), (3, None), (4, ""), (5, f"{twelve} {twelve}"), (5, twelve), (6, twelve.replace(" ", "_"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"zero {twelve} thirteen"), (8, "too short"), (9, None), (7, f"zero {twelve} thirteen")], "item_id long, item_text string")
    got = sorted(tuple(r) for r in leaks.leaks(docs, items, max_windows=bound).collect())
    assert got == [(1, 7), (5, 7), (6, 7)]
    clean = {r.doc_id: (r.text, r.n_leaked) for r in leaks.without_leaks(docs.where("doc_id <> 5"), items, max_windows=bound).collect()}
    assert clean[1] == ("start ! end", 1) and clean[3] == (None, 0) and clean[2][1] == 0
    assert leaks.leaks(docs.limit(0), items, max_windows=bound).count() == 0
    assert leaks.leaks(docs, items.limit(0), max_windows=bound).count() == 0


def brute_spans(texts, n):
    where = {}
    for d, t in texts:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in texts:
        at = [i for i in range(len(t or "") - n + 1) if len(where[t[i : i + n]]) > 1]
        k = 0
        while k < len(at):
            e = k
            while e + 1 < len(at) and at[e + 1] <= at[e] + n:
                e += 1
            out.add((d, at[k], at[e] + n))
            k = e + 1
    return out


@pytest.mark.parametrize(("length", "seed", "group"), [(12, 5, 2000), (12, 5, 2), (20, 20, 2000), (30, 8, 0)])
def test_shared_spans_against_brute_force(spark, length, seed, group):
    rng = random.Random(length + group)
    pool = ["".join(rng.choices("ab", k=rng.randint(5, 60))) for _ in range(6)] + ["é😡" * 20, "a" * 70]
    texts = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices("abcdef ", k=20)) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(90, None), (91, ""), (92, "zq" * 40)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, seed string")
    got = {tuple(r) for r in S.shared_spans(df, length=length, seed=seed, group=group).collect()}
    assert got == brute_spans(texts, length) and got


def test_span_edge_cases(spark):
    df = spark.createDataFrame([(1, "q" * 500), (1, "q" * 500), (2, "r" * 199), (3, "s" * 450)], "doc_id long, text string")
    assert S.shared_spans(df).count() == 0
    parts = {r.doc_id: r for r in S.shared_parts(spark.createDataFrame([(1, "t" * 250), (2, "t" * 300), (3, None)], "doc_id long, text string")).collect()}
    assert (parts[1].shared_chars, parts[2].shared_part, parts[3].n_chars) == (250, 1.0, 0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to Ann.Lee+x@mail.example.com.", [("email", "annleexmailexamplecom")]),
        ("my mail is ann (at) example [dot] org", [("email", "annatexampledotorg")]),
        ("reach me at ann at example dot org please", [("email", "annatexampledotorg")]),
        ("call me on +44 (0)20 7946 0123 - thanks", [("phone", "4402079460123")]),
        ("text (206) 555-0123", [("phone", "2065550123")]),
        ("error 676-285-291 and case 105230379, tracking ZX926793563", []),
        ("restarted it 842 times on 2017-11-09 invoice 2017/251/284", []),
        ("my social is 967-99-5662", [("id_number", "967995662")]),
        ("NI number is QQ 12 34 56 c", [("id_number", "qq123456c")]),
        ("passport no. X01234567 &amp; order W3844811", [("id_number", "x01234567")]),
        ("my address: 12b Old Mill Road, flat 3", [("street_address", "12boldmillroad")]),
        ("clearing 644 photos all the way", []),
        ("my name is Dr. Ann B. O'Leeworth, thanks", [("person_name", "annboleeworth")]),
        ("ask for the billing desk. this is getting tiring", []),
        ("@AppleSupport @115858 my iPhone 7 Plus on 11.0.3 ^AB", []),
        ("", []),
        ("my sister Anna Kowalska called you", [("person_name", "annakowalska")]),
        ("Ich wohne Hauptstraße 12 in Bonn", [("street_address", "hauptstraße12")]),
        ("Lange Gasse 3a, Wien", [("street_address", "langegasse3a")]),
        ("j'habite au 5 rue de la Paix à Lyon", [("street_address", "5ruedelapaix")]),
        ("vivo en Calle Mayor, 12 Madrid", [("street_address", "callemayor12")]),
        ("my number is 06 12 34 56 78", [("phone", "0612345678")]),
        ("Handy 0171 1234567", [("phone", "01711234567")]),
        ("Steuer-ID 86095742719", [("id_number", "86095742719")]),
        ("es mi NIE X1234567L", [("id_number", "x1234567l")]),
        ("12345678Z", [("id_number", "12345678z")]),
        ("12345678A and 123-45-0000 and 000-12-3456", []),
        ("best regards,\nTom Baker", [("person_name", "tombaker")]),
        ("thanks for the quick help - Maria Kowalczyk", [("person_name", "mariakowalczyk")]),
        ("- Battery Health shows nothing", []),
    ],
)
def test_personal_data(text, want):
    x = pii.readable(text)
    assert [(s.kind, pii.plain(x[s.start : s.end])) for s in pii.spans(x)] == want
    assert pii.spans(x) == next(pii._with_spans([text]))[1]


# Sentences written apart from the test tables, with what they hold.
INDEPENDENT = [
    ("Hi, my name is Deborah Lin and my phone died", {"person_name": 1}),
    ("Please ship the replacement to 48 Wellington Road", {"street_address": 1}),
    ("you can reach me at deborah.lin@post.example or 415 555 0199", {"email": 1, "phone": 1}),
    ("My passport number is K4471902 if you need it", {"id_number": 1}),
    ("ssn: 219-09-9999, please delete it", {"id_number": 1}),
    ("Regards, Marcus Oyelaran", {"person_name": 1}),
    ("My wife Ingrid Halvorsen is the account holder", {"person_name": 1}),
    ("I talked to Dr. Samuel Adeyemi yesterday", {"person_name": 1}),
    ("call me back on +49 30 901820 after six", {"phone": 1}),
    ("Meine Adresse: Lindenallee 7, Köln", {"street_address": 1}),
    ("mon adresse est 12 bis avenue Victor Hugo", {"street_address": 1}),
    ("Mi dirección es Avenida de América 25", {"street_address": 1}),
    ("appelez-moi au 01 44 55 66 77", {"phone": 1}),
    ("national insurance AB 12 34 56 C", {"id_number": 1}),
    ("mail me: j_smith (at) mail (dot) example", {"email": 1}),
    ("we moved to 9 Orchard Close last week", {"street_address": 1}),
    ("This is Priya Raman from Leeds", {"person_name": 1}),
    ("driver's licence D123-4567-8901", {"id_number": 1}),
    ("write to help at shop dot example please", {"email": 1}),
    ("ask for Tobias Lindqvist at the desk", {"person_name": 1}),
    ("text 07700 900123 when it is ready", {"phone": 1}),
    ("Mein Name ist Jürgen Habermann", {"person_name": 1}),
    ("DNI 00000014Z", {"id_number": 1}),
    ("iPhone 12 Pro Max on 16.4.1 restarts 3 times a day", {}),
    ("order 4471902 and case 100-200-3000 are still open", {}),
    ("build 20A362, serial C02XK1YJH5", {}),
    ("I tried Safe Mode and Disk Utility twice", {}),
    ("thanks, still broken", {}),
    ("the 3 way call drops in 5 places", {}),
    ("error 1100-2200 at 10:30 on 2021-05-06", {}),
    ("Hello Apple Support, what now?", {}),
    ("there are 200 photos in the way", {}),
    ("version 10.15.7 (19H15) since Monday", {}),
]


def test_recall_and_precision_on_independent_sentences():
    hit, found, true = {}, {}, {}
    for text, want in INDEPENDENT:
        got = [s.kind for s in pii.spans(pii.readable(text))]
        for kind in pii.TYPES:
            n, w = got.count(kind), want.get(kind, 0)
            hit[kind] = hit.get(kind, 0) + min(n, w)
            found[kind] = found.get(kind, 0) + n
            true[kind] = true.get(kind, 0) + w
    for kind in pii.TYPES:
        assert hit[kind] >= 0.9 * true[kind] and hit[kind] >= 0.9 * found[kind], (kind, hit[kind], found[kind], true[kind])


def test_redaction_keeps_the_rest(spark):
    assert pii.redact("Hi, call me on 206-555-0123 &gt; now") == "Hi, call me on [PHONE] > now"
    df = spark.createDataFrame([(1, "mail ann@example.com ann@example.com", 5), (2, None, 5), (3, "", 5), (1, "mail ann@example.com", 5)], "row_id long, t string, pii_type int")
    assert [tuple(r) for r in pii.find(df, ["t"]).collect()] == [(1, "t", "email", "annexamplecom")]
    assert sorted((r.row_id, r.t) for r in pii.redacted(df, ["t"]).where("t is null or t = ''").collect()) == [(2, None), (3, "")]
    assert pii.find(df.limit(0), ["t"]).count() == 0


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")


def test_long_text_is_read_to_its_end():
    x = "word " * 40_000 + "call me on 206-555-0123"
    assert [s.kind for s in pii.spans(x)] == ["phone"]


@pytest.fixture(scope="module")
def model():
    return abuse.train()


def test_abuse_spellings_are_normalised():
    assert abuse.normal("You are a M0r0n!!") == "you are a moron"
    assert abuse.normal("i d i o t s, w.a.n.k.e.r, uuuuseless") == "idiots wanker useles"
    assert abuse.normal("сlоwn") == "clown"  # with Cyrillic look-alikes
    assert abuse.normal(" \n") == ""


def test_abuse_on_held_out_fillings(model):
    """Windows of other fillings; ordinary messages, whole; the contrast set is the hardest part."""
    texts, y = abuse.training_windows(4, seed=2024)
    hit = model.scores(texts) >= abuse.THRESHOLD
    ordinary = model.scores(abuse.X.messages(1000, 2024)) >= abuse.THRESHOLD
    print("recall", hit[y > 0].mean(), "contrast", hit[y == 0].mean(), "ordinary", ordinary.mean())
    assert hit[y > 0].mean() > 0.75 and hit[y == 0].mean() < 0.25 and ordinary.mean() < 0.01


def test_abuse_of_patterns_left_out_of_training():
    """A tenth of the patterns is left out, and with it what only they say."""
    rng = random.Random(4)
    lines = {label: abuse.X.patterns(label) for label in (1, 0)}
    for x in lines.values():
        rng.shuffle(x)
    part = abuse.fit(lines={label: x[len(x) // 10 :] for label, x in lines.items()})
    held = [p for p, label in abuse.X.expand(6, 99, {1: lines[1][: len(lines[1]) // 10], 0: []}) if label]
    print("left out", (part.scores(held) >= abuse.THRESHOLD).mean())
    assert (part.scores(held) >= abuse.THRESHOLD).mean() > 0.75


def test_abuse_needs_a_person(model):
    filler = "the model drains within an hour and nobody at the desk could help since monday "
    bad = ["you lot are a bunch of id1ots", "I will find you and break your fingers one by one", "send me nudes", "only b r a i n l e s s cr*tins would write an answer like that"]
    fine = ["", None, "stupid phone stupid cable", "i feel like an idiot for updating", "how do i report a message where someone threatened my brother"]
    assert (model.scores([filler + b + " " + filler for b in bad]) >= abuse.THRESHOLD).all()
    assert (model.scores(fine) < abuse.THRESHOLD).all()


def test_abuse_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "s", 1.0), (2, "", None, 1.0), (3, "x " * 50_000 + "go to hell you stupid morons", "s", 1.0), (3, "x", "s", 1.0)], "row_id long, text string, ingest_source string, score double")
    assert [r.row_id for r in abuse.found(df, "text").collect()] == [3]
    got = {r.source: (r.n_rows, r.n_abusive) for r in abuse.rates(df, "text").collect()}
    assert got == {"s": (3, 1), None: (1, 0)}
    assert abuse.rates(df.limit(0), "text").count() == 0


def test_abuse_score_does_not_depend_on_the_table(spark):
    bad, ddl = "go to hell you stupid morons", "row_id long, text string, ingest_source string"
    alone = abuse.scores(spark.createDataFrame([(0, bad, "s")], ddl), "text").first().score
    rows = [(i, bad if i % 3 == 0 else f"my phone {i} drains within an hour", "s") for i in range(300)]
    got = {r.row_id: r.score for r in abuse.scores(spark.createDataFrame(rows, ddl), "text").collect()}
    assert {s for i, s in got.items() if i % 3 == 0} == {alone} and alone >= abuse.THRESHOLD
    assert max(s for i, s in got.items() if i % 3) < abuse.THRESHOLD


def test_abuse_knows_ordinary_talk_without_the_corpus(model):
    fine = ["The shop in Brunport had no answer. Nobody at the desk could help. My number is 206 555 0123", "My old ipad shows somebody else's backup list since Monday. I tried a full reset and another cable"]
    assert (model.scores(fine) < abuse.THRESHOLD).all()
