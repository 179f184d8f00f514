"""Column functions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newswake.functions import posts as P
from newswake.functions import text as T
from newswake.functions import timing as D
from newswake.operators import filters


@pytest.mark.parametrize(
    "query, text, found",
    [
        ("Bob Dylan", "un prix pour bob dylan", True),
        ("Israel", "le président d'Israël", True),
        ("Israël", "ISRAEL", True),
        ("bobdylan", "#BobDylan", True),
        ("bobdylan", "@BobDylan", True),
        ("Bob Dylan", "#BobDylan", False),
        ("Bob Dylan", "Bob seul", False),
    ],
)
def test_search_semantics(column, query, text, found):
    assert column(filters.search_all(F.lit(text), query)) is found


@pytest.mark.parametrize(
    "text, plain",
    [("Été à Noël", "Ete a Noel"), ("Œuvre, cœur", "OEuvre, coeur"), ("Straße", "Strasse"), ("Łódź ø", "Lodz o"), ("é", "e"), ("abc", "abc")],
)
def test_unaccent(column, text, plain):
    assert column(T.unaccent(F.lit(text))) == plain


def test_clean_title(column):
    assert column(T.clean_title(F.lit("L'état d'urgence: la  France, en «crise»!"))) == "etat urgence <<crise>>"


def test_strip_urls_mentions(column):
    assert column(T.strip_urls_mentions(F.lit("vu https://t.co/x par @moi ici"))) == "vu  par  ici"


def test_sentence_tokens(column):
    text = "New-York, Été http://x.y @moi c'est"
    assert column(T.sentence_tokens(F.lit(text))) == ["new", "york", "été", "c", "est"]


def test_terms_keep_accents_and_drop_single_letters(column):
    assert column(T.tokenize_terms(F.lit("À la fête: x y2"))) == ["la", "fête", "y2"]


@pytest.mark.parametrize("n, expected", [(2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_ngrams(column, n, expected):
    assert column(T.ngrams(F.array(*map(F.lit, "abc")), n)) == expected


def test_ngrams_of_nothing(column):
    assert column(T.term_grams(F.array().cast("array<string>"), 1, 3)) == []


def test_canonical_term(column):
    assert column(T.canonical_term(F.lit("ville de ville"))) == "de ville"


def test_stop_words_are_matched_in_lower_case(column):
    kept = T.remove_stopwords(F.array(F.lit("Le"), F.lit("Twitter"), F.lit("Nice")))
    assert column(kept) == ["Twitter", "Nice"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Wed Nov 16 08:15:00 +0000 2016", dt.datetime(2016, 11, 16, 8, 15)),
        ("Tue Feb 30 08:15:00 +0000 2016", None),
        ("yesterday", None),
    ],
)
def test_parse_created_at(column, text, expected):
    assert column(D.parse_created_at(F.lit(text))) == expected


def test_times_do_not_depend_on_the_session_zone(spark, column):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        assert column(D.parse_created_at(F.lit("Wed Jul 06 23:15:00 +0000 2016"))) == dt.datetime(2016, 7, 6, 23, 15)
        assert column(D.parse_timestamp_ms(F.lit("1479284100123"))) == dt.datetime(2016, 11, 16, 8, 15, 0, 123000)
        assert column(P.event_date(F.lit("afp.com-20161115T181832Z-TX-PAR-LEL49"))) == dt.datetime(2016, 11, 15, 18, 18, 32)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_timestamp_ms_missing(column):
    assert column(D.parse_timestamp_ms(F.lit(None).cast("string"))) is None


def test_date_shift(column):
    noon = F.lit("2016-11-15 12:00:00").cast("timestamp_ntz")
    assert column(D.date_shift(noon, days=-3)) == "2016-11-12T12:00:00"
    assert column(D.date_shift(noon, hours=0.5, seconds=-1)) == "2016-11-15T12:29:59"


def test_event_window(column):
    start, end = D.event_window("20161115")
    assert column(start) == dt.datetime(2016, 11, 12, 12)
    assert column(end) == dt.datetime(2016, 11, 16, 12)
    start, end = D.day_window("20161115")
    assert (column(start), column(end)) == (dt.datetime(2016, 11, 15), dt.datetime(2016, 11, 16))


def test_hashtag_string(column):
    tags = F.array(F.lit("b"), F.lit("Z"), F.lit("b"))
    assert column(P.hashtag_string(tags)) == "Z b b"
    assert column(P.hashtag_string(F.array().cast("array<string>"))) is None


def test_event_from_filename(column):
    event = column(P.event_from_filename(F.lit("/d/afp.com-20160914T033833Z-TX-PAR-GVL39.xml"), F.lit("titre")))
    assert event.asDict() == {
        "id": "afp.com-20160914T033833Z-TX-PAR-GVL39", "date": dt.datetime(2016, 9, 14, 3, 38, 33), "text": "titre",
    }


@pytest.mark.parametrize(
    "track, text, found",
    [(["été"], "Un ETE", True), (["de la"], "la ville de Nice", True), (["de la"], "de Nice", False), ([], "x", False)],
)
def test_track_any(column, track, text, found):
    assert column(filters.track_any(F.lit(text), track)) is found


def test_title_exclusion_is_case_sensitive(column):
    assert column(filters.title_exclusion(F.lit("A la une à dix heures"))) is False
    assert column(filters.title_exclusion(F.lit("a la une a dix heures"))) is True


@pytest.mark.parametrize("codes, kept", [(["15000000"], False), (["15000000", "04000000"], True), ([], False)])
def test_subject_exclusion(column, codes, kept):
    assert column(filters.subject_exclusion(F.array(*map(F.lit, codes)).cast("array<string>"))) is kept
