"""Rule-based sentiment: a case for each rule, and the published examples' order."""

import math

import pytest

from quantloom.operators import lexicon

CASES = {
    "stock gain today": 1.5,
    "no terms in here": 0.0,
    "very strong quarter": 1.0 + 0.293,
    "slightly weak quarter": -1.5 + 0.293,
    "very well strong quarter": 1.0 + 0.293 * 0.95,
    "very well then strong": 1.0 + 0.293 * 0.9,
    "very much more than strong": 1.0 + 0.293 * 0.95,  # "more" is two words before; "very" is four
    "not strong at all": 1.0 * -0.74,
    "not very strong quarter": (1.0 + 0.293) * -0.74,
    "isn't really strong now": (1.0 + 0.293) * -0.74,
    "STRONG quarter for all": 1.0 + 0.733,
    "STRONG QUARTER FOR ALL": 1.0,  # all in capitals: nothing stands out
    "VERY strong quarter here": 1.0 + 0.293 + 0.733,
    "strong sales but losses": 1.0 * 0.5 - 2.0 * 1.5,
    "the least strong name": 1.0 * -0.74,
    "at least strong sales": 1.0,
    "gain gain again": 3.0,
    "gain, they said (gain)": 3.0,
    "fraud not gain here": -3.5 + 1.5 * -0.74,
    "not fraud gain": -3.5 * -0.74 + 1.5 * -0.74,
}
MARKS = {"strong quarter!": (1.0, 0.292), "strong quarter!!!!!!": (1.0, 4 * 0.292), "weak quarter?!": (-1.5, 0.292), "weak quarter??": (-1.5, 0.36), "weak quarter?????": (-1.5, 0.96)}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [*CASES, *MARKS, "", None, "gain", "  up  "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "id int, headline string, term int").repartition(3)
    got = lexicon.rule_sentiment(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) >= {"id", "headline", "term"}
    return {r.headline: r for r in got}


@pytest.mark.parametrize("text", CASES)
def test_rules(scored, text):
    s = CASES[text]
    assert scored[text].sentiment_score == pytest.approx(s / math.sqrt(s * s + 15)) and scored[text].sentiment_confidence == abs(scored[text].sentiment_score)


@pytest.mark.parametrize("text", MARKS)
def test_marks(scored, text):
    s, more = MARKS[text]
    s += math.copysign(more, s)
    assert scored[text].sentiment_score == pytest.approx(s / math.sqrt(s * s + 15))


def test_shares_and_short_texts(scored):
    r = scored["strong sales but losses"]
    up, down, none = 1.5, 4.0, 2.0
    assert (r.prob_positive, r.prob_negative, r.prob_neutral) == pytest.approx((up / 7.5, down / 7.5, none / 7.5))
    for text in ("", None, "gain", "  up  "):
        assert (scored[text].sentiment_score, scored[text].prob_neutral, scored[text].sentiment_signal) == (0.0, 0.0, "neutral")


def test_own_lexicon(spark):
    own = spark.createDataFrame([("meh", -1.0, None, False), ("meh", -9.0, None, False), ("super", None, 0.5, False)], lexicon.SCHEMA).coalesce(1)
    df = spark.createDataFrame([("super meh stuff",), ("strong gain here",)], "headline string")
    got = {r.headline: r.sentiment_score for r in lexicon.rule_sentiment(df, lexicon=own).collect()}
    assert got["super meh stuff"] == pytest.approx(-1.5 / math.sqrt(1.5**2 + 15)) and got["strong gain here"] == 0
    assert lexicon.rule_sentiment(df.limit(0)).count() == 0
