"""Text sentiment against sums by hand."""

import math

import pytest

from quantloom.operators import text

#: Headlines and the summed weights of their reference terms.
CASES = [
    ("Shares surge on bullish outlook", 5.5), ("Upgrade after a record quarter", 4.0), ("Strong momentum, optimistic guidance", 4.0),
    ("Stock plunge follows bankruptcy and fraud probe", -9.5), ("Downgrade: lawsuit, losses and layoffs", -8.5), ("Selloff deepens as recession headwinds grow", -6.5),
    ("Outlook stable, margins steady", 1.0), ("Volume flat, mixed and unchanged", 0.0),
]


def test_lexicon_has_all_reference_terms(spark):
    assert len(text.TERMS) == 78 and sum(text.TERMS.values()) == pytest.approx(-42.0)
    got = {r.headline: r for r in text.lexicon_sentiment(spark.createDataFrame([(h,) for h, _ in CASES], "headline string")).collect()}
    for headline, total in CASES:
        score = total / math.sqrt(total * total + 15)
        assert got[headline].sentiment_score == pytest.approx(score) and got[headline].sentiment_confidence == pytest.approx(abs(score))
        assert got[headline].sentiment_signal == ("bullish" if score > 0.1 else "bearish" if score < -0.1 else "neutral")
