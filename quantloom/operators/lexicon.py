"""Rule-based sentiment of short texts: a lexicon table, and rules for what stands around its terms.

The rules are those of the VADER paper (Hutto and Gilbert, 2014): words that strengthen or weaken up to three words before a term,
fading with distance; negations there; capitals where not all is in capitals; "but", after which counts more; exclamation and question
marks. Tokens are joined with the lexicon, a table of any size; a text's tokens are then put together again and scanned by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import settled
from .text import MIN_LENGTH, TERMS

# Fixed values of the published rules.
BOOST, CAPITALS, NEGATED, FADE, MARK, QUESTION, QUESTIONS, NORM = 0.293, 0.733, -0.74, (1.0, 0.95, 0.9), 0.292, 0.18, 0.96, 15.0
STRONGER = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally extremely fabulously "
    "fully greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously unbelievably unusually utterly very"
)
WEAKER = "almost barely hardly just kinda kindof less little marginally occasionally partly scarcely slightly somewhat sorta sortof"
NEGATIONS = "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt rarely seldom shant shouldnt uhuh uhoh wasnt werent without wont wouldnt despite"
SCHEMA = "term string, valence double, boost double, negates boolean"


def default_lexicon(spark: SparkSession, terms: dict[str, float] | None = None) -> DataFrame:
    """``term, valence, boost, negates``: the finance terms (or others), with the words that change what they mean."""
    rows = [(t, float(v), None, False) for t, v in (terms or TERMS).items()]
    rows += [(t, None, BOOST, False) for t in STRONGER.split()] + [(t, None, -BOOST, False) for t in WEAKER.split()]
    rows += [(t, None, None, True) for t in NEGATIONS.split()]
    return spark.createDataFrame(rows, SCHEMA)


def tokens(text: Column) -> Column:
    """Words between white space, without marks around them; words of one or two characters then keep theirs (emoticons)."""
    raw = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")
    return F.transform(raw, lambda w: F.when(F.length(bare(w)) > 2, bare(w)).otherwise(w))


def capitals(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _context(i: Column, t: Column, mixed: Column) -> Column:
    """A term's valence after capitals, and the three words before it, the nearest first."""
    own = F.get(t, i)
    v = own["valence"]
    louder = lambda v: F.when(v > 0, F.lit(CAPITALS)).when(v < 0, F.lit(-CAPITALS)).otherwise(F.lit(0.0))
    start = v + F.when(mixed & capitals(own["word"]), louder(v)).otherwise(F.lit(0.0))

    def step(v: Column, back: int) -> Column:
        w = F.get(t, i - back)
        plain = w.isNotNull() & w["valence"].isNull()
        loud = F.when(mixed & capitals(w["word"]), F.lit(CAPITALS)).otherwise(F.lit(0.0))
        more = F.coalesce((w["boost"] + loud) * F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * FADE[back - 1], F.lit(0.0))
        turned = (v + more) * F.when(F.coalesce(w["negates"], F.lit(False)) | w["word"].contains("n't"), F.lit(NEGATED)).otherwise(F.lit(1.0))
        return F.when(plain, turned).otherwise(v)

    # each step looks at the value before it, so it is bound by a lambda and not written out again
    value = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, lambda v, back: F.when(back == 1, step(v, 1)).when(back == 2, step(v, 2)).otherwise(step(v, 3)))
    one, two = F.lower(F.get(t, i - 1)["word"]), F.lower(F.get(t, i - 2)["word"])
    least = F.coalesce((one == "least") & ~F.coalesce(two.isin("at", "very"), F.lit(False)), F.lit(False))
    return F.when(v.isNull() | own["boost"].isNotNull(), F.lit(0.0)).otherwise(value * F.when(least, F.lit(NEGATED)).otherwise(F.lit(1.0)))


def rule_sentiment(df: DataFrame, text: str = "headline", lexicon: DataFrame | None = None) -> DataFrame:
    """``df`` with ``sentiment_score`` (the compound, -1 to 1), ``sentiment_confidence`` (its size), ``prob_positive, prob_negative,
    prob_neutral`` (shares of the text) and ``sentiment_signal``. ``lexicon``: ``term`` (lower case), ``valence, boost, negates``; a
    term listed twice counts by its first. Null texts and those under five characters score 0, with shares of 0."""
    spark = df.sparkSession
    lexicon = (lexicon if lexicon is not None else default_lexicon(spark)).groupBy("term").agg(F.first("valence", True).alias("valence"), F.first("boost", True).alias("boost"), F.max("negates").alias("negates"))
    carried = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    keyed = settled(df.select(carried, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_id")), "texts")  # numbers stay as they are
    long_enough = F.coalesce(F.length(F.trim("_text")) >= MIN_LENGTH, F.lit(False))
    words = keyed.select("_id", F.posexplode(F.when(long_enough, tokens(F.col("_text")))).alias("pos", "word"))
    words = words.join(lexicon, F.lower("word") == F.col("term"), "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "valence", "boost", "negates"))).alias("t"))
    t, places = F.col("t"), F.sequence(F.lit(0), F.size("t") - 1)
    loud = F.size(F.filter("t", lambda w: capitals(w["word"])))
    words = words.withColumn("_mixed", (loud > 0) & (loud < F.size("t"))).withColumn("_s", F.transform(places, lambda i: _context(i, t, F.col("_mixed"))))
    but = F.array_position(F.transform("t", lambda w: F.lower(w["word"])), "but")
    # words before "but" count half, those after it half as much again
    s = F.transform("_s", lambda x, i: x * F.when((but == 0) | (i == but - 1), F.lit(1.0)).when(i < but - 1, F.lit(0.5)).otherwise(F.lit(1.5)))
    out = keyed.join(words.select("_id", s.alias("_s")), "_id", "left")

    count = lambda mark: F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(mark), F.lit("")))
    asks = count("?")
    marks = F.least(count("!"), F.lit(4)) * MARK + F.when(asks <= 1, F.lit(0.0)).when(asks <= 3, asks * QUESTION).otherwise(F.lit(QUESTIONS))
    add = lambda f: F.coalesce(F.aggregate("_s", F.lit(0.0), lambda a, x: a + f(x)), F.lit(0.0))
    out = out.withColumns({
        "_marks": F.coalesce(marks, F.lit(0.0)), "_sum": add(lambda x: x), "_up": add(lambda x: F.when(x > 0, x + 1).otherwise(F.lit(0.0))),
        "_down": add(lambda x: F.when(x < 0, 1 - x).otherwise(F.lit(0.0))), "_none": add(lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.lit(0.0))),
    })
    total = F.col("_sum") + F.signum("_sum") * F.col("_marks")
    up = F.col("_up") + F.when(F.col("_up") > F.col("_down"), F.col("_marks")).otherwise(F.lit(0.0))
    down = F.col("_down") + F.when(F.col("_up") < F.col("_down"), F.col("_marks")).otherwise(F.lit(0.0))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("_pu") + F.col("_pd") + F.col("_none")), F.lit(0.0))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.sqrt(total * total + NORM)))
    out = out.withColumns({"_score": score, "_pu": up, "_pd": down})
    x = F.col("_score")
    label = F.when(x > 0.1, "bullish").when(x < -0.1, "bearish").otherwise("neutral")
    return out.select("_row.*", x.alias("sentiment_score"), F.abs(x).alias("sentiment_confidence"), share(F.col("_pu")).alias("prob_positive"), share(F.col("_pd")).alias("prob_negative"), share(F.col("_none")).alias("prob_neutral"), label.alias("sentiment_signal"))
