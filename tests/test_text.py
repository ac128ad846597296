import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.functions.porter import stem, stem_tokens
from verbarium.functions.stopwords import STOP_WORDS
from verbarium.functions.text import analyzer, tokenize_naive, tokenize_punctuation


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


PUNCTUATION = [
    ("Who Baked These LOAVES?", ["baked", "loaves"]),
    # Each of the five marks parts tokens, alone or in a row.
    ("tin,zinc.iron;lead?gold!7", ["tin", "zinc", "iron", "lead", "gold", "7"]),
    ("salt.,;pepper", ["salt", "pepper"]),
    # Other marks belong to their token.
    ("left_right<up:down/back", ["left_right<up:down/back"]),
    ("Harbour :\tmasts,\n ropes;;SAILS", ["harbour", ":", "masts", "ropes", "sails"]),
    ("", []),
    ("\t \n", []),
    ("?;.", []),
    ("the and of", []),
]


def test_punctuation(spark):
    assert run(spark, tokenize_punctuation, *[t for t, _ in PUNCTUATION]) == [x for _, x in PUNCTUATION]


def test_null_text_gives_null(spark):
    assert run(spark, tokenize_punctuation, None) == [None]
    assert run(spark, tokenize_naive, None) == [None]


def test_naive_keeps_leading_empty_token(spark):
    assert run(spark, tokenize_naive, "\tRed  kite ", "", " \n", "Blue\nJay;") == [["", "red", "kite"], [""], [], ["blue", "jay;"]]


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 171


# By step: plurals, -ed and -ing, -y, double suffixes, -ful and the like, Latinate endings, final -e and -ll.
STEMS = {
    "gardens berries glasses pies lens": "garden berri glass pi len",
    "planted knitting bouncing sailing rolled glazed stirred buzzing": "plant knit bounc sail roll glaze stir buzz",
    "fed bring exceed refereed": "fed bring exce refere",
    "cloudy dry enjoy": "cloudi dry enjoi",
    "operational emotional frequency tokenizer noisily visibly gently silently curiously": "oper emot frequenc token noisili visibl gentli silent curious",
    "hybridization migration navigator pluralism decisiveness gratefulness nervousness": "hybrid migrat navig plural decis grate nervous",
    "locality passivity flexibility geology": "local passiv flexibl geologi",
    "duplicate decorative legalize authenticity musical hopeful kindness": "duplic decor legal authent music hope kind",
    "arrival avoidance preference boiler generic adaptable accessible irritant": "arriv avoid prefer boiler gener adapt access irrit",
    "argument movement apparent adoption expansion onion": "argument movement appar adopt expans onion",
    "controlled table love bee": "control tabl love bee",
    "ox 2024 x9": "ox 2024 x9",
}


@pytest.mark.parametrize("words", STEMS)
def test_stems(words):
    assert [stem(w) for w in words.split()] == STEMS[words].split()


def test_analyzer_stems_after_stop_words(spark):
    assert run(spark, analyzer(tokenize_punctuation, stem_tokens), "Those bakeries; were SHOUTING?", None) == [["bakeri", "shout"], None]


@given(st.text(alphabet="abceilnostyz'É1", max_size=12))
def test_stem_never_grows_by_more_than_one(word):
    assert len(stem(word)) <= len(word) + 1
    assert stem(word) == word or len(word) > 2
