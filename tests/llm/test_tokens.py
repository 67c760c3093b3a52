import random

import pytest
from pyspark.sql import functions as F
from tickloom.llm import tokens

ODD = [
    None, "", " ", "\n\n  \t", "it's we'LL they've 'tis ''s", "<|endoftext|> <s> [PAD]", "naïve café  ", "日本語のテスト、12３", "a" * 3000, "ab " * 5000, "\x00\x1c\x85\xa0x  y", "🤮👩‍👩‍👧 emoji", "𞤀𞤁 \U0001e5d0\U00010d40 new letters \U00011f50",
    "x\r\n\r\n y   z\t\t", "１２３ ⅷ ½ ٣", "é ​   end", "()[]{}!!! ...", "   leading", "trailing   ",
]


def expected(texts):
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.vocabulary_folder(), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    pool = list("abc XYZ'’sdtm \n\t 019٣ éßøñ日本ー。!?#– 　 🤮") + ["'s", " the", "'ll ", "́"]
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ODD[:4]


def test_ids_equal_the_library(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string").withColumns({"words": F.lit(1), "block": F.lit(2), "key": F.lit(3)})
    got = {r.doc_id: r.ids for r in tokens.encode(df, block_words=300).collect()}
    assert got == dict(enumerate(expected(corpus)))
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}


def test_round_trip(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df), chunk=7).collect()} == {i: t or "" for i, t in enumerate(corpus)}


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id bigint, text string")
    got = tokens.encode(df).collect()
    assert len(got) == 4 and sorted(len(r.ids) for r in got) == [0, 1, 2, 2]
    assert tokens.encode(df.limit(0)).count() == 0
