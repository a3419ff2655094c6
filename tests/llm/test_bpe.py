import random
from pathlib import Path

import pytest

from tessera.llm.bpe import GPT_PATTERN, Encoder, encode_corpus, read_ranks
from tessera.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = read_ranks(VOCABULARY)
    return Encoder(ranks, cache_limit=100), tiktoken.Encoding("own", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_merging(both):
    mine, theirs = both
    rnd = random.Random(0)
    for _ in range(3000):
        s = "".join(rnd.choice("abcdeéñ ß漢 theing0189\n\tAB's🎉​") for _ in range(rnd.randint(0, 60)))
        assert mine.encode(s) == theirs.encode_ordinary(s)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 5000 + "x", "ab" * 20_000, "漢" * 3000, "<|endoftext|> is text"])
def test_long_and_odd(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_table(spark, both):
    rows = [(1, "Hello  world", "x"), (2, "", "y"), (3, None, "z"), (None, "Hello  world", "w"), (1, "Hello  world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column with the result's name
    got = encode_corpus(df, VOCABULARY).collect()
    want = both[1].encode_ordinary("Hello  world")
    assert sorted([(r.doc_id or 0, r.ids) for r in got]) == sorted([(1, want), (2, []), (3, []), (0, want), (1, want)])
    assert got[0].__fields__ == ["doc_id", "ids"]
    assert encode_corpus(df.limit(0), VOCABULARY).count() == 0
