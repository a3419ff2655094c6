import random

import numpy as np
import pytest

import tessera.llm.spam as spam
from tessera.llm.spam import Counts, Tokenizer, information, pair_keys, stuffed_pages, stuffed_shares

DRIVERS = [f"{a}{b}" for a in ("ko", "ra", "ti", "mu", "ve") for b in ("lan", "der", "mi", "sto", "pek", "rin")]
PLACES = ("the hairpin", "turn two", "the old bridge", "pit entry", "the long straight")
FRAMES = (
    "{d} brakes far too late for {p} and runs wide onto the grass",
    "the stewards are looking into the contact between {d} and {e} at {p}",
    "there is smoke from the gearbox of {d} as the leaders come to {p}",
    "{d} has asked the engineer about the gap to {e} with ten laps to go",
    "the safety car picks up {d} while marshals clear the track near {p}",
    "it was a brave move by {d} on the outside of {e} into {p}",
    "the tyres of {d} are going off quickly now and {e} is right behind",
)
ITEMS = ["brake pads", "tow strap", "sim rig", "kart tyres", "fuel can", "seat insert", "pedal set", "wheel base", "race tickets", "team jacket", "pit board", "setup pack", "livery wrap", "tyre warmer"]


def sentence(rnd):
    return rnd.choice(FRAMES).format(d=rnd.choice(DRIVERS), e=rnd.choice(DRIVERS), p=rnd.choice(PLACES))


def article(rnd, n):
    return ". ".join(sentence(rnd) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(1)
    good = [article(rnd, rnd.randint(4, 12)) for _ in range(300)]
    good += ["Result\n" + "\n".join(f"{k}\t{rnd.choice(DRIVERS)}\t+{rnd.random() * 50:.3f}" for k in range(1, 30)) for _ in range(30)]
    good += ["Classification\n" + "\n".join(f"{k}\t{rnd.choice(DRIVERS)}\t{rnd.choice(ITEMS)} racing\t+{rnd.random() * 50:.3f}" for k in range(1, 30)) for _ in range(20)]
    good += [article(rnd, 9) + " Sources: http://a.test/x http://b.test/y" for _ in range(20)]
    one = [" ".join(rnd.choice(["buy", "cheap", "best", "sale"]) + " " + rnd.choice(two) for _ in range(60)) for two in (rnd.sample(ITEMS, 2) for _ in range(15))]
    links = ["\n".join(f"[{rnd.choice(ITEMS)}](http://shop{rnd.randint(1, 99)}.test/{rnd.randint(1, 9)})" for _ in range(30)) for _ in range(15)]
    tags = [article(rnd, 2) + " Tags: " + ", ".join(rnd.choice(ITEMS) for _ in range(70)) for _ in range(10)]
    marks = [article(rnd, 1) + " " + " ".join("#" + rnd.choice(ITEMS).replace(" ", "") + rnd.choice(["", "7", "42"]) for _ in range(40)) for _ in range(10)]
    ordinary = sorted({w for f in FRAMES for w in f.split() if w.isalpha()})
    salad = [" ".join(rnd.choice(ordinary) for _ in range(120)) for _ in range(10)]
    return good, one + links + tags + marks + salad


def found(spark_, pages, **params):
    good, bad = pages
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r.doc_id for r in stuffed_pages(spark_.createDataFrame(rows, "doc_id long, text string").repartition(5), **params).collect()}
    return got, set(range(len(good), len(good) + len(bad)))


def test_tells_stuffed_pages_from_lists_and_articles(spark, pages):
    got, want = found(spark, pages)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2
    assert all(k in got for k in sorted(want)[-10:])  # salad of ordinary words


def test_without_the_information_nothing_is_found(spark, pages):
    # thresholds no mean can lie below stand for the criterion taken out
    got, want = found(spark, pages, salad=-4.0, least=-4.0)
    assert not got
    # and with the reading of words alone held back, salad is still found by its mean
    got, want = found(spark, pages, least=-4.0)
    assert all(k in got for k in sorted(want)[-10:]) and not got - want


def test_information_is_that_of_the_corpus_without_the_page():
    read = Tokenizer()
    texts = ["brake pads and tow strap", "brake pads", "brake pads or brake test", "tow strap"]
    ids, _, n = (np.array(x) for x in read(texts))
    doc = np.repeat(np.arange(len(texts)), n)
    words = Counts(*np.unique(ids, return_counts=True))
    a, b = spam.neighbours(ids, doc)
    pairs = Counts(*np.unique(pair_keys(ids[a], ids[b]), return_counts=True))
    at, value = information(ids, doc, words, pairs, len(ids), 10.0)
    total = 14
    # page 1: "brake pads"; elsewhere brake 3 times, pads 2, the pair 2; neither repeats on the page
    overall = (2 + 0.5) / (total - 2)
    want = np.log((2 + 10 * overall) / (3 + 10) / overall)
    assert value[list(at).index(6)] == pytest.approx(want)
    # page 2 says brake twice: the second one needs its neighbour "or", which never calls for it elsewhere
    overall = (2 + 0.5) / (total - 5)
    want = np.log(10 * overall / (0 + 10) / (overall + 1 / 5))
    assert value[list(at).index(10)] == pytest.approx(want) and want < -0.4


def test_numbers_part_neighbours_and_kinds_are_told():
    ids, sizes, _ = Tokenizer()(["#12 Pole #pole $9.99 http://a.test/x b.test/y lap 3 time, over"])
    assert ids[0] == spam.NUMBER and ids[2:6] == [spam.TAG, spam.PRICE, spam.URL, spam.URL]
    a, b = spam.neighbours(np.array(ids), np.zeros(len(ids), int))
    assert (7 not in a) and (8 not in b) and sizes[0] == 3


def test_edges(spark, pages):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "!!! ---"), (None, "some text here"), (5, "word " * 40_000), (5, "word " * 40_000), (6, "one"), (7, "привет мир " * 30), (8, "1 2 3")]
    rows += [(100 + i, t) for i, t in enumerate(pages[0][:40])]
    df = spark.createDataFrame([(a, b, 0.5, 1) for a, b in rows], "doc_id long, text string, stuffed_share double, ids int")
    got = stuffed_shares(df).collect()
    assert len(got) == len(rows)
    assert all(r.stuffed_share == 0 for r in got if r.doc_id in (1, 2, 3, 4, 6, 8))
    assert all(r.mean_pmi is None for r in got if r.doc_id in (1, 2, 3, 4, 6))
    assert [r.stuffed_share for r in got if r.doc_id == 5] == [1.0, 1.0]
    assert stuffed_shares(df.limit(0)).count() == 0
