import random

import numpy as np
import pytest

from tessera.llm.contamination import align_many, leaked_items, leaked_pairs, squash, word_of_char, word_runs

rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(2500)]
PASSAGES = [" ".join(rnd.choice(VOCAB) for _ in range(60)) + "." for _ in range(20)]
FILL = [" ".join(rnd.choice(VOCAB) for _ in range(80)) for _ in range(60)]


def copy(p, a, n):
    return " ".join(p.split()[a : a + n])


def edited(text, every=8):
    w = text.split()
    return " ".join("changed" if i % every == every - 1 else x for i, x in enumerate(w))


CASES = {
    1: (FILL[0] + " " + PASSAGES[0] + " " + FILL[1], {0}),
    2: (FILL[2] + " " + copy(PASSAGES[1], 10, 14), {1}),
    3: (FILL[3] + " " + copy(PASSAGES[2], 10, 9) + " " + FILL[4], set()),
    4: (edited(PASSAGES[3]), {3}),
    5: (PASSAGES[4].upper().replace(" ", "  \n"), {4}),
    6: ("<b>" + PASSAGES[5].replace(" ", "</b>&nbsp;<b>") + "</b>", {5}),
    7: ("".join(c + "​" for c in PASSAGES[6]), {6}),
    8: (copy(PASSAGES[7], 30, 30) + " " + copy(PASSAGES[7], 0, 30), {7}),
    9: (" uh ".join(copy(PASSAGES[8], k, 6) for k in range(0, 60, 6)), {8}),
    10: (FILL[5], set()),
    11: ("", set()),
    12: (None, set()),
    13: (" ".join(FILL) * 10 + " " + PASSAGES[9], {9}),
    14: (copy(PASSAGES[10], 0, 20).replace("e", "é"), {10}),
}


def frames(spark):
    docs = spark.createDataFrame([(k, t, -1) for k, (t, _) in CASES.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(k, p) for k, p in enumerate(PASSAGES)] + [(100, PASSAGES[0]), (101, None), (102, "")], "item_id long, passage string")
    return docs, items


def test_cases(spark):
    docs, items = frames(spark)
    got = {(r.doc_id, r.item_id) for r in leaked_pairs(docs, items).collect()}
    assert got == {(d, i) for d, (_, want) in CASES.items() for i in want} | {(1, 100)}


def test_blocks_of_items_give_the_same(spark):
    docs, items = frames(spark)
    a = {tuple(r) for r in leaked_items(docs, items).collect()}
    assert a == {tuple(r) for r in leaked_items(docs, items, index_chars=2000).collect()}
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_squash_and_words():
    t = "Á b-c <i>d</i>&amp;­e 12½"
    assert len(word_of_char(t)) == len(squash(t)) and squash(t).startswith("abcd")


def test_alignment_against_full_table():
    r = np.random.default_rng(0)
    tasks, want = [], []
    for _ in range(30):
        p = r.integers(97, 101, r.integers(5, 30)).astype(np.uint8)
        t = np.concatenate([r.integers(97, 101, 4), p[: len(p) // 2], r.integers(97, 101, 1), p[len(p) // 2 :]]).astype(np.uint8)
        h, best = np.zeros((len(p) + 1, len(t) + 1), int), 0
        for i in range(1, len(p) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if p[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        tasks.append((t, p, -len(p), len(t)))
        want.append(h.max())
    for (t, p, *_), got, best in zip(tasks, align_many(tasks, batch=7), want):
        on = np.nonzero(got >= 0)[0]
        places = got[on]
        assert (np.diff(places) > 0).all() and (t[places] == p[on]).all()
        skipped = (on[-1] - on[0] + 1 - len(on)), (places[-1] - places[0] + 1 - len(on))
        assert len(on) - max(skipped) >= best - min(skipped) - 1 and len(on) >= best


def test_runs():
    m = np.array([1, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1], bool)
    assert word_runs(m, 0.8, 3, 4) == [(0, 6), (11, 15)]
    assert word_runs(np.zeros(5, bool), 0.8, 3, 4) == []


@pytest.mark.parametrize("n", [13, 14])
def test_length_decides(spark, n):
    docs = spark.createDataFrame([(1, FILL[9] + " " + copy(PASSAGES[11], 20, n) + " " + FILL[10])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, passage string")
    assert leaked_pairs(docs, items).count() == int(n >= 14)


def test_every_window_with_two_words_changed(spark):
    items = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, passage string")
    rows, want = [], set()
    for p in range(12, 16):
        for a in range(47):
            w = copy(PASSAGES[p], a, 14).split()
            w[4], w[9] = "xyqqh", "whhqyx"
            rows.append((len(rows), FILL[a] + " " + " ".join(w) + " " + FILL[a + 1]))
            want.add((rows[-1][0], p))
    got = {(r.doc_id, r.item_id) for r in leaked_pairs(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    # the alignment itself does not cross an edit longer than the words beyond it
    assert got <= want and len(want - got) <= 3


@pytest.mark.parametrize("front", [True, False])
def test_short_tail_beyond_an_edit(spark, front):
    tails = [k for k in range(4, 44) if 9 <= len("".join(PASSAGES[16].split()[k : k + 2] if front else PASSAGES[16].split()[k + 12 : k + 14])) <= 11]
    rows = []
    for k in tails:
        w = copy(PASSAGES[16], k, 14).split()
        w.insert(2 if front else 12, "xyq")
        rows.append((k, FILL[11] + " " + " ".join(w) + " " + FILL[12]))
    items = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, passage string")
    got = leaked_pairs(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert rows and {(r.doc_id, r.item_id) for r in got.collect()} == {(k, 16) for k in tails}


def test_p7_leaks_searches_questions(spark, tmp_path):
    from tessera.llm.queries import p7_leaks

    items = [(k, PASSAGES[k], copy(PASSAGES[k + 10], 5, 8 + k % 4)) for k in range(8)]
    spark.createDataFrame(items, "item_id long, passage string, question string").write.parquet(str(tmp_path / "eval_items.parquet"))
    docs = [(k, FILL[k] + " " + q + " " + FILL[k + 9]) for k, _, q in items] + [(20, PASSAGES[0]), (21, FILL[30])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.item_id, r.field) for r in p7_leaks(spark, str(tmp_path)).collect()}
    assert got == {(k, k, "question") for k in range(8)} | {(20, 0, "passage")}


RUSSIAN = "на старте гонки дождь усилился и пилоты выехали на промежуточных шинах потому что трасса у моста совсем не сохла до самого финиша".split()
CHINESE = "比赛开始之前雨下得更大所有车手都换上了中性胎因为桥边的赛道直到终点都没有干过"
OTHER = "вчера вечером повар приготовил густой суп из свежей рыбы и позвал соседей к столу хотя никто из них давно уже не приходил".split()


def test_letters_of_other_scripts_are_letters(spark):
    spaced = " ".join(CHINESE[k : k + 2] for k in range(0, len(CHINESE), 2))
    items = spark.createDataFrame([(1, " ".join(RUSSIAN)), (2, spaced), (3, PASSAGES[0])], "item_id long, passage string")
    changed = [w if k != 9 else "гонщики" for k, w in enumerate(RUSSIAN)]
    docs = [(1, " ".join(OTHER)), (2, "Итак: " + " ".join(RUSSIAN[2:19]).upper() + "!"), (3, " ".join(changed)), (4, FILL[0] + CHINESE), (5, CHINESE[::-1]), (6, " ".join(OTHER) + spaced[: len(spaced) // 4])]
    got = {(r.doc_id, r.item_id) for r in leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(2, 1), (3, 1), (4, 2)}


def test_short_words_with_one_changed(spark):
    words = "a kid in the pit saw it go by at ten to six as we sat on"
    items = spark.createDataFrame([(1, words + ". " + PASSAGES[0])], "item_id long, passage string")
    w = words.split()
    docs = [(k, FILL[1] + " " + " ".join(x if i != k else "zzzzz" for i, x in enumerate(w)) + " " + FILL[2]) for k in range(3, 14)]
    got = {r.doc_id for r in leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {k for k, _ in docs}


def test_bands_are_judged_together_as_their_words_are_found():
    from tessera.llm.contamination import DRIFT, Sieve, build_index, code_points, may_leak, regions

    ix = build_index(PASSAGES, [[k] for k in range(len(PASSAGES))])
    sieve = Sieve(ix, 14, 0.8)
    texts = [squash(t) for t, want in CASES.values() if want]
    wanted = sieve(texts)
    places = sieve.places(wanted)
    for t, p in zip(*np.divmod(wanted, len(PASSAGES))):
        mine = places[0] == t * len(PASSAGES) + p
        assert mine.any()
        for word, k, d in zip(*(x[mine].tolist() for x in places[1:4])):
            begin = int(np.nonzero(ix.words[p] == k)[0][0])
            assert texts[t].startswith(ix.spelled[p][k] if word else ix.pairs[p][k], begin + d)
    raw = code_points("\x00".join(texts))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    found = may_leak(regions(raw, starts, ix, 64, wanted, sieve.short_words(places)), places, ix, 14, 0.8)
    assert {p for _, p in found} == {p for _, want in CASES.values() for p in want} and DRIFT


def test_rare_words_with_a_letter_put_in_count(spark):
    w = copy(PASSAGES[17], 20, 16).split()
    changed = [x[:2] + "q" + x[2:] if i in (3, 8) else x for i, x in enumerate(w)]
    items = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, passage string")
    docs = spark.createDataFrame([(1, FILL[20] + " " + " ".join(changed) + " " + FILL[21])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_pairs(docs, items).collect()} == {(1, 17)}
