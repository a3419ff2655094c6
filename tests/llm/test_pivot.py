import itertools
import random

from pyspark.sql import functions as F

from tessera.llm.names import connected_components
from tessera.llm.pivot import agreement_keys, pivot_clusters, same_incident, theme_clusters, tokens
from tessera.plans.lineage import Workspace


#: Ways of telling of an incident, and of telling of nothing in particular.
FRAMES = (
    "{x} went straight into the back of {y} at {w}, {z} they say, and the {s} car is done",
    "the stewards want to see {y} and {x} after {w}; the {s} mechanics have found {z}",
    "{z} again: {x} is hit by {y} near {w} and climbs out of the {s} entry",
    "have another look at {w} where {y} meets {x}",
    "nobody in the {s} pit knew of {z} before {y} lost it at {w}",
)
SMALL = ("the crowd is loving this race", "we go back to the booth now", "tyres are the story of the day", "here comes the safety car again", "the leader has a clear track ahead")


def name(p, k):
    return f"{p}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}"


CAUSES = tuple(f"a {how} {name('part', k)}" for k, how in enumerate(("cracked", "worn", "stuck", "soft") * 50))


def told(n=60, seed=0):
    """Rows, and the particulars each of them names."""
    rnd = random.Random(seed)
    rows, known = [], {}
    for k in range(n):
        v = {"x": name("ann", k), "y": name("bob", k), "w": name("edge", k), "s": name("acme", k), "z": CAUSES[k % len(CAUSES)]}
        for _ in range(rnd.randint(2, 6)):
            frame = rnd.choice(FRAMES)
            said = dict(v, **rnd.choice([{}, {}, {"x": "somebody"}, {"w": "the exit"}]))
            known[len(rows)] = {said[f] for f in "xywsz" if "{" + f + "}" in frame} & set(v.values())
            rows.append((len(rows), "s", rnd.choice(["", ">> ", "Well "]) + rnd.choice([str, str.upper])(frame.format(**said)) + "."))
    # the rest says the same things of others, no two of which meet again
    for _ in range(6000):
        other = {f: name("zed", rnd.randrange(3000)) for f in "xyws"} | {"z": rnd.choice(CAUSES)}
        rows.append((len(rows), "s", rnd.choice(FRAMES).format(**other)))
        rows.append((len(rows), "s", f"{rnd.choice(SMALL)} and {name('zed', rnd.randrange(3000))} is {rnd.choice(['quick', 'slow', 'calm'])}, {rnd.choice(SMALL)}"))
    return rows, known


def test_tokens(spark):
    df = spark.createDataFrame([("Well, ANN's kart-team go go GO <PERSON> 3.5",), (None,), ("",)], "text string")
    got = [r.w for r in df.select(tokens(F.col("text")).alias("w")).collect()]
    assert got == [["well", ",", "ann", "kart-team", "go", "go", "go", "<person>", "3", ".", "5"], None, []]


def test_incidents_against_brute_force(spark):
    rows, known = told()
    want = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if len(known[a] & known[b]) >= 3}
    extra = [(9000, "s", None), (9001, None, ""), (None, "s", rows[0][2]), (rows[0][0], "s", rows[0][2]), (9002, "s", "that put " * 3000), (9003, "s", " ".join(name("long", k) for k in range(3000)))]
    df = spark.createDataFrame([(*r, 1, [2]) for r in rows + extra], "sentence_id long, session string, text string, cluster int, keys array<long>")

    got = [(r.sentence_id_a, r.sentence_id_b) for r in same_incident(df.repartition(5)).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.99 * len(want)
    assert len(set(got) - want) <= 0.1 * len(want)  # chance agreements among six thousand sentences of the same frames
    assert same_incident(df.limit(0)).count() == 0


def test_three_particulars_tell_beyond_chance_only(spark):
    rows = [(1, 0, 0, 10, 6.0), (1, 1, 1, 11, 6.0), (1, 2, 1, 12, 6.0), (1, 3, 2, 13, 1.0), (2, 0, 0, 10, 6.0)]
    found = spark.createDataFrame(rows, "id long, at int, stretch int, word long, weight double")
    # 1,000 records, fewer than half a pair expected: the weights must sum to 13.8; words of one stretch make no key
    got = {r.id: len(r["keys"]) for r in agreement_keys(found, 1000, 0.5).collect()}
    assert got == {}
    got = {r.id: len(r["keys"]) for r in agreement_keys(found, 600, 0.5).collect()}
    assert got == {1: 2}


def test_pivots_absorb_only_neighbours_and_keep_every_record(spark):
    rnd = random.Random(3)
    rows = [(i, sorted({i % 9 * 100 + rnd.randrange(6) for _ in range(4)})) for i in range(200)] + [(900, None), (901, [])]
    got = pivot_clusters(spark.createDataFrame(rows, "id long, keys array<long>"), "id").collect()
    assert len(got) == 200
    by = {}
    for r in got:
        by.setdefault(r.cluster, []).append(r.id)
    assert all(len({i % 9 for i in v}) == 1 for v in by.values())
    assert len(by) < 30  # most of a group's members meet in one cluster
    again = pivot_clusters(spark.createDataFrame(rows[::-1], "id long, keys array<long>"), "id").collect()
    assert {r.id: r.cluster for r in got} == {r.id: r.cluster for r in again}


def test_hot_profile(spark):
    """A third of all rows alike: one profile stands for them."""
    rows = [(i, [1, 2, 3]) if i % 3 == 0 else (i, [1000 + i, 5000 + i, 9000 + i]) for i in range(900)]
    got = pivot_clusters(spark.createDataFrame(rows, "id long, keys array<long>"), "id")
    assert {r.agreement for r in got.filter("id % 3 = 0").collect()} == {900}
    assert got.groupBy("cluster").count().filter("count = 300").count() == 1 and got.count() == 900


def test_themes_hold_every_sentence(spark):
    say = lambda t: f"alpha{t}x beta{t}x gamma{t}x"
    rows = [(i, f"s{i % 3}", f"Now {say(i % 40)} of N{i}") for i in range(400)] + [(900, "s1", "odd"), (901, None, None), (902, "s1", "")]
    got = theme_clusters(spark.createDataFrame(rows, "sentence_id long, session string, text string")).collect()
    assert sum(r["size"] for r in got) == 402 and all(1 <= len(r.typical) <= 3 for r in got)
    assert sorted(r["size"] for r in got) == [1, 1] + [10] * 40
    assert all(len({i % 40 for i in r.typical}) == 1 and r.typical == sorted(r.typical) for r in got if r["size"] == 10)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002), (7, 7)]
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "id_a long, id_b long")).collect()
    assert {r.component for r in got if r.id <= 300} == {0} and {r.component for r in got if r.id >= 1000} == {1000}
