import itertools
import random
from pathlib import Path

import pytest

from tessera.llm.names import Lexicon, Parser, alike, codes, edits, entities, jaro_winkler, learn_lexicon, same_entity, short_for, skeleton

SCHEMA = "entry_id long, canonical string, category string, variants array<string>, entity string"
GROUPS = [
    [("Robert Hipouburt", "PERSON", ["Bob Hipouburt"]), ("HIPOUBURT, ROBERT D.", "person", None), ("Robert Hipuoburt", "PERSON", []), ("#15 Robert Hípouburt  ", None, ["R. Hipouburt"])],
    [("Edward Hipouburt", "PERSON", ["Ted Hipouburt"]), ("Hipouburt Edward", "PERSON", [None, ""])],
    [("Robert Hipouburt Jr.", "PERSON", ["Bob Hipouburt Jr"]), ("Hipouburt, Robert, Junior", "PERSON", [])],
    [("Captain Natreimou", "PERSON", ["Isabella Raitebes"]), ("Captain Natreimou", "PERSON", []), ("Izzy Raitebes", "PERSON", [])],
    [("Stakaireim Garage", "TEAM", ["GG"]), ("Team Stakaireim-Garage Ltd", "team", []), ("STAKAIREIMGARAGE", None, [])],
    [("Stakaireim Garage Academy", "TEAM", []), ("Stakaireim Grg Academy", "TEAM", [])],
    [("Stakaireim Autodrome", "PLACE", []), ("The Stakaireim Auto Drome Intl", "PLACE", [])],
    [("North Grebroudourt Ring", "PLACE", []), ("north grebroudourt rng", "PLACE", [])],
    [("South Grebroudourt Ring", "PLACE", [])],
    [("Setup Shop Fugrouloutt", "DROP", []), ("FugroulouttSetupShop", "drop", [])],
    [(None, "PERSON", None)],
    [("", None, [])],
]


def others(n=12):
    """Entries that show which words are kinds; no two are alike."""
    rnd = random.Random(4)
    core = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5)).capitalize()
    kinds = [("Garage", "TEAM"), ("Autodrome", "PLACE"), ("Ring", "PLACE"), ("Setup Shop", "DROP"), ("Racing", "TEAM"), ("Circuit", "PLACE")]
    return [(f"{core()} {kind}", category, []) for kind, category in kinds for _ in range(n)]


def frame(spark):
    rows, want, n = [], set(), 0
    for group in GROUPS + [[x] for x in others()]:
        ids = []
        for canonical, category, variants in group:
            n += 1
            ids.append(n)
            rows.append((n, canonical, category, variants, "clash"))
        want |= set(itertools.combinations(ids, 2))
    return spark.createDataFrame(rows + rows[:2], SCHEMA), want, n


def test_groups(spark):
    df, want, n = frame(spark)
    got = [(r.entry_id_a, r.entry_id_b) for r in same_entity(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert entities(df).count() == n
    assert same_entity(df.limit(0)).count() == 0


def test_many_equal_entries(spark):
    rows = [(i, "Walter Gaijaipeind", "PERSON", None, "") if i % 3 == 0 else (i, f"Walter Q{chr(98 + i % 20)}a{chr(98 + i % 19)}okr{chr(97 + i % 5)}m", "PERSON", None, "") for i in range(1, 91)]
    got = entities(spark.createDataFrame(rows, SCHEMA))
    assert got.filter("entry_id % 3 = 0").select("entity").distinct().count() == 1


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("", "a", 0), ("x", "x", 1)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-3)


def test_spelling():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 1) == 2
    assert alike("mekaizaild", "mecaizaild") == 2 and alike("hipouburt", "hipoburt") == 1 and alike("greitaikum", "drobrenutt") == 0
    assert skeleton("Philip".lower()) == skeleton("filip")
    from tessera.llm.names import NICKNAMES

    assert short_for("bob", "robert", NICKNAMES) and short_for("kimmy", "kimberly", NICKNAMES) and not short_for("victoria", "eleanor", NICKNAMES)


def test_parser_reads_orders():
    p = Parser(Lexicon())
    for name in ("Eleanor Sainougrek", "Sainougrek, Eleanor", "Sainougrek Eleanor", "#7 Ellie B. Sainou-grek"):
        f = p.person(name)[0]
        assert f["a"] == "sainougrek" and "eleanor" in f["b"], name
    p = Parser(Lexicon(kinds=("circuit", "setup", "raceway", "motorsport")))
    assert p.organisation("RAKRAIBRUSCIRCUIT")["a"] == "rakraibrus"
    assert [p.organisation(x)["b"] for x in ("Abc Set-up", "Abc Race Way", "Abc Msport")] == [["setup"], ["raceway"], ["motorsport"]]
    assert p.organisation("Nobody Here")["shape"] == "n" and p.organisation("...") is None
    assert [x["a"] for x in p.entry(["Abcdef Circuit", "AC", "ACR"], "PLACE")] == ["abcdef"] and p.entry(["AC"], "PLACE")[0]["a"] == "ac"


def test_order_of_tokens_does_not_matter():
    p = Parser(Lexicon(kinds=("racing",)))
    a, b = p.organisation("Blue Falcon Racing"), p.organisation("Racing Falcon Blue")
    assert a["a"] == b["a"] and codes(*a["parts"]) == codes(*b["parts"])


TWINS = [
    ("Scuderia Falcone", "Falcone Scuderia", "TEAM"),
    ("Nurburg Arena", "Nurbourg Arena", "PLACE"),
    ("Acme Tyres", "Acme Tyers", "DROP"),
    ("Blue Falcon Racing", "Racing Falcon Blue", "TEAM"),
    ("Li Wu", "Wu, Li", "PERSON"),
    ("Bo", "bo", "TEAM"),
]


def test_names_without_a_listed_kind_and_short_names(spark):
    rows = [(x, c, []) for a, b, c in TWINS for x in (a, b)] + others()
    df = spark.createDataFrame([(i, n, c, v, "") for i, (n, c, v) in enumerate(rows)], SCHEMA)
    assert {(r.entry_id_a, r.entry_id_b) for r in same_entity(df).collect()} == {(2 * k, 2 * k + 1) for k in range(len(TWINS))}


def test_kinds_are_learned(spark):
    names = [(n, c) for n, c, _ in others()] + [(f"Zabibu {w}", "TEAM") for w in ("Garage", "Garaeg", "Grage", "Garag")]
    df = spark.createDataFrame([(c, [n]) for n, c in names] + [("PERSON", ["Robert Hill"])], "category string, names array<string>")
    assert learn_lexicon(df).kinds == ("autodrome", "circuit", "garage", "racing", "ring", "setup", "shop")


def test_entries_without_a_given_name_all_join_the_one_entity(spark):
    names = ["Walter Gaijaipeind", "W. Gaijaipeind", "W. Gaijaipeind", "W. Gaijaipeind", "Gaijaipeind", "W. Gaijapeind"]
    names += ["Robert Hipouburt", "Rachel Hipouburt", "R. Hipouburt", "R. Hipouburt"]
    got = {r.entry_id: r.entity for r in entities(spark.createDataFrame([(i, n, "PERSON", None, "") for i, n in enumerate(names, 1)], SCHEMA)).collect()}
    assert {got[i] for i in range(1, 7)} == {1}
    assert not {got[9], got[10]} & {got[7], got[8]} and got[7] != got[8]


def test_slices_of_keys_give_the_same_and_little_stays_on_disk(spark, monkeypatch):
    from tessera.llm import names

    df, want, _ = frame(spark)
    monkeypatch.setattr(names, "SLICE_ENTRIES", 12, raising=False)
    spaces = []

    class Kept(names.Workspace):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            spaces.append(self)

    monkeypatch.setattr(names, "Workspace", Kept)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    assert {(r.entry_id_a, r.entry_id_b) for r in same_entity(df).collect()} == want
    assert spark.conf.get(setting, None) == before
    left = [sorted(p.name[4:] for p in Path(w.root.split("://")[-1]).iterdir() if any(p.glob("*.parquet"))) for w in spaces]
    assert sorted(left) == [["components"], ["entities"], ["links"]]


def test_one_edit_is_the_edit_distance():
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(2))
        assert edits(a, b, 1) == min(2, edits(a, b, 9))
