"""Variant spellings of names: phonetic blocks, Jaro-Winkler with nicknames, connected components.

Every name of an entry is parsed into what it is about (a person's family name and given
name, an organisation's or place's core and kind, or an epithet) and into flags that keep
entities apart (junior, academy, north, south).  Which words are kinds (racing, park) and
which given names is learned from the entries; a name without a kind is all core.  Names
are blocked by phonetic codes of their sorted tokens, with one code per letter that may be
wrong; candidates are verified by Jaro-Winkler similarity and edit distance of the parts,
with nicknames standing for given names; accepted pairs of entries are clustered by
connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import Workspace
from tessera.sources.tables import single_deliveries, spread

#: Given names and those of their nicknames that no rule derives (fixed values; a parameter).
NICKNAMES = {
    "abigail": "gail", "albert": "bert", "alexander": "sasha sandy xander", "alexandra": "sasha sandra lexi", "amanda": "mandy manda", "andrew": "drew",
    "anthony": "tony ant", "augustus": "gus", "barbara": "babs", "bartholomew": "barty", "benjamin": "", "caroline": "carrie lina", "charles": "chuck charlie",
    "christine": "tina", "christopher": "kit", "clifford": "", "daniel": "", "david": "davy", "deborah": "debbie", "dominic": "nic", "dorothy": "dot dolly dora",
    "edward": "ted teddy ned", "eleanor": "nell ellie nora lena", "elizabeth": "liz beth betty bella lisa", "emmanuel": "manny manu", "frances": "fran frankie",
    "francisco": "paco cisco frank", "frederick": "", "gabriel": "gabi", "gerald": "jerry", "giovanni": "vanni gianni", "gregory": "", "harold": "hal harry",
    "heinrich": "heinz heiner", "ignacio": "nacho iggy", "isabella": "bella izzy", "jacqueline": "jacqui jackie", "james": "jim jimmy", "jeffrey": "geoff",
    "jennifer": "", "jessica": "", "johannes": "hannes jan johann", "john": "jack johnny", "joseph": "joe joey", "katherine": "kate kathy kit", "kenneth": "",
    "kimberly": "", "konstantin": "kostja stan", "lawrence": "larry lars", "leonard": "lenny", "leopold": "poldi", "louisa": "lulu lou", "madeleine": "maddy lena",
    "margaret": "meg peggy maggie", "matthew": "matty", "maximilian": "", "michael": "mike mick", "natalie": "tally", "nathaniel": "nate", "nicholas": "nico nick",
    "olivia": "ollie liv", "oswald": "oz ozzie", "patricia": "trish patty", "patrick": "paddy", "penelope": "penny", "peter": "", "philip": "pip", "raymond": "",
    "rebecca": "becky becca", "reginald": "reggie", "richard": "dick rick", "robert": "bob rob bobby", "ronald": "", "rosemary": "romy rosie", "samantha": "mantha sammy",
    "samuel": "", "sebastian": "basti", "solomon": "", "stephanie": "stevie", "stephen": "steve stevie", "susan": "sue susie", "tabitha": "", "terence": "tel terry",
    "theodore": "ted teddy", "thomas": "", "timothy": "", "ulrich": "uli ulli", "ursula": "ulla", "valerie": "valli", "victoria": "vicky tori", "vincent": "vinny",
    "walter": "wally", "william": "bill billy", "winifred": "winnie freddie", "wolfgang": "", "yannick": "nick", "zachary": "zack",
}
#: Articles and legal forms, flags and epithets (fixed values; a parameter).
EMPTY_WORDS = ("the", "team", "ltd", "limited", "inc", "intl", "international", "co", "corp")
SQUADS = {"junior": "junior", "juniors": "junior", "jr": "junior", "ii": "junior", "iii": "junior", "academy": "academy", "acad": "academy"}
SIDES = ("north", "south", "east", "west")
EPITHETS = ("captain", "big", "uncle", "aunt", "little", "old", "king", "queen", "doc", "kid", "great", "the")


@dataclass(frozen=True)
class Lexicon:
    """Vocabularies the parser uses; the learned parts come from frequent tokens of the data."""

    nicknames: dict[str, str] = field(default_factory=lambda: NICKNAMES)
    given: frozenset[str] = frozenset()
    kinds: tuple[str, ...] = ()


def plain(text: str) -> str:
    """Compatibility forms unified, marks removed, apostrophes and dots dropped."""
    t = unicodedata.normalize("NFKD", text).replace("ß", "ss")
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"#\s*\d+|['’`.]", " ", t).strip()


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A spelling-free form: letters and digraphs that sound alike are one, doubles collapse."""
    for a, b in (("ph", "f"), ("ck", "k"), ("oo", "u"), ("ou", "u"), ("ei", "ai"), ("ey", "ai"), ("ay", "ai")):
        word = word.replace(a, b)
    word = word.translate(str.maketrans("cqwzyj", "kkvsii"))
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """Phonetic code: the consonants of ``sound``, the first letter kept."""
    s = sound(word)
    return s[:1] + re.sub(r"[aeiou]", "", s[1:])


def sorted_code(tokens: list[str]) -> str:
    """Phonetic codes of the tokens, sorted and written together, so their order does not matter."""
    return "".join(sorted(skeleton(t) for t in tokens))


def codes(*tokens: str) -> set[str]:
    """The phonetic code of the sorted tokens and, where it is long enough, each with one letter left out."""
    s = sorted_code(list(tokens))
    return {s} | ({s[:k] + s[k + 1 :] for k in range(len(s))} if len(s) >= 4 else set())


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hit_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit_a.append(c)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    hit_b = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(hit_a, hit_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(4, prefix) * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours swapped as one edit; ``most`` + 1 stands for any more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most == 1:
        return _one_edit(a, b)
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def _one_edit(a: str, b: str) -> int:
    """0: equal; 1: what lies between the common ends is one letter or two swapped ones; 2: more."""
    if a == b:
        return 0
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    return 1 if n - i <= 1 and m - i <= 1 or n - i == m - i == 2 and a[i] == b[i + 1] and a[i + 1] == b[i] else 2


def alike(a: str, b: str, least: float = 0.9) -> int:
    """2: the parts sound the same; 1: they differ by a slip of the hand; 0: they are different."""
    x, y = sound(a), sound(b)
    if x == y:
        return 2
    most = 2 if min(len(x), len(y)) >= 9 and x[0] == y[0] else 1
    return int(abs(len(x) - len(y)) <= most and edits(x, y, most) <= most and jaro_winkler(x, y) >= least)


@lru_cache(maxsize=200_000)
def _stem(nick: str) -> str:
    """A short form without the ending put on, a doubled letter at the end once; empty if too little is left."""
    stem = re.sub(r"(ie|ey|y|i|e)$", "", nick) if len(nick) > 3 else nick
    return "" if len(stem) < min(3, len(nick)) else re.sub(r"(.)\1$", r"\1", stem)


def short_for(nick: str, full: str, irregular: dict[str, str]) -> bool:
    """Is ``nick`` listed as a short form of ``full``, or its beginning with an ending put on?"""
    if nick in irregular.get(full, "").split():
        return True
    stem = _stem(nick)
    return len(stem) >= 2 and len(nick) < len(full) and (full.startswith(stem) or full.startswith(nick) or (len(nick) >= 4 and nick in full))


class Parser:
    """Turns the names of an entry into comparable forms."""

    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon
        self.full = frozenset(lexicon.nicknames) | lexicon.given
        self.nicks = frozenset(n for v in lexicon.nicknames.values() for n in v.split())
        self.kinds = tuple(dict.fromkeys(lexicon.kinds))
        self.meaning = lru_cache(maxsize=200_000)(self._meaning)
        self.kind_of = lru_cache(maxsize=200_000)(self._kind_of)

    def _meaning(self, word: str) -> frozenset[str]:
        """Given names a token may stand for; none if it is no given name."""
        if word in self.full:
            return frozenset([word])
        out = {f for f in self.full if short_for(word, f, self.lex.nicknames)}
        if not out and len(word) >= 4:
            out = {f for f in self.full if abs(len(f) - len(word)) <= 1 and edits(word, f, 1) <= 1}
        if not out and len(word) >= 4:
            out = {f for f, more in self.lex.nicknames.items() if any(len(n) >= 4 and edits(word, n, 1) <= 1 for n in more.split())}
        return frozenset(out)

    def _kind_of(self, word: str) -> frozenset[str]:
        """Kinds a token stands for: itself, a part, an abbreviation or a misspelling of one."""
        if len(word) < 2:
            return frozenset()
        if word in self.kinds:
            return frozenset([word])
        out = set()
        for k in self.kinds:
            letters = iter(k)
            abbreviated = word[0] == k[0] and len(word) < len(k) and all(c in letters for c in word) and len(word) <= 6
            part = len(word) >= 3 and (k.startswith(word) or k.endswith(word))
            if abbreviated or part or (len(k) >= 4 and len(word) >= 4 and edits(word, k, 1) <= 1):
                out.add(k)
        return frozenset(out)

    def _bare(self, word: str, kinds: set[str], flags: set[str]) -> str:
        """A word without the kinds, flags and empty words run together with it."""
        for _ in range(3):
            for w in (*self.kinds, *EMPTY_WORDS, *SQUADS, *SIDES):
                if len(w) >= 3 and len(word) > len(w) + 2 and (word.endswith(w) or w in (*SIDES, "team", *self.kinds) and word.startswith(w)):
                    word = word[: -len(w)] if word.endswith(w) else word[len(w) :]
                    if w in SQUADS or w in SIDES:
                        flags.add(SQUADS.get(w, w))
                    elif w in self.kinds:
                        kinds.add(w)
                    break
            else:
                break
        return word

    def organisation(self, name: str) -> dict | None:
        """Core, kinds and flags of an organisation or place; None if nothing is left of the name.

        A name of kinds alone is its own core.
        """
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", plain(name)).lower()
        core, kinds, flags = [], set(), set()
        words = [w for w in re.findall(r"[^\W_]+", spaced) if w not in EMPTY_WORDS]
        at = 0
        while at < len(words):
            w, both = words[at], words[at] + words[at + 1] if at + 1 < len(words) else ""
            if w in SQUADS or w in SIDES:
                flags.add(SQUADS.get(w, w))
            elif both in self.kinds or len(both) >= 6 and any(edits(both, k, 1) <= 1 for k in self.kinds if len(k) >= 6):
                kinds |= self.kind_of(both)
                at += 1
            elif k := self.kind_of(w):
                kinds |= k
            else:
                core.append(self._bare(w, kinds, flags))
            at += 1
        if not core:  # kinds alone, or letters that may stand for one
            core, kinds = [w for w in words if w not in SQUADS and w not in SIDES], set()
        if not core:
            return None
        core.sort(key=lambda w: (sound(w), w))
        return {"shape": "o" if kinds else "n", "a": "".join(core), "parts": core, "b": sorted(kinds), "flags": flags}

    def person(self, name: str) -> list[dict]:
        """Forms of a person's name: family and given name, family with an initial, or an epithet."""
        text = plain(name).lower()
        flags: set[str] = set()
        parts = [re.findall(r"[^\W_]+", p.replace("-", "")) for p in text.split(",")]
        parts = [p for p in ([w for w in p if not (w in SQUADS and not flags.add(SQUADS[w]))] for p in parts) if p]
        if not parts:
            return []
        if len(parts) >= 2:  # family name first
            words, family = [w for p in parts[1:] for w in p], "".join(parts[0])
            given = next((w for w in words if len(w) > 1), words[0] if words else "")
            return [self._form(family, given, flags)]
        words = parts[0]
        if any(w in EPITHETS for w in words):
            core = "".join(w for w in words if w not in EPITHETS)
            return [{"shape": "e", "a": core, "parts": [core], "b": sorted(w for w in words if w in EPITHETS), "flags": set()}] if core else []
        long = [w for w in words if len(w) > 1]
        letters = [w for w in words if len(w) == 1]
        exact = [w for w in long if w in self.full or w in self.nicks]
        known = exact or [w for w in long if self.meaning(w) and len(long) > 1]
        if len(known) == len(long) and len(long) > 1:
            known = known[:-1]
        unknown = [w for w in long if w not in known]
        if not unknown:
            return []
        if known:
            # pieces of a family name belong together; one piece alone would fit too many names
            return [self._form("".join(unknown), known[0], flags)]
        if letters:
            return [self._form("".join(unknown), letters[0], flags)]
        if len(unknown) == 1:
            return [self._form(unknown[0], "", flags)]
        return [self._form("".join(unknown[1:]), unknown[0], flags), self._form(unknown[0], unknown[1], flags)]

    def _form(self, family: str, given: str, flags: set[str]) -> dict:
        means = sorted(self.meaning(given)) or [given] if len(given) > 1 else [given]
        return {"shape": "p" if len(given) > 1 else "w", "a": family, "parts": [family], "b": means, "flags": flags}

    def entry(self, names: list[str], category: str | None) -> list[dict]:
        """Forms of all names of an entry; the entry's flags hold for each of them."""
        forms: list[dict] = []
        for name in dict.fromkeys(names):
            org = self.organisation(name) if category != "PERSON" else None
            if org and category is None and org["shape"] == "n":
                org = None  # nothing shows that it is no person
            forms += [org] if org else self.person(name) if category in (None, "PERSON") else []
        # initials of another of the names, or letters too few to tell, add nothing to it
        full = [x for x in forms if x["shape"] == "o"]
        forms = [x for x in forms if x["shape"] != "n" or not full or not any(_initials(x["a"], y) for y in full)]
        flags = "+".join(sorted({f for x in forms if x["shape"] != "e" for f in x["flags"]}))
        support: dict[str, int] = {}
        for x in forms:
            support[sound(x["a"])] = support.get(sound(x["a"]), 0) + 1
        out = {(x["shape"], x["a"], tuple(x["b"])): {"shape": x["shape"], "a": x["a"], "parts": x["parts"], "b": x["b"], "flags": "" if x["shape"] == "e" else flags, "support": support[sound(x["a"])]} for x in forms if x["a"]}
        return list(out.values())


def _initials(word: str, form: dict) -> bool:
    """Could a short word be the initials of a name, in any order?"""
    return len(word) <= 4 and word[0] in {w[0] for w in form["parts"]} | {k[0] for k in form["b"]}


def blocks(form: dict) -> list[tuple[str, bool]]:
    """Keys of a form and whether they are weak (a family name with an initial or alone)."""
    head, out = f"{form['shape']}|{form['flags']}|", []
    if form["shape"] in "one":
        return [(head + c, False) for c in codes(*form["parts"])]
    person = f"p|{form['flags']}|"
    for c in codes(form["a"]):
        if form["shape"] == "p":
            out += [(f"{person}{c}|{skeleton(g)}", False) for g in form["b"]]
            out += [(f"{person}{c}|~{i}", True) for i in {g[0] for g in form["b"]}] + [(f"{person}{c}|~", True)]
        else:
            out.append((f"{person}{c}|~{form['b'][0]}", True))
    return out


def same_form(a: dict, b: dict, weak: bool) -> bool:
    """Do two forms of equal shape and flags name the same entity, as far as names can tell?"""
    close = alike(a["a"], b["a"])
    if not close or close == 1 and min(a["support"], b["support"]) > 1:
        return False  # two spellings that each entry uses repeatedly are two names
    if a["shape"] in "on":
        return bool(set(a["b"]) & set(b["b"])) or a["shape"] == "n"
    if a["shape"] == "e":
        return list(a["b"]) == list(b["b"])
    if weak:
        return True
    if set(a["b"]) & set(b["b"]):
        return True
    return any(jaro_winkler(x, y) >= 0.9 and edits(x, y, 1) <= 1 for x in a["b"] for y in b["b"])


#: Keys of up to so many entries are compared at once; of more, in slices by the keys' hash, of which there are at most so many.
SLICE_ENTRIES, MOST_SLICES = 250_000, 16
_SEP = "\x1f"


@lru_cache(maxsize=200_000)
def _codes_of(words: str) -> frozenset[str]:
    return frozenset(codes(*words.split(_SEP)))


def keys_of(batches: Iterator[pa.RecordBatch], part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Each form under those of its keys that fall into slice ``part`` of ``parts``; both sides of a pair get the same slice."""
    for batch in batches:
        shape, words, b, flags = (batch.column(c).to_pylist() for c in ("shape", "words", "b", "flags"))
        rows, keys = [], []
        for i, (s, w, given, f) in enumerate(zip(shape, words, b, flags)):
            form = {"shape": s, "a": w.replace(_SEP, ""), "parts": w.split(_SEP), "b": given.split(_SEP), "flags": f}
            for key in {k for k, _ in blocks(form)}:
                if parts == 1 or crc32(key.encode("utf-8", "surrogatepass")) % parts == part:
                    rows.append(i)
                    keys.append(key)
        held = batch.select(["id", "fid", "category", "shape", "words", "b", "support"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *held.columns], names=["key", *held.schema.names])


def near_under(key: str, rows: list[dict]) -> Iterator[tuple]:
    """``(weak, id_a, id_b, fid_a, fid_b)`` of the forms under a key that name the same entity.

    Under a weak key only forms without a given name are looked at, each with all others, and stand
    first.  A pair with several common keys is compared under one of them: the least code and,
    where the key has one, the least given name's code.
    """
    head, _, last = key.rpartition("|")
    weak, person = last.startswith("~"), key.startswith("p|")
    code = head.rpartition("|")[2] if person else last
    rows.sort(key=lambda r: r["id"])
    loose = [i for i, r in enumerate(rows) if r["shape"] == "w"] if weak else range(len(rows))
    for i in loose:
        x = rows[i]
        for j in range(0 if weak else i + 1, len(rows)):
            y = rows[j]
            if x["id"] == y["id"] or weak and j < i and y["shape"] == "w":
                continue
            if x["category"] is not None and y["category"] is not None and x["category"] != y["category"]:
                continue
            if code != min(_codes_of(x["words"]) & _codes_of(y["words"])) or person and not weak and last != min(x["given"] & y["given"]):
                continue
            if same_form(x, y, weak):
                yield (weak, x["id"], y["id"], x["fid"] if weak else None, y["fid"] if weak else None)


_NEAR = "weak boolean, id_a bigint, id_b bigint, fid_a bigint, fid_b bigint"


def near_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``near_under`` each key of rows sorted by key; a key may go on in the next batch."""

    def groups(held: list[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
        t = pa.Table.from_batches(held).combine_chunks()
        key = t["key"]
        new = np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy().astype(bool), [True]])
        some = t.filter(pa.array(~(new[:-1] & new[1:])))  # a key of one form has no pair
        for k, rows in groupby(some.to_pylist(), itemgetter("key")):
            rows = list(rows)
            for r in rows:
                r["a"], r["b"] = r["words"].replace(_SEP, ""), r["b"].split(_SEP)
                r["given"] = {skeleton(g) for g in r["b"]}
            yield k, rows

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for k, rows in groups(held):
            found += near_under(k, rows)
        if found:
            types = [pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["weak", "id_a", "id_b", "fid_a", "fid_b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, last = batch.column("key"), batch.column("key")[-1].as_py()
        cut = pc.index(key, last).as_py()  # the last key may go on
        if cut:
            yield from compared([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column("key")[-1].as_py() != last:
            yield from compared(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from compared(held)


def learn_lexicon(entries: DataFrame, least_share: float = 0.003, least_entries: int = 25, kind_share: float = 0.01, least_partners: int = 6) -> Lexicon:
    """Given names and kinds from the data: tokens in many entries of persons, and tokens in names of many other things.

    A given name needs ``least_share`` of the persons' entries, a kind ``kind_share`` of all
    others' and ``least_partners`` different words beside it; with the handful of tokens an
    entry has, their number is bounded whatever the size of the data.
    """
    person = F.upper(F.trim("category")) == "PERSON"

    def held_by(rows: DataFrame, spelled: Column) -> DataFrame:
        words = F.array_distinct(F.flatten(F.transform("names", lambda x: F.regexp_extract_all(F.lower(spelled(x)), F.lit(r"(\p{L}{3,})"), F.lit(1)))))
        return rows.select(words.alias("words"))

    persons = entries.filter(person)
    n = persons.count()
    held = held_by(persons, lambda x: x).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(least_entries, least_share * n))
    learned = {plain(r["w"]) for r in held.collect()} - set(EPITHETS) - set(SQUADS)
    given = frozenset(w for w in learned if not any(w in v.split() or short_for(w, k, NICKNAMES) for k, v in NICKNAMES.items()))
    others = entries.filter(~person)
    m = others.count()
    split = held_by(others, lambda x: F.regexp_replace(x, r"(?<=\p{Ll})(?=\p{Lu})", " "))
    often = split.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(3, kind_share * m))
    common = F.broadcast(often.limit(int(100 / kind_share)).withColumnRenamed("n", "held"))
    beside = split.select("words", F.explode("words").alias("w")).join(common, "w").select("w", "held", F.explode("words").alias("other"))
    beside = beside.filter((F.col("w") != F.col("other")) & ~F.col("other").isin(*EMPTY_WORDS, *SQUADS, *SIDES, *EPITHETS))
    # spellings of one word begin alike, so partners are counted by their first three letters; a name in
    # many entries has the spellings of its kind beside it, a kind has ever other names
    partners = beside.groupBy("w", "held").agg(F.approx_count_distinct(F.substring("other", 1, 3)).alias("n")).filter((F.col("n") >= least_partners) & ((F.col("n") >= 0.2 * F.col("held")) | (F.col("n") >= 100)))
    count: dict[str, int] = {}
    for r in partners.collect():
        count[plain(r["w"])] = count.get(plain(r["w"]), 0) + r["held"]
    kinds = [w for w in sorted(count) if w not in {*EMPTY_WORDS, *SQUADS, *SIDES, *EPITHETS} and w not in NICKNAMES and w not in given]

    def stands_for(k: str, o: str) -> bool:
        """Is the kind ``k`` a slip, a plural or an abbreviation of the more frequent ``o``?"""
        if count[k] > count[o] or k == o:
            return False
        return edits(k, o, 1) <= 1 or o.startswith(k) or len(k) < len(o) and 3 * count[k] < count[o] and bool(Parser(Lexicon({}, frozenset(), (o,))).kind_of(k))

    kinds = [k for k in kinds if not any(stands_for(k, o) for o in kinds)]
    return Lexicon(given=given, kinds=tuple(kinds))


def link_entries(gazetteer: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``(entry_id_a, entry_id_b)`` links between entries of one entity, before clustering.

    Names are the canonical name and all variants; nulls and empty names say nothing, an
    entry without any legible name has no link.  A null category fits any, other categories
    must be equal whatever their case.
    """
    spark = gazetteer.sparkSession
    ws = Workspace(spark, "names", tidy=True)
    names = F.filter(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    whole = single_deliveries(gazetteer.select("entry_id", "canonical", "category", "variants").filter(F.col("entry_id").isNotNull()), "entry_id")
    entries = ws.write(whole.select("entry_id", F.nullif(F.upper(F.trim("category")), F.lit("")).alias("category"), names.alias("names")), "entries")
    slices = min(MOST_SLICES, max(1, -(-entries.count() // SLICE_ENTRIES)))
    with ws.tidied():
        shared = spark.sparkContext.broadcast(lexicon or learn_lexicon(entries))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(shared.value)
        for pdf in batches:
            rows = []
            for entry, category, given in zip(pdf["entry_id"], pdf["category"], pdf["names"]):
                category = category if isinstance(category, str) else None
                rows += [(entry, category, x["shape"], _SEP.join(x["parts"]), _SEP.join(x["b"]), x["flags"], x["support"]) for x in parser.entry(list(given), category)]
            yield pd.DataFrame(rows, columns=["entry_id", "category", "shape", "words", "b", "flags", "support"])

    parsed = spread(entries).mapInPandas(parse, "entry_id bigint, category string, shape string, words string, b string, flags string, support int")
    spelled = ["shape", "words", "b", "flags", "support"]
    forms = ws.write(parsed.withColumn("fid", F.xxhash64(*spelled)), "forms")
    ws.drop(entries)
    # equal forms of many entries are compared once: the smallest entry stands for them
    heads = ws.write(forms.groupBy("fid", "category", *spelled).agg(F.min("entry_id").alias("id")), "heads")
    ids = ws.write(forms.select("entry_id", "category", "fid", "shape"), "ids")
    ws.drop(forms)
    # only one slice of the keys is on disk at a time
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for part in range(slices):
        keys = spread(heads).mapInArrow(lambda batches, part=part: keys_of(batches, part, slices), "key string, id bigint, fid bigint, category string, shape string, words string, b string, support int")
        found.append(ws.write(keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(near_forms, _NEAR), f"near{part}"))
    near = reduce(DataFrame.unionByName, found)
    tops = heads.select(F.col("fid").alias("top_fid"), F.col("category").alias("top_category"), F.col("id").alias("head"))
    equal = ids.filter("shape <> 'w'").join(tops, F.col("fid") == F.col("top_fid")).filter("entry_id <> head").filter("category is null or top_category is null or category = top_category")
    copies = equal.select(F.least("entry_id", "head").alias("id_a"), F.greatest("entry_id", "head").alias("id_b"))
    strong = ws.write(near.filter("not weak").select("id_a", "id_b").unionByName(copies).distinct(), "strong")
    entity = connected_components(ws, strong)
    # an entry that never gives a given name joins the one entity its family name and initial fit
    given = ids.groupBy("entry_id").agg(F.max(F.col("shape") != "w").alias("given"))
    sure, loose = given.filter("given"), given.filter("not given").select("entry_id")
    weak = near.filter("weak").select(F.col("fid_a").alias("fid"), F.col("id_a").alias("head"), F.col("id_b").alias("y"))
    weak = weak.unionByName(near.filter("weak").select(F.col("fid_b").alias("fid"), F.col("id_b").alias("head"), F.col("id_a").alias("y")))
    # every holder of a form has the links of the entry that stands for it, and that entry itself
    holders = ids.filter("shape = 'w'").select("entry_id", "category", "fid").join(loose, "entry_id", "left_semi")
    held = ws.write(holders.join(tops, (F.col("fid") == F.col("top_fid")) & F.col("category").eqNullSafe(F.col("top_category"))).select(F.col("entry_id").alias("x"), "fid", "head"), "held")
    both = held.join(weak, ["fid", "head"]).select("x", "y").unionByName(held.select("x", F.col("head").alias("y"))).filter("x <> y").distinct()
    named = both.join(entity.select(F.col("id").alias("y"), "component"), "y", "left").join(sure.select(F.col("entry_id").alias("y"), "given"), "y", "left")
    named = ws.write(named.select("x", "y", F.coalesce("component", "y").alias("component"), F.coalesce("given", F.lit(False)).alias("given")), "named")
    # other loose entries count only where no entry with a given name fits
    best = named.groupBy("x").agg(F.max("given").alias("given"))
    only = named.join(best, ["x", "given"]).groupBy("x").agg(F.min("component").alias("component"), F.max("component").alias("other"), F.min("y").alias("y")).filter("component = other")
    extra = only.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    links = ws.write(strong.unionByName(extra).distinct().select(F.col("id_a").alias("entry_id_a"), F.col("id_b").alias("entry_id_b")), "links")
    for over in (heads, ids, *found, strong, entity, held, named):
        ws.drop(over)
    return links


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of the ids in ``edges (id_a, id_b)``; a component is its smallest id.

    Alternating large-star and small-star rounds: each id hangs its greater neighbours, then
    all its neighbours, on the smallest one it knows.  Stars have a bounded depth, so long
    chains take a logarithmic number of rounds; no component is ever gathered.
    """
    e = ws.write(edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.write(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = ws.write(small, "small")
        with ws.tidied():
            change = small.exceptAll(e).limit(1).count() + e.exceptAll(small).limit(1).count()
        ws.drop(large)
        ws.drop(e)
        e = small
        if not change:
            break
    tops = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    found = ws.write(tops.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component")), "components")
    ws.drop(e)
    return found


def entities(gazetteer: DataFrame) -> DataFrame:
    """``(entry_id, entity)``: every entry with the smallest entry id of its entity."""
    ws = Workspace(gazetteer.sparkSession, "entities", tidy=True)
    found = connected_components(ws, link_entries(gazetteer).select(F.col("entry_id_a").alias("id_a"), F.col("entry_id_b").alias("id_b")))
    ids = gazetteer.select("entry_id").filter("entry_id is not null").distinct()
    return ids.join(found.withColumnRenamed("id", "entry_id"), "entry_id", "left").select("entry_id", F.coalesce("component", "entry_id").alias("entity"))


def same_entity(gazetteer: DataFrame) -> DataFrame:
    """All pairs of entries of one entity, smaller id first, unlike categories apart."""
    ws = Workspace(gazetteer.sparkSession, "pairs", tidy=True)
    category = gazetteer.groupBy("entry_id").agg(F.max(F.upper(F.trim("category"))).alias("category"))
    held = ws.write(entities(gazetteer).join(category, "entry_id"), "entities")
    a, b = (held.select("entity", F.col("entry_id").alias(f"entry_id_{x}"), F.col("category").alias(f"c_{x}")) for x in "ab")
    return a.join(b, "entity").filter("entry_id_a < entry_id_b and (c_a is null or c_b is null or c_a = c_b)").select("entry_id_a", "entry_id_b")
