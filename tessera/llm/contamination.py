"""Test passages leaking into training text: q-gram lemma filter and banded alignment.

Texts and passages are reduced to their letters and digits (case, punctuation, spacing,
markup, accents and invisible characters gone), so a leak is a run of characters that
survives any reformatting.  By the q-gram lemma a region that is an edited copy shares a
minimum of q-grams with the passage within a band of diagonals, derived for each passage
from the length and share that verification asks for; bands below it are dropped, as are
passages too few of whose neighbouring words stand together, in the text (one pass of an
automaton, before anything else) and in their bands.  The rest are aligned, and the words
of the passage that align exactly decide.  Documents stream through once; only the index of the test items, whose
size is checked, is broadcast, and larger item tables are taken in blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import spread

Q, DRIFT, PAD = 8, 8, 60
_MARKUP = re.compile(r"<[^<>]{0,200}>")
_LETTERS = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(42)


def squash(text: str | None) -> str:
    """Letters and digits of a text in lower case, compatibility forms unified, marks and markup removed."""
    if not text:
        return ""
    plain = _MARKUP.sub(" ", text) if "<" in text else text
    plain = html.unescape(plain) if "&" in plain else plain
    plain = plain if plain.isascii() else unicodedata.normalize("NFKD", plain)
    return "".join(_LETTERS(plain.lower()))


def word_of_char(text: str) -> np.ndarray:
    """For each character of ``squash(text)``: the index of the word it belongs to."""
    plain = unicodedata.normalize("NFKD", html.unescape(_MARKUP.sub(" ", text))).lower()
    spaced = "".join(c if c.isalnum() else " " if not unicodedata.combining(c) and unicodedata.category(c) != "Cf" else "" for c in plain)
    return np.repeat(np.arange(len(spaced.split())), [len(w) for w in spaced.split()])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 8 characters from each position, by doubling."""
    with np.errstate(over="ignore"):
        b2, b4 = _MIX * _MIX, _MIX * _MIX * _MIX * _MIX
        h1 = raw.astype(np.uint64) + np.uint64(1)
        if len(h1) < Q:
            return np.zeros(0, np.uint64)
        h2 = h1[:-1] * _MIX + h1[1:]
        h4 = h2[:-2] * b2 + h2[2:]
        return (h4[:-4] * b4 + h4[4:]) * _MIX


@dataclass
class PassageIndex:
    """Sorted q-grams of all passages with their places, and what alignment needs of each passage."""

    hashes: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    odd: np.ndarray  # whether the q-gram touches a rare word of its passage
    present: np.ndarray
    raw: list[np.ndarray]
    words: list[np.ndarray]
    text: list[str]
    spelled: list[list[str]]
    pairs: list[list[str]]  # neighbouring words written together
    places: list[list[int]]  # where each pair begins
    rare: list[np.ndarray]  # by word: in three passages at most
    short: list[list[str]]  # rare words no q-gram fits into
    need: np.ndarray  # least q-grams a leak of the passage shares
    sure: np.ndarray  # the same for a leak without rare words
    owners: list[list]

    def __post_init__(self) -> None:
        self.distinct, self.first, self.count = np.unique(self.hashes, return_index=True, return_counts=True)


def shared_qgrams(sizes: np.ndarray, least_words: int, share: float, alike: float | None = None) -> int:
    """Least q-grams shared by a passage of these word sizes and a text with ``share`` of ``least_words`` or more of its words.

    Each word changed or put in costs the q-grams across it, a changed one its own as well; where
    ``alike`` is given, only the rest of that share may be changed.  Longer spans hold a part
    of ``least_words`` to twice as many words that is no worse, so these lengths suffice.
    """
    best = int(sizes.sum()) + 1
    for n in range(least_words, min(len(sizes), 2 * least_words - 1) + 1):
        edits, changed = (n - int(np.ceil(x * n - 1e-9)) for x in (share, alike or share))
        w = np.sort(np.lib.stride_tricks.sliding_window_view(sizes, n), axis=1)
        best = min(best, int((w[:, : n - changed].sum(1) - (Q - 1) * (edits + 1)).min()))
    return max(1, best)


def build_index(passages: list[str], owners: list[list], least_words: int = 14, share: float = 0.8) -> PassageIndex:
    squashed = [squash(p) for p in passages]
    raw = [code_points(s) for s in squashed]
    words = [word_of_char(p) for p in passages]
    spelled = [[s[a:b] for a, b in _word_bounds(w)] for s, w in zip(squashed, words)]
    held: dict[str, int] = {}
    for ws in spelled:
        for w in set(ws):
            held[w] = held.get(w, 0) + 1
    rare = [np.array([held[w] <= 3 and not w.isdigit() for w in ws], bool) for ws in spelled]
    short = [[w for w, odd in zip(ws, r) if odd and len(w) < Q] for ws, r in zip(spelled, rare)]
    pairs = [[a + b for a, b in zip(ws, ws[1:])] for ws in spelled]
    places = [[a for a, _ in _word_bounds(w)][:-1] for w in words]
    sizes = [np.array([len(w) for w in ws], int) for ws in spelled]
    need = np.array([shared_qgrams(x, least_words, share) for x in sizes], int)
    sure = np.array([shared_qgrams(x, least_words, share, 0.95) for x in sizes], int)
    parts = [qgram_hashes(r) for r in raw]
    touch = [np.convolve(r[w], np.ones(Q, int), "valid") > 0 if len(w) >= Q else np.zeros(0, bool) for r, w in zip(rare, words)]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    pid = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    place = np.concatenate([np.arange(len(x)) for x in parts]) if parts else np.zeros(0, int)
    order = np.lexsort((pid, h))
    odd = np.concatenate(touch)[order] if touch else np.zeros(0, bool)
    h, pid, place = h[order], pid[order], place[order]
    present = np.zeros(1 << 22, bool)
    present[(h >> _SLOT).astype(np.int64)] = True
    return PassageIndex(h, pid.astype(np.int32), place.astype(np.int32), odd, present, raw, words, squashed, spelled, pairs, places, rare, short, need, sure, owners)


def _word_bounds(words: np.ndarray) -> list[tuple[int, int]]:
    if not len(words):
        return []
    cut = np.nonzero(np.diff(words))[0] + 1
    edges = [0, *cut.tolist(), len(words)]
    return list(zip(edges[:-1], edges[1:]))


class Sieve:
    """Pairs of texts and passages of which enough neighbouring words occur in the text, wherever.

    A word changed parts two pairs of neighbours and a word put in one, so a leak keeps a
    number of pairs together, and a piece of one with rare words holds one of them at least
    (see ``may_leak``, which asks for this and more within a band).  All pairs and rare words
    of all passages are looked for in one pass over a text.
    """

    def __init__(self, ix: PassageIndex, least_words: int, share: float):
        import ahocorasick

        self.least, self.share = least_words, share
        self.width = max([1, *(len(x) for x in ix.pairs)]) + 8 * least_words  # more than any span, so spans of two passages stay apart
        ids: dict[str, int] = {}
        place = lambda p, i: p * self.width + 2 * least_words + i
        of = [(ids.setdefault(w, len(ids)), place(p, i), False) for p, ws in enumerate(ix.pairs) for i, w in enumerate(ws)]
        of += [(ids.setdefault(ws[i], len(ids)), place(p, int(i)), True) for p, ws in enumerate(ix.spelled) for i in np.nonzero(ix.rare[p])[0]]
        order = sorted(of)
        self.at = np.array([x for _, x, _ in order], np.int64)
        self.odd = np.array([x for _, _, x in order], bool)
        self.first = np.searchsorted(np.array([k for k, _, _ in order], np.int64), np.arange(len(ids) + 1))
        self.passages = len(ix.raw)
        self.size = np.array([len(w) for w in ids], np.int64)
        owner, which = np.divmod(self.at, self.width)
        which -= 2 * least_words
        self.owner, self.which, self.small = owner, which, self.size[[k for k, _, _ in order]] < Q if order else self.odd
        begins = [_word_bounds(w) for w in ix.words]
        self.begin = np.array([begins[p][i][0] for p, i in zip(owner.tolist(), which.tolist())], np.int64)
        self.auto = ahocorasick.Automaton()
        for w, k in ids.items():
            self.auto.add_word(w, k)
        self.auto.make_automaton()

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Sorted ``text * passages + passage`` of what may hold a leak."""
        none = np.zeros(0, np.int64)
        found = [list(self.auto.iter(t)) if len(self.auto) else [] for t in texts]
        size = np.array([len(f) for f in found], np.int64)
        self.hits = none, none, none
        if not size.sum():
            return none
        end, ids = np.array([x for f in found for x in f], np.int64).T
        text = np.repeat(np.arange(len(texts)), size)
        self.hits = text, ids, end + 1 - self.size[ids]
        once = np.unique(text * len(self.size) + ids)
        text, ids = np.divmod(once, len(self.size))
        n = self.first[ids + 1] - self.first[ids]
        entry = np.repeat(self.first[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(text, n) * (self.passages * self.width) + self.at[entry]
        odd = self.odd[entry]
        rare, key = np.sort(key[odd]), key[~odd]
        own = key // self.width
        count = np.bincount(own)
        key = np.sort(key[count[own] >= self.least // 4 * _kept(5, self.share)])
        own = key // self.width
        held = []
        for k in range(self.least, 2 * self.least):
            j = _kept(k, self.share)
            held.append(own[: len(key) - j + 1][key[j - 1 :] - key[: len(key) - j + 1] <= k - 2] if len(key) >= j else none)
        spans = []
        for k in range(4, self.least):
            for j, named in ((_kept(k, self.share), True), (int(np.ceil(self.share * k - 1e-9)) - 1, False)):
                if len(key) < j:
                    continue
                a, b = key[: len(key) - j + 1], key[j - 1 :]
                ok = b - a <= k - 2
                start, end = b[ok] - k + 2, a[ok] + k  # the words of any stretch of that length with these pairs
                if named:
                    some = np.searchsorted(rare, end) > np.searchsorted(rare, start)
                    start, end = start[some], end[some]
                spans.append(np.stack([start, end]))
        if spans:
            start, end = np.concatenate(spans, axis=1)
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
            before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
            new = np.maximum(end - np.maximum(start, before), 0)
            words = np.bincount(start // self.width, weights=new) if len(start) else none
            held.append(np.nonzero(words >= self.least)[0])
        return np.unique(np.concatenate(held))

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the last texts: ``(text * passages + passage, is a word, which word or pair, diagonal, is shorter than a q-gram)`` of every place of the wanted, sorted by the first."""
        text, ids, at = self.hits
        own = np.unique(wanted // self.passages)
        stay = np.isin(text, own)
        text, ids, at = text[stay], ids[stay], at[stay]
        n = self.first[ids + 1] - self.first[ids]
        entry = np.repeat(self.first[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(text, n) * self.passages + self.owner[entry]
        stay = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
        key, entry, diagonal = key[stay], entry[stay], np.repeat(at, n)[stay] - self.begin[entry[stay]]
        order = np.argsort(key, kind="stable")
        return key[order], self.odd[entry][order], self.which[entry][order], diagonal[order], self.small[entry][order]

    def short_words(self, places: tuple[np.ndarray, ...]) -> np.ndarray:
        """``text * passages + passage`` where a rare word no q-gram fits into is met."""
        return np.unique(places[0][places[1] & places[4]])


def regions(raw: np.ndarray, starts: np.ndarray, ix: PassageIndex, band: int, wanted: np.ndarray, short: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """Candidate regions ``(low diagonal, high diagonal, from, to)`` by text and passage of concatenated texts.

    Of texts and passages only the ``wanted`` are looked at (sorted ``text * passages + passage``).
    These are bands of diagonals that share with the passage the q-grams any leak of it must:
    ``need`` of which one touches a rare word, or ``sure`` of any kind; where a rare word is
    shorter than a q-gram, the letters of the text decide whether it may be there (``short``: the
    texts and passages for which one is).  Bands overlap
    by half, so a run that drifts by less than half a band lies whole in one of them.
    """
    h = qgram_hashes(raw)
    maybe = np.nonzero(ix.present[(h >> _SLOT).astype(np.int64)])[0]
    k = np.minimum(np.searchsorted(ix.distinct, h[maybe]), len(ix.distinct) - 1)
    there = ix.distinct[k] == h[maybe]
    if not there.any():
        return {}
    maybe, lo, n = maybe[there], ix.first[k[there]], ix.count[k[there]]
    at = np.repeat(maybe, n)
    entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(raw))))[at]
    pid, odd = ix.passage[entry].astype(np.int64), ix.odd[entry]
    where = at - starts[text]
    diagonal = where - ix.place[entry] + (1 << 20)
    pair = text.astype(np.int64) * len(ix.raw) + pid
    stay = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
    odd, where, diagonal, owner = odd[stay], where[stay], diagonal[stay], pair[stay] << 33
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for shift in (0, band // 2):
        key = owner | ((diagonal + shift) // band)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, int)
        if not len(first):
            continue
        count = np.diff(np.append(first, len(key)))
        t, p = np.divmod(key[first] >> 33, len(ix.raw))
        told = np.logical_or.reduceat(odd[order], first)
        told |= np.isin(key[first] >> 33, short)
        good = (count >= ix.sure[p]) | ((count >= ix.need[p]) & told)
        d, x = diagonal[order] - (1 << 20), where[order]
        ends = (np.minimum.reduceat(d, first), np.maximum.reduceat(d, first), np.minimum.reduceat(x, first), np.maximum.reduceat(x, first) + Q)
        for a, b, *part in np.stack([v[good] for v in (t, p, *ends)], axis=1).tolist():
            found.setdefault((a, b), []).append(tuple(part))
    for key, parts in found.items():
        if len(parts) > 1:
            parts = sorted(set(parts), key=lambda r: (r[0], -r[1]))
            found[key] = [r for r in parts if not any(o is not r and o[0] <= r[0] and r[1] <= o[1] and o[2] <= r[2] and r[3] <= o[3] for o in parts)]
    return found


def may_leak(found: dict[tuple[int, int], list[tuple[int, int, int, int]]], places: tuple[np.ndarray, ...], ix: PassageIndex, least_words: int, share: float) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """The bands whose words can make up a leak or a piece of one, whatever the alignment.

    A word changed parts two pairs of neighbours and a word put in one, so a leak keeps a number
    of pairs together in its band: in one stretch, or in pieces of four words or more that
    hold half of their rare words, or all words where they have none.  ``places`` are those of
    all pairs and rare words (see ``Sieve.places``), by ``text * passages + passage``.
    """
    out: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    # bands of passages of like length are computed together
    keys = sorted(found, key=lambda k: (len(ix.spelled[k[1]]), k))
    for at in range(0, len(keys), 500):
        _judge(keys[at : at + 500], found, places, ix, least_words, share, out)
    return {k: out[k] for k in found if k in out}


def _judge(keys: list[tuple[int, int]], found: dict, places: tuple[np.ndarray, ...], ix: PassageIndex, least_words: int, share: float, out: dict) -> None:
    parts = np.array([part for k in keys for part in found[k]], np.int64)
    many = np.array([len(found[k]) for k in keys])
    first = np.cumsum(many) - many
    pair = np.repeat(np.arange(len(keys)), many)
    size = np.array([len(ix.spelled[p]) for _, p in keys])
    words, rows = int(size.max()), len(parts)
    own, is_word, which, diagonal, _ = places
    named = np.array([t * len(ix.raw) + p for t, p in keys])[pair]
    lo = np.searchsorted(own, named)
    n = np.searchsorted(own, named, side="right") - lo
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = np.repeat(np.arange(rows), n)
    inside = (diagonal[entry] >= parts[row, 0] - DRIFT) & (diagonal[entry] <= parts[row, 1] + DRIFT)
    row, entry = row[inside], entry[inside]
    held, here, rare = np.zeros((rows, words), bool), np.zeros((rows, words), bool), np.zeros((len(keys), words), bool)
    starts = np.full((len(keys), words), 1 << 40)
    for i, (_, p) in enumerate(keys):
        rare[i, : size[i]] = ix.rare[p]
        starts[i, : size[i] - 1] = ix.places[p]
    is_word = is_word[entry]
    held[row[~is_word], which[entry[~is_word]]] = True
    here[row[is_word], which[entry[is_word]]] = True
    starts = starts[pair]
    low, high, a, b = (parts[:, c : c + 1] for c in range(4))
    held &= (starts >= a - PAD - high - DRIFT) & (starts < b + PAD - low + DRIFT)  # pairs beside the band say nothing
    rare, size = rare[pair], size[pair]
    enough = np.logical_or.reduceat(held, first).sum(axis=1) >= least_words // 4 * _kept(5, share)

    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((rows, 1), np.int16), np.cumsum(x, axis=1, dtype=np.int16)], axis=1)

    total, odd, met = sums(held)[:, :-1], sums(rare), sums(here)
    whole, cover = np.zeros(rows, bool), np.zeros((rows, words + 1), np.int16)
    for k in range(4, min(words, 2 * least_words - 1) + 1):
        spans = total[:, k - 1 :] - total[:, : words - k + 1]
        fits = np.arange(words - k + 1) + k <= size[:, None]
        if k >= least_words:
            whole |= ((spans >= _kept(k, share)) & fits).any(axis=1)
            continue
        odds = odd[:, k:] - odd[:, :-k]
        told = (2 * (met[:, k:] - met[:, :-k]) >= odds) & (odds > 0) & (spans >= _kept(k, share))
        ok = (told | (odds == 0) & (spans >= int(np.ceil(share * k - 1e-9)) - 1) & (spans.max(axis=1, keepdims=True) >= _kept(k, share))) & fits
        cover[:, : words - k + 1] += ok
        cover[:, k:] -= ok
    covered = np.cumsum(cover, axis=1)[:, :-1] > 0
    some = np.logical_or.reduceat(covered, first).sum(axis=1) >= least_words
    good = enough & (np.logical_or.reduceat(whole, first) | some)
    keep = (whole | covered.any(axis=1)) & good[pair]
    for i in np.nonzero(keep)[0]:
        out.setdefault(keys[pair[i]], []).append(tuple(parts[i].tolist()))


@lru_cache
def _kept(n: int, share: float) -> int:
    """Pairs of neighbours that ``n`` words keep together when ``share`` of them is equal."""
    return n - 1 - 2 * (n - int(np.ceil(share * n - 1e-9)))


def along(text: np.ndarray, passage: np.ndarray, part: tuple[int, int, int, int]) -> np.ndarray | None:
    """Places of a region that is an exact copy on one diagonal to an end of text or passage on both sides; None if it is not."""
    low, high, a, b = part
    if low != high or not np.array_equal(text[a:b], passage[a - low : b - low]):
        return None
    while a > 0 and a - low > 0 and text[a - 1] == passage[a - 1 - low]:
        a -= 1
    while b < len(text) and b - low < len(passage) and text[b] == passage[b - low]:
        b += 1
    if (a > 0 and a - low > 0) or (b < len(text) and b - low < len(passage)):
        return None  # beyond an edit there may be words too short for a q-gram
    out = np.full(len(passage), -1)
    out[a - low : b - low] = np.arange(a, b)
    return out


def align_many(tasks: list[tuple[np.ndarray, np.ndarray, int, int]], batch: int = 256) -> list[np.ndarray]:
    """Local alignments of texts with passages, each over diagonals low to high (text place less passage place).

    Equal characters score 1, an unequal or missing one -1.  Returns for each passage
    character the text place it is equal to on the best path, or -1.  Tasks of similar
    size are computed together, row by row.
    """
    out: list[np.ndarray] = [np.zeros(0, int)] * len(tasks)
    order = sorted(range(len(tasks)), key=lambda k: (len(tasks[k][1]), tasks[k][3] - tasks[k][2]))
    at = 0
    while at < len(order):
        some = order[at : at + batch]
        while len(some) > 16 and len(some) * len(tasks[some[-1]][1]) > 100_000:
            some = some[: len(some) // 2]  # passages are long: the scores take as much as those of many short ones
        at += len(some)
        n, rows = len(some), max(len(tasks[k][1]) for k in some)
        width = max(tasks[k][3] - tasks[k][2] + 1 for k in some)
        text, passage = np.full((n, rows + width), -1, np.int32), np.full((n, rows), -2, np.int32)
        inside = np.zeros((n, rows + width), bool)
        wide = np.zeros((n, width), bool)
        for i, k in enumerate(some):
            t, q, lo, hi = tasks[k]
            passage[i, : len(q)] = q
            a, b = max(0, -lo), min(rows + width, len(t) - lo)  # column x holds text place lo + x
            if b > a:
                text[i, a:b], inside[i, a:b] = t[lo + a : lo + b], True
            wide[i, : hi - lo + 1] = True
        score = np.zeros((rows + 1, n, width + 2), np.int16)
        span = np.arange(width + 2, dtype=np.int16)
        for r in range(rows):
            same = text[:, r : r + width] == passage[:, r : r + 1]
            prev, row = score[r], score[r + 1]
            step = prev[:, 1:-1] + (same.view(np.int8) * np.int8(2) - np.int8(1))  # both advance
            np.maximum(step, prev[:, 2:] - np.int16(1), out=step)  # a passage character is skipped
            np.maximum(step, 0, out=step)
            np.multiply(step, wide & inside[:, r : r + width], out=row[:, 1:-1])
            row += span
            np.maximum.accumulate(row, axis=1, out=row)  # text characters are skipped
            row -= span
            row[:, 0] = row[:, -1] = 0
        for i, k in enumerate(some):
            out[k] = _closed(_best_path(score[:, i], *tasks[k][:3]), *tasks[k][:2])
    return out


def _best_path(score: np.ndarray, text: np.ndarray, passage: np.ndarray, low: int) -> np.ndarray:
    out = np.full(len(passage), -1)
    r, c = divmod(int(score.argmax()), score.shape[1])
    cells, t, p = memoryview(np.ascontiguousarray(score[: r + 1])), text.tolist(), passage.tolist()
    last = score.shape[1] - 1
    while r > 0 and cells[r, c] > 0:
        place, here = r - 1 + low + c - 1, cells[r, c]
        same = 0 <= place < len(t) and r <= len(p) and t[place] == p[r - 1]
        if here == cells[r - 1, c] + (1 if same else -1):
            if same:
                out[r - 1] = place
            r -= 1
        elif c < last and here == cells[r - 1, c + 1] - 1:
            r, c = r - 1, c + 1
        elif here == cells[r, c - 1] - 1:
            c -= 1
        else:
            break
    return out


def _closed(out: np.ndarray, text: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Of paths that score the same, the one whose runs are not broken: a letter next to its run is not matched beyond an edit."""
    out, text, passage = out.tolist(), text.tolist(), passage.tolist()
    taken = {x: i for i, x in enumerate(out) if x >= 0}
    for step, order in ((1, range(1, len(out))), (-1, range(len(out) - 2, -1, -1))):
        for i in order:
            if out[i] >= 0 or out[i - step] < 0:
                continue
            want = out[i - step] + step
            if not 0 <= want < len(text) or text[want] != passage[i]:
                continue
            other = taken.get(want)
            if other is not None:
                if 0 <= other + step < len(out) and out[other + step] == want + step:
                    continue  # it belongs to the next run
                out[other] = -1
            out[i], taken[want] = want, i
    return np.array(out, int)


def word_runs(matched: np.ndarray, share: float, gap: int, least: int) -> list[tuple[int, int]]:
    """Longest disjoint spans of words that begin and end with a match, have at most ``gap`` misses in a row and ``share`` matches."""
    hits = np.nonzero(matched)[0]
    best: tuple[int, int] | None = None
    for a in range(len(hits)):
        for b in range(len(hits) - 1, a - 1, -1):
            span = hits[b] - hits[a] + 1
            if best and span <= best[1] - best[0] or span < least:
                break
            inner = hits[a : b + 1]
            if len(inner) >= share * span and (len(inner) < 2 or np.diff(inner).max() <= gap + 1):
                best = (int(hits[a]), int(hits[b]) + 1)
                break
    if best is None:
        return []
    left, right = matched.copy(), matched.copy()
    left[best[0] :] = False
    right[: best[1]] = False
    return [*word_runs(left, share, gap, least), best, *word_runs(right, share, gap, least)]


def task_of(part: tuple[int, int, int, int], text: np.ndarray, passage: np.ndarray, pad: int = PAD) -> tuple[tuple, int, int]:
    """The alignment that verifies a region, with the offsets of its text and passage."""
    low, high, a, b = part
    a0, b0 = max(0, a - pad), min(len(text), b + pad)
    p0, p1 = max(0, a0 - high - DRIFT), min(len(passage), b0 - low + DRIFT)
    return (text[a0:b0], passage[p0:p1], low - DRIFT - a0 + p0, high + DRIFT - a0 + p0), a0, p0


def longest_leak(aligned: list[tuple[np.ndarray, int, int]], ix: PassageIndex, p: int, least_words: int, share: float, gap: int) -> tuple[int, int]:
    """``(words in a row, words matched)`` of the longest leak of passage ``p`` in a text; (0, 0) if none is long enough."""
    words, rare = ix.words[p], ix.rare[p]
    bounds = _word_bounds(words)
    first, end = np.array(bounds, int).reshape(-1, 2).T
    runs = []
    for got, a0, p0 in aligned:
        place = np.full(len(words), -1)
        place[p0 : p0 + len(got)] = np.where(got >= 0, got + a0, -1)
        matched = (np.minimum.reduceat(place, first) >= 0) & (place[end - 1] - place[first] <= end - first)
        for w0, w1 in word_runs(matched, share, gap, 4):
            odd = rare[w0:w1]
            ok = matched[w0:w1]
            if odd.any() and 2 * (ok & odd).sum() < odd.sum() or not odd.any() and ok.mean() < 0.95:
                continue  # the same sentence pattern about other names
            runs.append((int(place[bounds[w0][0]]), int(place[bounds[w1 - 1][1] - 1]) + 1, w1 - w0, int(ok.sum())))
    runs = sorted(set(runs))
    best = (0, 0)
    chain: list[tuple[int, int, int, int]] = []
    for run in runs:
        if chain and run[0] < chain[-1][1]:
            if run[2] <= chain[-1][2]:
                continue
            chain.pop()
        if chain and run[0] - chain[-1][1] > 24:
            chain = []
        chain.append(run)
        total = (sum(r[2] for r in chain), sum(r[3] for r in chain))
        best = max(best, total)
    return best if best[0] >= least_words else (0, 0)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least_words: int = 14, share: float = 0.8, gap: int = 3, band: int = 64, index_chars: int = 20_000_000) -> DataFrame:
    """``(id, item, n_words, n_matched)`` for each document and item whose passage it carries.

    A case holds ``least_words`` or more words of the passage in a row: ``share`` of them equal,
    no more than ``gap`` changed in a row, whatever stands between.  Stretches of the passage that
    follow each other in another order add up.  Where a stretch holds words that few passages
    have (names), at least half of these must be equal, since sentence patterns recur.
    ``n_words`` is the length of the longest such stretch.  Null and short texts or passages give
    no row; items that share a passage each give a row; rows with equal ids are one document.
    """
    spark = docs.sparkSession
    usable = items.filter(F.col(passage_col).isNotNull()).select(item_col, passage_col)
    size = usable.agg(F.coalesce(F.sum(F.length(passage_col)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // index_chars))
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (items, item_col)))
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, n_words int, n_matched int"
    out = None
    for k in range(blocks):
        part = usable.filter(F.pmod(F.xxhash64(passage_col), F.lit(blocks)) == k).groupBy(passage_col).agg(F.sort_array(F.collect_set(item_col)).alias("owners")).toPandas()
        shared = spark.sparkContext.broadcast(build_index(part[passage_col].tolist(), [list(x) for x in part["owners"]], least_words, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            sieve = Sieve(ix, least_words, share)
            for batch in batches:
                for at in range(0, batch.num_rows, 400):
                    ids, texts = batch.column(0).slice(at, 400), [squash(t) for t in batch.column(1).slice(at, 400).to_pylist()]
                    wanted = sieve(texts)
                    if not len(wanted):
                        continue
                    own, *places = sieve.places(wanted)
                    kept, renamed = np.unique(wanted // len(ix.raw), return_inverse=True)
                    ids, texts = ids.take(pa.array(kept)), [texts[k] for k in kept]
                    wanted = renamed * len(ix.raw) + wanted % len(ix.raw)
                    places = (np.searchsorted(kept, own // len(ix.raw)) * len(ix.raw) + own % len(ix.raw), *places)
                    raw = code_points("\x00".join(texts))
                    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
                    by: dict[tuple[int, int], list] = {}
                    unclear, tasks = [], []
                    found = may_leak(regions(raw, starts, ix, band, wanted, sieve.short_words(places)), places, ix, least_words, share)
                    for (t, p), parts in found.items():
                        text = raw[starts[t] : starts[t] + len(texts[t])]
                        for part in parts:
                            exact = along(text, ix.raw[p], part)
                            if exact is None:
                                unclear.append((t, p))
                                tasks.append(task_of(part, text, ix.raw[p]))
                            else:
                                by.setdefault((t, p), []).append((exact, 0, 0))
                    for key, (_, a0, p0), got in zip(unclear, tasks, align_many([x[0] for x in tasks])):
                        by.setdefault(key, []).append((got, a0, p0))
                    rows = []
                    for (t, p), aligned in by.items():
                        n, m = longest_leak(aligned, ix, p, least_words, share, gap)
                        rows += [(t, owner, n, m) for owner in ix.owners[p] if n]
                    if rows:
                        t, owner, n, m = zip(*rows)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), pa.array(owner), pa.array(n, pa.int32()), pa.array(m, pa.int32())], names=[id_col, item_col, "n_words", "n_matched"])

        found = spread(docs.select(id_col, text_col)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **params) -> DataFrame:
    """The distinct ``(document, item)`` pairs of ``leaked_items``."""
    return leaked_items(docs, items, id_col=id_col, item_col=item_col, **params).select(id_col, item_col).distinct()


def leaked_fields(docs: DataFrame, items: DataFrame, fields: dict[str, int], **params) -> DataFrame:
    """``leaked_items`` of several text columns of the items, each with its ``least_words``; column ``field`` names the text."""
    out = None
    for name, least_words in fields.items():
        found = leaked_items(docs, items, passage_col=name, least_words=least_words, **params).withColumn("field", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
