"""Keyword-stuffed pages, link lists and tag lists, told by the information between neighbouring words.

Corpus counts of words and of neighbouring pairs, always without the page at hand, give
every pair of neighbours its pointwise mutual information: how much likelier the second
word is after the first than by itself.  "By itself" is its share of the corpus plus its
repeated share of the page, so a word that comes again and again needs a neighbour that
calls for it.  Where the mean over a window is low, the words are a salad or one
collocation repeated beyond what language asks for; in sentences it is high.  Links, tags
and prices are one word each that no neighbour calls for; numbers part their neighbours and
tell something themselves.

A mean of no information at all is salad whatever the words.  Between that and the level of
sentences lie tables of names and glossaries too; there a window must also read like the
surely incoherent pages of the corpus rather than like the rest, by the likelihood ratio of
its words.  The page's share of characters in such windows decides.

Counts are exact sums by key.  Words and pairs below a share of all tokens count as
unseen, which bounds what is broadcast whatever the size of the corpus; texts are read
once and no pass shuffles them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import Workspace
from tessera.sources.tables import spread

MARK, NUMBER, PRICE, TAG, URL, WORD = 0, 1, 2, 3, 4, 16  # words are hashes from WORD on
URLS = r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@.])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,12}(?:/[^\s<>\"')\]]*)?(?![\w.])"
TAGS, PRICES, NUMBERS = r"#(?=[\w-]*[^\W\d])[\w-]+", r"[$€£]\d+(?:[.,]\d+)*", r"#?\d+(?:[.:,]\d+)*"
TOKEN = f"{URLS}|{TAGS}|{PRICES}|{NUMBERS}" + r"|[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\w\s]+|_+"
KINDS = ((NUMBERS, NUMBER), (PRICES, PRICE), (TAGS, TAG), (URLS, URL))
_MOST = 3.0  # nats either way that one pair or word may tell
_FACT = 2.0  # nats of a number, about those of a pair in a sentence: results and charts state something in each row


def token_id(token: str) -> int:
    """Hash of a word, or the number of the kind a token is of."""
    for pattern, kind in KINDS:
        if re.fullmatch(pattern, token):
            return kind
    return max(WORD, xxhash.xxh64_intdigest(token) >> 1) if token[0].isalpha() else MARK


class Tokenizer:
    """Ids and sizes of the tokens of texts, a stretch without white space at a time; stretches seen before are looked up."""

    def __init__(self, cache_limit: int = 500_000):
        self._find, self._limit = re.compile(TOKEN).findall, cache_limit
        self._cache: dict[str, tuple[list[int], list[int]]] = {}

    def _read(self, stretch: str) -> tuple[list[int], list[int]]:
        found = self._find(stretch)
        got = [token_id(t) for t in found], [len(t) for t in found]
        if len(stretch) <= 64:
            if len(self._cache) >= self._limit:
                self._cache.clear()
            self._cache[stretch] = got
        return got

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """Ids and lengths in characters of all tokens, and the number of tokens of each text."""
        get, ids, sizes, counts = self._cache.get, [], [], []
        for text in texts:
            before = len(ids)
            for stretch in (text or "").lower().split():
                i, s = get(stretch) or self._read(stretch)
                ids += i
                sizes += s
            counts.append(len(ids) - before)
        return ids, sizes, counts


class Counts:
    """Sorted keys with one number each; 0 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0).astype(float)


def neighbours(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first and second tokens of all neighbouring pairs: marks between do not count, a number parts them."""
    at = np.nonzero(ids != MARK)[0]
    a, b = at[:-1], at[1:]
    ok = (ids[a] != NUMBER) & (ids[b] != NUMBER) & (doc[a] == doc[b])
    return a[ok], b[ok]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)).astype(np.int64)


def _own(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element: how often its text holds its key, and its key's index among the distinct keys, which come third."""
    uniq, index = np.unique(keys, return_inverse=True)
    _, inverse, count = np.unique(doc.astype(np.int64) * max(1, len(uniq)) + index, return_inverse=True, return_counts=True)
    return count[inverse].astype(float), index, uniq


def information(ids: np.ndarray, doc: np.ndarray, words: Counts, pairs: Counts, tokens: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the second tokens of all pairs and of the numbers, and their information in nats.

    The share of a word after its neighbour is that of the corpus without the page, drawn to
    the word's overall share with ``weight``; it is compared with the overall share plus the
    share of the page that repeats the word.  A number has ``_FACT``.
    """
    a, b = neighbours(ids, doc)
    facts = np.nonzero(ids == NUMBER)[0]
    if not len(a):
        return facts, np.full(len(facts), _FACT)
    n = np.bincount(doc[ids != MARK], minlength=doc[-1] + 1).astype(float)[doc[b]]
    own, index, uniq = _own(ids, doc)
    rest = np.maximum(words.of(uniq)[index] - own, 0)
    joint, pair_index, pair_uniq = _own(pair_keys(ids[a], ids[b]), doc[b])
    both = np.maximum(pairs.of(pair_uniq)[pair_index] - joint, 0)
    overall = (rest[b] + 0.5) / np.maximum(tokens - n, 1)
    after = np.where(ids[b] < WORD, overall, (both + weight * overall) / (np.maximum(rest[a], both) + weight))
    value = np.clip(np.log(after / (overall + (own[b] - 1) / n)), -_MOST, _MOST)
    return np.concatenate([b, facts]), np.concatenate([value, np.full(len(facts), _FACT)])


def _window(values: np.ndarray, doc: np.ndarray, n_tokens: np.ndarray, half: int) -> np.ndarray:
    """Sum of ``values`` over the window around each token of its text."""
    start = np.concatenate([[0], np.cumsum(n_tokens)])
    total = np.concatenate([[0.0], np.cumsum(values)])
    i = np.arange(len(values))
    return total[np.minimum(i + half + 1, start[doc + 1])] - total[np.maximum(i - half, start[doc])]


def coherence(at: np.ndarray, value: np.ndarray, doc: np.ndarray, n_tokens: np.ndarray, half: int) -> np.ndarray:
    """Mean information of the pairs in the window around each token; infinite where there are fewer than four."""
    m = len(doc)
    pairs = _window(np.bincount(at, minlength=m).astype(float), doc, n_tokens, half)
    total = _window(np.bincount(at, weights=value, minlength=m), doc, n_tokens, half)
    return np.where(pairs >= 4, total / np.maximum(pairs, 1), np.inf)


def _share(flag: np.ndarray, sizes: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(doc, weights=sizes * flag, minlength=m) / np.maximum(np.bincount(doc, weights=sizes, minlength=m), 1)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 500_000):
    """Columns of tokens as flat arrays: keys, ids, sizes, text index, tokens of each text."""
    for batch in batches:
        lists = batch.column(1)
        n = np.asarray(pc.list_value_length(lists).fill_null(0))
        cut = np.cumsum(n) // most
        for part in np.unique(cut):
            rows = np.nonzero(cut == part)[0]
            sub = batch.slice(rows[0], rows[-1] - rows[0] + 1)
            size = n[rows[0] : rows[-1] + 1]
            ids, sizes = (np.asarray(sub.column(k).flatten()).astype(np.int64) for k in (1, 2))
            yield sub.column(0), ids, sizes, np.repeat(np.arange(len(size)), size), size


_SUMS = "kind int, key bigint, a double, b double"


def _rows(kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    b = np.zeros(len(keys)) if b is None else b
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(a.astype(float)), pa.array(b.astype(float))], names=["kind", "key", "a", "b"])


def corpus_counts(ws: Workspace, tokens: DataFrame, least_share: float) -> tuple[Counts, Counts, float]:
    """Counts of words and of neighbouring pairs of at least ``least_share`` of all tokens (and 2), and the number of tokens."""

    def run(batches):
        for _, ids, _, doc, _ in _batches(batches):
            said = ids[ids != MARK]
            yield _rows(0, *np.unique(said, return_counts=True))
            a, b = neighbours(ids, doc)
            yield _rows(1, *np.unique(pair_keys(ids[a], ids[b]), return_counts=True))
            yield _rows(2, np.zeros(1, np.int64), np.array([len(said)]))

    summed = ws.write(tokens.mapInArrow(run, _SUMS).groupBy("kind", "key").agg(F.sum("a").alias("a")), "counts")
    total = summed.filter("kind = 2").agg(F.sum("a").alias("n")).first()["n"] or 0.0
    # at most 1 / least_share words and as many pairs can pass
    kept = summed.filter((F.col("kind") < 2) & (F.col("a") >= max(2.0, least_share * total))).toArrow()
    kind, key, n = (np.asarray(kept[c]) for c in ("kind", "key", "a"))
    ws.drop(summed)
    return Counts(key[kind == 0], n[kind == 0]), Counts(key[kind == 1], n[kind == 1]), max(1.0, total)


def stuffed_shares(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 5e-7, weight: float = 10.0,
    sure: float = 0.7, sure_half: int = 12, salad: float = 0.0, least: float = 1.3, half: int = 16,
) -> DataFrame:
    """``(id, stuffed_share, mean_pmi)`` of every row.

    ``stuffed_share`` is the share of characters (white space aside) in stuffed windows, 0
    for null, empty and word-less texts; ``mean_pmi`` is the page's mean information between
    neighbours in nats, null without pairs.  Pages most of which lies below ``sure`` in
    windows of ``sure_half`` tokens to each side teach which words are stuffing; a window of
    ``half`` is stuffed if its mean lies below ``salad``, or below ``least`` and its words read
    so.  Each row is read whole; repeated rows each get a row, null ids stay null.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "stuffed")
    id_type = df.schema[id_col].dataType.simpleString()

    def split(batches):
        read = Tokenizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, sizes, counts = read(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids, pa.int64()), (sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=[id_col, "ids", "sizes"])

    tokens = ws.write(spread(df.select(id_col, text_col)).mapInArrow(split, f"`{id_col}` {id_type}, ids array<bigint>, sizes array<int>"), "tokens")
    shared = spark.sparkContext.broadcast(corpus_counts(ws, tokens, least_share))

    def learn(batches):
        words, pairs, total = shared.value
        for _, ids, sizes, doc, n in _batches(batches):
            at, value = information(ids, doc, words, pairs, total, weight)
            flag = coherence(at, value, doc, n, sure_half) < sure
            flag &= (_share(flag, sizes, doc, len(n)) > 0.5)[doc]
            said = ids != MARK
            uniq, index = np.unique(ids[said], return_inverse=True)
            yield _rows(0, uniq, *(np.bincount(index, weights=x[said], minlength=len(uniq)) for x in (flag, ~flag)))

    summed = ws.write(tokens.mapInArrow(learn, _SUMS).groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "learned")
    stuffed, other = summed.agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    known = summed.filter(F.col("a") + F.col("b") >= max(2.0, least_share * (stuffed + other))).toArrow()
    a, b = (np.asarray(known[c]) for c in ("a", "b"))
    ratio = np.log((a + 0.5) / (stuffed + 1)) - np.log((b + 0.5) / (other + 1))
    told = spark.sparkContext.broadcast(Counts(np.asarray(known["key"]), np.clip(ratio, -_MOST, _MOST)))

    def read(batches):
        words, pairs, total = shared.value
        for keys, ids, sizes, doc, n in _batches(batches):
            at, value = information(ids, doc, words, pairs, total, weight)
            uniq, index = np.unique(ids, return_inverse=True)
            reads = told.value.of(uniq)[index] if len(ids) else np.zeros(0)
            mean = coherence(at, value, doc, n, half)
            flag = (mean < salad) | (mean < least) & (_window(reads, doc, n, half) > 0)
            count = np.bincount(doc[at], minlength=len(n))
            level = np.bincount(doc[at], weights=value, minlength=len(n)) / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([keys, pa.array(_share(flag, sizes, doc, len(n))), pa.array(level, mask=count == 0)], names=[id_col, "stuffed_share", "mean_pmi"])

    return tokens.mapInArrow(read, f"`{id_col}` {id_type}, stuffed_share double, mean_pmi double")


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """Ids of the rows most of whose characters are stuffed keywords, link lists or tags; null ids have none."""
    return stuffed_shares(df, id_col, **params).filter((F.col("stuffed_share") > 0.5) & F.col(id_col).isNotNull()).select(id_col)
