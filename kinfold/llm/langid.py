"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  A word that no
language has is covered by character n-grams: at each of its places the longest
known n-gram that starts there counts (five characters, then four, down to one),
scored by its log frequency among n-grams of its order.  A text's score in a
language is the mean over its words; the language with the largest one wins,
ties by code point, and the reported score is the softmax of these means.

A word or n-gram that a language lacks has the same floor in every language, half a sighting in the largest
one's sample, so a language of few words gains nothing by its small total; nor by the words it has,
as ``PRIOR`` unseen ones count with its own.  Languages whose sample has no word are left out.

Words are runs of letters (Unicode L), lower-cased.  The classifier is fitted on
a bounded sample of labelled rows: about ``sample_rows`` texts a language, and
``most_rows`` in all, at most; whole texts, chosen by a hash of the id, equal texts
once.  All of the sample's words and n-grams are in the model, which is broadcast;
the sample bounds its size.  Everything is predicted from the text alone.

Words and n-grams go by 64-bit hashes, and a batch of texts is one array of characters: hashing,
lookups and sums are array operations, and nothing is remembered from batch to batch.

Null texts and texts without a letter give ``und`` and 0.  Without any labelled
row all are ``und``.  A null id is never learned from and is not held out.
Repeated rows give repeated results; an empty table gives no rows; further
columns are ignored.  Labels of more than ``MAX_LANGS`` languages raise.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import U64, Keys, mix64, powers, table
from kinfold.shared import give_back, python_ready, tidy

UND = "und"
ORDERS = (5, 4, 3, 2, 1)
MAX_LANGS = 1000
#: Characters that are worked on at a time.
CHUNK = 300_000
#: Codes of a word's borders, beyond Unicode.
START, END = 0x110000, 0x110001
#: Words or n-grams added to a language's total.
PRIOR = 100
_NO_LETTER = re.compile(r"[\W\d_]")
_SALT = mix64(np.arange(201, 207, dtype=U64))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Lower-cased (number, text) in runs of about CHUNK characters; a longer text is cut where there is no letter."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t = t.lower()
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        at = 0
        while len(t) - at > CHUNK and (cut := _NO_LETTER.search(t, at + CHUNK)):
            yield [(i, t[at : cut.start()])]
            at = cut.start()
        held.append((i, t[at:] if at else t))
        size += len(t) - at
    if held:
        yield held


class Words(NamedTuple):
    """The words of a chunk: number of each one's text, place and size of its letters, hash; and the letters' mixed codes."""

    of: np.ndarray
    first: np.ndarray
    size: np.ndarray
    key: np.ndarray
    mixed: np.ndarray


def find_words(parts: list[tuple[int, str]]) -> Words:
    codes = np.frombuffer("\n".join([t for _, t in parts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for _, t in parts])
    of = np.array([i for i, _ in parts], np.int64)[np.searchsorted(ends, start, side="right")]
    mixed = mix64(codes[letter].astype(U64))
    first = np.cumsum(size) - size
    if not len(size):
        return Words(of, first, size, np.zeros(0, U64), mixed)
    place = np.arange(len(mixed)) - np.repeat(first, size)
    key = np.add.reduceat(mixed * powers(int(size.max()))[place], first)
    return Words(of, first, size, mix64(key + size.astype(U64) * _SALT[0]), mixed)


def find_grams(mixed: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word of each place between its borders, characters from there to its end, hashes of the k characters from there for k = 0..5)."""
    n = size + 2
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - begin[of]
    c = np.empty(len(of), U64)
    inner = (place > 0) & (place <= size[of])
    c[inner] = mixed[(first[of] + place - 1)[inner]]
    c[begin], c[begin + n - 1] = mix64(np.array([START, END], U64))
    total, hashes = np.zeros(len(c), U64), [np.zeros(0, U64)]
    for k in range(1, 6):
        total = total.copy()
        total[: max(0, len(c) - k + 1)] += c[k - 1 :] * powers(64)[k - 1]
        hashes.append(mix64(total + _SALT[k]))
    return of, n[of] - place, hashes


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


class Model(NamedTuple):
    """Sorted hashes of words and n-grams, each one's order (0: word), and its languages from ``starts`` on: their numbers and log frequencies above ``floors`` (by order)."""

    langs: list[str]
    keys: np.ndarray
    orders: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    above: np.ndarray
    floors: np.ndarray


def model_of(langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
    """The model from counts of (language, word or n-gram)."""
    totals = np.bincount(order * len(langs) + lang, weights=n, minlength=6 * len(langs)).reshape(6, len(langs))
    some = np.flatnonzero(totals[0])
    langs, totals = [langs[i] for i in some], totals[:, some]
    floors = np.log(0.5 / (totals.max(axis=1, initial=0) + PRIOR))
    lang = np.searchsorted(some, lang)
    at = np.lexsort((lang, key))
    lang, order, key, n = lang[at], order[at], key[at], n[at]
    keys, starts = np.unique(key, return_index=True)
    above = np.log(n / (totals[order, lang] + PRIOR)) - floors[order]
    return Model(langs, keys, order[starts].astype(np.uint8), np.append(starts, len(key)).astype(np.int32), lang.astype(np.int16), above.astype(np.float32), floors)


def _count(langs: list[str]):
    number = {c: i for i, c in enumerate(langs)}

    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, inverse = np.unique(key, return_inverse=True)
        return found, np.bincount(inverse, weights=n, minlength=len(found)).astype(np.int64)

    def run(batches):
        for b in batches:
            of = np.array([number[c] for c in b.column(0).to_pylist()], np.int64)
            out: list[tuple] = []
            for parts in chunks(b.column(1).to_pylist()):
                w = find_words(parts)
                lang = of[w.of]
                for c in np.unique(lang):
                    own = np.flatnonzero(lang == c)
                    keys, one, inverse = np.unique(w.key[own], return_index=True, return_inverse=True)
                    n = np.bincount(inverse)
                    out.append((c, 0, keys, n))
                    word, room, hashes = find_grams(w.mixed, w.first[own[one]], w.size[own[one]])
                    for k in ORDERS:
                        fits = room >= k
                        out.append((c, k, *summed(hashes[k][fits], n[word[fits]])))
            sizes = [len(o[2]) for o in out]
            column = lambda i, kind: pa.array(np.repeat([o[i] for o in out], sizes).astype(kind))
            key, n = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, U64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([column(0, np.int32), column(1, np.int32), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "o", "gram", "n"])

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 3000, most_rows: int = 40_000) -> Model:
    """Fit on a bounded sample of ``docs``, all of whose rows with an id and a language may be learned from."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("k is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    none = np.zeros(0, np.int64)
    if not langs:
        return model_of([], none, none, none.view(U64), none)
    sample_rows = min(sample_rows, most_rows // len(langs))
    share = F.create_map([x for c in langs for x in (F.lit(c), F.lit(min(1.0, sample_rows / counts[c])))])
    sample = docs.where((F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("langid")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) & F.col("text").isNotNull())
    sample = sample.withColumn("h", F.md5("text")).dropDuplicates(["lang", "h"]).select("lang", "text")
    got = sample.mapInArrow(tidy(_count(langs)), "lang int, o int, gram long, n long").groupBy("lang", "o", "gram").agg(F.sum("n").alias("n")).toArrow()
    column = lambda c: got.column(c).to_numpy().astype(np.int64)
    return model_of(langs, column("lang"), column("o"), column("gram").view(U64), column("n"))


class Scorer:
    """A worker's model."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = Keys(model.keys)

    def batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        m, size = self.model, len(texts)
        width = len(m.langs)
        words, floors, above = np.zeros(size), np.zeros(size * 6), np.zeros(size * width)
        if not width:
            return [UND] * size, words

        def add(of: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> None:
            nonlocal floors, above
            floors += np.bincount(of * 6 + m.orders[rows], weights=weight, minlength=len(floors))
            n = m.starts[rows + 1] - m.starts[rows]
            at = np.repeat(m.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            above += np.bincount(np.repeat(of, n) * width + m.columns[at], weights=m.above[at] * np.repeat(weight, n), minlength=len(above))

        for parts in chunks(texts):
            w = find_words(parts)
            words += np.bincount(w.of, minlength=size)
            rows = self.keys.find(w.key)
            known = rows >= 0
            add(w.of[known], rows[known], np.ones(known.sum()))
            rest = np.flatnonzero(~known)
            if not len(rest):
                continue
            word, room, hashes = find_grams(w.mixed, w.first[rest], w.size[rest])
            found = np.full(len(word), -1)
            for k in ORDERS:
                todo = np.flatnonzero((found < 0) & (room >= k))
                found[todo] = self.keys.find(hashes[k][todo])
            at = np.flatnonzero(found >= 0)
            # A character that no language has says nothing; the mean is over the others.
            pieces = np.bincount(word[at], minlength=len(rest))
            add(w.of[rest[word[at]]], found[at], 1 / pieces[word[at]])
        sums = (floors.reshape(size, 6) @ m.floors)[:, None] + above.reshape(size, width)
        mean = sums / np.maximum(words, 1)[:, None]
        best = mean.argmax(axis=1)
        top = mean[np.arange(size), best]
        score = np.where(words > 0, 1 / np.exp(mean - top[:, None]).sum(axis=1), 0)
        return [m.langs[i] if n else UND for i, n in zip(best.tolist(), words.tolist())], score


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score for each row."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        s = Scorer(shared.value)
        for b in batches:
            lang, score = s.batch(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    give_back()  # what fitting has left on the driver
    return docs.select(*keep, F.col(text).alias("the text")).mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
