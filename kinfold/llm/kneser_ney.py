"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

**Symbols.**  A text is a start symbol, its words and an end symbol.  Words are runs of anything but
ASCII blanks; each is a sign, which stands for the blanks before it and says whether the word repeats the
one before, and its characters.  All but the start are predicted from up to ``order`` - 1 symbols before them, across words: the
order of words counts as far as their ends and beginnings, or short words, tell.

**Training.**  N-grams of all orders of all trusted texts are counted, combined before the shuffle,
in which they are short strings.  Counts live in tables sharded by n-gram hash:
continuation counts, discounts (from counts of counts of each order) and
context totals are grouped counts, and each order's probabilities come
from a join with the next lower one's.  What is gathered grows with the trusted text.

**Scoring.**  The model's rows (hash, log probability, log back-off weight) are dealt into
as many shards as keep each at about ``max_rows`` at most; a shard is one broadcast and one
pass over the texts.  Probabilities of n-grams and back-off weights of contexts are rows of their own: an n-gram goes by the symbols
before its last, a context by its own, as the positions do that they serve.  The last of these
symbols gives the group, the last two the shard in the group.  A position is resolved by its shard: rows that
need one symbol are in all shards of its group, and only those that need none (single symbols,
at most as many as Unicode has) in every shard.  Groups are as many as the rows of two symbols
need, so no number of rows is too many. Sums over shards give perplexities.

**Decision.**  Trusted texts are split by crc32 of the id: four fifths train, the rest
give each language's perplexity quantile.  A text is kept up to that
threshold times ``slack``; a null or unseen language uses that of all texts.

Texts without a word (null, empty, blank) have no perplexity and are not kept.  Without trusted
text every text with a word is kept.  Repeated labels count once; labels without a
quality say nothing.  Repeated rows give repeated results; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import U64, mix64, powers, table
from kinfold.shared import drop_shared, filter_by_ids, give_back, python_ready, tidy, write_shared

ORDER = 5
#: Symbols of no text: code points that Unicode keeps free of characters.  The last stands for the null character.
START, END, NEW, AGAIN, NULL = (chr(0xFDD0 + i) for i in range(5))
#: Rows of a broadcast shard: 16 bytes each.
MAX_ROWS = 4_000_000
#: Characters of texts that are worked on at a time (a longer text by itself), and n-grams that a task holds before it gives counts out.
CHUNK, HELD = 200_000, 800_000
_POWERS = mix64(np.arange(1, 33, dtype=U64))
_LABEL = mix64(np.arange(101, 134, dtype=U64))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's text, its place in the text, its code point); texts without a word have none."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = (codes > 32) | (codes < 9) | ((codes > 13) & (codes < 32))
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    said = codes[solid]
    said = np.where(said == 0, np.uint32(ord(NULL)), said)
    first = np.cumsum(size) - size
    key = np.add.reduceat(mix64(said.astype(U64)) * powers(int(size.max()))[np.arange(len(said)) - np.repeat(first, size)], first)
    again = np.zeros(len(size), bool)
    again[1:] = (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (of[1:] == of[:-1])
    text, word, words = np.unique(of, return_index=True, return_counts=True)
    sign = first + np.arange(len(size)) + 2 * np.repeat(np.arange(len(text)), words) + 1
    out = np.empty(len(said) + len(size) + 2 * len(text), np.uint32)
    out[np.repeat(sign + 1 - first, size) + np.arange(len(said))] = said
    out[sign] = np.where(again, ord(AGAIN), ord(NEW))
    begin = sign[word] - 1
    n = np.append(begin[1:], len(out)) - begin
    out[begin], out[begin + n - 1] = ord(START), ord(END)
    return np.repeat(text, n), np.arange(len(out)) - np.repeat(begin, n), out


def window_sums(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Sums that tell the k symbols that end at each place, for k = 0..order; windows that reach over a text's start are meaningless."""
    c = mix64(codes.astype(U64) + U64(1))
    total, sums = np.zeros(len(c), U64), [np.zeros(len(c), U64)]
    for k in range(1, order + 1):
        total = total.copy()
        total[k - 1 :] += c[: max(0, len(c) - k + 1)] * _POWERS[k - 1]
        sums.append(total)
    return sums


def slices(codes: np.ndarray, order: int):
    """(place of a slice of about CHUNK symbols, sums of its windows, places of the sums that are its own)."""
    for s in range(0, len(codes), CHUNK):
        low = max(0, s - order)
        yield low, window_sums(codes[low : s + CHUNK], order), slice(s - low, None)


def window_hash(k: int, sums: np.ndarray) -> np.ndarray:
    """Hashes of windows of k symbols from their sums."""
    return mix64(sums ^ _LABEL[k]) if k else np.full(len(sums), _LABEL[0])


def chunks(texts: list[str | None]):
    """(number, text) in runs of about CHUNK characters; a longer text is a run by itself."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if t and held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        if t:
            held.append((i, t))
            size += len(t)
    if held:
        yield held


def shard_keys(one: np.ndarray, two: np.ndarray, known: np.ndarray | int) -> np.ndarray:
    """Keys of positions from hashes of the symbol before and the two before: 32 bits of each, as far as symbols are known."""
    key = np.where(known >= 1, one >> U64(32), U64(0))
    return key << U64(32) | np.where(known >= 2, two >> U64(32), U64(0))


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points, 0 for none) and their summed counts."""
    key = np.zeros(len(rows), U64)
    for i in range(rows.shape[1]):
        key = mix64(key + rows[:, i].astype(U64)) + U64(i)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return rows[order[new]], np.add.reduceat(n[order], np.flatnonzero(new))


def _count_grams(order: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows():
            grams, n = held.pop()
            said = np.ascontiguousarray(grams).view(f"<U{order}").ravel()
            for i in range(0, len(said), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(said[i : i + 100_000].tolist(), pa.string()), pa.array(n[i : i + 100_000])], ["gram", "n"])

        for b in batches:
            for part in chunks(b.column(0).to_pylist()):
                _, place, codes = symbols([t for _, t in part])
                for low, sums, own in slices(codes, order):
                    far = place[low : low + len(sums[0])].copy()
                    far[: own.start] = 0
                    for k in range(1, order + 1):
                        at = np.flatnonzero(far >= max(1, k - 1))
                        if not len(at):
                            continue
                        key = sums[k][at]
                        by = np.argsort(key)
                        key = key[by]
                        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                        last = at[by[new]] + low
                        grams = np.zeros((len(last), order), np.uint32)
                        for i in range(k):
                            grams[:, i] = codes[last - (k - 1 - i)]
                        held.append((grams, np.diff(np.append(new, len(key)))))
                        size += len(last)
                if size > HELD:
                    held[:] = [_summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows()
                        size = 0
        if held:
            held[:] = [_summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
            yield from rows()

    return run


def _describe(order: int):
    """Counted n-grams (gram, n) by hashes: of themselves, of all but the last and all but the first of their symbols, and of their positions."""

    def run(batches):
        for b in batches:
            said = b.column(0).to_pylist()
            k = np.array([len(g) for g in said], np.int64)
            if not len(k):
                continue
            codes = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32)
            last = np.cumsum(k) - 1
            sums = window_sums(codes, order)
            gram, context, suffix = (np.empty(len(k), U64) for _ in range(3))
            for j in range(1, order + 1):
                own = np.flatnonzero(k == j)
                at = last[own]
                gram[own], context[own], suffix[own] = window_hash(j, sums[j][at]), window_hash(j - 1, sums[j - 1][at - 1]), window_hash(j - 1, sums[j - 1][at])
            key = shard_keys(window_hash(1, sums[1][last - 1]), window_hash(2, sums[2][last - 1]), k - 1)
            start = codes[last - k + 1] == ord(START)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context, suffix, key)), pa.array(start), b.column(1)], ["k", "gram", "context", "suffix", "shard_key", "start", "n"])

    return run


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """The model's rows (k, gram, shard_key, logp, backoff) from a column of trusted texts.

    A row has the probability of an n-gram of k symbols or the back-off weight of a
    context before the last of k symbols; the other is null.  k = 0: the unknown symbol.
    """
    spark = texts.sparkSession
    python_ready(spark)
    counted = texts.select(text).mapInArrow(tidy(_count_grams(order)), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = counted.mapInArrow(tidy(_describe(order)), "k int, gram long, context long, suffix long, shard_key long, start boolean, n long")
    grams, grams_path = write_shared(grams, "grams")
    # Adjusted counts: as counted for the highest order and at a text's start, else the number of distinct extensions to the left.
    left = grams.where("k > 1").groupBy(F.col("suffix").alias("gram")).agg(F.count("*").alias("extensions"))
    a = grams.join(left, "gram", "left").withColumn("a", F.when((F.col("k") == order) | F.col("start"), F.col("n")).otherwise(F.col("extensions")))
    a, a_path = write_shared(a.drop("extensions", "n"), "adjusted")
    tallies = {r["k"]: r for r in a.groupBy("k").agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("types")).collect()}

    def discounts(k: int) -> list[float]:
        n1, n2, n3, n4 = (tallies[k][f"n{i}"] for i in range(1, 5)) if k in tallies else (0,) * 4
        if not (n1 and n2 and n3 and n4):
            return [0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        return [min(max(d, 0.01), i) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]

    d = {k: discounts(k) for k in range(1, order + 1)}
    pick = lambda i: F.element_at(F.create_map([F.lit(x) for k in d for x in (k, d[k][i])]), F.col("k"))
    discount = F.when(F.col("a") == 1, pick(0)).when(F.col("a") == 2, pick(1)).otherwise(pick(2))
    contexts = a.groupBy("context").agg(F.first("k").alias("k"), F.first("shard_key").alias("shard_key"), F.sum("a").alias("total"), F.sum(discount).alias("mass"))
    contexts, contexts_path = write_shared(contexts.withColumn("backoff", F.col("mass") / F.col("total")).drop("mass"), "contexts")
    direct = a.join(contexts.select("context", "total", "backoff"), "context").select("k", "gram", "context", "suffix", "shard_key", ((F.col("a") - discount) / F.col("total")).alias("own"), "backoff")
    direct, direct_path = write_shared(direct, "direct")
    uniform = 1.0 / (1 + (tallies[1]["types"] if 1 in tallies else 0))
    level = direct.where("k = 1").select("k", "gram", "shard_key", (F.col("own") + F.col("backoff") * uniform).alias("p"))
    levels, level_paths = [], []
    for k in range(1, order + 1):
        if k > 1:
            lower = levels[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            level = direct.where(F.col("k") == k).join(lower, "suffix").select("k", "gram", "shard_key", (F.col("own") + F.col("backoff") * F.col("lower")).alias("p"))
        level, path = write_shared(level, f"order{k}")
        levels.append(level)
        level_paths.append(path)
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    rows = rows.select("k", "gram", "shard_key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"))
    rows = rows.unionByName(contexts.select("k", F.col("context").alias("gram"), "shard_key", F.lit(None).cast("double").alias("logp"), F.log("backoff").alias("backoff")))
    unknown = spark.createDataFrame([(0, int(_LABEL[32].view(np.int64)), 0, math.log(uniform), 0.0)], rows.schema)
    model, _ = write_shared(rows.unionByName(unknown), "model")
    drop_shared(spark, grams_path, a_path, contexts_path, direct_path, *level_paths)
    return model


class Shard(NamedTuple):
    """One of the ``parts`` of one of the ``groups``."""

    group: int
    groups: int
    part: int
    parts: int

    def rows(self, model: DataFrame) -> DataFrame:
        """The shard's rows of a model."""
        group = F.shiftrightunsigned("shard_key", 32) % self.groups == self.group
        part = F.col("shard_key").bitwiseAND(0xFFFFFFFF) % self.parts == self.part
        return model.where((F.col("k") == 1) | ((F.col("k") == 2) & group) | ((F.col("k") > 2) & group & part))


WHOLE = Shard(0, 1, 0, 1)


def deal(model: DataFrame, max_rows: int) -> list[Shard]:
    """Shards of about ``max_rows`` rows of the model at most."""
    model = model.where("k > 0")
    if model.select("gram").distinct().count() <= max_rows:
        return [WHOLE]
    symbol = F.shiftrightunsigned("shard_key", 32)
    single = model.where("k = 1").count()
    most = model.where("k = 2").groupBy(symbol.alias("s")).count().agg(F.max("count").alias("m")).first()["m"] or 0
    groups = 1
    while True:
        sizes = model.where("k > 1").groupBy((symbol % groups).alias("g")).agg(F.count_if(F.col("k") == 2).alias("pairs"), F.count_if(F.col("k") > 2).alias("longer")).collect()
        # Rows of one symbol stay together; there are no more of them than of single symbols.
        if max((r["pairs"] for r in sizes), default=0) <= max((max_rows - single) // 2, 2 * most):
            break
        groups *= 2
    found = {r["g"]: r for r in sizes}
    shards = []
    for g in range(groups):  # positions after unknown symbols may need a group without rows
        pairs, longer = (found[g]["pairs"], found[g]["longer"]) if g in found else (0, 0)
        parts = max(1, math.ceil(1.25 * longer / max(max_rows - single - pairs, max_rows // 8, 1)))  # parts are uneven
        shards += [Shard(g, groups, p, parts) for p in range(parts)]
    return shards


class Lookup:
    """An open-addressed table of a shard's rows."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = U64(size - 1)
        self.keys, self.at = np.zeros(size, U64), np.full(size, len(keys), np.int32)
        slot, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            s = slot[todo].astype(np.int64)
            free = self.at[s] == len(keys)
            _, first = np.unique(s[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[s[put]], self.at[s[put]] = keys[todo[put]], todo[put]
            todo = np.delete(todo, put)
            slot[todo] = (slot[todo] + U64(1)) & self.mask
        self.none = len(keys)
        self.logp = np.append(logp, np.float32("nan")).astype(np.float32)
        self.backoff = np.append(backoff, 0).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys; ``none`` where absent."""
        slot = (keys & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.at[slot], self.none)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.at[slot] != self.none))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            s = slot[left]
            hit = self.keys[s] == keys[left]
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.at[s] != self.none)]
        return out


class Scorer:
    """Log probabilities of texts under one shard."""

    def __init__(self, keys, logp, backoff, unknown: float, order: int, shard: Shard):
        self.table = Lookup(keys, logp, backoff)
        self.unknown, self.order, self.shard = unknown, order, shard
        #: The back-off weight of the empty context.
        self.empty = float(self.table.backoff[self.table.find(np.array([_LABEL[0]]))[0]])

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Predicted symbols, and their log probability over the positions that this shard resolves, of each text."""
        n, out = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for part in chunks(texts):
            of, place, codes = symbols([t for _, t in part])
            if len(of):
                numbers = np.array([i for i, _ in part])
                own = np.bincount(of, minlength=len(part))
                n[numbers] += np.maximum(own - 1, 0)
                out[numbers] += np.bincount(of, weights=self.positions(place, codes), minlength=len(part))
        return n, out

    def positions(self, place: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The log probability of each symbol after a start; 0 for starts and what other shards resolve."""
        return np.concatenate([self.windows(place[low : low + len(sums[0])], sums, own.start)[own] for low, sums, own in slices(codes, self.order)])

    def windows(self, place: np.ndarray, sums: list[np.ndarray], first: int) -> np.ndarray:
        """``positions`` of one slice from its ``first`` place on."""
        todo = np.flatnonzero(place >= 1)
        todo = todo[todo >= first]
        if self.shard != WHOLE:
            key = shard_keys(window_hash(1, sums[1][todo - 1]), window_hash(2, sums[2][todo - 1]), place[todo])
            group, groups, part, parts = (U64(x) for x in self.shard)
            todo = todo[((key >> U64(32)) % groups == group) & ((key & U64(0xFFFFFFFF)) % parts == part)]
        out, weight = np.zeros(len(place)), np.zeros(len(place))
        for k in range(self.order, 0, -1):
            usable = place[todo] >= k - 1
            at = todo[usable]
            logp = self.table.logp[self.table.find(window_hash(k, sums[k][at]))]
            hit = ~np.isnan(logp)
            out[at[hit]] = logp[hit] + weight[at[hit]]
            at = at[~hit]
            if k > 1:  # the weight of the context of k - 1 symbols that ends one place before
                weight[at] += self.table.backoff[self.table.find(window_hash(k - 1, sums[k - 1][at - 1]))]
            todo = np.concatenate((todo[~usable], at))
        out[todo] = self.unknown + weight[todo] + self.empty
        return out


def _score(docs: DataFrame, model, unknown: float, order: int, shard: Shard) -> DataFrame:
    held: list[Scorer] = []

    def run(batches):
        scorer = held[0] if held else Scorer(*model.value, unknown, order, shard)
        held[:] = [scorer]
        for b in batches:
            n, logp = scorer.batch(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(logp)], ["doc_id", "lang", "h", "n_symbols", "log_prob"])

    return docs.mapInArrow(tidy(run), "doc_id long, lang string, h long, n_symbols long, log_prob double")


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs (doc_id, lang, text): (doc_id, lang, h, n_symbols, perplexity), one pass a shard; h: the hash of id and text."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), "text")
    unknown = model.where("k = 0").first()["logp"]
    shards = deal(model, max_rows)
    parts = []
    for shard in shards:
        own = shard.rows(model.where(F.col("k") > 0))
        # What is both an n-gram and a context has one row in a shard.
        own = own.groupBy("gram").agg(F.max("logp").cast("float").alias("logp"), F.coalesce(F.max("backoff"), F.lit(0.0)).cast("float").alias("backoff"))
        got = own.toArrow()
        value = (got.column(0).to_numpy().view(U64), got.column(1).to_numpy(zero_copy_only=False).astype(np.float32), got.column(2).to_numpy(zero_copy_only=False))
        shared = spark.sparkContext.broadcast(value)
        del got, value
        give_back()
        parts.append(_score(docs, shared, unknown, order, shard))
    if len(shards) == 1:
        scored = parts[0]
    else:
        sums = None
        for p in parts:
            one = p.groupBy("h").agg(F.max("n_symbols").alias("n_symbols"), F.max("log_prob").alias("log_prob"))
            sums = one if sums is None else sums.unionByName(one)
        sums = sums.groupBy("h").agg(F.max("n_symbols").alias("n_symbols"), F.sum("log_prob").alias("log_prob"))
        scored = docs.select("doc_id", "lang", "h").join(sums, "h")
    return scored.select("doc_id", "lang", "h", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(-F.col("log_prob") / F.col("n_symbols"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 1.25, order: int = ORDER, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs (doc_id, lang, text), trusted (doc_id): (doc_id, lang, h, n_symbols, perplexity, threshold, keep) for each row of docs."""
    spark = docs.sparkSession
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(filter_by_ids(docs.select("doc_id", "text"), trusted.where(~held), "doc_id"), order=order)
    scores, _ = write_shared(perplexities(docs, model, order, max_rows), "scores")
    known = scores.join(trusted.where(held), "doc_id", "left_semi").where("perplexity is not null")
    each = known.where("lang is not null").groupBy(F.col("lang").alias("l")).agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("own"))
    overall = known.agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("t")).first()["t"]
    out = scores.join(each, F.col("lang") == F.col("l"), "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))
    return out.select("doc_id", "lang", "h", "n_symbols", "perplexity", "threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that ``classify`` keeps."""
    gone = classify(docs, trusted).where(~F.col("keep")).select(F.col("h").alias("row hash"))
    hashed = docs.withColumn("row hash", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return filter_by_ids(hashed, gone, "row hash", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels"))).drop("h")
