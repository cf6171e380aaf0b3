"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document's set holds its distinct word n-grams as 64-bit hashes.  Two sets of
sizes a and b reach the threshold t = p/100 exactly if their symmetric
difference is at most (a + b)(100 - p)/(100 + p).

**Index.**  Sizes fall into bands that grow by 1.4; a pair's scheme is that of
the larger set's band, so a set is indexed under its own band and, where a larger
partner may lie in the next one, under that band too.  With H the largest
difference a scheme allows, the hash universe is cut into segments.  Either H + 1
+ e segments are compared whole, so that e + 1 of a linked pair's segments are
equal; then each set leaves out its lightest segments, as many as e allows (equal
segments are equally light, so both sides leave out the same).  Or (H + 1)/2
segments each come with all their one-deletion neighbours, as one of a linked
pair's segments then differs by one n-gram at most.  A cost for rows and for
light segments chooses the plan of each band.

**Candidates.**  Equal sets are one node.  Rows of a signature are streamed in
order; each member names the first member its centre.  All pairs that share a
signature are members of a common centre, so centres' groups, in blocks of about
the root of their size, are compared through parity sketches: a bit per bucket
of hashes, the parity of how many fall in it.  Differing bits never exceed the
symmetric difference, so a rejected pair is no link.  Of the pairs that pass, a
block reports only a spanning forest, never all pairs.

**Verification.**  Reported pairs are compared by their whole sets.  Where one
fails and its ends are still in different components, the groups that hold both of them are
compared again without it, from the components confirmed so far; such a round reports 16 times as
many pairs for two components as the one before, so rounds are few.  It ends when no failed pair
spans two components or a round had no more pairs to report, so every component is exactly that
of all links.

Null, empty and blank texts have no set, link with nothing and are their own
component.  Rows of one id are one node, whatever texts they have (then each row has its
own text's n_shingles); a null id has a null component.  An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import ASCII_LOWER, U64, as_bytes, mix64, table
from kinfold.operators.components import components
from kinfold.shared import bounded, drop_shared, filter_by_ids, python_ready, tidy, write_counted, write_shared

_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: Words a worker remembers the hash of.
CACHE = 100_000
#: Cost of indexing a segment of under three n-grams, in rows.
LIGHT = 12.0
#: Members of a group that one block holds at least.
BLOCK = 64
#: Words of sketches that are compared at a time.
CELLS = 1_000_000


class WordHash(dict):
    """The hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes | None, n: int, words: WordHash) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams of lower-cased words."""
    split = text.translate(ASCII_LOWER).split() if text else []
    if not split:
        return np.zeros(0, U64)
    w = np.array([words[x] for x in split], U64)
    k = min(n, len(w))
    h = w[: len(w) - k + 1] * _A + U64(k)
    for j in range(1, k):
        h = (h ^ (h >> U64(29))) * _B + w[j : len(w) - k + 1 + j]
    h = mix64(h)
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h


@lru_cache(maxsize=None)
def edge(k: int) -> int:
    """The smallest size of band k."""
    return 1 if k == 0 else max(edge(k - 1) + 1, math.ceil(edge(k - 1) * 1.4))


@lru_cache(maxsize=65536)
def band(size: int) -> int:
    k = 0
    while edge(k + 1) <= size:
        k += 1
    return k


def _poisson_below(mean: float, n: int) -> float:
    return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(n))


class Scheme:
    """How sets of a band and the one below are cut: ``segments``, ``slack`` (e), or one-deletion neighbours."""

    def __init__(self, k: int, percent: int):
        most = edge(k + 1) - 1
        self.differ = 2 * most * (100 - percent) // (100 + percent)
        self.salt = mix64(np.array([k + 1], U64))[0]
        self.deletions = False
        self.segments = self.slack = 0
        if self.differ < 1:
            return  # only equal sets link, and these are one node
        typical = (edge(k) + most) / 2
        h = self.differ + 1
        plans = []
        for slack in {max(2, round(h * x)) for x in (0.05, 0.1, 0.15, 0.2, 0.3)}:
            m = h + slack
            mean = typical / m
            light = max(0.0, m * _poisson_below(mean, 3) - slack)
            empty = max(0.0, m * _poisson_below(mean, 1) - slack / 3)
            plans.append((m - slack + LIGHT * light + 10 * LIGHT * empty, False, m, slack))
        pairs = -(-h // 2)
        plans.append((pairs + typical + 10 * LIGHT * pairs * _poisson_below(typical / pairs, 1), True, pairs, 0))
        _, self.deletions, self.segments, self.slack = min(plans)
        self.edges = np.array([(i << 64) // self.segments for i in range(1, self.segments)], U64)
        self.names = mix64(np.arange(1, self.segments + 1, dtype=U64) * _C ^ self.salt)

    def signatures(self, h: np.ndarray, mixed: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Hashes of the segments to index; ``sums``: running sums of ``mixed``, which starts with 0."""
        at = np.concatenate(([0], h.searchsorted(self.edges), [len(h)]))
        n = at[1:] - at[:-1]
        total = sums[at[1:]] - sums[at[:-1]]
        keys = mix64((total ^ self.names) + n.astype(U64) * _A)
        if not self.deletions:
            below = np.cumsum(np.bincount(n, minlength=1))
            light = int(np.searchsorted(below, self.slack, side="right"))  # segments of fewer n-grams than this are left out
            return keys[n >= light]
        of = np.repeat(np.arange(self.segments), n)
        fewer = mix64(((total[of] - mixed) ^ self.names[of]) + (n[of] - 1).astype(U64) * _A)
        return np.concatenate((keys, fewer))


@lru_cache(maxsize=256)
def scheme(k: int, percent: int) -> Scheme:
    return Scheme(k, percent)


def all_signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set under its own band's scheme, and the next one's if a partner may be there."""
    mixed = mix64(h ^ _C)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mixed, dtype=U64)))
    k, out = band(len(h)), []
    for j in (k, k + 1):
        if (j == k or 100 * len(h) >= percent * edge(j)) and scheme(j, percent).segments:
            out.append(scheme(j, percent).signatures(h, mixed, sums))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many hashes fall in each of 64 buckets or more; folding halves gives the shorter sketches."""
    bits = max(64, 1 << (6 * len(h) - 1).bit_length())
    at = (mix64(h ^ _B) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def set_key(h: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set of hashes."""
    return int(np.sum(mix64(h ^ _A), dtype=U64).view(np.int64)), int(np.sum(mix64(h + _B), dtype=U64).view(np.int64))


def _index(percent: int, n: int):
    words = WordHash()
    names = ["doc_id", "n", "f1", "f2", "sketch", "sigs"]

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, as_bytes(b.column(1))):
                h = shingles(t, n, words)
                out.append((i, len(h), *set_key(h), sketch(h) if len(h) else None, all_signatures(h, percent).view(np.int64) if len(h) and i is not None else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names)

    return run


def _centres(batches):
    """Rows (sig, doc) sorted by both: (doc, centre) for signatures of two nodes or more."""
    last, first, alone = None, 0, True
    for b in batches:
        sig, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(sig):
            continue
        start = np.concatenate(([last is None or sig[0] != last], sig[1:] != sig[:-1]))
        run = np.cumsum(start)
        firsts = np.concatenate(([first], doc[start]))
        centre = firsts[run]
        same = ~start & (doc != centre)
        if same.any():
            pairs = np.unique(np.stack((doc[same], centre[same]), 1), axis=0)
            own = np.unique(centre[same])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs[:, 0], own))), pa.array(np.concatenate((pairs[:, 1], own)))], ["doc", "centre"])
        last, first = sig[-1], centre[-1]


class Members:
    """Members of a group as arrays: ids, set sizes, components, sketches and the ids that each failed to link with."""

    def __init__(self, rows: pa.StructArray):
        column = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        self.block, self.doc, self.n, self.comp = column("block"), column("doc"), column("n"), column("comp")
        self.sketches, failed = rows.field("sketch"), rows.field("failed")
        self.length = np.diff(np.frombuffer(self.sketches.buffers()[1], np.int32, len(rows) + 1, 4 * self.sketches.offset))
        self.failed = failed if failed.null_count < len(failed) else None

    def folded(self, at: np.ndarray, bits: int) -> np.ndarray:
        """The sketches, all of one length, of the members at these places, folded to so many bits."""
        taken = self.sketches.take(pa.array(at))
        first = np.frombuffer(taken.buffers()[1], np.int32, 1, 4 * taken.offset)[0]
        out = np.frombuffer(taken.buffers()[2], np.uint8, len(at) * self.length[at[0]], first).view(U64).reshape(len(at), -1)
        while out.shape[1] > bits // 64:
            out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
        return out

    def close(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs' sketches differ in no more bits than the threshold allows; sketches of like lengths go together, so that long ones aren't folded for a short one."""
        out = np.zeros((len(a), len(b)), bool)
        for s in np.unique(self.length[a]):
            for t in np.unique(self.length[b]):
                if s > 4 * t or t > 4 * s:
                    continue
                i, j = np.flatnonzero(self.length[a] == s), np.flatnonzero(self.length[b] == t)
                out[np.ix_(i, j)] = self._close(a[i], b[j], int(min(s, t)) * 8, percent)
        if self.failed is not None:
            for k, x in enumerate(a.tolist()):
                if (bad := self.failed[x]).is_valid and len(bad):
                    out[k] &= ~np.isin(self.doc[b], bad.values.to_numpy())
        return out

    def _close(self, a: np.ndarray, b: np.ndarray, bits: int, percent: int) -> np.ndarray:
        x, y = self.folded(a, bits), self.folded(b, bits)
        na, nb = self.n[a], self.n[b]
        most = (na[:, None] + nb) * (100 - percent) // (100 + percent)
        out = np.zeros(most.shape, bool)
        step = max(1, CELLS // max(1, len(b) * x.shape[1]))
        for i in range(0, len(a), step):
            differ = np.bitwise_count(x[i : i + step, None, :] ^ y[None]).sum(axis=2, dtype=np.int64)
            out[i : i + step] = differ <= most[i : i + step]
        return out & (np.abs(na[:, None] - nb) <= most)


def spanning(linked: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of a spanning forest of the links.

    ``left`` and ``right`` number the nodes of rows and columns in ``labels``, which
    holds each node's component and is brought up to date.
    """
    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        js = np.flatnonzero(linked[i])
        groups = labels[right[js]]
        mine = labels[left[i]]
        others, first = np.unique(groups, return_index=True)
        for g, f in zip(others.tolist(), first.tolist()):
            if g != mine:
                out.append((int(i), int(js[f])))
                labels[labels == g] = mine
    return out


def crossing(linked: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Linked pairs (i, j) of different components, at most so many for two components, and whether there are more."""
    i, j = np.nonzero(linked & (left[:, None] != right))
    size = 1 + max(left.max(), right.max())
    key = np.minimum(left[i], right[j]) * size + np.maximum(left[i], right[j])
    order = np.argsort(key, kind="stable")
    rank = np.arange(len(key)) - np.searchsorted(key[order], key[order])
    return [(int(i[k]), int(j[k])) for k in order[rank < most]], bool((rank >= most).any())


def _blocks(percent: int, most: int):
    """Pairs of blocks of a group: of the pairs that the sketches let pass, a spanning forest, or up to ``most`` for two components."""

    def run(batches):
        for b in batches:
            left, right, cut = [], [], []
            groups = b.column(2)
            ends = np.cumsum(groups.value_lengths().to_numpy())
            rows = groups.flatten()
            # One group's members at a time; a batch's are never all Python objects.
            for lo, hi, end, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends.tolist(), groups.value_lengths().to_pylist()):
                m = Members(rows.slice(end - size, size))
                x = np.flatnonzero(m.block == lo)
                y = x if lo == hi else np.flatnonzero(m.block == hi)
                if not len(x) or not len(y):
                    continue
                comps, at = np.unique(m.comp, return_inverse=True)
                forest, more = np.arange(len(comps)), False
                if most > 1:
                    got, more = crossing(np.triu(m.close(x, x, percent), 1), at[x], at[x], most) if lo == hi else crossing(m.close(x, y, percent), at[x], at[y], most)
                elif lo == hi:
                    got = spanning(np.triu(m.close(x, x, percent), 1), forest, at[x], at[x])
                else:
                    spanning(np.triu(m.close(x, x, percent), 1), forest, at[x], at[x])
                    spanning(np.triu(m.close(y, y, percent), 1), forest, at[y], at[y])
                    got = spanning(m.close(x, y, percent), forest, at[x], at[y])
                left += [int(m.doc[x[i]]) for i, _ in got]
                right += [int(m.doc[y[j]]) for _, j in got]
                cut += [more] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(cut, pa.bool_())], ["a", "b", "cut"])

    return run


def _forests(members: DataFrame, percent: int, most: int) -> DataFrame:
    """members (centre, doc, n, sketch, block, blocks, comp, failed): pairs (a, b) to verify, and whether some were cut."""
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.groupBy("centre", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("block", "doc", "n", "sketch", "comp", "failed")).alias("members"))
    found = met.select("lo", "hi", "members").mapInArrow(tidy(_blocks(percent, most)), "a long, b long, cut boolean")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cut").alias("cut"))


def _verify(docs: DataFrame, pairs: DataFrame, odd: DataFrame | None, percent: int, n: int) -> tuple[DataFrame, list[str]]:
    """pairs (a, b, cut) with ``linked``: their whole sets compared; and the path of the sets.

    ``odd``: ids of several sets, whose nodes go by a hash of the set (see ``jaccard_components``).
    """
    words = WordHash()

    def sets(batches):
        for b in batches:
            out = [shingles(t, n, words) for t in as_bytes(b.column(1))]
            keys = [set_key(h) for h in out]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2)), pa.array(map(len, out), pa.int64()), pa.array([h.tobytes() for h in out], pa.binary())], ["doc", "f1", "f2", "n", "tokens"])

    def compare(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(3), b.column(4)):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.bool_())], ["a", "b", "cut", "linked"])

    schema = "doc long, f1 long, f2 long, n long, tokens binary"
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    plain = docs.select(F.col("doc_id").alias("doc"), "text")
    if odd is not None:
        ids = odd.select(F.col("doc_id").alias("doc"))
        ends, plain, several = ends.distinct(), plain.join(ids, "doc", "left_anti"), plain.join(ids, "doc", "left_semi")
    tokens = filter_by_ids(plain, ends, "doc").mapInArrow(tidy(sets), schema).select("doc", "tokens")
    if odd is not None:
        own = several.mapInArrow(tidy(sets), schema).select(_odd_node().alias("doc"), "tokens")
        tokens = tokens.unionByName(own.join(ends, "doc", "left_semi"))
    tokens, path = write_shared(tokens.dropDuplicates(["doc"]), "sets")
    rows = pairs.join(tokens.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    return rows.select("a", "b", "cut", "x", "y").mapInArrow(tidy(compare), "a long, b long, cut boolean, linked boolean"), [path]


def _odd_node():
    """The node of a set that only ids of several sets have."""
    return F.xxhash64("f1", "f2", "n")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the graph of components that these join is solved."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti")
    base = comp.unionByName(ends.select("node", F.col("node").alias("component")))
    a, b = (base.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    merged = components(links.join(a, "a").join(b, "b"), "ca", "cb")
    return base.join(merged.select(F.col("node").alias("component"), F.col("component").alias("smaller")), "component", "left").select("node", F.coalesce("smaller", "component").alias("component"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): components of all pairs whose Jaccard similarity is at least ``percent``/100."""
    if not 72 <= percent <= 100:
        raise ValueError("bands that grow by 1.4 hold partners for thresholds of 0.72 or more")
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index, index_path = write_shared(docs.mapInArrow(tidy(_index(percent, n)), "doc_id long, n long, f1 long, f2 long, sketch binary, sigs array<long>"), "index")
    usable = index.where("n > 0 and doc_id is not null")
    one_set = F.struct("f1", "f2", "n")
    odd, odd_path, several = write_counted(usable.groupBy("doc_id").agg(F.min(one_set).alias("lo"), F.max(one_set).alias("hi")).where("lo != hi").select("doc_id"), "several")
    odd = bounded(odd, several) if several else None
    # Equal sets are one node: the smallest id; a hash of the set where all of its ids have several sets.
    if odd is not None:
        usable = usable.join(odd.withColumn("odd", F.lit(True)), "doc_id", "left")
        least = F.min(F.when(F.col("odd").isNull(), F.col("doc_id")))
        nodes = usable.groupBy("f1", "f2", "n").agg(least.alias("plain"), F.count(F.lit(1)).alias("copies"))
        nodes = nodes.select("f1", "f2", "n", F.coalesce("plain", _odd_node()).alias("node"), "copies", F.col("plain").isNull().alias("hashed"))
    else:
        nodes = usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.lit(False).alias("hashed"))
    nodes, nodes_path = write_shared(nodes, "nodes")
    named, named_path, sets = write_counted(nodes.where("copies > 1 or hashed").select("f1", "f2", "n", "node", "hashed"), "named")
    first = usable.join(bounded(named, sets), ["f1", "f2", "n"], "left").withColumn("doc", F.coalesce("node", "doc_id"))
    # One row stands for the copies of a set.
    first = first.where("doc = doc_id or hashed").select("doc", "n", "sketch", "sigs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = first.select(F.explode("sigs").alias("sig"), "doc").repartition(parts, "sig").sortWithinPartitions("sig", "doc")
    stars, stars_path = write_shared(rows.mapInArrow(tidy(_centres), "doc long, centre long").distinct(), "stars")
    about = filter_by_ids(first.select("doc", "n", "sketch"), stars.select("doc"), "doc").dropDuplicates(["doc"])
    # Large groups are dealt into blocks before their members are gathered.
    large, large_path, groups = write_counted(stars.groupBy("centre").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 4 * BLOCK).select("centre", F.ceil(F.sqrt(F.col("size") / BLOCK)).cast("int").alias("blocks")), "large")
    members = stars.join(about, "doc").join(bounded(large, groups), "centre", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members, members_path = write_shared(members.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "members")
    paths, failed, comp, most = [stars_path, members_path, nodes_path, index_path, odd_path, named_path, large_path], None, None, 1
    same = None
    if odd is not None:  # an id's sets are one node
        own = usable.where("odd").select("doc_id", "f1", "f2", "n").join(nodes, ["f1", "f2", "n"])
        least = own.groupBy("doc_id").agg(F.min("node").alias("a"))
        same = own.join(least, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    while True:
        now = members
        if failed is None:
            now = now.withColumn("comp", F.col("doc")).withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            bad = failed.select("a", "b").unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("doc")).agg(F.collect_set("b").alias("failed"))
            # A pair that failed can have stood for others only in groups that hold both of its ends.
            ends = [now.select("centre", F.col("doc").alias(x)) for x in "ab"]
            again = apart.join(ends[0], "a").join(ends[1], ["centre", "b"], "left_semi")
            now = filter_by_ids(now, again.select("centre"), "centre").join(comp.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left").join(bad, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        pairs, pairs_path = write_shared(_forests(now, percent, most), "pairs")
        verified, own = _verify(docs, pairs, odd, percent, n)
        checked, checked_path = write_shared(verified, "checked")
        paths += [pairs_path, checked_path, *own]
        tally = checked.agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("failed"), F.max("cut").alias("cut")).first()
        links = checked.where("linked").select("a", "b")
        if comp is None:
            comp, _ = write_shared(components(links if same is None else links.unionByName(same)), "components")
        elif tally["linked"]:
            comp, _ = write_shared(_joined(comp, links), "components")
        if not tally["failed"] or (most > 1 and not tally["cut"]):
            break
        wrong = checked.where("not linked").select("a", "b")
        failed = wrong if failed is None else failed.unionByName(wrong)
        # Only pairs whose ends no other links join can have hidden links.
        a, b = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        apart = wrong.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        apart, apart_path, rest = write_counted(apart, "apart")
        paths.append(apart_path)
        if not rest:
            break
        most *= 16
    if odd is not None:  # a component's name is its smallest id, which may not be its smallest node
        ids = usable.select("doc_id", "f1", "f2", "n").join(nodes, ["f1", "f2", "n"]).join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "doc_id")
        least = ids.groupBy("c").agg(F.min("doc_id").alias("component"))
        comp, _ = write_shared(ids.select("node", "c").distinct().join(least, "c").select("node", "component"), "components")
    named = nodes.join(comp, "node", "left").select("f1", "f2", "n", F.coalesce("component", "node").alias("component_id"))
    linked = index.where("n > 0 and doc_id is not null").select("doc_id", "f1", "f2", "n").join(named, ["f1", "f2", "n"])
    rest = index.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "component_id").unionByName(rest)
    drop_shared(spark, *[p for p in paths if p not in (nodes_path, index_path)])
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but the smallest id of each component; rows without an id stay."""
    found = jaccard_components(docs, key, text, n, percent)
    return filter_by_ids(docs, found.where(F.col(key) != F.col("component_id")).select(key), key, "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
