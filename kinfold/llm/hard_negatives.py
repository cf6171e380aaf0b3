"""Hard negatives by partial products in a rotated space.

Each component becomes floor(256 x), so scores are integer inner products.  An anchor's positives are
its best ``positives`` other rows of its label; each positive's negatives are the best ``negatives`` rows of
other labels whose score is from ``low`` to ``high`` hundredths of the positive's.  Higher scores come first, ties by smaller id.

**Rotation.**  The principal axes of a sample (``SAMPLE_ROWS`` rows a length of vector at most, by a hash of the
id) are an orthogonal rotation, which leaves inner products as they are.  Most of the mass lies
in the leading components: after each of ``STEPS`` a score is at most the partial product plus the product of the
two residual norms.  A pair whose bound, with a slack for the rounding of the rotated doubles, is under what its
anchor still needs is discarded at once; those left after the last step are verified by integer products,
in doubles while these are exact (under 2**53), in 64-bit integers beyond.

**Plan.**  Anchors and rows meet in a grid of blocks: anchors in blocks of ``ANCHOR_BYTES`` at most, rows in blocks
of ``ROW_BLOCK`` at most and small enough for all cores.  A task keeps one block of anchors with
their best so far and streams the rows against it, so what an anchor needs grows along the
stream.  Each block gives at most ``positives`` rows an anchor, or ``negatives`` a positive, which windows merge.
The grid runs twice, once for each kind.

Rows without an id, label or vector and those with a null or non-finite component take no part.  A vec_id
names one row: of rows with the same id the one with the least (label, vector) takes part.  Vectors of different lengths never
meet; empty vectors score 0 with each other.  Scores must fit 64 bits: a component of 2**31 or more
after scaling raises, as do two vectors whose product can leave 64 bits.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import table
from kinfold.shared import drop_shared, python_ready, tidy, write_counted, write_shared

SCALE = 256
#: Rows of a length of vector that the rotation is fitted on; lengths of vectors.
SAMPLE_ROWS, MOST_LENGTHS = 20_000, 256
ANCHOR_BYTES, ROW_BLOCK, LEAST_ROWS = 64 << 20, 200_000, 2000
#: Parts of the components after which pairs are discarded.
STEPS = (0.25, 0.5, 1.0)
#: Part of a block's pairs under which the rest are worked on one by one.
SPARSE = 0.02
#: Scores at a time.
CELLS = 2_000_000
#: Rounding of rotated products, as a part of the product of the norms.
SLACK = 1e-9


def _whole(batches):
    """(vec_id, label, v): scaled components as int16 or int32, rows that take no part left out."""
    for b in batches:
        ids, labels, packed = [], [], []
        for i, v, label in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i is None or label is None or v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.floor(SCALE * x)
            if len(x) and np.abs(x).max() >= 2**31:
                raise ValueError("components of 2**31 or more after scaling")
            ids.append(i), labels.append(label)
            packed.append((b"\x02" + x.astype("<i2").tobytes()) if not len(x) or np.abs(x).max() < 2**15 else b"\x04" + x.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])


def _length(v: str) -> Column:
    return ((F.octet_length(v) - 1) / F.when(F.substring(v, 1, 1) == F.lit(b"\x02"), 2).otherwise(4)).cast("int")


def _stack(raw: list[bytes], dim: int) -> np.ndarray:
    if all(r[0] == 2 for r in raw):
        return np.frombuffer(b"".join([r[1:] for r in raw]), "<i2").reshape(len(raw), dim).astype(np.float64)
    return np.array([np.frombuffer(r[1:], "<i2" if r[0] == 2 else "<i4") for r in raw], np.float64).reshape(len(raw), dim)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal columns, principal axes first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows of whole numbers."""
    dim = max(1, a.shape[1])
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most >= 2**63:
        raise ValueError("scores beyond 64 bits")
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


class Side:
    """Vectors, whole and rotated, with the norms of what is left after each step."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray):
        self.whole = whole
        self.rotated = whole @ axes
        self.cuts = sorted({max(1, round(s * whole.shape[1])) for s in STEPS}) if whole.shape[1] else []
        self.rest = [np.sqrt((self.rotated[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        self.norm = np.sqrt((whole**2).sum(axis=1))


def survivors(a: Side, b: Side, needed: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) among the ``allowed`` whose score can reach what the row of a needs.

    Products are added up for whole blocks while many pairs are left, and pair by pair once few are.
    """
    slack = SLACK * a.norm.max(initial=0) * b.norm.max(initial=0) + 1e-6
    floor = (needed - slack)[:, None]
    product = np.zeros(allowed.shape)
    left, i, j, part, before = allowed, None, None, None, 0
    for cut, ra, rb in zip(a.cuts, a.rest, b.rest):
        if i is None:
            product += a.rotated[:, before:cut] @ b.rotated[:, before:cut].T
            left = left & (product >= floor - ra[:, None] * rb)
            if np.count_nonzero(left) < SPARSE * left.size:
                i, j = np.nonzero(left)
                part = product[i, j]
        else:
            part = part + np.einsum("ij,ij->i", a.rotated[i, before:cut], b.rotated[j, before:cut])
            stays = part >= floor[i, 0] - ra[i] * rb[j]
            i, j, part = i[stays], j[stays], part[stays]
        before = cut
    if a.cuts:
        return (i, j) if i is not None else np.nonzero(left)
    return np.nonzero(allowed & (0 >= floor))


class Best:
    """The best ``k`` (score, id) of each of n places, in order; ``ids`` -1 where none."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), -1, np.int64)
        self.count = np.zeros(n, np.int64)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        touched = np.unique(place)
        held = np.arange(self.k) < self.count[touched][:, None]
        p = np.concatenate((np.repeat(touched, held.sum(axis=1)), place))
        s, x = np.concatenate((self.score[touched][held], score)), np.concatenate((self.ids[touched][held], ids))
        order = np.lexsort((x, -s, p))
        p, s, x = p[order], s[order], x[order]
        start = np.flatnonzero(np.diff(p, prepend=-1))
        rank = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
        keep = rank < self.k
        p, s, x, rank = p[keep], s[keep], x[keep], rank[keep]
        self.score[p, rank], self.ids[p, rank] = s, x
        self.count[touched] = np.bincount(p, minlength=len(self.count))[touched]

    def worst(self) -> np.ndarray:
        """What the next one must reach: the last score where all places are taken, else -inf."""
        return np.where(self.count == self.k, self.score[:, -1].astype(np.float64), -np.inf)


class Anchors:
    """One block of anchors of one length, and the best rows that it has met."""

    def __init__(self, rows: dict, axes: np.ndarray, bands: bool, k: int, low: int, high: int):
        self.ids, self.labels = np.array(rows["vec_id"], np.int64), np.array(rows["label"], np.int64)
        self.side = Side(_stack(rows["v"], len(axes)), axes)
        self.bands, self.low, self.high = bands, low, high
        if bands:
            self.width = max(len(p) for p in rows["positives"])
            self.top = np.zeros((len(self.ids), self.width), np.int64)
            self.real = np.zeros((len(self.ids), self.width), bool)
            for i, p in enumerate(rows["positives"]):
                self.top[i, : len(p)], self.real[i, : len(p)] = p, True
            self.best = Best(len(self.ids) * self.width, k)
        else:
            self.best = Best(len(self.ids), k)

    def needed(self) -> np.ndarray:
        worst = self.best.worst()
        if not self.bands:
            return worst
        floor = np.where(self.real, self.low * self.top / 100.0, np.inf)
        return np.maximum(worst.reshape(floor.shape), floor).min(axis=1)

    def meet(self, ids: np.ndarray, labels: np.ndarray, side: Side) -> None:
        same = self.labels[:, None] == labels
        allowed = ~same if self.bands else same & (self.ids[:, None] != ids)
        i, j = survivors(self.side, side, self.needed(), allowed)
        for at in range(0, len(i), CELLS // max(1, side.whole.shape[1])):
            p, q = i[at : at + CELLS // max(1, side.whole.shape[1])], j[at : at + CELLS // max(1, side.whole.shape[1])]
            score = products(self.side.whole[p], side.whole[q])
            if not self.bands:
                self.best.add(p, score, ids[q])
                continue
            top = self.top[p]
            fits = self.real[p] & (self.low * top <= 100 * score[:, None]) & (100 * score[:, None] <= self.high * top)
            pair, band = np.nonzero(fits)
            self.best.add(p[pair] * self.width + band, score[pair], ids[q[pair]])

    def found(self):
        """(anchor, number of the positive or 0, score, id) columns."""
        place, k = np.nonzero(np.arange(self.best.k) < self.best.count[:, None])
        anchor, band = (place // self.width, place % self.width) if self.bands else (place, np.zeros(len(place), np.int64))
        return self.ids[anchor], band, self.best.score[place, k], self.best.ids[place, k]


def _meet(model, bands: bool, k: int, low: int, high: int):
    """Stream (i, j, role, vec_id, label, v, positives) sorted by block pair, anchors (role 0) first."""

    def run(batches):
        block, held, anchors = None, {}, {}

        def results():
            got = [a.found() for a in anchors.values()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if got else np.zeros(0, np.int64), pa.int64()) for c in (zip(*got) if got else [()] * 4)], ["anchor_id", "band", "score", "vec_id"])

        def start():
            for dim, rows in held.items():
                anchors[dim] = Anchors(rows, model.value[dim], bands, k, low, high)
            held.clear()

        for b in batches:
            blocks = list(zip(b.column("i").to_pylist(), b.column("j").to_pylist()))
            roles, raw = b.column("role").to_numpy(), b.column("v").to_pylist()
            ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            edges = [0, *(x for x in range(1, len(blocks)) if blocks[x] != blocks[x - 1]), len(blocks)]
            for at, end in zip(edges, edges[1:]):
                if blocks[at] != block:
                    start()
                    yield results()
                    anchors.clear()
                    block = blocks[at]
                middle = at + int((roles[at:end] == 0).sum())
                for x in range(at, middle):
                    dim = (len(raw[x]) - 1) // raw[x][0]
                    rows = held.setdefault(dim, {"vec_id": [], "label": [], "v": [], "positives": []})
                    rows["vec_id"].append(ids[x]), rows["label"].append(labels[x]), rows["v"].append(raw[x])
                    if bands:
                        rows["positives"].append(b.column("positives")[x].as_py())
                if middle == end:
                    continue
                start()
                dims = np.array([(len(r) - 1) // r[0] for r in raw[middle:end]])
                for dim in np.unique(dims):
                    a = anchors.get(int(dim))
                    if a is None:
                        continue
                    mine = middle + np.flatnonzero(dims == dim)
                    for cut in np.array_split(mine, max(1, math.ceil(len(mine) * len(a.ids) / CELLS))):
                        a.meet(ids[cut], labels[cut], Side(_stack([raw[x] for x in cut], int(dim)), model.value[int(dim)]))
        start()
        yield results()

    return run


def _fit(rows: DataFrame) -> dict[int, np.ndarray]:
    """The rotation for each length of vector, from one bounded sample."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().limit(MOST_LENGTHS + 1).collect()}
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if not sizes:
        return {}
    # Long vectors are sampled less, so that all samples stay within ANCHOR_BYTES.
    share = {d: min(1.0, min(SAMPLE_ROWS, max(100, ANCHOR_BYTES // (4 * max(1, d) * len(sizes)))) / n) for d, n in sizes.items()}
    shares = F.create_map([x for d in share for x in (F.lit(d), F.lit(share[d]))])
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < shares[F.col("dim")] * 1_000_000).select("dim", "vec_id", "v").toArrow().sort_by([("dim", "ascending"), ("vec_id", "ascending")])
    samples: dict[int, list[bytes]] = {}
    for dim, v in zip(picked.column("dim").to_pylist(), picked.column("v").to_pylist()):
        samples.setdefault(dim, []).append(v)
    return {d: rotation(_stack(samples[d], d)) if d in samples and d else np.eye(d) for d in sizes}


def _grid(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], model, bands: bool, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, band, score, vec_id): the best of each block pair."""
    i, j = blocks
    few = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias("j"), F.pmod(F.xxhash64("vec_id"), F.lit(i)).cast("int").alias("i"), F.lit(0).alias("role"), "vec_id", "label", "v", *(["positives"] if bands else []))
    many = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(j)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("i"), F.lit(1).alias("role"), "vec_id", "label", "v", *([F.lit(None).cast("array<long>").alias("positives")] if bands else []))
    met = few.unionByName(many).repartition("i", "j").sortWithinPartitions("i", "j", "role")
    return met.mapInArrow(tidy(_meet(model, bands, k, low, high)), "anchor_id long, band long, score long, vec_id long")


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's text.

    ``is_anchor`` and ``label`` are columns of ``df``.
    """
    spark = df.sparkSession
    python_ready(spark)
    label = F.col(label) if isinstance(label, str) else label
    whole = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), label.cast("long").alias("label")).mapInArrow(tidy(_whole), "vec_id long, label long, v binary")
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    rows, rows_path, n = write_counted(one.withColumn("dim", _length("v")), "rows")
    ids = df.where(is_anchor).select(F.col(key).cast("long").alias("vec_id")).distinct()
    anchors, anchors_path, asked = write_counted(rows.join(ids, "vec_id", "left_semi"), "anchors")
    fitted = _fit(rows)
    model = spark.sparkContext.broadcast(fitted)
    longest = max(fitted, default=1)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(asked * 16 * max(1, longest) / ANCHOR_BYTES)), max(1, math.ceil(n / ROW_BLOCK), min(2 * cores, math.ceil(n / LEAST_ROWS)))
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = _grid(anchors, rows, blocks, model, False, positives, low, high).withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    best, best_path = write_shared(best.select("anchor_id", (F.col("place") - 1).cast("long").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    asked_again = anchors.join(tops, "vec_id")
    found = _grid(asked_again, rows, blocks, model, True, negatives, low, high)
    by = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    out = found.join(best, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out, _ = write_shared(out, "negatives")
    drop_shared(spark, rows_path, anchors_path, best_path)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label=label)


ORACLE_SQL = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b))::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5
""",
}
