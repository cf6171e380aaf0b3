"""Near-duplicate embeddings by product quantisation.

A vector is scaled to length one, so cosine c is distance r = sqrt(2 - 2c).  Equal
vectors of a label are one node with a count.  A coarse quantiser puts each node
in the inverted list of its nearest centroid; its residual is coded by 16
subspaces of 16 codewords, with the distance between it and its code kept.

**Probes.**  A neighbour y of x that lies in the list of centroid c is on c's
side of the bisector between c and x's own centroid o, which is (|x - c|^2 -
|x - o|^2) / (2 |c - o|) away from x.  So no list whose bisector is further than r can hold one.
A difference of length r that spreads evenly over e directions goes further than
``sigmas`` r / sqrt(e) towards a given bisector about once in 700 times (``SIGMAS`` = 3), so x probes the
lists within that way, with the effective dimension e of the residuals of x's own list (squared trace
of their covariance over the trace of its square, corrected for the size of the sample).  Where
vectors lie along few directions e is under nine and all lists within r are probed, which
loses nothing.  ``sigmas=None`` probes these everywhere.

**Candidates.**  Table lookups give the distance from a query to a code (the query
is not coded); y stays a candidate while that distance is at most r plus y's own
coding error, as the triangle inequality asks.

**Rerank.**  Candidates' cosines are taken from the stored vectors in double precision.

A list's own vectors meet the queries that probe it.  A link is found from both ends or from one;
where it is from one, the finding counts for both, so counts agree.

There are about as many lists as the root of the number of vectors of the largest label (``MOST_LISTS`` at most).  Quantisers are
fitted on a sample by hash: ``PER_LIST`` vectors a list, ``SAMPLE_BYTES`` in all
at most.  That bounds their size, so they are broadcast.  Lists, split into blocks about the root of
their size, meet in pairs of blocks.  A block pair gives counts of links and the
pairs of a spanning forest, never all pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and those
without a label, link with nothing: n_links 0, their own component, kept.  Rows with the
same id are vectors of their own.  Vectors of different lengths never link (a label can
mix them).  A null id has a null component.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import table
from kinfold.operators.components import components
from kinfold.llm.ngram_join import spanning
from kinfold.shared import bounded, drop_shared, python_ready, tidy, write_counted, write_shared

#: Most lists; vectors a list that its quantiser is fitted on, and most bytes of all of them.
MOST_LISTS, PER_LIST, SAMPLE_BYTES = 4096, 64, 64 << 20
#: Lists of few vectors.
LEAST_LISTS = 16
SUBSPACES, CODEWORDS = 16, 16
BLOCK = 64
#: Cells of a table of distances at a time.
CELLS = 4_000_000
#: Standard deviations of a neighbour's way towards a bisector that probes cover.
SIGMAS = 3.0
#: Slack of float arithmetic in bounds; exact cosines decide.
EPS = 1e-6


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x."""
    half, step = (c * c).sum(axis=1) / 2, max(1, CELLS // len(c))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; empty clusters keep theirs."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.flatnonzero(n))
        c[n > 0] = np.add.reduceat(x[order], starts, axis=0) / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        sample = sample.astype(np.float64)
        self.dim = sample.shape[1]
        self.centroids = _kmeans(sample, min(lists, max(1, len(sample) // PER_LIST)))
        self.cuts = [(i * self.dim // SUBSPACES, (i + 1) * self.dim // SUBSPACES) for i in range(SUBSPACES)]
        self.cuts = [c for c in self.cuts if c[0] < c[1]]
        own = _nearest(sample, self.centroids)
        residual = sample - self.centroids[own]
        self.books = [_kmeans(residual[:, a:b], min(CODEWORDS, len(sample))) for a, b in self.cuts]
        self.directions = np.ones(len(self.centroids))
        for c in np.unique(own):
            # The trace of the square of r'r is that of rr', the smaller of the two will do.
            r = residual[own == c]
            square = r @ r.T if len(r) < self.dim else r.T @ r
            total = np.trace(square)
            if total > 0:
                self.directions[c] = 1 / max((square * square).sum() / total**2 - 1 / len(r), 1 / self.dim)

    def probes(self, x: np.ndarray, radius: float, sigmas: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(own list, matrix of the lists that may hold neighbours within the radius)."""
        c, g = self.centroids, (self.centroids**2).sum(axis=1)
        d = np.maximum((x * x).sum(axis=1)[:, None] + g - 2 * x @ c.T, 0)
        own = d.argmin(axis=1)
        reach = np.full(len(c), radius) if sigmas is None else radius * np.minimum(1, sigmas / np.sqrt(self.directions))
        between = np.sqrt(np.maximum(g[own][:, None] + g - 2 * c[own] @ c.T, 0))
        probed = d - d[np.arange(len(x)), own][:, None] <= 2 * between * (reach[own][:, None] + EPS) + EPS
        probed[np.arange(len(x)), own] = True
        return own, probed

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance of each row to what its code stands for."""
        residual = x - self.centroids[own]
        codes, error = np.empty((len(x), len(self.cuts)), np.uint8), np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            d = ((residual[:, None, a:b] - book) ** 2).sum(axis=2)
            codes[:, m] = d.argmin(axis=1)
            error += d.min(axis=1)
        return codes, np.sqrt(error)

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: queries as they are against codes of one list, by table lookups."""
        residual = x - self.centroids[own]
        out = np.zeros((len(x), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            lookup = ((residual[:, None, a:b] - book) ** 2).sum(axis=2)
            out += lookup[:, codes[:, m]]
        return np.sqrt(out)


def _clean(batches):
    """(vec_id, label, dim, k1, k2, vector): usable vectors as doubles with a key of their bits, others with dim 0."""
    for b in batches:
        ids, labels = b.column(0).to_pylist(), b.column(2)
        dims, k1, k2, vectors = [], [], [], []
        for v, label in zip(b.column(1).to_pylist(), labels.to_pylist()):
            x = None if v is None or label is None or not v or None in v else np.array(v, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                dims.append(0), k1.append(0), k2.append(0), vectors.append(None)
                continue
            x = x + 0.0  # one zero
            raw = x.tobytes()
            short = x.astype(np.float32)
            key = hashlib.blake2b(raw, digest_size=16).digest()
            dims.append(len(x)), k1.append(int.from_bytes(key[:8], "little", signed=True)), k2.append(int.from_bytes(key[8:], "little", signed=True)), vectors.append(short.tobytes() if (short == x).all() else raw)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), labels, pa.array(dims, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "label", "dim", "k1", "k2", "vector"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _stack(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows as doubles; those that floats hold exactly come as floats."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), dim).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])


def _place(model, radius: float, sigmas: float | None):
    """A node's row in its own list (role 0) and one in each list that it probes (role 1)."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                q: Quantiser = model.value[int(dim)]
                at = np.flatnonzero(dims == dim)
                for cut in np.array_split(at, max(1, len(at) * len(q.centroids) // CELLS, len(at) // 512)):
                    own, probed = q.probes(_unit(_stack([b.column("vector")[int(i)].as_py() for i in cut], int(dim))), radius, sigmas)
                    r, c = np.nonzero(probed)
                    index = np.concatenate((cut, cut[r]))
                    rows = b.select(["label", "node", "copies", "dim", "vector"]).take(pa.array(index))
                    lists = [pa.array(np.concatenate(x), pa.int32()) for x in ((own, own[r]), (own, c), (np.zeros(len(cut)), np.ones(len(r))))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *lists], ["label", "node", "copies", "dim", "vector", "own", "list", "role"])

    return run


def _meet(model, cosine: float, sigmas: float | None):
    """One block of a list against one block of queries: link counts and a spanning forest of the links."""
    radius = math.sqrt(2 - 2 * cosine)

    def run(batches):
        for b in batches:
            kind, a, other, n = [], [], [], []
            for dim, centroid, base, queries in zip(*(b.column(i).to_pylist() for i in range(4))):
                q: Quantiser = model.value[dim]
                y = _unit(_stack([m["vector"] for m in base], dim))
                codes, error = q.encode(y, np.full(len(y), centroid))
                copies, ids = np.array([m["copies"] for m in base]), np.array([m["node"] for m in base])
                label = {int(i): k for k, i in enumerate(dict.fromkeys([*ids.tolist(), *(m["node"] for m in queries)]))}
                forest = np.arange(len(label))
                right = np.array([label[int(i)] for i in ids])
                alone = np.zeros(len(y), np.int64)  # links that only the query finds
                for at in range(0, len(queries), 256):
                    part = queries[at : at + 256]
                    x, own_ids = _unit(_stack([m["vector"] for m in part], dim)), np.array([m["node"] for m in part])
                    i, j = np.nonzero((q.distances(x, centroid, codes) <= radius + error + EPS) & (own_ids[:, None] != ids))
                    if not len(i):
                        continue
                    linked = np.zeros((len(x), len(y)), bool)
                    for s in range(0, len(i), 100_000):
                        p, t = i[s : s + 100_000], j[s : s + 100_000]
                        linked[p, t] = np.einsum("ij,ij->i", x[p], y[t]) >= cosine
                    if not linked.any():
                        continue
                    counts = linked @ copies
                    for k in np.flatnonzero(counts):
                        kind.append(0), a.append(int(own_ids[k])), other.append(0), n.append(int(counts[k]))
                    own, times = np.array([m["own"] for m in part]), np.array([m["copies"] for m in part])
                    far = np.flatnonzero(linked[own != centroid].any(axis=0))
                    if len(far):
                        back = np.zeros((len(x), len(far)), bool)
                        for s in range(0, len(far), max(1, CELLS // len(q.centroids))):
                            some = slice(s, s + max(1, CELLS // len(q.centroids)))
                            back[:, some] = q.probes(y[far[some]], radius, sigmas)[1][:, own].T
                        alone[far] += times @ (linked[:, far] & ~back & (own != centroid)[:, None])
                    left = np.array([label[int(k)] for k in own_ids])
                    for p, t in spanning(linked, forest, left, right):
                        kind.append(1), a.append(int(own_ids[p])), other.append(int(ids[t])), n.append(0)
                for k in np.flatnonzero(alone):
                    kind.append(0), a.append(int(ids[k])), other.append(0), n.append(int(alone[k]))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

    return run


def _fit(nodes: DataFrame) -> dict[int, Quantiser]:
    """A quantiser for each length of vector, from one sample by hash."""
    found = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).limit(257).collect()
    if len(found) > 256:
        raise ValueError("vectors of more than 256 lengths")
    sizes = {r["dim"]: r["n"] for r in found}
    lists = {r["dim"]: min(MOST_LISTS, max(LEAST_LISTS, math.isqrt(r["most"]))) for r in found}
    share = {dim: min(1.0, max(2000, min(lists[dim] * PER_LIST, SAMPLE_BYTES // (4 * dim * len(sizes)))) / n) for dim, n in sizes.items()}
    if not sizes:
        return {}
    shares = F.create_map([x for dim in share for x in (F.lit(dim), F.lit(share[dim]))])
    picked = nodes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1_000_000)) < shares[F.col("dim")] * 1_000_000).select("dim", "k1", "k2", "vector").toArrow()
    picked = picked.sort_by([("dim", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
    sample: dict[int, list[bytes]] = {}
    for dim, raw in zip(picked.column("dim").to_pylist(), picked.column("vector").to_pylist()):
        sample.setdefault(dim, []).append(raw)
    return {dim: Quantiser(_unit(_stack(sample.get(dim) or [nodes.where(F.col("dim") == dim).first()["vector"]], dim)), lists[dim]) for dim in sizes}


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, sigmas: float | None = SIGMAS) -> DataFrame:
    """(key, n_links, component_id, kept) for each vector; see the module's text."""
    spark = df.sparkSession
    python_ready(spark)
    label_type = df.schema[label].dataType.simpleString()
    rows, rows_path = write_shared(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label")).mapInArrow(tidy(_clean), f"vec_id long, label {label_type}, dim int, k1 long, k2 long, vector binary"), "vectors")
    usable = rows.where("dim > 0 and vec_id is not null")
    nodes, nodes_path = write_shared(usable.groupBy("label", "dim", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "nodes")
    model = spark.sparkContext.broadcast(_fit(nodes))
    placed = nodes.select("label", "node", "copies", "dim", "vector").mapInArrow(tidy(_place(model, math.sqrt(2 - 2 * cosine), sigmas)), f"label {label_type}, node long, copies long, dim int, vector binary, own int, list int, role int")
    placed, placed_path = write_shared(placed, "placed")
    group = ["label", "dim", "list"]
    large = placed.groupBy(*group, "role").agg(F.count("*").alias("size")).where(F.col("size") > 4 * BLOCK)
    large = large.withColumn("blocks", F.ceil(F.sqrt(F.col("size") / BLOCK)).cast("int")).groupBy(*group).agg(F.max(F.when(F.col("role") == 0, F.col("blocks"))).alias("base"), F.max(F.when(F.col("role") == 1, F.col("blocks"))).alias("asks"))
    large, large_path, lists = write_counted(large, "large")
    # Large lists are dealt into blocks before they are gathered.
    dealt = placed.join(bounded(large, lists), group, "left").withColumns({"base": F.coalesce("base", F.lit(1)), "asks": F.coalesce("asks", F.lit(1))})
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "role"), F.when(F.col("role") == 0, F.col("base")).otherwise(F.col("asks"))).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("asks")).otherwise(F.col("base")) - 1)))
    met = met.withColumns({"i": F.when(F.col("role") == 0, F.col("block")).otherwise(F.col("other")), "j": F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("block"))})
    members = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct("node", "copies", "own", "vector")))
    pairs = met.groupBy(*group, "i", "j").agg(members(0).alias("list_block"), members(1).alias("queries"))
    pairs = pairs.where((F.size("list_block") > 0) & (F.size("queries") > 0)).select("dim", "list", "list_block", "queries")
    found, found_path = write_shared(pairs.mapInArrow(tidy(_meet(model, cosine, sigmas)), "kind int, a long, b long, n long"), "found")
    comp, _ = write_shared(components(found.where("kind = 1")), "components")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # Vectors of one id and label can be different nodes only if ids repeat; then they share what their id has.
    named = nodes.join(links, "node", "left").join(comp, "node", "left").select("label", "dim", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = usable.join(named, ["label", "dim", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("dim = 0 or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    drop_shared(spark, placed_path, large_path)
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND list_count(embedding) = len(embedding)
         AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE ok),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
}
