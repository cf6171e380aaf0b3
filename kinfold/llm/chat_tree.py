"""Chat formatting as a prefix forest: shared opening turns are emitted once.

A turn is a node, named by a 128-bit hash of all turns up to it, so conversations
that open alike share nodes.  Nodes are emitted depth first as one stream of
tokens (code points here).  Each has its start in the stream, its
position id (tokens of its ancestors), its text and its loss span.  A conversation
is the list of stream intervals that its last token attends to: its ancestors'
tokens and its own, neighbouring ones merged.

Depth-first order needs no tree in memory: a node's key is the path of those
ancestors-or-self at which its tree branches, then its depth; sorting by it gives
the stream, and a running sum of lengths the starts.  All steps are sorts, joins and
streamed passes; a conversation or an opening turn of any size is never held
whole, only hashed and summed along.

A turn reads ``### role: text </turn>`` and a line end.  Backslashes, number signs
and less-than signs in texts, and colons in roles too, get a backslash before them,
so no text holds a control string, and taking the backslashes away gives it back.

Rows are taken by turn, nulls first, ties by role and text, repeated rows all kept. Null roles
and texts count as empty.  Rows without a conv_id are one conversation.  An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import table
from kinfold.shared import drop_shared, python_ready, write_counted, write_shared

LEARNED = "assistant"
#: A key with more than this part of a table's rows is hot. There are fewer hot keys than this, so they can be broadcast.
HOT = 1000
_TEXT, _ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, what: re.Pattern = _TEXT) -> str:
    return what.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and the span of the turn's own text in it."""
    head = f"### {escape(role, _ROLE)}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(stream: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered stream; text that isn't one raises."""
    out, at = [], 0
    while at < len(stream):
        m = _TURN.match(stream, at)
        if not m:
            raise ValueError("not a rendered conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _chain(batches):
    """Rows (conv, turn, role, text) by conversation and turn: each one's depth, node and parent, and rendered text."""
    last, depth, node = (), 0, b""
    for b in batches:
        out = []
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (conv,) != last:
                last, depth, node = (conv,), 0, b""
            parent = node
            said = b"%d\n" % len(role) + role.encode() + text.encode()
            node = hashlib.blake2b(parent + said, digest_size=16).digest()
            segment, low, high = render(role, text)
            out.append((conv, depth, node, parent, segment, len(segment), low if role == LEARNED else None, high if role == LEARNED else None))
            depth += 1
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["conv_id", "depth", "node", "parent", "segment", "n", "loss_from", "loss_to"])


def _paths(batches):
    """Rows (conv, depth, node, n, branches, owned) by conversation and depth: path and position of the nodes that the conversation owns."""
    path, position = b"", 0
    for b in batches:
        nodes, paths, depths, positions = [], [], [], []
        for depth, node, n, branches, owned in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
            if depth == 0:
                path, position = b"", 0
            if branches or depth == 0:
                path += node
            if owned:
                nodes.append(node), paths.append(path), depths.append(depth), positions.append(position)
            position += n
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(paths, pa.binary()), pa.array(depths, pa.int64()), pa.array(positions, pa.int64())], ["node", "path", "depth", "position"])


def _starts(batches):
    """Sorted nodes: their starts within the partition."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_pylist()
        local = []
        for x in n:
            local.append(at)
            at += x
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([part] * len(n), pa.int64()), pa.array(local, pa.int64())], ["node", "n", "position", "part", "local"])


def build(turns: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text): the forest's nodes and each conversation's rows.

    nodes: (node, start, n, position, segment, loss_from, loss_to, uses), offsets in code
    points, ``start`` in the depth-first stream, ``uses`` its rows.  rows: (conv_id, depth, node).
    """
    python_ready(spark, 500)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = clean.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    schema = "conv_id long, depth long, node binary, parent binary, segment string, n long, loss_from long, loss_to long"
    rows, _, n_rows = write_counted(ordered.mapInArrow(_chain, schema), "turns")
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("owner"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("uses"))
    nodes, nodes_path, n_nodes = write_counted(nodes, "nodes")
    forks = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).where("children > 1")
    forks, forks_path = write_shared(forks, "forks")
    # A parent with very many children is known to branch: its children need no shuffle.
    crowded = F.col("children") * HOT > n_nodes
    hot = F.broadcast(forks.where(crowded).select("parent"))
    few = forks.where(~crowded).select("parent", F.lit(True).alias("branches"))
    flags = nodes.join(hot, "parent", "left_semi").select("node", "owner", "uses", F.lit(True).alias("branches")).unionByName(
        nodes.join(hot, "parent", "left_anti").join(few, "parent", "left").select("node", "owner", "uses", F.coalesce("branches", F.lit(False)).alias("branches")))
    flags, flags_path = write_shared(flags, "flags")
    common = F.col("uses") * HOT > n_rows
    hot = F.broadcast(flags.where(common).drop("uses"))
    short = rows.select("conv_id", "depth", "node", "n")
    marked = short.join(hot, "node").unionByName(short.join(hot, "node", "left_anti").join(flags.where(~common).drop("uses"), "node"))
    marked = marked.select("conv_id", "depth", "node", "n", "branches", F.col("conv_id").eqNullSafe(F.col("owner")).alias("owned"))
    marked = marked.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "depth")
    paths = marked.mapInArrow(_paths, "node binary, path binary, depth long, position long")
    # One row a node: its first owner's row brings its text and length.
    own = rows.select("node", "segment", "n", "loss_from", "loss_to").dropDuplicates(["node"])
    texts, texts_path = write_shared(own, "texts")
    keyed = paths.join(texts.select("node", "n"), "node").repartitionByRange(parts, "path", "depth").sortWithinPartitions("path", "depth").select("node", "n", "position")
    placed, placed_path = write_shared(keyed.mapInArrow(_starts, "node binary, n long, position long, part long, local long"), "placed")
    sums = sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a number a partition
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    offset = F.create_map([F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0).cast("long")
    out = placed.select("node", (F.col("local") + offset).alias("start"), "position").join(texts, "node").join(flags.select("node", "uses"), "node")
    forest, _ = write_shared(out.select("node", "start", "n", "position", "segment", "loss_from", "loss_to", "uses"), "forest")
    drop_shared(spark, nodes_path, forks_path, flags_path, texts_path, placed_path)
    return forest, rows.select("conv_id", "depth", "node")


class _Reader:
    """Digests of one conversation, from its segments in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.learned = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.intervals: list[list[int]] = []

    def add(self, start: int, segment: str, low: int | None, high: int | None) -> None:
        for role, text in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if low is not None:
            text = unescape(segment[low:high])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.chars += len(segment)
        if self.intervals and self.intervals[-1][1] == start:
            self.intervals[-1][1] += len(segment)
        else:
            self.intervals.append([start, start + len(segment)])

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.intervals


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("intervals", pa.list_(pa.list_(pa.int64())))])


def _read(batches):
    now = None
    for b in batches:
        done = []
        for conv, start, segment, low, high in zip(*(b.column(i).to_pylist() for i in range(5))):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = _Reader(conv)
            now.add(start, segment, low, high)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(_READ)], schema=_READ)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.row(), _READ)], schema=_READ)


def read_back(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation from the stream: digests, and its attention intervals as [start, end) pairs."""
    spark = nodes.sparkSession
    python_ready(spark, 500)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A node's rows are dealt into pieces of a thousandth of all rows, its text copied to each: fewer than 2 * HOT copies.
    total = rows.count()
    pieces = F.ceil(F.col("uses") * HOT / F.lit(max(total, 1)))
    hot = F.broadcast(nodes.where(F.col("uses") * HOT > total).select("node", pieces.alias("pieces")))
    dealt = rows.join(hot, "node", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("conv_id"), "pieces"), F.lit(0).cast("long")))
    copies = nodes.select("node", "start", "segment", "loss_from", "loss_to", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(pieces, F.lit(1)) - 1)).alias("piece"))
    full = dealt.join(copies, ["node", "piece"])
    full = full.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "start", "segment", "loss_from", "loss_to")
    return full.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, intervals array<array<long>>")


#: What both turns of conversation -7 say: control strings of the template.
PROBE = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    nodes, rows = build(turns.unionByName(probe), spark)
    return read_back(nodes, rows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE_SQL = {
    "op5_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM range(2) t(i))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
}
