r"""Repair of conversations by a forward Viterbi pass over the grammar `(s?(ua)+)?` of role initials.

A row's first fault counts: blank (no `[^\x20\x09-\x0D]`), duplicate (role and text stand earlier in
the conversation), truncated (the last such character is not `.`, `!` or `?`).  Edits: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty turn of
user or assistant, anywhere, 2; a truncated row that stays adds 1.  The cheapest edits win, ties by the
ASCII-least string of their initials.

**States.**  Nothing yet, a system turn, a user's turn, an assistant's turn.  From each the next turn's role
is given (a user's, or the assistant's after a user's), so a string of initials says everything.  A row's
layer holds, for each state, the cheapest way whose last edit is the row's own.  The layer is closed by at
most two inserts before the next row is read: two reach every state that inserts can reach.

**Audits.**  Of two ways whose last edit is the same row's, neither initial string begins the other: what
one has more would be inserts, and these would come last.  So their order never changes when both go on
alike, and a layer carries each state's cost and the rank of its audit among the four; the
audits themselves are kept as one byte a state and row and read backwards at the end.  States that another one
reaches more cheaply by inserts are left out.  Each state carries the digest of the text it has repaired,
so no text is held.

**Plan.**  Rows are dealt by conversation once.  Duplicates are numbered by a window within those partitions, then
the rows are sorted by turn and streamed; a conversation of any length needs four bytes a row.  A digest of a
conversation's whole text is one stream, so one conversation is one task's, without being held.

Rows are taken by turn, nulls first, ties by role and text, repeated rows all kept.  Null roles and texts are
one space.  Rows without a conv_id are one conversation.  An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.llm.common import table
from kinfold.shared import python_ready, tidy

SPACE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after the turn that may follow a state.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE = "K", "R", "D"
EDITS = KEEP + REROLE + DELETE
COST = {KEEP: 0, REROLE: 2, DELETE: 3}
INSERT, MOST_INSERTS, TRUNCATED = 2, 2, 1
DEAD = 255


def _moves(state: int, initial: str, truncated: bool) -> list[tuple[int, int, str, int]]:
    """(state after, cost, initials, inserts) of the best way from a state over one row to each state."""
    best: dict[int, tuple[int, str, int]] = {}
    at = state
    for inserts in range(MOST_INSERTS + 1):
        ways = [(at, DELETE), (NEXT[at], REROLE)]
        if initial == "s" and at == NONE:
            ways.append((SYSTEM, KEEP))
        if initial == ("a" if NEXT[at] == ASSISTANT else "u"):
            ways.append((NEXT[at], KEEP))
        for after, edit in ways:
            way = (INSERT * inserts + COST[edit] + TRUNCATED * (truncated and edit != DELETE), "I" * inserts + edit, inserts)
            best[after] = min(best.get(after, way), way)
        at = NEXT[at]
    return [(after, *way) for after, way in best.items()]


MOVES = {(p, c, t): _moves(p, c, t) for p in range(4) for c in ("s", "u", "a", "") for t in (False, True)}


def _written(digest, state: int, inserts: int) -> int:
    """Add inserted turns to a digest; the state they lead to."""
    for _ in range(inserts):
        digest.update((b"" if state == NONE else b"\n") + ROLES[NEXT[state]].encode() + b":")
        state = NEXT[state]
    return state


class Conversation:
    """The state of one conversation's pass."""

    def __init__(self):
        #: state: (cost, rank of its audit, digest)
        self.layer = {NONE: (0, 0, hashlib.sha256())}
        self.back = bytearray()
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn, role: str, text: str | None, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
            self.turns += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if blank or duplicate:
            self.blank += blank
            self.duplicate += not blank
            self.layer = {s: (cost + COST[DELETE], rank, digest) for s, (cost, rank, digest) in self.layer.items()}
            self.back += bytes((s | EDITS.index(DELETE) << 4) if s in self.layer else DEAD for s in range(4))
            return
        self.truncated += truncated
        found: dict[int, tuple] = {}
        for p, (cost, rank, _) in self.layer.items():
            for after, more, initials, inserts in MOVES[p, initial if initial in ("s", "u", "a") else "", truncated]:
                way = (cost + more, rank, initials, inserts, p)
                if after not in found or way < found[after]:
                    found[after] = way
        inf = float("inf")
        u, a, s, e = (found[x][0] if x in found else inf for x in (USER, ASSISTANT, SYSTEM, NONE))
        to_a = min(a, u + INSERT, s + 2 * INSERT, e + 2 * INSERT)
        to_u = min(u, a + INSERT, s + INSERT, e + INSERT)
        # A system turn only leads to a user's, as an assistant's does; nothing yet can keep a system turn, which costs at most a deletion elsewhere.
        limit = {USER: to_u, ASSISTANT: to_a, SYSTEM: to_a, NONE: to_a + COST[DELETE]}
        alive = sorted((x for x in found if found[x][0] <= limit[x]), key=lambda x: found[x][1:3])
        layer, codes = {}, bytearray([DEAD] * 4)
        line = None
        for rank, after in enumerate(alive):
            cost, _, initials, inserts, p = found[after]
            digest = self.layer[p][2].copy()
            state = _written(digest, p, inserts)
            edit = initials[-1]
            if edit != DELETE:
                if line is None:
                    line = f":{text}".encode()
                digest.update((b"" if state == NONE else b"\n") + (role if edit == KEEP else ROLES[after]).encode())
                digest.update(line)
            layer[after] = (cost, rank, digest)
            codes[after] = p | inserts << 2 | EDITS.index(edit) << 4
        self.layer = layer
        self.back += codes

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired turns)."""
        ways = []
        for p, (cost, rank, _) in self.layer.items():
            at = p
            for inserts in range(MOST_INSERTS + 1):
                if at in (NONE, ASSISTANT):
                    ways.append((cost + INSERT * inserts, rank, inserts, p))
                at = NEXT[at]
        cost, _, inserts, state = min(ways)
        digest = self.layer[state][2].copy()
        _written(digest, state, inserts)
        audit = ["I" * inserts]
        for at in range(len(self.back) - 4, -1, -4):
            code = self.back[at + state]
            audit.append(EDITS[code >> 4])
            audit.append("I" * (code >> 2 & 3))
            state = code & 3
        return cost, "".join(reversed(audit)), digest.hexdigest()

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _scan(kind: pa.DataType):
    """Stream sorted rows (conv, turn, role, text, present, blank, duplicate, truncated) to a row a conversation."""

    def run(batches):
        now: Conversation | None = None
        name = None
        done: list[tuple] = []

        def finish():
            cost, audit, digest = now.end()
            done.append((name, now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, cost, audit, digest))

        def out():
            columns = list(zip(*done)) or [()] * 9
            done.clear()
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", *FIGURES, "audit", "repaired_sha256"])

        for b in batches:
            for conv, turn, role, text, present, *faults in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != name:
                    if now is not None:
                        finish()
                    now, name = Conversation(), conv
                if present:
                    now.add(turn, role, text, *faults)
            yield out()
        if now is not None:
            finish()
        yield out()

    return run


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows that are not ``present`` only name their conversation.
    """
    spark = rows.sparkSession
    python_ready(spark)
    conv_type = rows.schema[key].dataType
    rows = rows.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"))
    rows = rows.withColumns({"body": F.rtrim("text", F.lit(SPACE)), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("turn"), "text", "role")})
    rows = rows.withColumns({"blank": F.length("body") == 0, "truncated": ~F.substring("body", -1, 1).isin(".", "!", "?")}).drop("body")
    seen = Window.partitionBy("conv", "present", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv").withColumn("duplicate", F.row_number().over(seen) > 1)
    ordered = dealt.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "duplicate")
    # Rows that must go need no text any more.
    kept = F.when(F.col("blank") | F.col("duplicate"), F.lit("")).otherwise(F.col("text"))
    ordered = ordered.select("conv", "turn", "role", kept.alias("text"), "present", "blank", "duplicate", "truncated")
    schema = f"conv {conv_type.simpleString()}, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string"
    found = ordered.mapInArrow(tidy(_scan(to_arrow_type(conv_type))), schema)
    return found.withColumnRenamed("conv", key)


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows damaged by crc32 of ``key:turn``: dropped (kept here as rows that are not present), emptied, without stops, repeated, or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(key, turn, F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(name(key), F.lit(":"), name(turn))) % 20).alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(key, turn, F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")), present=F.col("present"))


_CRC = "list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda c: ord(c)), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
#: States e, s, u, a are structs of cost, initials and repaired text; least() compares them in that order.
ORACLE_SQL = {
    "op12_turn_repair": r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(4294967295, CRC) % 20 AS f FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
faults AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed),
rows AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM faults),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM rows GROUP BY conv_id),
way(conv_id, n, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0, 'w': '', 't': ''}, {'c': 1000000000, 'w': '', 't': ''}, {'c': 1000000000, 'w': '', 't': ''}, {'c': 1000000000, 'w': '', 't': ''} FROM figures
  UNION ALL
  SELECT c.conv_id, r.n,
    {'c': e.c + 3, 'w': e.w || 'D', 't': e.t},
    least({'c': s.c + 3, 'w': s.w || 'D', 't': s.t}, CASE WHEN must OR i <> 's' THEN none ELSE {'c': e.c + r.cut, 'w': e.w || 'K', 't': e.t || chr(10) || r.role || ':' || r.text} END),
    least({'c': cu.c + 3, 'w': cu.w || 'D', 't': cu.t}, CASE WHEN must THEN none ELSE {'c': tou.c + r.cut + CASE WHEN i = 'u' THEN 0 ELSE 2 END, 'w': tou.w || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END, 't': tou.t || chr(10) || CASE WHEN i = 'u' THEN r.role ELSE 'user' END || ':' || r.text} END),
    least({'c': ca.c + 3, 'w': ca.w || 'D', 't': ca.t}, CASE WHEN must THEN none ELSE {'c': cu.c + r.cut + CASE WHEN i = 'a' THEN 0 ELSE 2 END, 'w': cu.w || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END, 't': cu.t || chr(10) || CASE WHEN i = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text} END)
  FROM (
    SELECT *, least(e, s, ca) AS tou FROM (
      SELECT *, least(a, {'c': cu.c + 2, 'w': cu.w || 'I', 't': cu.t || chr(10) || 'assistant:'}) AS ca FROM (
        SELECT *, {'c': 1000000000, 'w': '', 't': ''} AS none, least(u, {'c': e.c + 2, 'w': e.w || 'I', 't': e.t || chr(10) || 'user:'}, {'c': s.c + 2, 'w': s.w || 'I', 't': s.t || chr(10) || 'user:'}, {'c': a.c + 2, 'w': a.w || 'I', 't': a.t || chr(10) || 'user:'}) AS cu FROM way))) c
  JOIN (SELECT *, blank OR duplicate AS must, truncated::INT AS cut, left(role, 1) AS i FROM rows) r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = c.n + 1),
best AS (
  SELECT w.conv_id, least(e, a, {'c': u.c + 2, 'w': u.w || 'I', 't': u.t || chr(10) || 'assistant:'}, {'c': s.c + 4, 'w': s.w || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS b
  FROM way w JOIN figures f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.n = f.size),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.w, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM every LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM every.conv_id
""".replace("CRC", _CRC.format("name")),
}
