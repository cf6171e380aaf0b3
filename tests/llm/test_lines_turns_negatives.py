"""Line dedup, conversation repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import hard_negatives, line_dedup, turn_repair


# --- lines


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    first = {k: min(ids, key=lambda i: (i is None, i or 0)) for k, ids in holders.items() if len(k) >= 10}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def deduped(docs):
    both = line_dedup.with_bitmaps(docs, line_dedup.dropped_bitmaps(docs))
    return sorted(((r[0], r[1], r[2], r[3]) for r in both.select("doc_id", F.size(line_dedup.lines("text")), F.coalesce("n_dropped", F.lit(0)), F.sha2(line_dedup.kept_text("text", "words"), 256)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["a common line of text", "\tA common LINE of text \r", "Ünïcode stäys as it is", "ünïcode stäys as it is", "short", "", "          ", "nine char", "ten chars!", " ten chars! ", "a line with a separator"] + [f"line number {i}" for i in range(40)]
    rows = [(r.choice([None, *range(60)]) if r.random() < 0.2 else i, None if r.random() < 0.05 else "\n".join(r.choice(pool[: r.choice([3, 51])]) for _ in range(r.choice([0, 1, 3, 200])))) for i in range(120)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "h1": F.lit(1), "doc": F.lit(2), "words": F.lit(3)})
    got = deduped(docs)
    assert got == brute_lines(rows)
    assert sum(x[2] for x in got) > 100


def test_lines_of_hot_keys_are_sliced(spark):
    """One line in every document: its rows are dealt into slices, and the first document alone keeps it."""
    rows = [(i, f"the line of everyone\nown line number {i}\nthe line of everyone") for i in range(1, 3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = line_dedup.hashed_lines(docs, "doc_id", "text", 10)
    hot = line_dedup.hot_keys(hashed, hashed.count(), 4).collect()
    assert len(hot) == 1 and hot[0].slices > 4
    got = deduped(docs)
    assert [x for x in got if not x[2]] == [x for x in got if x[0] == 1] and all(x[2] == 2 for x in got if x[0] > 1)
    assert got == brute_lines(rows)


def test_lines_of_a_long_document_and_of_nothing(spark):
    long = "\n".join(["kept in the first"] * 3 + [f"only here {i}" for i in range(50_000)] + ["kept in the first"])
    rows = [(5, "kept in the first\nx"), (7, long), (8, None), (9, ""), (10, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped(docs) == brute_lines(rows)
    maps = {r.doc: r for r in line_dedup.dropped_bitmaps(docs).collect()}
    assert set(maps) == {7, 10}
    assert len(maps[7].words) == 2 and maps[7].words[1].skip == 50_003 // 64 - 1  # two words say it all
    assert deduped(docs.where("doc_id > 100")) == []


# --- conversations


def brute_repair(rows):
    """rows (turn, role, text) in order: figures by trying every string of edits with at most two inserts at a place."""
    space = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(space)
        faults.append("blank" if not body.strip(space) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = None
    places = []
    for (_, role, text), fault in zip(rows, faults):
        cut = fault == "truncated"
        ways = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]
        places.append(ways)
    inserts = [[]] + [[(x, "")] for x in ("user", "assistant")] + [[(x, ""), (y, "")] for x in ("user", "assistant") for y in ("user", "assistant")]
    gap_ways = [(2 * len(i), "I" * len(i), i) for i in inserts]
    for ways in itertools.product(*[x for p in places for x in (gap_ways, p)], gap_ways):
        turns_out = [t for _, _, ts in ways for t in ts]
        if re.fullmatch(r"(s?(ua)+)?", "".join(t[0][:1] or "?" for t in turns_out)):
            way = (sum(c for c, _, _ in ways), "".join(a for _, a, _ in ways), turns_out)
            best = way if best is None or way[:2] < best[:2] else best
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], digest)


def repaired(df, **k):
    return {r.conv_id: tuple(r[c] for c in (*turn_repair.FIGURES, "audit", "repaired_sha256")) for r in turn_repair.repair(df, **k).collect()}


def test_repair_equals_every_string_of_edits(spark):
    r = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(r.choice([1, 2, 3, 3, 4])):
            rows.append((conv if conv else None, r.choice([turn, turn, None, turn * 2]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "a", None]), r.choice(["One.", "Two!", "cut off", "", " \t", "One.", "Ünd?\n", None])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"present": F.lit(0), "blank": F.lit("x"), "conv": F.lit(1)})
    filled = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    want = {}
    for conv in {c for c, *_ in filled}:
        own = sorted(((t, role, text) for c, t, role, text in filled if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        want[conv] = brute_repair(own)
    got = repaired(df)
    assert got == want
    assert {x for w in want.values() for x in w[6]} == set("KRDI")


def test_repair_of_long_and_empty_conversations(spark):
    n = 30_000
    rows = [(1, t, "assistant" if t % 2 else "user", f"Turn {t}.") for t in range(n)] + [(2, t, "user", "") for t in range(n)] + [(3, t, "user", f"Turn {t}.") for t in range(n)] + [(4, 0, "tool", "Odd.")] * 2
    got = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got[1][5:7] == (0, "K" * n) and got[1][7] == hashlib.sha256("\n".join(f"{'assistant' if t % 2 else 'user'}:Turn {t}." for t in range(n)).encode()).hexdigest()
    assert got[2][1] == n and got[2][5:] == (3 * n, "D" * n, hashlib.sha256(b"").hexdigest())
    assert got[3][5:7] == (n, "KR" * (n // 2))
    assert got[4][2] == 1 and got[4][5:7] == (6, "DD")  # "IR" would cost 2 + 2 + 3 for the copy
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(nothing).count() == 0


def test_damage_names_every_conversation(spark):
    rows = [(c, t, "user", f"A. b! c? {t}") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if f == 4 else role, "" if f in (0, 1) else re.sub("[.!?]", "", text) if f == 2 else text, f != 0)
        want += [row] * (2 if f == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in turn_repair.damage(df).collect()))) == sorted(map(repr, want))
    gone = spark.createDataFrame([(7, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert repaired(gone, present=F.lit(False)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- hard negatives


def brute_negatives(rows):
    ok = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and None not in v and np.isfinite(np.array(v, float)).all():
            x = [int(np.floor(256 * float(c))) for c in v]
            ok.setdefault(i, []).append((label, len(x), x))
    ok = {i: v[0] for i, v in ok.items()}
    score = lambda a, b: sum(p * q for p, q in zip(ok[a][2], ok[b][2]))
    out = []
    for a in (i for i in ok if i % 100 == 0):
        others = [i for i in ok if i != a and ok[i][1] == ok[a][1]]
        same = sorted((i for i in others if ok[i][0] == ok[a][0]), key=lambda i: (-score(a, i), i))[:5]
        for p in same:
            fit = sorted((i for i in others if ok[i][0] != ok[a][0] and 80 * score(a, p) <= 100 * score(a, i) <= 100 * score(a, p)), key=lambda i: (-score(a, i), i))[:5]
            out += [(a, p, k + 1, i, score(a, p), score(a, i)) for k, i in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("dim,seed", [(64, 1), (6, 2), (1, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, seed):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 50)
    r = np.random.default_rng(seed)
    axes = r.normal(size=(3, dim))
    rows = [(i * (20 if i < 40 else 1), [float(x) for x in np.float32(r.normal(size=3) @ axes / 4 + r.normal(size=dim) * 0.05)], int(r.integers(0, 4))) for i in range(400)]
    rows = list({i: (i, v, label) for i, v, label in rows}.values())
    rows += [(9000 + i, rows[i % 7][1], int(r.integers(0, 4))) for i in range(60)]  # ties
    rows += [(100_000 + i, v, label) for i, (v, label) in enumerate([(None, 1), ([float("nan")] * dim, 1), ([None] * dim, 1), ([1.0] * dim, None), ([], 1), ([], 2), ([0.0] * dim, 3), ([1.0] * (dim + 1), 1), ([2.0] * (dim + 1), 1), ([1.9] * (dim + 1), 2)])]
    rows += [(None, [1.0] * dim, 1), (200_000, [300.0] * dim, 1)] + rows[:4]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(0), "i": F.lit("x"), "role": F.lit(1), "dim": F.lit(1)})
    want = brute_negatives(rows)
    assert mined(df) == want and len(want) > 20
    assert mined(df.where("vec_id < 0")) == []


def test_partial_products_discard_and_lose_nothing():
    r = np.random.default_rng(5)
    axes = r.normal(size=(8, 64))
    whole = np.floor(256 * (r.normal(size=(600, 8)) @ axes / 20 + r.normal(size=(600, 64)) * 0.01))
    turn = hard_negatives.rotation(whole)
    assert np.allclose(turn.T @ turn, np.eye(64))
    a, b = hard_negatives.Side(whole[:50], turn), hard_negatives.Side(whole, turn)
    exact = whole[:50] @ whole.T
    needed = np.sort(exact, axis=1)[:, -20]
    i, j = hard_negatives.survivors(a, b, needed, np.ones(exact.shape, bool))
    found = np.zeros(exact.shape, bool)
    found[i, j] = True
    assert found[exact >= needed[:, None]].all()
    assert found.sum() < 0.1 * found.size
    assert (hard_negatives.products(whole[i], whole[j]) == exact[i, j]).all()
    big = np.full((1, 4), 2.0**29)
    assert hard_negatives.products(big, big)[0] == 4 * 2**58
    with pytest.raises(ValueError):
        hard_negatives.products(big * 4, big * 4)
