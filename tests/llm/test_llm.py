"""Operators of the llm package on small fixtures: brute force, round trips, planted cases, hostile rows."""

import itertools
import math
import random
import re
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import check  # noqa: E402

from trackloom.llm import packing, quantiles, queries, runs, sql, tokens, truncation  # noqa: E402

POINTS = "site string, clip string, track_id long, class string, frame long, time_s double, x double, y double, speed double, `group` string, arrived_at timestamp"
CLIPS = "clip string, site string, fps int, started_at timestamp"
AT = datetime(2025, 1, 1)
DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    check(spark, sf, queries.QUERIES[name], sql.ORACLES.get(name))


@pytest.fixture
def clips(spark):
    return spark.createDataFrame([("c", "s", 10, AT), ("d", "s", 10, None)], CLIPS)


def row(track, frame, x, y, speed=1.0, cls="person", group="people", at=AT, clip="c"):
    return ("s", clip, track, cls, frame, None, x, y, speed, group, at)


def brute_runs(rows, step=0.03, gap=20):
    out = set()
    for track in {r[2] for r in rows}:
        own = sorted({r[4]: r for r in rows if r[2] == track and r[6] is not None and r[7] is not None and not math.isnan(r[6])}.values(), key=lambda r: r[4])
        run = [own[0]] if own else []
        for r in own[1:] + [None]:
            if r is not None and math.hypot(r[6] - run[-1][6], r[7] - run[-1][7]) <= step + 1e-6 and r[4] - run[-1][4] <= gap:
                run.append(r)
                continue
            if len(run) > 1:
                out.add((track, run[0][4], run[-1][4], len(run)))
            run = [r]
    return out


@pytest.mark.parametrize("slice_s", [3.0, 17.0, 1800.0])
def test_runs_at_any_slicing(spark, clips, slice_s):
    rng = random.Random(2)
    rows = []
    for t in range(12):
        x = 0.0
        for f in range(0, 900, 5):
            if rng.random() < 0.1:
                continue
            x += rng.choice([0.0, 0.0, 0.02, 0.03, 0.04, 1.0]) if t else 0.0
            rows.append(row(t, f, None if rng.random() < 0.05 else round(x, 3), math.nan if rng.random() < 0.02 else 1.0))
    rows = [r for r in rows if not (r[7] is not None and math.isnan(r[7]))]
    df = spark.createDataFrame(rows, POINTS).selectExpr("*", "1 as own", "2 as fps", "3 as slice")
    got = {(r.track_id, r.start_frame, r.end_frame, r.n_rows) for r in runs.collapse_runs(df.drop("fps"), clips, slice_s=slice_s).collect()}
    assert got == brute_runs(rows) and len(got) > 20


def test_runs_of_nothing_and_of_copies(spark, clips):
    assert runs.collapse_runs(spark.createDataFrame([], POINTS), clips).count() == 0
    rows = [row(1, 5, 1.0, 1.0), row(1, 5, 1.0, 1.0), row(1, 10, None, 1.0), row(None, 5, 1.0, 1.0), row(2, None, 1.0, 1.0), row(3, 5, math.nan, 1.0), row(3, 10, math.nan, 1.0)]
    assert runs.collapse_runs(spark.createDataFrame(rows, POINTS), clips).count() == 0


def test_percentiles_within_bound_and_mergeable(spark, clips):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.lognormal(0, 1, 30_000), np.full(10_000, 2.0)])
    df = spark.createDataFrame([(int(k % 3), float(x)) for k, x in enumerate(v)], "k long, v double").repartition(7)
    base = quantiles.sketches(df, ["k"], "v", 400)
    one = quantiles.answers(quantiles.sketches(df, [], "v", 400), k=400).collect()[0]
    both = quantiles.answers(quantiles.merged(base, [], 400), k=400).collect()[0]
    s = np.sort(v)
    for r in (one, both):
        assert r.n == len(v) and r.rank_error == quantiles.rank_error(400)
        for p in quantiles.PERCENTILES:
            x = r[f"p{round(100 * p):02d}"]
            lo, hi = np.searchsorted(s, x, "left") / len(s), np.searchsorted(s, x, "right") / len(s)
            assert lo - 2 * r.rank_error <= p <= hi + 2 * r.rank_error


def test_percentiles_of_hostile_rows(spark, clips):
    assert quantiles.speed_percentiles(spark.createDataFrame([], POINTS), clips).count() == 0
    rows = [row(1, 5, 1.0, 1.0, math.nan), row(1, 10, 1.0, 1.0, None), row(1, 15, None, None, 3.0, None, None), row(1, 15, None, None, 3.0, None, None), row(2, 5, 0.0, 0.0, -1.0, "Car ", "VEHICLES", None, "d")]
    got = quantiles.speed_percentiles(spark.createDataFrame(rows, POINTS), clips).where("level = 'all' and group is not null").collect()
    assert {(r.group, r.n, r.p50) for r in got} == {("people", 1, 3.0), ("vehicles", 1, -1.0)}


def test_joins_equal_whole_encodings():
    enc = tokens.encoding()
    rng = random.Random(3)
    alphabet = ["a", "bc", "the", " ", "  ", "\n", "'s", "'ll", "'", "1", "23", "!", "…", "日本", "é", "é", "😀", "\t", ".", "Ω", " ", " x", "<|endoftext|>", "\r\n", "ing"]
    for n in range(400):
        kind = n % 4
        if kind == 0:
            t = "".join(rng.choice("abcdefghijklmnoinerst") for _ in range(rng.randint(700, 3000)))
        elif kind == 1:
            t = rng.choice(["a", "ab", "  ", "!", "日", "=-", "'", "l'l"]) * rng.randint(100, 900)
        elif kind == 2:
            t = "word's " + "".join(rng.choice("inerstao") for _ in range(900)) + " " * rng.randint(1, 40) + "x"
        else:
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 150)))
        block = rng.choice([3, 7, 16, 100, 600]) if len(t) < 300 else rng.choice([100, 600])
        parts = [tokens.Part(t[i : i + block], enc.encode_ordinary(t[i : i + block])) for i in range(0, len(t), block)]
        assert tokens.join_all(enc, parts) == enc.encode_ordinary(t), (n, block)


def test_ids_of_documents(spark):
    texts = ["", None, " ", "Hello world", "x" * 9000, "word " * 3000, "日本語" * 2000, "<|endoftext|>", "a\x00b", "\n" * 5000]
    df = spark.createDataFrame([(k % 8, t, "s") for k, t in enumerate(texts)], DOCS).selectExpr("*", "1 as ids", "2 as _row")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.document_ids(df, block=64).collect())
    enc = tokens.encoding()
    assert got == sorted((k % 8, enc.encode_ordinary(t) if t else []) for k, t in enumerate(texts))
    assert all(enc.decode(i) == t for i, t in [(enc.encode_ordinary(t), t) for t in texts if t])
    assert tokens.document_ids(spark.createDataFrame([], DOCS)).count() == 0


def test_patterns_fill_exactly_and_use_every_item():
    rng = np.random.default_rng(7)
    for capacity in (1, 7, 64, 512):
        for _ in range(6):
            counts = np.bincount(np.clip(rng.geometric(0.05, int(rng.integers(0, 400))), 1, capacity), minlength=capacity + 1)
            plan = packing.plan_patterns(counts, capacity)
            used = np.zeros(capacity + 1, int)
            for content, times in plan:
                assert sum(content) <= capacity and times > 0
                for x in content:
                    used[x] += times
            assert (used == counts).all()
    assert packing._exact(10, np.array([0, 0, 0, 2, 1, 0])) == [4, 3, 3]
    assert packing._exact(9, np.array([0, 0, 0, 2, 0, 0])) is None


def brute_triple(gap, left):
    have = [x for x in range(1, len(left)) if left[x]]
    ways = [(a,) for a in have] + list(itertools.combinations_with_replacement(have, 2)) + list(itertools.combinations_with_replacement(have, 3))
    return any(sum(w) == gap and all(w.count(x) <= left[x] for x in w) for w in ways)


def test_every_filling_by_up_to_three_is_found():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        left = np.zeros(int(rng.integers(3, 24)), np.int64)
        at = rng.integers(1, len(left), int(rng.integers(1, 6)))
        left[at] = rng.integers(1, 4, len(at))
        gap = int(rng.integers(1, 3 * len(left)))
        got = packing._exact(gap, left)
        assert (got is not None) == brute_triple(gap, left), (gap, left)
        assert got is None or (sum(got) == gap and all(got.count(x) <= left[x] for x in got))


def test_a_triple_behind_many_that_fail():
    left = np.zeros(400_001, np.int64)
    for b in range(120_000, 120_080):
        left[b] = left[400_000 - 2 * b] = 1
    left[[150_001, 149_998, 100_001]] = 1
    got = packing._exact(400_000, left)
    assert got is not None and sum(got) == 400_000 and len(set(got)) == 3


def test_capacities_beyond_a_million(spark):
    items = spark.createDataFrame([(p, k, 0, n) for p in (1, 2) for k, n in enumerate([1_500_000, 500_000, 7, 1_048_583])], "pack_id int, key long, piece long, length long")
    got = packing.pack_items(items, {1: 2_000_000, 2: 3_000_000}).collect()
    assert len(got) == 8
    for p, capacity in ((1, 2_000_000), (2, 3_000_000)):
        for c in {r.container_id for r in got if r.pack_id == p}:
            mine = sorted((r.start, r.length) for r in got if r.pack_id == p and r.container_id == c)
            assert sum(n for _, n in mine) <= capacity
            assert all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))


def test_runs_come_from_the_strings():
    """Any two positions within the step share a cell of one of the four grids; without a match there is no run."""
    rng = np.random.default_rng(9)
    x, y = (np.cumsum(rng.uniform(-0.03, 0.03, 20_000)) + 5e5 for _ in range(2))
    near = np.hypot(np.diff(x), np.diff(y)) <= 0.03
    found = runs.repetitions(x, y, 0.03)
    assert not found[0] and found[1:][near].all() and not found.all()
    rows = {"track_id": np.ones(len(x), np.int64), "slice": np.zeros(len(x), np.int64), "frame": np.arange(len(x)), "fps": np.full(len(x), 10.0), "x": x, "y": y, "own": np.ones(len(x), bool)}
    assert len(runs.slice_runs(rows, 0.03, 2.0)["track_id"]) > 100
    pattern, runs.REPEAT = runs.REPEAT, re.compile("(?!)")
    try:
        assert len(runs.slice_runs(rows, 0.03, 2.0)["track_id"]) == 0
    finally:
        runs.REPEAT = pattern


def test_packed_documents(spark):
    rng = random.Random(5)
    texts = ["", None, " "] + ["stop"] * 400 + ["word " * rng.randint(1, 60) for _ in range(300)] + ["long text " * 900]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS).selectExpr("*", "1 as key", "2 as length", "3 as pack_id")
    packs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 500), (3, "byte_bpe_50k", None)], "pack_id int, tokenizer string, capacity_tokens int")
    got = packing.packed_documents(docs, packs).toPandas()
    size = {k: len(tokens.encoding().encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    for pack, capacity in ((1, 64), (2, 500)):
        g = got[got["pack_id"] == pack]
        assert g.groupby("doc_id")["length"].sum().to_dict() == size
        assert all(len(x) == 1 for k, x in g.groupby("doc_id") if size[k] <= capacity)
        q = g[g["length"] > 0].sort_values(["container_id", "start"])
        for _, c in q.groupby("container_id"):
            ends = (c["start"] + c["length"]).to_numpy()
            assert c["start"].iloc[0] == 0 and (c["start"].to_numpy()[1:] == ends[:-1]).all() and ends[-1] <= capacity
        assert q["container_id"].nunique() <= math.ceil(sum(size.values()) / capacity) + 1
        for _, c in g[g["doc_id"] == len(texts) - 1].groupby("doc_id"):
            c = c.sort_values("piece")
            assert (c["doc_start"].to_numpy() == capacity * np.arange(len(c))).all()
    assert packing.packed_documents(spark.createDataFrame([], DOCS), packs).count() == 0
    assert packing.packed_documents(docs, packs.where("false")).count() == 0


SENTENCES = ["The camera stood above the gate.", "We filmed the fountain for two hours and the result was sharp.", "Somebody leaned a bicycle against the rail.", "Track seven breaks twice behind the pillar, then carries on as before.", "Please compare the grid with the older run."]


def documents():
    rng = random.Random(11)
    docs, cut = [], set()
    for k in range(900):
        source = ["mail", "form", "log"][k % 3]
        text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 14)))
        if source == "form" and len(text) > 300:
            text = text[:300]
            if text[-1] != ".":
                cut.add(k)
        elif source == "log" and k % 30 == 2:
            text = text[: rng.randint(60, len(text) - 3)].rstrip()
            if text[-1] != ".":
                cut.add(k)
        elif source == "mail" and k % 2:
            text += "\n\nCheers\nthe crew"
        elif source == "mail" and k % 4 == 0:
            text = text.rstrip(".")
        docs.append((k, text, source))
    return docs, cut


def test_truncation_finds_planted_cuts(spark):
    docs, cut = documents()
    extra = [(2000, None, "mail"), (2001, "", None), (2002, "  \n", "mail"), (2003, "ok", "mail"), (2004, '{"a": [1, 2', "log"), (2005, '{"a": [1, 2]}', "log"), (2006, "id,name,speed\n1,car,3\n2,bus", "log"), (2007, "```\nx = 1", None), (2000, None, "mail"), (2008, "x" * 20000 + ".", "mail")]
    df = spark.createDataFrame(docs + extra, DOCS).selectExpr("*", "1 as row", "2 as phrase", "3 as keys", "true as truncated")
    got = {r.doc_id for r in truncation.truncated_documents(df).collect()}
    planted = {d for d in got if d < 2000}
    assert len(planted & cut) >= 0.9 * len(cut) and len(planted - cut) <= 0.1 * len(planted)
    assert {d for d in got if d >= 2000} == {2004, 2006, 2007}
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates["form"].n_at_limit > 50 and rates["form"].rate > rates["log"].rate > rates["mail"].rate


def test_ends_are_read_whole_however_long():
    """Marks, words and lines longer than any window."""
    assert truncation.without_mark("and so on" + "." * 500) == "and so on"
    assert truncation.without_mark("and so on" + " ..." * 300 + " [more]") == "and so on"
    assert truncation.without_mark("a. " * 50 + "end") == "a. " * 50 + "end"
    rng = random.Random(6)
    for n in (1, 3, 50, 400, 3000):
        line = " ".join("".join(rng.choice("abcdefg'1.,:") for _ in range(rng.randint(1, n))) for _ in range(8)) + " last words here"
        for text in (line, "a line before\n" + line):
            whole = truncation.TOKEN.findall(line)
            assert truncation.last_tokens(text)[-4:] == whole[-4:]
    long_word = "x" * 1000
    assert truncation.last_tokens(long_word) == [long_word]
    assert truncation.ending("short wo...")[0] == "marked-ask"


def test_filter_holds_what_was_asked(spark):
    keys = [random.Random(1).getrandbits(63) * (-1) ** k for k in range(5000)]
    bits = truncation.asked_filter(spark.createDataFrame([(k,) for k in keys], "key long").repartition(5), len(keys))
    known = np.array(keys, np.int64).view(np.uint64)
    assert len(truncation.might_hold(bits, known)) == len(keys)
    others = np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert len(truncation.might_hold(bits, others)) < 5_000
    texts = [" ".join(random.Random(k).choice(SENTENCES) for _ in range(6)) + "\n- item one\n- item two" for k in range(40)]
    key, ends, on = truncation.word_runs(texts, truncation._Words())
    half = {int(k): (int(e), int(g)) for k, e, g in zip(key[::2], ends[::2], on[::2])}
    bits = truncation.asked_filter(spark.createDataFrame([(k,) for k in half], "key long"), len(half))
    got = {int(k): (int(e), int(g)) for k, e, g in zip(*truncation.word_runs(texts, truncation._Words(), bits))}
    assert half.items() <= got.items() and len(got) < len(key)


def test_rules_are_named(spark):
    docs, _ = documents()
    extra = [(2004, '{"a": [1, 2', "log"), (2009, "We filmed the fountain for two hours and the ...", "log")]
    got = {r.doc_id: r.by for r in truncation.classified(spark.createDataFrame(docs + extra, DOCS)).where("truncated").collect()}
    assert got[2004] == "structure" and got[2009] == "mark" and {"limit", "ending"} <= set(got.values())
    at = {r.doc_id for r in truncation.documents_at_limit(spark.createDataFrame(docs + extra, DOCS)).collect()}
    assert {d for d, by in got.items() if by == "limit"} <= at


def test_truncation_of_nothing(spark):
    assert truncation.truncated_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert truncation.truncation_rates(spark.createDataFrame([(1, None, None)], DOCS)).collect()[0].rate == 0.0
