"""Nearest times, runs and turns against plain loops."""

import random

import numpy as np
import pytest

from turnloom.llm.nearest_time import XFastTrie, nearest_in_time
from turnloom.llm.runs import collapse_runs, edit_similarity
from turnloom.llm.turns import clean_text, speaker_turns


def test_trie_against_search():
    r = np.random.default_rng(1)
    for bits in (1, 4, 11, 20):
        keys = r.integers(0, 1 << bits, 50)
        query = r.integers(0, 1 << bits, 300)
        trie = XFastTrie(keys, bits)
        before, after = trie.neighbours(query)
        known = np.unique(keys)
        assert (before == np.searchsorted(known, query, side="right") - 1).all()
        at = np.searchsorted(known, query, side="left")
        assert (after == np.where(at < len(known), at, -1)).all()
    assert [x.tolist() for x in XFastTrie(np.array([], np.int64), 4).neighbours(np.array([3]))] == [[-1], [-1]]


RECORDS = "s string, t bigint, rec bigint, note string"
LABELS = "s string, t bigint, lab bigint, note string"


@pytest.mark.parametrize("seed,chunk", [(1, 10), (2, 64), (3, 100_000)])
def test_nearest_against_a_loop(spark, seed, chunk):
    r = random.Random(seed)
    rec = [(r.choice("ab"), r.randrange(-50, 400), i, "x") for i in range(150)] + [(None, 3, 900, "x"), ("a", None, 901, "x")]
    lab = [(r.choice("abc"), r.randrange(-50, 400), 1000 + i, "y") for i in range(90)] + [("a", None, 3, "y"), (None, 3, 4, "y")]
    lab += [(s, t, i + 500, n) for s, t, i, n in lab[:10] if t is not None]
    want = set()
    for s, t, i, _ in rec:
        if s is not None and t is not None:
            near = min(((abs(u - t), j) for q, u, j, _ in lab if q == s and u is not None), default=None)
            if near and near[0] <= 6:
                want.add((i, near[1], near[0]))
    found = nearest_in_time(spark.createDataFrame(rec, RECORDS), spark.createDataFrame(lab, LABELS), ["s"], "t", "rec", "lab", 6, chunk=chunk)
    got = [(x.rec, x.lab, x.distance) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_empty(spark):
    none_r, none_l = spark.createDataFrame([], RECORDS), spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([("a", 1, 1, "x")], RECORDS)
    assert nearest_in_time(one, none_l, ["s"], "t", "rec", "lab", 5).collect() == []
    assert nearest_in_time(none_r, none_l, ["s"], "t", "rec", "lab", 5).collect() == []


def brute_runs(rows, gap):
    out, cur = [], None
    for s, t, i, same in sorted((x for x in rows if x[1] is not None and x[3] is not None), key=lambda x: (str(x[0]), x[1], x[2])):
        if cur and cur[0] == s and cur[1] == same and t - cur[5] <= gap:
            cur[3], cur[4], cur[5] = i, cur[4] + 1, t
        else:
            if cur:
                out.append(tuple(cur))
            cur = [s, same, i, i, 1, t]
    return set(out + ([tuple(cur)] if cur else []))


@pytest.mark.parametrize("seed,chunk", [(1, 5), (2, 40), (3, 10_000)])
def test_runs_against_a_loop(spark, seed, chunk):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randrange(0, 300), i, r.choice("xxy")) for i in range(250)] + [("a", None, 900, "x"), ("a", 5, 901, None)]
    df = spark.createDataFrame(rows, "s string, t bigint, i bigint, same string").withColumnRenamed("same", "label")
    got = {(x.s, x.label, x.first_id, x.last_id, x.events, x.last_start) for x in collapse_runs(df, ["s"], "t", "i", "label", 4, chunk=chunk).collect()}
    assert got == brute_runs(rows, 4)
    assert collapse_runs(df.limit(0), ["s"], "t", "i", "label", 4).collect() == []


def test_clean_text():
    cases = {
        "[ applause ] um the lease": "the lease", "A: okay": "okay", ">> so": "so", "SPK_00> hmmm— why?": "why?", "((crosstalk)) er,": "", "♪ hold music ♪": "", "-": "", None: "", "": "",
        "5:": "", "the- the summary": "the summary", "they they- should": "they should", "[inaudible 00:01:15] mm-hmm": "", "(keyboard": "", "ähm Erm... no.": "no.",
        "00:00:01,000 --> 00:00:02,000\nhello {door slams} there": "hello there", "  THE SCHEDULE ": "THE SCHEDULE", "umbrella": "umbrella",
    }
    for text, want in cases.items():
        assert clean_text(text) == want, text
    assert clean_text("word " * 50_000).count("word") == 50_000


def test_a_lone_note_is_a_mark():
    cases = {
        "the ♪ floor plan": "the floor plan", "♪ the lease": "the lease", "the lease ♪": "the lease", "♪ A: okay": "okay", "♪": "", "♪ uhm": "", "♫ so": "so",
        "a new ♪ hold music ♪ badge ♪ then": "a new badge then", "then ♪ hold music": "then", "♪ we forgot\nthe list ♪": "we forgot the list",
    }
    for text, want in cases.items():
        assert clean_text(text) == want, text


def test_turns(spark):
    rec = [("s", 0, 5, 1, "um hello"), ("s", 7, 9, 2, "[noise]"), ("s", 8, 9, 3, "there"), ("s", 30, 31, 4, "again"), ("s", 33, 34, 5, "bye"), ("s", 90, 91, 6, "far from all")]
    lab = [("s", 1, 10, "A"), ("s", 8, 11, "A"), ("s", 30, 12, "A"), ("s", 33, 13, "B")]
    df = spark.createDataFrame(rec, "s string, t bigint, e bigint, rec bigint, text string")
    found = speaker_turns(df, spark.createDataFrame(lab, "s string, t bigint, lab bigint, who string"), ["s"], "t", "rec", "text", "lab", "who", 2, 10, end="e")
    got = {(r.speaker, r.first_id, r.last_id, r.records, r.text, r.end) for r in found.collect()}
    assert got == {("A", 1, 3, 2, "hello there", 9), ("A", 4, 4, 1, "again", 31), ("B", 5, 5, 1, "bye", 34)}


def test_tolerance_longer_than_a_slice(spark):
    left = spark.createDataFrame([("a", 1, 10_000)], "e string, id bigint, t bigint")
    right = spark.createDataFrame([("a", 7, 10_450), ("a", 8, 9_100)], "e string, rid bigint, t bigint")
    found = nearest_in_time(left, right, ["e"], "t", "id", "rid", tolerance=1_000, chunk=100).collect()
    assert [(r.id, r.rid, r.distance) for r in found] == [(1, 7, 450)]


def near_runs(rows, gap, least):
    """Of (entity, time, id, value), each event is compared with the open run's first value."""
    out, run = [], None
    for e, t, i, v in sorted(rows):
        if run and run[0] == e and t - run[4] <= gap and edit_similarity(run[1], v) >= least:
            run = (*run[:3], i, t, run[5] + 1)
        else:
            out += [run] if run else []
            run = (e, v, i, i, t, 1)
    return out + ([run] if run else [])


@pytest.mark.parametrize("seed", range(3))
def test_near_identical_events(spark, seed):
    r = random.Random(seed)
    words = ["engine stopped", "engine stoped", "engine stopped!", "engine started", "door open", "door opened", "d00r open"]
    rows = [(r.choice("ab"), r.randrange(400), i, r.choice(words)) for i in range(120)]
    df = spark.createDataFrame(rows, "e string, t bigint, id bigint, v string")
    found = collapse_runs(df, ["e"], "t", "id", "v", 15, chunk=50, similarity=edit_similarity, least=0.85).collect()
    got = sorted((x.e, x.v, x.first_id, x.last_id, x.last_start, x.events) for x in found)
    assert got == sorted(near_runs(rows, 15, 0.85))
    assert len(got) < len(collapse_runs(df, ["e"], "t", "id", "v", 15, chunk=50).collect())


def test_long_lines_and_groups_take_linear_time():
    import time

    began = time.time()
    assert clean_text("[cough] " * 20_000) == ""
    assert time.time() - began < 5
    import pyarrow as pa

    from turnloom.llm.slabs import slabs

    batch = pa.record_batch({"k": pa.array(["a"] * 1000)})
    began = time.time()
    assert [t.num_rows for t in slabs((batch for _ in range(3000)), ["k"], 1000)] == [3_000_000]
    assert time.time() - began < 10
