"""Tokens, packing, mixing and personal data."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import boost, mixing, packing, pii, ranking, tokens


def test_token_counts_are_exact():
    count = tokens.TokenCounter()
    r = random.Random(4)
    pieces = ["the", "Straße", "l'été", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "x1", "999", "—", "don't", "A.B.", "…", " ", "日本", "é"]
    for _ in range(400):
        text = "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randrange(0, 40)))
        assert count(text) == len(count.encode(text)), repr(text)
    assert count(None) == count("") == 0
    long = "lorem ipsum " * 30_000
    assert count(long) == len(count.encode(long))


def sequential(sizes, capacity):
    """Best fit item by item, largest first; ties to the container opened first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_best_fit_is_that_of_single_items():
    r = random.Random(1)
    for _ in range(60):
        capacity = r.choice([10, 64, 512])
        sizes = Counter(r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 120)))
        used = {}
        for size, n in sizes.items():
            spans = sorted(m for m in packing.best_fit(sizes, capacity) if m[0] == size)
            for rank in range(n):
                m = [x for x in spans if x[1] <= rank][-1]
                c = m[2] + (rank - m[1]) // m[3]
                used[c] = used.get(c, 0) + size
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        assert len(used) == sequential(sizes.elements(), capacity)


def test_packing_keeps_every_token(spark):
    r = random.Random(2)
    items = [(i, r.choice([0, 3, 7, 50, 64, 65, 400, r.randrange(1, 60)])) for i in range(300)] + [(900, None), (901, -4)]
    placed = packing.pack_items(spark.createDataFrame(items, "doc_id bigint, tokens bigint"), [("s", 64), ("l", 500)]).collect()
    for kind, capacity in (("s", 64), ("l", 500)):
        own = [p for p in placed if p.container_kind == kind]
        load, size = Counter(), Counter()
        for p in own:
            size[p.doc_id] += p.tokens
            if p.container_id is None:
                assert p.tokens == 0
            else:
                load[p.container_id] += p.tokens
        assert max(load.values()) <= capacity
        assert all(size[i] == max(n or 0, 0) for i, n in items)
        for i, n in items:
            assert sum(p.doc_id == i for p in own) == max(1, -(-max(n or 0, 0) // capacity))
    assert packing.pack_items(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [("s", 64)]).collect() == []


def test_ranks_of_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(500)]
    got = ranking.spread_rank(spark.createDataFrame(rows, "id bigint, g string"), ["g"], [F.col("id")], "id", 8).collect()
    for g in ("hot", None):
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(sum(x[1] == g for x in rows)))


def test_mixing_meets_shares_and_caps(spark):
    r = random.Random(3)
    sizes = {"a": 4000, "b": 900, "c": 300}
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            n += 1
            rows.append((n, s, r.choice(["en", "de", None]), r.randrange(1, 400)))
    rows += [(90_000, "other", "en", 10), (90_001, "a", "en", None), (90_002, None, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint")
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 9)]
    mix = mixing.mix_sources(docs, targets, ["lang"]).cache()
    report = {x.source: x for x in mixing.share_report(mix, targets).collect()}
    for s, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9), ("none", 0.0)):
        assert report[s].actual_share == pytest.approx(want, abs=0.01)
        assert report[s].most_copies <= report[s].max_repeat
    langs = {x.lang: x.t for x in mix.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    corpus = Counter()
    for _, s, g, t in rows:
        if s in sizes and t:
            corpus[g] += t
    for g in corpus:
        assert langs[g] / sum(langs.values()) == pytest.approx(corpus[g] / sum(corpus.values()), abs=0.02)
    assert mixing.mix_sources(docs.limit(0), targets, ["lang"]).collect() == []


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(5)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost.BoostedTrees().fit(x[:1200], y[:1200]).calibrate(x[1200:1600], y[1200:1600])
    p = model.probability(x[1600:])
    assert ((p > boost.best_threshold(p, y[1600:])) == (y[1600:] > 0)).mean() > 0.95


GIVEN = "Ann Bea Carl Dora Emil Fritz Gina Hugo".split()
FAMILY = "Ashberg Brannford Caldmere Drenholm Eisgate Fennwick Grimsund Harrodahl".split()


def letters(n, seed):
    """Invented rulings and where their personal data lies."""
    r = random.Random(seed)
    for _ in range(n):
        parts, spans = [], []

        def add(text, kind=None):
            at = sum(map(len, parts))
            parts.append(text)
            if kind:
                spans.append((kind, at, at + len(text)))

        add("High Court\nNo. HT 415-515-1316 (9/3/2019)\n\nBefore: Judge ")
        add(f"{r.choice(GIVEN)} {r.choice(FAMILY)}", "name")
        add("\n\n")
        for _ in range(r.randrange(3, 9)):
            k = r.randrange(7)
            if k == 0:
                add("Mrs ")
                add(r.choice(FAMILY), "name")
                add(" submitted that the clause was void. ")
            elif k == 1:
                add("Tel. ")
                add(f"+999 {r.randrange(100, 999)} 555 0{r.randrange(100, 199)}", "phone")
                add("; no fax. ")
            elif k == 2:
                add("Nat. ID: ")
                add(f"{r.randrange(900, 999)}-0{r.randrange(1, 9)}-{r.randrange(1000, 9999)}", "id_number")
                add(". ")
            elif k == 3:
                add("Service was effected at ")
                add(f"{r.choice(GIVEN).lower()}.x{r.randrange(99)}@mail.test", "email")
                add(". ")
            elif k == 4:
                add("The crane was posted to ")
                add(f"{r.randrange(1, 200)} Quillon Street, Ashwick NQ{r.randrange(1, 9)} 2TR", "address")
                add(". ")
            elif k == 5:
                add(f"In R v {r.choice(FAMILY)}, {r.randrange(1, 90)} Vell. Rep. {r.randrange(1, 900)} (1982), the point was decided. Quillmere Housing Trust accepted it on 4/5/2020. ")
            else:
                add(f"{r.choice(FAMILY).upper()}, {r.choice(GIVEN)}", "name")
                add(" gave evidence by video link. Mr X, identity number ████, signed the lease. ")
        yield "".join(parts), spans


def test_personal_data_held_out(spark):
    train, held = list(letters(500, 1)), list(letters(200, 2))
    detector = pii.Detector.fit([t for t, _ in train])
    found = detector.find([t for t, _ in held])
    want = Counter((i, *s) for i, (_, spans) in enumerate(held) for s in spans)
    got = Counter((i, k, a, b) for i, spans in enumerate(found) for k, a, b, _ in spans)
    hits = sum((want & got).values())
    assert hits / sum(want.values()) > 0.97 and hits / sum(got.values()) > 0.97
    rows = [(i, t) for i, (t, _) in enumerate(held[:20])] + [(100, None), (101, ""), (102, "plain words, nothing else. " * 20_000), (0, held[0][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark_found = Counter((r.doc_id, r.kind, r.start_char, r.end_char) for r in pii.find_personal(df, detector=detector).collect())
    assert all(spark_found[(i, k, a, b)] == (2 if i == 0 else 1) for i in range(20) for k, a, b, _ in found[i])
    assert not any(i >= 100 for i, *_ in spark_found)
    red = {r.doc_id: r for r in pii.redact_personal(df, detector=detector).collect()}
    assert red[100].text is None and red[101].text == "" and red[102].redactions == 0
    assert "@mail.test" not in red[3].text
    assert pii.find_personal(df.limit(0), detector=detector).collect() == []


def notes(n, seed):
    """Notes whose phrases no rule names: only a title or an announcing word here and there says what is what."""
    r = random.Random(seed)
    number = lambda: f"0{r.randrange(20, 99)} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)}"
    for _ in range(n):
        parts, spans = [], []

        def add(text, kind=None):
            at = sum(map(len, parts))
            parts.append(text)
            if kind:
                spans.append((kind, at, at + len(text)))

        for _ in range(r.randrange(3, 8)):
            k = r.randrange(6)
            if k == 0:
                add("The caller left ")
                add(number(), "phone")
                add(" with the desk. ")
            elif k == 1:
                add("Phone: ")
                add(number(), "phone")
                add(". ")
            elif k == 2:
                add(f"{r.choice(('Dr', 'Mrs', 'Mr'))} ")
                add(r.choice(FAMILY), "name")
                add(" cancelled lunch. ")
            elif k == 3:
                add(f"{r.choice(GIVEN)} {r.choice(FAMILY)}", "name")
                add(" cancelled lunch. ")
            elif k == 4:
                add(f"The pump, serial {r.randrange(10, 99)}-{r.randrange(100000, 999999)}, was sold by Hallow Marine Ltd. Order no. {r.randrange(10, 99)}-{r.randrange(100000, 999999)}. ")
            else:
                add(f"Item § {r.randrange(10, 99)}-{r.randrange(100000, 999999)} of page 3 was paid. ")
        yield "".join(parts), spans


def test_phrases_no_rule_names():
    train, held = list(notes(500, 3)), list(notes(200, 4))
    detector = pii.Detector.fit([t for t, _ in train])
    got = Counter((i, k, a, b) for i, spans in enumerate(detector.find([t for t, _ in held])) for k, a, b, _ in spans)
    want = Counter((i, *s) for i, (_, spans) in enumerate(held) for s in spans)
    rules = Counter((i, kind, c.start, c.end) for i, (t, _) in enumerate(held) for c in pii.candidates(t) for kind in c.kinds if pii.label(t, c, kind))
    hits = sum((want & got).values())
    assert hits / sum(want.values()) > 0.95 and hits / sum(got.values()) > 0.95
    assert sum((want & rules).values()) / sum(want.values()) < 0.8  # the rules alone don't find them


def test_candidates_of_any_length():
    spans = lambda text, kind: {text[c.start : c.end] for c in pii.candidates(text) if kind in c.kinds}
    assert "Anna Maria Berger" in spans("and Anna Maria Berger left", "name")
    assert "12345\n6789" in spans("card no. 12345\n6789 was", "id_number")
    assert "+999-247-555-0148 ext. 84" in spans("on +999-247-555-0148 ext. 84 at", "phone")
    assert "Old Tannery Lane, Ashwick NQ7 7TR" in spans("found at Old Tannery Lane, Ashwick NQ7 7TR.", "address")
    assert "P.O.  Box 5225, Sault-Merle" in spans("at P.O.  Box 5225, Sault-Merle were", "address")


def test_without_labels_nothing_is_found():
    assert pii.Detector.fit([]).find(["Mr Berger, tel. 030 1234 5678"]) == [[]]
    assert pii.Detector.fit(["no data at all"]).find([None, "", "Mr Berger"])[:2] == [[], []]


def test_full_pieces_and_ties(spark):
    items = [(i, 512) for i in range(50)] + [(100 + i, 300) for i in range(40)] + [(200, 5 * 512 + 10), (201, None), (202, 0)]
    placed = packing.pack_items(spark.createDataFrame(items, "doc_id bigint, tokens bigint").repartition(5), [("x", 512)]).collect()
    load = Counter()
    for r in placed:
        if r.container_id is not None:
            load[r.container_id] += r.tokens
    assert sum(load.values()) == 50 * 512 + 40 * 300 + 5 * 512 + 10 and max(load.values()) <= 512
    assert sorted(load) == list(range(len(load))) and len(load) == 50 + 40 + 5
    assert {r.doc_id for r in placed if r.container_id is None} == {201, 202}


def test_raking_that_cannot_settle_says_so():
    cells = [{"source": "a", "lang": "x", "tokens": 100.0}, {"source": "b", "lang": "y", "tokens": 100.0}]
    with pytest.warns(UserWarning, match="still moving"):
        mixing.rake(cells, {"a": 0.9, "b": 0.1}, {"a": 2, "b": 2}, ["lang"], rounds=5)
