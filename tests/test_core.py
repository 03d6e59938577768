"""Labels, joins, sequences, clustering and metrics on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import labels, pcm, text, vector
from turnloom.operators import clustering, diarization, joins, reports, sequence
from turnloom.operators.assignment import assign
from turnloom.operators.deliveries import first_delivery
from turnloom.operators.graph import connected_components
from turnloom.sources import audio, messages, rttm


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_labels(spark):
    given = ["AUTO : a", "auto：B", "​auto/c ", "DEV2: REGISTERED:Ann-Lee Poe", "dev0:stored:anon_004", "Auto\xa0:\xa0D", "unknown", " ", None, "auto:Z", "registered:", "x:y", "auto: "]
    want = ["auto:A", "auto:B", "auto:C", "registered:ann_lee_poe", "stored:anon_004", "auto:D", None, None, None, None, None, None, None]
    assert column(spark, given, "string", labels.clean_label) == want


def test_text_functions(spark):
    assert column(spark, ["a. ", "b…", "c", ""], "string", text.ends_sentence) == [True, True, False, False]
    assert column(spark, ["a/B-c", "__x__", "9"], "string", text.slug) == ["a_b_c", "x", "9"]
    assert column(spark, ["anon_012", "anon_x", "zanon_1", None], "string", text.anon_number) == [12, None, None, None]
    assert column(spark, ["o'c"], "string", text.sql_literal) == ["'o''c'"]


def test_pcm(spark):
    data = np.array([0, 1, -1, 32767, -32768], "<i2").tobytes()
    assert column(spark, [data, b""], "binary", pcm.samples) == [[0, 1, -1, 32767, -32768], []]
    with pytest.raises(Exception, match="odd number"):
        column(spark, [b"abc"], "binary", pcm.samples)
    assert column(spark, [data], "binary", lambda c: pcm.time_slice(c, F.lit(0.0), F.lit(1 / 16000), F.lit(3 / 16000))) == [data[2:6]]
    law = column(spark, [0, 1, 159_999, 160_000, 176_000, 200_123], "bigint", lambda n: pcm.window_offsets(n, 160_000, 16_000))
    for n, got in zip([0, 1, 159_999, 160_000, 176_000, 200_123], law):
        whole = max(0, (n - 160_000) // 16_000 + 1) if n >= 160_000 else 0
        assert len(got) == whole + (n > 0) and got == [i * 16_000 for i in range(len(got))]


def test_vector_errors(spark):
    assert column(spark, [[3.0, 4.0]], "array<float>", vector.l2_normalize)[0] == pytest.approx([0.6, 0.8])
    for bad in ([0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="no direction"):
            column(spark, [bad], "array<float>", vector.l2_normalize)
    assert column(spark, [[0.0, 0.0]], "array<float>", vector.l2_normalize_lenient) == [[0.0, 0.0]]


def test_first_delivery(spark):
    rows = [("s", "u", 5, "late"), ("s", "u", 2, "first"), ("s", None, 7, "x"), ("s", None, 8, "y"), ("t", "u", 1, "z"), ("t", "u", None, "w")]
    df = spark.createDataFrame(rows, "session string, utt string, id bigint, label string")
    got = {(r.id, r.label) for r in first_delivery(df, ["session", "utt"], "id", {"label": F.col("label")}).collect()}
    assert got == {(2, "first"), (7, "x"), (8, "y"), (1, "z"), (None, "w")}


def test_interval_join_finds_every_pair_once(spark):
    r = random.Random(5)
    make = lambda n: [(r.choice("ab"), i, (s := r.randrange(300)), s + r.choice([0, 1, 5, 90])) for i in range(n)]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "k string, i int, s1 bigint, e1 bigint"), spark.createDataFrame(b, "k string, j int, s2 bigint, e2 bigint")
    got = [(x.i, x.j) for x in joins.interval_join(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), 16).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2]}
    assert len(got) == len(set(got)) and set(got) == want
    kept = joins.interval_join(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), 16, how="left").collect()
    assert {x.i for x in kept} == {x[1] for x in a}


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, t int, v string")
    got = lambda **o: {r.id: r.v for r in joins.asof(left, right, ["k"], "t", ["v"], **o).collect()}
    assert got() == {1: "y", 2: None, 3: None}
    assert got(exact=False) == {1: "x", 2: None, 3: None}
    assert got(forward=True) == {1: "y", 2: "x", 3: None}
    for chunk in (1, 2, 100):
        assert got(chunk=chunk) == got() and got(chunk=chunk, forward=True) == got(forward=True) and got(chunk=chunk, exact=False) == got(exact=False)


def test_nearest_vector_by_matrix_key_and_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id int, v array<double>")
    known = df.withColumnRenamed("id", "k")
    got = joins.nearest_vector(df, known, "id", "v", "k", "v", 0.9).collect()
    assert len(got) == 5 and all(r.k == 0 for r in got)
    r = np.random.default_rng(4)
    x = r.standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)] + [(90, "a", None), (91, "a", [1.0])]
    probes = spark.createDataFrame(rows, "id bigint, g string, v array<double>")
    known = probes.select(F.col("id").alias("k"), "g", F.col("v").alias("w"))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = {i: int(s[i].argmax()) for i in range(40) if s[i].max() >= 0.3}
    for bound in (64 << 20, 400):
        found = joins.nearest_vector(probes, known, "id", "v", "k", "w", 0.3, max_bytes=bound, not_itself=True).collect()
        assert {f.id: f.k for f in found} == best
        assert all(abs(f.similarity - s[f.id, f.k]) < 1e-12 for f in found)
    s[(np.arange(40)[:, None] + np.arange(40)) % 2 == 1] = -2
    best = {i: int(s[i].argmax()) for i in range(40) if s[i].max() >= 0.3}
    for bound in (64 << 20, 400):
        found = joins.nearest_vector(probes, known, "id", "v", "k", "w", 0.3, on=["g"], max_bytes=bound, not_itself=True).collect()
        assert {f.id: f.k for f in found} == best
    assert joins.nearest_vector(probes, known.limit(0), "id", "v", "k", "w", 0.3).collect() == []


def test_a_damaged_interval_stays_few_rows(spark):
    left = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 5, 40_000_000_000)], "k string, i int, s1 bigint, e1 bigint")
    right = spark.createDataFrame([("a", j, j * 1_000_000, j * 1_000_000 + 7) for j in range(30)] + [("a", 99, 3, 30_000_000_000)], "k string, j int, s2 bigint, e2 bigint")
    got = {(x.i, x.j) for x in joins.interval_join(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), 10_000).collect()}
    assert got == {(1, 0), (1, 99), (2, 0), (2, 99)} | {(2, j) for j in range(1, 30)}


def test_adaptive_moves_leave_locked_and_distant_rows(spark):
    rows = [("s", 1, "auto:A", False, [1.0, 0.0]), ("s", 2, "auto:A", False, [0.0, 1.0]), ("s", 3, "auto:A", True, [0.0, 1.0]), ("s", 4, None, False, [0.0, 1.0]),
            ("s", 5, "auto:B", None, [-1.0, 0.0]), ("t", 6, "auto:A", False, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "session string, id int, label string, is_locked boolean, v array<double>")
    centres = spark.createDataFrame([("s", "auto:A", [1.0, 0.0]), ("s", "auto:B", [0.0, 1.0]), ("s", "auto:C", [0.0, 0.0])], "session string, c string, w array<double>")
    moves = lambda delta: {(r.id, r.new_label) for r in clustering.adaptive_moves(df, centres, "session", "id", "label", "v", "c", "w", delta).collect()}
    assert moves(0.5) == {(2, "auto:B")} and moves(2.0) == {(2, "auto:B")}
    row = clustering.adaptive_changes(df, centres, "session", "id", "label", "v", "c", "w", 0.5).collect()
    assert [(r.old_label, r.new_label, r.n, r.ids, r.reason) for r in row] == [("auto:A", "auto:B", 1, [2], "recluster")]


def test_inactive_speakers_get_no_centre():
    centers = clustering.OnlineCenters(0.5, 0.3, 20, tau_active=0.6)
    x = np.eye(3)
    assert centers.assign(x, np.array([0.5, 0.5, 0.5]), np.array([0.9, 0.5, 0.7])) == [0, -1, 1]


def test_known_speakers_come_first(spark):
    rows = [("s", 1, [1.0, 0.0], 2.0, None), ("s", 2, [0.0, 1.0], 2.0, "stored:ann"), ("s", 3, [0.0, 1.0], 0.1, None), ("s", 4, [1.0, 0.0], 2.0, None)]
    df = spark.createDataFrame(rows, "session string, id int, v array<double>, seconds double, known string")
    got = {r.id: r.label for r in clustering.identify_phrases(df, "session", "id", "v", "seconds", known="known").collect()}
    assert got == {1: "auto:A", 2: "stored:ann", 3: "stored:ann", 4: "auto:A"}


def test_reasons_of_phrase_parts(spark):
    rows = [("p", 0, 10, "One."), ("p", 12, 20, "two"), ("p", 60, 70, "three"), ("q", 0, 5, "four"), ("r", 0, 5, "five"), ("r", 50, 60, "six."), ("u", 0, 5, "a."), ("u", 80, 90, "b")]
    df = spark.createDataFrame(rows, "p string, s bigint, e bigint, t string")
    found = sequence.phrase_parts(df, ["p"], ["s"], "s", "e", "t", 30).collect()
    assert {r.p: r.reason for r in found} == {"p": "both", "q": "none", "r": "both", "u": "sentence"}
    assert [r.part for r in sorted(found, key=lambda r: (r.p, r.s))] == [0, 1, 2, 0, 0, 1, 0, 1]


def test_audio_of_any_rate(spark):
    import struct

    def wav(x, rate, bits):
        width = bits // 8
        whole = np.clip(np.rint(x * 2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype(int)
        data = b"".join(int(v + (128 if bits == 8 else 0)).to_bytes(width, "little", signed=bits != 8) for v in whole.ravel())
        n = x.shape[1]
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * n * width, n * width, bits) + b"data" + struct.pack("<I", len(data)) + data

    for rate, bits in ((44_100, 16), (8_000, 24), (16_000, 8), (48_000, 32)):
        t = np.arange(rate) / rate
        tone = 0.5 * np.sin(2 * np.pi * 440 * t)
        content = wav(np.stack([tone, tone * 0.5], axis=1), rate, bits)
        mono = audio.mono_slice(content, 0.25, 0.5)
        assert len(mono) == 8_000
        want = 0.375 * np.sin(2 * np.pi * 440 * (0.25 + np.arange(8_000) / 16_000))
        assert np.abs(mono - want).max() < 0.02
    df = spark.createDataFrame([("a", content)], "k string, c binary")
    assert len(audio.mono_of(df, "c", "k").first().samples) == 16_000


def test_bytes_left_of_a_chunk_go_before_the_next(spark):
    frames = np.arange(40, dtype="<i2").tobytes()
    cuts = [0, 1, 7, 7, 30, 31, 80]
    rows = [("a", i, frames[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))] + [("b", 0, frames[:5]), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, pcm binary")
    found = sorted(audio.mixed_stream(df, "k", "i", "pcm", 2, "sum").collect())
    assert b"".join(bytes(r.pcm) for r in found if r.k == "a") == audio.mix_down(frames, 2, "sum")
    assert b"".join(bytes(r.pcm) for r in found if r.k == "b") == audio.mix_down(frames[:4], 2, "sum")


def test_results_of_json_and_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"sample": "a", "metrics": {"der": 0.5, "x": "bad"}}, {"sample": "b", "metrics": null}]')
    rows = {r.sample: r.metrics for r in messages.read_json_results(spark, str(tmp_path / "r.json"), ["der", "x", "y"]).collect()}
    assert tuple(rows["a"]) == (0.5, 0.0, 0.0) and tuple(rows["b"]) == (0.0, 0.0, 0.0)
    lines = [("a.csv", 1, 'run,"der",note'), ("a.csv", 2, 'r1,0.25,"x, ""y"""'), ("a.csv", 3, "r2,,z"), ("a.csv", 3, "r2,,z"), ("a.csv", 4, "cut,0"), ("b.jsonl", 1, '{"m": {"der": 0.75}}'),
             ("b.jsonl", 2, '{"der": "0.5"}'), ("b.jsonl", 3, '{"der": 0.'), ("b.jsonl", 4, '{"x": 1}'), ("b.jsonl", 5, None)]
    found = messages.metric_of_lines(spark.createDataFrame(lines, "file_name string, line_no int, raw string"), "der").collect()
    assert {(r.file_name, r.line_no): r.value for r in found} == {("a.csv", 2): 0.25, ("a.csv", 3): None, ("b.jsonl", 1): 0.75, ("b.jsonl", 2): 0.5, ("b.jsonl", 4): None}
    out = str(tmp_path / "all")
    for n in (3, 2):
        messages.write_json_array(spark.range(n), out)
        import json

        assert json.loads(spark.read.text(out).first()[0]) == [{"id": i} for i in range(n)]
    with pytest.raises(ValueError):
        messages.write_json_array(spark.range(5), out, most=4)


def test_assignment_against_permutations():
    r = np.random.default_rng(1)
    for _ in range(300):
        n, m = map(int, r.integers(1, 6, 2))
        c = r.random((n, m)).round(1)
        got = assign(c)
        wide = c if n <= m else c.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert len(got) == min(n, m) and sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def clouds(seed=0, n=8, groups=3, dim=16):
    r = np.random.default_rng(seed)
    return np.vstack([np.eye(dim)[g] + r.normal(0, 0.05, (n, dim)) for g in range(groups)]), np.repeat(np.arange(groups), n)


def test_density_clusters():
    x, truth = clouds()
    x = clustering.unit_rows(x)
    found = clustering.hdbscan(clustering.distances(x), 2, 1, 0.3)
    assert len({(a, b) for a, b in zip(found, truth)}) == 3 and (found >= 0).all()
    # The root is never a cluster: rows that leave it one by one are all noise, and then all one cluster.
    line = np.abs(np.subtract.outer(*[np.array([0.0, 1, 3, 7, 15])] * 2))
    assert (clustering.hdbscan(line, 2, 1, 0.3) == -1).all()
    assert (clustering.absorb_noise(x[:5], np.full(5, -1)) == 0).all()
    assert list(clustering.hdbscan(np.zeros((1, 1)))) == [-1]


def test_long_sessions_are_clustered_whole(spark, tmp_path):
    from turnloom.plans.vectors import QUERIES

    x, truth = clouds(4, n=400)
    assert (clustering.hdbscan_of_rows(x, 60) == clustering.hdbscan(clustering.distances(x), 60)).all()
    rows = [("s", f"u{i:04}", i, "auto:A", False, v.tolist(), "m", float(i), i + 1.0) for i, v in enumerate(x)]
    # 21 pairs: more clusters than letters.
    wide = np.repeat(np.eye(21), 2, axis=0)
    rows += [("w", f"w{i:04}", 5000 + i, "auto:A", False, v.tolist(), "n", float(i), i + 1.0) for i, v in enumerate(wide)]
    columns = "session_id string, utterance_id string, segment_id bigint, label string, is_locked boolean, embedding array<double>, model_id string, t_start double, t_end double"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/speaker_segment.parquet")
    spark.createDataFrame([("m", x.shape[1]), ("n", 21)], "model_id string, embedding_dim int").write.parquet(f"{tmp_path}/speaker.parquet")
    found = QUERIES["c1_final_recluster"](spark, str(tmp_path)).collect()
    own = {r.utterance_id: r.cluster for r in found if r.session_id == "s"}
    assert len(own) == len(x) and len({(own[i], int(g)) for i, g in zip(range(len(x)), truth)}) == 3
    assert sum(r.session_id == "w" and r.label is None and r.cluster is not None for r in found) == 42


def test_tree_of_a_long_session_by_many_tasks(spark):
    x, _ = clouds(4, n=300)
    x[5], x[700] = x[400], x[6]  # exact copies
    tree = clustering._spanning_tree(clustering.distances(x))
    for block in (7, 200, 2_000):
        assert clustering._least_edges(len(x), clustering._block_edges(x, len(x), block))[:, 0] == pytest.approx(np.array([w for w, _, _ in tree]), abs=1e-9)
    columns = "session_id string, utterance_id string, label string, is_locked boolean, embedding array<double>, t_start double, t_end double"
    rows = spark.createDataFrame([("s", f"u{i:04}", "auto:A", False, v.tolist(), float(i), i + 1.0) for i, v in enumerate(x)], columns)
    edges = clustering.spanning_edges(rows, most_alone=100, most_part=200)
    assert edges.count() >= len(x) - 1 and clustering.spanning_edges(rows).count() == 0
    alone = {(r.utterance_id, r.cluster, r.label, r.noise) for r in clustering.final_recluster(rows).collect()}
    assert {(r.utterance_id, r.cluster, r.label, r.noise) for r in clustering.final_recluster(rows, edges=edges).collect()} == alone


def test_tree_of_many_voices_compares_closely_what_bounds_leave(spark):
    x, _ = clouds(6, n=40, groups=16)
    x[5], x[601] = x[400], x[6]  # exact copies
    x = clustering.unit_rows(x)
    tree = [w for w, _, _ in clustering._spanning_tree(clustering.distances(x))]
    columns = "session_id string, utterance_id string, is_locked boolean, embedding array<double>"
    rows = spark.createDataFrame([("s", f"u{i:04}", False, v.tolist()) for i, v in enumerate(x)], columns)
    for marks, near in ((300, 0.4), (50, 0.1), (300, 3.0), (1, 0.4)):  # voices, parts of voices, one voice
        edges = clustering.spanning_edges(rows, most_alone=100, most_part=200, marks=marks, near=near).collect()
        found = np.array([(e.w, int(e.a[1:]), int(e.b[1:])) for e in edges])
        assert clustering._least_edges(len(x), found)[:, 0] == pytest.approx(np.array(tree), abs=1e-9)
        # Trees of all pairs of parts would be several times the rows.
        assert near != 0.4 or marks == 1 or len(edges) < 2 * len(x)


def test_passes_go_on_from_the_labels_of_the_same_beginning(spark, monkeypatch):
    from turnloom.plans.vectors import QUERIES

    ran, whole = [], clustering.post_pass
    monkeypatch.setattr(clustering, "post_pass", lambda rows, passes, *a, **k: (ran.append(passes), whole(rows, passes, *a, **k))[1])
    QUERIES["c7_post_passes"](spark, "/root/testdata/sf0.001")
    assert [p for passes in ran for p in passes].count("adaptive") == 1


@pytest.mark.parametrize("name", ["c1_final_recluster", "c7_label_changes", "a28_cluster_diagnostics"])
def test_utterances_are_read_once(spark, monkeypatch, name):
    from turnloom.plans.vectors import QUERIES

    given, whole = [], clustering.final_recluster
    monkeypatch.setattr(clustering, "final_recluster", lambda rows, *a, **k: (given.append(rows), whole(rows, *a, **k))[1])
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert given[0].inputFiles() == []


def test_letters_keep_known_ones():
    x, truth = clouds()
    known = {"auto:B": x[0], "auto:A": x[8]}
    got = clustering.issue_letters(clustering.unit_rows(x), truth, np.ones(len(x)), known)
    assert got == {0: "auto:B", 1: "auto:A", 2: "auto:C"}
    with pytest.raises(RuntimeError):
        clustering.issue_letters(np.eye(21), np.arange(21), np.ones(21), {})


def test_online_centers_never_share_a_center_in_a_window():
    x, _ = clouds()
    centers = clustering.OnlineCenters(delta_new=0.5)
    assert centers.assign(x[[0, 8]], np.array([0.9, 0.9])) == [0, 1]
    assert centers.assign(x[[9, 1]], np.array([0.9, 0.9])) == [1, 0]
    assert centers.assign(x[[16]], np.array([0.9])) == [2]
    assert centers.assign(np.array([[np.nan] * 16]), np.array([0.9])) == [-1]


def frames(rows, step=1):
    out = {}
    for uri, s, e, label in rows:
        for t in range(s, e, step):
            out.setdefault((uri, t), set()).add(label)
    return out


def test_der_against_frame_counting(spark):
    r = random.Random(8)
    make = lambda names: [("u", (s := r.randrange(200)), s + r.randrange(1, 30), r.choice(names)) for _ in range(25)]
    ref, hyp = make("ab"), make("xyz")
    schema = "uri string, start bigint, end bigint, label string"
    got = diarization.der(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), "uri", 16).first()
    fr, fh = frames(ref), frames(hyp)
    best = None
    for p in itertools.permutations("xyz", 2):
        m = dict(zip(p, "ab"))
        miss = fa = conf = total = 0
        for k in set(fr) | set(fh):
            a, b = fr.get(k, set()), {m.get(h, h) for h in fh.get(k, set())}
            total += len(a)
            miss += max(0, len(a) - len(b))
            fa += max(0, len(b) - len(a))
            conf += min(len(a), len(b)) - len(a & b)
        if best is None or miss + fa + conf < sum(best[1:]):
            best = (total, miss, fa, conf)
    assert (got.total, got.miss, got.false_alarm, got.confusion) == best
    same = diarization.der(spark.createDataFrame(ref, schema), spark.createDataFrame(ref, schema), "uri", 16).first()
    assert same.der == 0


def test_adaptive_triggers(spark):
    rows = [("s", i, float(t)) for i, t in enumerate([0, 1, 2, 3, 40, 41, 42, 43, 44])]
    df = spark.createDataFrame(rows, "s string, n int, t double")
    assert sorted(r.fired for r in sequence.adaptive_triggers(df, ["s"], ["n"], "t", 3, 30.0).collect()) == [2.0, 40.0, 43.0]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double")
    assert df.agg(reports.nearest_rank(F.col("x"), 50).alias("y")).first().y == 3.0
    assert diarization.percentile_nearest(np.array([1, 2, 3, 4]), 50) == 3.0


def test_rttm_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("a", 0.5, 1.25, "S1"), ("a", 2.0, 2.0, "S2"), ("b", 0.0, 3.0, "S1")], rttm.TURNS)
    rttm.write_rttm(turns, str(tmp_path / "x"))
    got = {tuple(r) for r in rttm.read_rttm(spark, str(tmp_path / "x")).collect()}
    assert got == {("a", 0.5, 1.25, "S1"), ("b", 0.0, 3.0, "S1")}
    odd = spark.createDataFrame([("; note a b c d e f g h",), ("LEXEME f 1 0.5 1 <NA> <NA> S",), ("SPEAKER f 1 x 1 <NA> <NA> S <NA>",), ("",)], "value string")
    assert rttm.parse_rttm(odd).count() == 0 and rttm.parse_rttm(odd, lenient=True).count() == 1


def test_audio(spark, tmp_path):
    import struct

    samples = np.arange(4000, dtype="<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(samples))
    (tmp_path / "a.wav").write_bytes(head + samples)
    (tmp_path / "b.pcm").write_bytes(samples + b"\x01")
    (tmp_path / "c.pcm").write_bytes(b"")
    rows = audio.read_pcm(spark, str(tmp_path)).orderBy("path", "seq").collect()
    for name in ("a.wav", "b.pcm"):
        assert b"".join(bytes(r.pcm) for r in rows if r.path.endswith(name)) == samples
    with pytest.raises(ValueError):
        audio.wav_pcm(b"RIFFxxxxWAVEdata", "bad.wav")
    two = np.array([[1, 4], [32767, 32767], [-3, -2]], "<i2").tobytes()
    assert list(np.frombuffer(audio.mix_down(two + b"\x00", 2), "<i2")) == [2, 32767, -2]
    assert list(np.frombuffer(audio.mix_down(two, 2, "sum"), "<i2")) == [5, 32767, -5]
    tone = np.repeat((1000 * np.sin(np.arange(1024) / 5)).astype("<i2")[:, None], 2, axis=1)
    beam = np.frombuffer(audio.delay_and_sum(tone.tobytes(), 2, np.zeros((2, 3)), np.array([1.0, 0, 0])), "<i2")
    assert np.abs(beam - tone[:, 0]).max() <= 1


def test_beams_of_many_chunks(spark, tmp_path, monkeypatch):
    from turnloom.plans.surface import QUERIES

    calls, steering = [], audio.steering
    monkeypatch.setattr(audio, "steering", lambda *a: calls.append(1) or steering(*a))
    rng = np.random.default_rng(0)
    chunks = [rng.integers(-9999, 9999, n).astype("<i2").tobytes() for n in (0, 64, 300, 129, 128)] + [None]
    rows = spark.createDataFrame(list(enumerate(chunks)), "i int, pcm binary")
    place, way = [[0.0, 0.0, 0.0], [0.1, 0.0, 0.0]], [1.0, 0.0, 0.0]
    found = {r.i: r.pcm for r in audio.beamformed(rows, "pcm", 2, place, way, 64).collect()}
    assert len(calls) == 33  # once a frequency, not once a chunk
    for i, c in enumerate(chunks):
        assert found[i] is None if c is None else bytes(found[i]) == audio.delay_and_sum(c, 2, np.array(place), np.array(way), 64)
    every = np.array([-32768, -1, 0, 1, 255, 256, 32767], "<i2")
    assert column(spark, [every.tobytes(), b""], "binary", pcm.samples) == [every.tolist(), []]
    # Samples below zero are heard, too.
    heard = spark.createDataFrame([(1, "é" * 4), (2, "abcd")], "event_id bigint, props string")
    heard.selectExpr("*", "1L AS user_id", "'a' AS event_type", "1.0D AS value", "timestamp'2026-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    first = {r.event_id: r.first for r in QUERIES["s6_beamformed"](spark, str(tmp_path)).collect()}
    assert all(abs(first[i] - np.frombuffer(t.encode()[:2], "<i2")[0]) <= 1 for i, t in ((1, "é"), (2, "ab")))


def test_messages(spark):
    raw = [
        '{"message_type": "partial_transcript", "text": "he"}', '{"message_type": "committed_transcript", "text": "hello"}', '{"message_type": "other"}', "no json", None,
        '{"message_type": "committed_transcript_with_timestamps", "words": [{"type": "word", "text": "a", "start": 1.0}, {"type": "spacing", "text": " "}, {"type": "word", "text": "b", "start": 2.0, "end": 2.5}]}',
    ]
    rows = messages.parse_messages(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")).collect()
    assert {(r.text, r.is_final, r.t_start, r.t_end) for r in rows} == {("he", False, None, None), ("hello", True, None, None), ("a", True, 1.0, 1.0), ("b", True, 2.0, 2.5)}


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_islands_in_slices(spark, chunk):
    r = random.Random(8)
    rows = sorted({(r.choice(["a", None]), t := r.randrange(120), t * 2 + r.randrange(2), r.choice("xxy")) for _ in range(150)}, key=lambda x: (x[0] or "", x[1], x[2]))
    rows = list({(k, i): (k, t, i, v) for k, t, i, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, t int, i int, v string")
    found = sequence.sliced_islands(df, ["k"], ["t", "i"], ["v", "t"], lambda before: (F.col("v") != before("v")) | (F.col("t") - before("t") > 3), chunk).collect()
    got = {(x.k, x.t, x.i): x.island for x in found}
    want, last, n = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        if k not in last or last[k][1] != v or t - last[k][0] > 3:
            n[k] = n.get(k, 0) + 1
        last[k] = (t, v)
        want[(k, t, i)] = n[k]
    assert got == want


@pytest.mark.parametrize("chunk", [3, 1_000])
def test_ordinals_and_inherited_labels_in_slices(spark, chunk):
    r = random.Random(2)
    rows = [(k, t, i, r.choice("pq"), r.choice([0.1, 0.5])) for i, (k, t) in enumerate((r.choice("ab"), r.randrange(40)) for _ in range(60))]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string, d double")
    place = {x.i: x.n for x in sequence.ordinals(df, ["k"], ["t", "i"], "n", chunk).collect()}
    found = {x.i: x.inherited for x in sequence.inherited_labels(df, ["k"], ["t", "i"], "v", F.col("d"), chunk=chunk).collect()}
    n, last = {}, {}
    for k, t, i, v, d in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        n[k] = n.get(k, 0) + 1
        last[k] = v if d >= 0.3 or k not in last else last[k]
        assert place[i] == n[k] and found[i] == last[k]


def test_both_tiers_in_one_pass_and_apart(spark):
    r = np.random.default_rng(6)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in r.standard_normal((n, 4))]
    probes = spark.createDataFrame([(i, "m", v) for i, v in enumerate(unit(40))] + [(99, "x", [1.0])], "id int, m string, v array<double>")
    known = lambda n, name: spark.createDataFrame([(f"{name}{i}", "m", v) for i, v in enumerate(unit(n))], "who string, m string, w array<double>")
    a, b = known(5, "r"), known(9, "s")
    found = [sorted((x.id, x.tier, x.who, x.similarity and round(x.similarity, 9)) for x in joins.three_tiers(probes, a, b, "id", "v", "who", "w", 0.6, 0.7, on=["m"], max_bytes=m).collect()) for m in (64 << 20, 8)]
    assert found[0] == found[1] and {x[1] for x in found[0]} == {"registered", "stored", "none"} and len(found[0]) == 41
