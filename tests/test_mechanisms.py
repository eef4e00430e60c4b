"""Operators that work in blocks, bins, parts or ranges, and their rules on nulls, repeats and borders, against brute force."""

import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import captions, composition, frames, parts, planning, runs, sampling, similarity, validate
from framewise.plans import curation
from framewise.sources import tables


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def cosine(a, b):
    top = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / top if top else 0.0


@pytest.mark.parametrize("blocks", [(2_048, 65_536), (3, 5)])
def test_semantic_pruning(spark, monkeypatch, blocks):
    """A hot clip in one tile and in many; null and repeated places, zero, null and non-finite vectors, other lengths, clips without anchors."""
    monkeypatch.setattr(similarity, "ANCHORS", blocks[0])
    monkeypatch.setattr(similarity, "VECTORS", blocks[1])
    rng = np.random.default_rng(1)
    vector = lambda: [float(x) for x in rng.normal(size=4)]
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", i % 5 if i % 4 else None, vector()) for i in range(90)]
    rows += [(100, "hot", 1, [0.0] * 4), (101, "hot", 1, None), (102, "hot", 2, [1.0, None, 0.0, 0.0]), (103, "hot", 2, [math.nan] * 4), (104, "hot", 2, [1.0, 1.0]), (105, None, 1, vector()),
        (106, "alone", 1, vector()), (107, "hot", 3, [1e200] * 4), (108, "hot", 3, [1e-200] * 4), (109, "none", None, [1.0, 0.0, 0.0, 0.0]), (110, "none", None, [0.0, 1.0, 0.0, 0.0])]
    anchors = [("hot", vector()) for _ in range(20)] + [(f"c{i}", vector()) for i in range(6)] + [("hot", [0.0] * 4), ("hot", None), ("c1", [math.inf] * 4), (None,
        vector()), ("none", [1.0, 0.0, 0.0, 0.0])]
    anchors += anchors[:9]
    df = spark.createDataFrame(rows, "row int, clip_id string, clause_ord int, vector array<double>").repartition(3)
    got = captions.prune_semantic(df, spark.createDataFrame(anchors, "clip_id string, vector array<double>"), 0.6)
    assert got.columns == ["clip_id", "row", "clause_ord", "best", "dropped"]
    found = {r["row"]: r for r in got.collect()}
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    assert len(found) == len(rows)
    for i, clip, _, v in rows:
        own = [a for c, a in anchors if c == clip and clip is not None and fine(a) and fine(v) and len(a) == len(v)]
        scale = [x / max(map(abs, v)) for x in v] if fine(v) and any(v) else v
        best = max((cosine(scale, a) for a in own), default=None)
        assert (found[i]["best"] is None) == (best is None) and (best is None or abs(found[i]["best"] - best) < 1e-12), i
        assert found[i]["dropped"] == (best is not None and best > 0.6), i


def test_both_pruning_stages(spark):
    rows = [("a", "A cat,", "one hat. two; three, four and five while six"), ("a", "Other", "one. two"), ("b", " B ,, ", "red hat"), ("c", None, None), ("d", "D", "x. y"), (None, "N", "x hat. y")]
    caps = spark.createDataFrame(rows, "clip_id string, anchor string, suffix string")
    near, far = [1.0, 0.0], [0.0, 1.0]
    clause = [("a", 0, near), ("a", 1, near), ("a", 2, far), ("a", 3, [1.0, 0.1]), ("a", 3, far), ("a", 5, None), ("a", 77, near), ("a", -1, near), ("d", 0, near), (None, 1, near)]
    anchors = [("a", near), ("a", None), (None, near)]
    vectors = spark.createDataFrame(clause, "clip_id string, clause_ord int, vector array<double>")
    got = captions.prune_in_stages(caps, vectors, spark.createDataFrame(anchors, "clip_id string, vector array<double>"), ("hat",), 0.9).collect()
    told = {(r["clip_id"], r["suffix_in"]): (r["kept"], r["dropped"], r["final"]) for r in got}
    assert len(got) == len(rows)
    assert told["a", rows[0][2]] == (["three", "five", "six"], ["one hat", "two", "four"], "A cat, three, five, six.")  # the pattern's first, then the vectors'
    assert told["a", "one. two"] == ([], ["one", "two"], "Other.")
    assert told["b", "red hat"] == ([], ["red hat"], "B .") and told["d", "x. y"] == (["x", "y"], [], "D, x, y.") and told[None, "x hat. y"] == (["y"], ["x hat"], "N, y.")
    same = captions.prune_in_stages(caps, vectors.limit(0), vectors.select("clip_id", "vector"), ("hat",), 0.9).select("final").collect()
    assert sorted(same) == sorted(captions.prune(caps, ("hat",)).select("final").collect())


def test_colours_in_one_pass(spark):
    colour = lambda text, colours: one(spark, captions.ground_colours(F.lit(text), colours, "thing"))
    assert colour("the cat", {"the": "blue", "blue": "red"}) == "the, a blue thing cat"
    assert colour("blue the", {"the": "blue", "blue": "red", "thing": "x"}) == "blue, a red thing the, a blue thing"
    assert colour("a.b axb a.b.", {"a.b": "red"}) == "a.b, a red thing axb a.b, a red thing."
    assert colour("bathe théthe", {"the": "red"}) == "bathe théthe" and colour(None, {"x": "y"}) is None and colour("", {"x": "y"}) == "" and colour("x", {}) == "x"
    assert colour("big cat cat", {"cat": "red", "big cat": "blue"}) == "big cat, a blue thing cat, a red thing"


def test_key_sets_of_files(spark, tmp_path):
    """From files to both verdicts: absent keys are not null values, extra keys hide a missing one from the strict form alone."""
    whole = {"file_path": "a", "text": None, "type": "video"}
    (tmp_path / "a.json").write_text(json.dumps([whole, {"file_path": "b", "extra": {"x": [1]}}, 7, {}, {**whole, "width": 5, "more": 1}], indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "data": [{"text": "t"}, whole]}))
    (tmp_path / "c.json").write_text("no json")
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text(json.dumps({"type": "image"}))
    entries = tables.read_entries(spark, f"{tmp_path}/*.json")
    got = [(r["ord"], r["file_path"], r["width"], None if r["keys"] is None else sorted(r["keys"]), r["missing_keys"], r["fails"], r["fails_strictly"])
        for r in validate.with_key_checks(entries).orderBy("ord").collect()]
    every = ["file_path", "text", "type"]
    assert got == [
        (0, "a", None, every, [], False, False), (1, "b", None, ["extra", "file_path"], ["text", "type"], True, False), (2, None, None, None, every, True, True), (3,
            None, None, [], every, True, True),
        (4, "a", 5, ["file_path", "more", "text", "type", "width"], [], False, False), (5, None, None, ["text"], ["file_path", "type"], True, True), (6, "a", None, every, [], False, False),
        (7, None, None, None, every, True, True), (8, None, None, ["type"], ["file_path", "text"], True, True),
    ]


def test_prompt_gates(spark):
    kind = "id int, identity array<string>, action_beats array<string>, camera string, lighting string, style string, "
    kind += "negatives array<string>, schema_version string, rendered string, provenance struct<author: string, seed: int>"
    good = (["TOK"], ["it waves"], "pan", "soft", "flat", ["blur"], "v1", "It waves.", ("a", 7))
    change = lambda i, **new: (i, *[new.get(k, v) for k, v in zip(("identity", "action_beats", "camera", "lighting", "style", "negatives", "schema_version", "rendered",
        "provenance"), good, strict=True)])
    cases = {
        0: ({}, []), 1: ({"identity": None}, ["no_identity"]), 2: ({"identity": [None, " \t"]}, ["no_identity"]), 3: ({"action_beats": None}, ["no_action_beat"]),
            4: ({"action_beats": []}, ["no_action_beat"]),
        5: ({"camera": None, "provenance": None}, ["no_camera"]), 6: ({"camera": "", "provenance": (None, None)}, ["no_camera"]), 7: ({"camera": "\u2003"},
            ["no_camera"]), 8: ({"lighting": None}, ["no_lighting"]), 9: ({"lighting": " \n"}, ["no_lighting"]),
        10: ({"style": None, "negatives": None}, ["no_style", "no_negatives"]), 11: ({"schema_version": None}, ["no_version"]), 12: ({"rendered": None}, ["no_rendered"]),
            13: ({"rendered": "a\rb"}, ["paragraphs"]),
        14: ({"rendered": "a\u2028b"}, ["paragraphs"]), 15: ({"rendered": "w " * 200}, []), 16: ({"rendered": "w " * 201}, ["too_long"]), 17: ({"action_beats": [None,
            "its BEAK opens"]}, ["forbidden_term"]),
        18: ({k: None for k in ("identity", "action_beats", "camera", "lighting", "style", "negatives", "schema_version", "rendered")}, [f.problem for f in validate.PROMPT_FIELDS]),
    }
    df = spark.createDataFrame([change(i, **new) for i, (new, _) in cases.items()], kind)
    assert {r["id"]: r["problems"] for r in validate.prompt_problems(df, ("beak",)).collect()} == {i: want for i, (_, want) in cases.items()}
    own = (validate.Required("no_author", "provenance.author"), validate.Required("no_seed", "provenance.seed", "value"), validate.Required("no_steps", "sampler.steps", "value"))  # no such field
    got = [r["problems"] for r in validate.prompt_problems(df.where("id in (0, 5, 6)"), (), fields=own).orderBy("id").collect()]
    assert got == [["no_steps"], ["no_author", "no_seed", "no_steps"], ["no_author", "no_seed", "no_steps"]]
    with pytest.raises(ValueError, match="no array"):
        validate.prompt_problems(df, (), fields=(validate.Required("x", "style", "items"),))


def test_null_probes_are_problems(spark):
    meta = spark.createDataFrame([("a", "t", "video"), ("b", "t", "video"), ("c", None, "video")], "file_path string, text string, type string")
    probes = spark.createDataFrame([("a", None, None, None, None), ("b", 768, 1360, "16/1", 33), ("c", 768, 1360, "16/1", 33)],
        "file_path string, width int, height int, r_frame_rate string, nb_read_frames int")
    got = {r["file_path"]: r["problems"] for r in validate.metadata_problems(meta, probes).collect()}
    assert got == {"a": ["frames", "size", "rate"], "b": [], "c": ["missing_key"]}


def slow_nearest(times, most):
    """Seconds to frames as the earliest minimum of the distances, over times in order of frames."""
    return {s: min(range(len(times)), key=lambda i: (abs(times[i] - s), times[i], i)) for s in range(min(round(max(times)) + 1, most))}


def test_nearest_frames_by_bins(spark):
    """Empty bins, ties, equal times, times before 0 and behind the last second, one frame; null and NaN times are left out."""
    rng = np.random.default_rng(3)
    clips = {"dense": [i / 30 for i in range(400)], "sparse": [0.0, 7.5, 7.5, 40.0], "ties": [0.5, 1.5, 2.5], "one": [3.2], "late": [90.0, 91.0], "early": [-5.0, -4.0],
        "both": [-3.0, 4.6, 4.6, 22.49, 300.0]}
    clips |= {f"r{k}": sorted(float(x) for x in rng.uniform(0, 40, rng.integers(1, 9)).round(1)) for k in range(40)}
    rows = [(c, t, i) for c, ts in clips.items() for i, t in enumerate(ts)] + [("dense", None, 900), ("dense", math.nan, 901), ("nothing", None, 0)]
    df = spark.createDataFrame(rows, "clip string, t double, idx long").repartition(5)
    for most in (24, 3):
        got = {(r["clip"], r["second"]): r["idx"] for r in sampling.nearest_per_second(df, most).collect()}
        assert got == {(c, s): i for c, ts in clips.items() for s, i in slow_nearest(ts, most).items()}


def test_two_rows_before_over_borders(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(i), None if k % 11 == 3 else float(rng.integers(0, 9))) for g, n in (("hot", 300), ("two", 2), ("one", 1), (None, 40)) for k, i in enumerate(rng.choice(2_000, n, replace=False))]
    df = spark.createDataFrame(rows, "clip_id string, frame_idx long, motion double").repartition(5)
    for span in (1, 3, 50, 4_096):
        got = parts.previous_two(df, "clip_id", "frame_idx", "motion", ("one", "two"), span).collect()
        assert len(got) == len(rows)
        for g in ("hot", "two", "one", None):
            v = [x for _, x in sorted((i, x) for h, i, x in rows if h == g)]
            mine = [(r["motion"], r["one"], r["two"]) for r in sorted((r for r in got if r["clip_id"] == g), key=lambda r: r["frame_idx"])]
            assert mine == [(v[k], v[k - 1] if k else None, v[k - 2] if k > 1 else None) for k in range(len(v))]
    steady = spark.createDataFrame([("c", i, float(i * i)) for i in range(9_000)], "clip_id string, frame_idx long, motion double")
    assert abs(frames.smoothness(steady, 1.5).first()["jerk"] - 2.0) < 1e-12  # over two borders of 4096 frames


def test_medians_by_selection(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=30_000), "ties": rng.integers(0, 3, 5_000), "one": [7.0], "two": [1.0, 4.0], "same": [2.5] * 900,
        "wide": rng.exponential(size=2_001) ** 9, "halves": [0.0] * 500 + [1.0] * 500}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("hot", None), ("hot", math.nan), ("void", None), (None, 1.0)]
    got = {r["g"]: r["median"] for r in frames.medians(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v").collect()}
    assert got == {g: statistics.median([float(x) for x in v]) for g, v in groups.items()}


def test_ranking_in_ranges(spark):
    """Equal to a window over all rows: ties over borders, nulls, NaN and a value that half of the rows share."""
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 13 == 0 else math.nan if i % 17 == 0 else float(rng.integers(0, 40)), 5 if i % 2 else int(rng.integers(0, 9)), None if i % 5 == 0 else "xyz"[i % 3]) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id int, a double, n int, c string").repartition(6)
    from pyspark.sql import Window

    for metrics in ((("a", True), ("n", False), ("c", True)), (("n", True),), (("c", False), ("a", False))):
        want = df.withColumn("rank", F.rank().over(Window.orderBy(*[F.desc_nulls_last(c) if up else F.asc_nulls_last(c) for c, up in metrics])))
        whole = sorted((r["id"], r["rank"]) for r in want.collect())
        for ranges in (256, runs.SAMPLED):
            assert sorted((r["id"], r["rank"]) for r in runs.rank_by(df, metrics, ranges).collect()) == whole
    assert runs.rank_by(df.limit(0), (("a", True),)).count() == 0


def slow_sparkline(losses):
    low, high = min(losses), max(losses)
    return "".join("▁▂▃▄▅▆▇█"[min(7, int((v - low) / (high - low + 1e-12) * 7))] for v in losses[:: max(1, len(losses) // 60)])


def test_sparklines(spark):
    rng = np.random.default_rng(7)
    series = {"long": rng.random(10_000).tolist(), "short": [3.0, 1.0, 2.0], "flat": [2.0] * 130, "peak": [0.0] * 7 + [9.0] + [0.0] * 200, "far": [0.0, 1e9]}  # the peak is not among the points shown
    rows = [(r, 1 + i // 3, i % 3, i, v, 0.1) for r, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, line_no long, nth int, step long, loss double, lr double").repartition(5)
    assert {r["run"]: r["sparkline"] for r in runs.sparkline_text(df).collect()} == {r: slow_sparkline(v) for r, v in series.items()}


def test_appends_of_absent_rows(spark, tmp_path):
    path, schema = f"{tmp_path}/captions", "clip_id string, text string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    held = lambda: sorted(((r["clip_id"] or "", r["text"]) for r in tables.read_appended(spark, path, schema).collect()), key=str)
    assert held() == []
    assert tables.append_absent(rows(("a", "first"), ("b", "z"), ("b", "y"), (None, "n")), path, "clip_id", "1")
    assert held() == [("", "n"), ("a", "first"), ("b", "y")]
    assert not tables.append_absent(rows(("c", "again")), path, "clip_id", "1")  # the batch is there
    broken = rows(("c", "new"), ("d", "bad")).withColumn("text", F.when(F.col("clip_id") == "d", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text"))).repartition(2)
    with pytest.raises(Exception, match="lost"):
        tables.append_absent(broken, path, "clip_id", "2")
    assert held() == [("", "n"), ("a", "first"), ("b", "y")]
    assert tables.append_absent(rows(("a", "changed"), ("c", "new"), ("d", "good")), path, "clip_id", "2")  # the same batch, once more
    assert held() == [("", "n"), ("a", "first"), ("b", "y"), ("c", "new"), ("d", "good")]
    (tmp_path / "captions" / "batch-2" / "_SUCCESS").unlink()  # as if its writer had died before the end
    assert held() == [("", "n"), ("a", "first"), ("b", "y")]
    assert tables.append_absent(rows(("d", "third")), path, "clip_id", "2") and held()[-1] == ("d", "third")


def test_names_versions_and_beats(spark):
    names = ["v/2D_XQ_Lantern_Base.mp4", "2D_XQ_Kettle2_Base.mp4", "XQ_HOrseRide.pdf", "XQ_Lantern_v2.pdf", "a.b-V3.pdf", "Love.pdf", " plain ", None]
    part = composition.parsed_name(F.col("n"), ("2D", "XQ", "Base"))
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[c.alias(k) for k, c in part.items()]).collect()
    assert [(r["stem"], r["version"], r["case_differs"]) for r in got] == [("lantern", 1, False), ("kettle", 2, False), ("horseride", 1, True), ("lantern", 2, False), ("a_b", 3, False),
        ("love", 1, False), ("plain", 1, False), (None, 1, False)]
    left = [(n,) for n in ("2D_XQ_Lantern_Base.mp4", "2D_XQ_Kettle2_Base.mp4", "2D_XQ_Harbour_Base.mp4", "only_Base.mp4", "x_v1.mp4", "x_v2.mp4", "y.mp4", "y.mov", None)]
    right = [(n,) for n in ("XQ_Lantern_v2.pdf", "XQ_Kettle.pdf", "XQ_HARBOUR.pdf", "x_v2.pdf", "y.pdf", "other.pdf")]
    got = composition.reconcile_versions(spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string"), "name", ("2D", "XQ", "Base")).collect()
    assert {r["stem"]: r["status"] for r in got} == {"lantern": "version_mismatch", "kettle": "version_mismatch", "harbour": "matched", "only": "left_only",
        "x": "superseded", "y": "duplicated", "other": "right_only"}
    beats = [("s", t) for t in ("1. a", "2) b", " 2: c", "#6 d", "Beat 9 e", "no number")] + [("t", "1. a"), ("t", "2. b"), ("z", "0 a"), ("z", "1 b"), (None, "1 a"), ("u", "3. a")]
    got = {tuple(r) for r in composition.beat_problems(spark.createDataFrame(beats, "storyboard string, label string")).collect()}
    assert got == {("s", "duplicated", 2, 2), ("s", "missing", 3, 3), ("s", "missing", 7, 2), ("u", "missing", 1, 2)}


def test_all_alternatives_and_folders(spark):
    found = runs.find_checkpoints(spark.createDataFrame([("r", f"checkpoint-{i}", True) for i in range(250)] + [("s", "", True)], "root string, path string, has_weights boolean"))
    got = {r["root"]: r for r in runs.resolve_checkpoint(found, 999).collect()}
    assert got["r"]["alternatives"] == ", ".join(map(str, range(250))) and not got["r"]["found"] and got["s"]["alternatives"] == ""
    folders = spark.createDataFrame([("/x/checkpoint-7/", True), ("/x/own", True), ("/x/empty", False), ("5", True), (None, True)], "path string, has_weights boolean")
    told = {w: {tuple(r)[1:5] for r in runs.resolve_checkpoint(found, w, folders).collect()} for w in ("/x/checkpoint-7", "/x/own/", "/x/empty", "/none", "5", "latest")}
    assert told["/x/checkpoint-7"] == {(7, "/x/checkpoint-7/", "checkpoint-7", True)} and told["/x/own/"] == {(None, "/x/own", "own", True)}
    assert told["/x/empty"] == told["/none"] == {(None, None, None, False)} and told["5"] == {(None, "5", "5", True)}
    assert told["latest"] == {(249, "checkpoint-249", "checkpoint-249", True), (None, "", "final", True)}
    assert runs.resolve_checkpoint(found, "no such folder").where("found").count() == 0


def test_rates_names_picks_and_masks(spark):
    rates = {"24/1": 24.0, "30000/1001": 29.97, "1/3": 0.333, "16": 16.0, "5/0": None, "a/1": None, "1/2000": 0.0, "1/1000": 0.001}
    assert {r: one(spark, planning.exact_rate(F.lit(r))) for r in rates} == rates and one(spark, planning.exact_rate(F.lit("1/3"), 5)) == 0.33333
    unknown = lambda c: one(spark, planning.is_unknown(F.lit(c).cast("string"), {"a": "A"}, ("a+b",)))
    assert [unknown(c) for c in ("a", "a+b", "b", "", None)] == [False, False, True, True, True]
    clips = [("x", i) for i in range(10)] + [("y", 0)] + [("z", i) for i in (0, 3, 9)]
    got = sampling.picked_frames(spark.createDataFrame(clips, "clip_id string, frame_idx long")).collect()
    of = lambda c, p: [r["frame_idx"] for r in sorted((r for r in got if r["clip_id"] == c and r["pick"] == p), key=lambda r: r["nth"])]
    assert [of("x", p) for p in ("quarters", "middle", "ends")] == [[0, 2, 5, 7, 9], [5], [0, 9]] and [of("y", p) for p in ("quarters", "middle", "ends")] == [[0], [0], [0]]
    assert of("z", "quarters") == [0, 9] and of("z", "middle") == []
    df = spark.createDataFrame([(i, 1 + i % 48, 8 + i % 90, 8 + i % 70) for i in range(3_000)], "id long, frames int, height int, width int")
    masks = sampling.mask_plan_of_four(df, "id", 7).collect()
    counts = [sum(r["mask_mode"] == m for r in masks) for m in range(4)]
    assert min(counts) > 600 and sum(counts) == 3_000
    for r in masks:
        assert 0 <= r["frame_from"] <= r["frame_to"] <= r["frames"] and 0 <= r["x_from"] <= r["x_to"] <= r["width"] and 0 <= r["y_from"] <= r["y_to"] <= r["height"] and 0 <= r["coverage"] <= 1
        if r["mask_mode"] < 2:
            assert (r["frame_from"], r["frame_to"]) == (1, r["frames"] if r["mask_mode"] == 0 else max(r["frames"] - 1, 1))


def test_epoch_draws_count_rows_when_they_run(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    got = sorted((r["draw_no"], r["k"]) for r in sampling.epoch_draws(rows, "k", 1, 2, F.col("n") * 2 + 3, 4).collect())
    assert [d for d, _ in got] == list(range(4, 17)) and {k for d, k in got if 7 <= d < 14} == set(range(7))
    assert sampling.epoch_draws(rows.limit(0), "k", 1, 2, 5).count() == 0 and sampling.epoch_draws(rows, "k", 1, 2, 0).count() == 0


def test_joins_by_counted_keys(spark, monkeypatch):
    """Hot keys by broadcast and cold ones by shuffle give one join, whatever the bounds."""
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i % 9}", i) for i in range(40)] + [(None, 1)], "g string, v int")
    keyed = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = sorted((r["g"], r["v"], r["s"]) for r in rows.where("g is not null").join(keyed, "g").collect())
    for most, keys in ((1_000_000, 1_000), (10, 1_000), (1, 2), (1_000_000, 1)):
        monkeypatch.setattr(parts, "HOT_ROWS", most)
        monkeypatch.setattr(parts, "HOT_KEYS", keys)
        assert sorted((r["g"], r["v"], r["s"]) for r in parts.join_counted(rows, keyed, ["g"]).collect()) == want


def stood_still(spark):
    """Segments whose end is their start, written in other parts: doubles of parts added up differ in the last place for the first three."""
    rows = [(f"s{i}.mp4", f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms % 60_000 / 1000:06.3f}", f"{ms / 1000:.3f}") for i, ms in enumerate((61_029, 61_154, 2_039_928, 500))]
    rows += [("long.mp4", "00:01:01.029", "61.030"), ("edge.mp4", "5.1", "10.1625")]
    given = [(i + 1, f, a, b, "a+b" if i < 4 else "a", "x", "show" if i < 4 else "", "", "", "p") for i, (f, a, b) in enumerate(rows)]
    return planning.plan_clips(spark.createDataFrame(given, "row_ord long, source_file string, in string, out string, " + ", ".join(f"{c} string" for c in ("character", "action_label",
        "bg_type", "alpha_file", "bg_plate", "props"))))


def test_gates_leave_out_segments_without_length(spark):
    got = composition.gates(stood_still(spark).where("verdict = 'ok'")).first()
    assert (got["total"], got["multi_share"], got["show_share"], got["show_ok"]) == (2, 0.0, 0.0, True)


def test_equal_times_are_no_clip(spark):
    got = {r["row_ord"]: (r["verdict"], r["duration_s"], r["frames"]) for r in stood_still(spark).collect()}
    assert got == {**{i: ("empty", 0.0, 49) for i in (1, 2, 3, 4)}, 5: ("ok", 0.001, 49), 6: ("ok", 5.0625, 81)}


def test_footage_without_length_is_no_source(spark):
    clips = stood_still(spark).where("verdict = 'ok'").withColumn("shot", F.col("action_label"))
    assert sorted((r["source_file"], r["clips"], r["footage_s"]) for r in composition.footage(clips).collect()) == [("edge.mp4", 1, 5.063), ("long.mp4", 1, 0.001)]


def test_segments_of_odd_times_are_planned_as_by_sql(spark, tmp_path):
    """Ends before midnight, an hour that the session's time zone leaves out, and no user."""
    duckdb = pytest.importorskip("duckdb")
    at = "timestamp_ntz'2024-03-10 "
    rows = f"(0, {at}00:00:01.25', 3, 'x', -150.0D), (1, {at}02:30:00.125', 4, 'y', 100.0D), (2, {at}00:00:00', 5, 'x', -0.1D), (3, {at}00:00:00', 6, 'x', 0.0D), (4, {at}23:59:59.9999', null, 'x', 253.1D)"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.sql(f"select bigint(i) event_id, ts, bigint(u) user_id, t event_type, v value, '{{\"k\": 5}}' props from values {rows} as e(i, ts, u, t, v)").write.parquet(f"{tmp_path}/events.parquet")
    columns = ["row_ord", "duration_s", "frames", "in_window", "verdict", "path"]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [tuple(r) for r in curation.segment_plan(spark, str(tmp_path)).select(columns).orderBy("row_ord").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(1, -3.0, 49, False, "empty", "/data/sheets/skit_3.mp4"), (2, 2.0, 49, True, "ok", "/data/sheets/skit_4.mp4"), (3, -0.002, 49, False, "empty", "/data/sheets/skit_5.mp4"),
        (4, 0.0, 49, False, "empty", "/data/sheets/skit_6.mp4"), (5, 5.062, 49, True, "ok", None)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert con.sql(f"SELECT {', '.join(columns)} FROM ({curation.SEGMENT_PLAN}) ORDER BY row_ord").fetchall() == got


def test_footage_is_the_same_in_every_order(spark):
    """Doubles give 0.8 for the first source in one order and 0.801 in another, and lose the short clips of the second beside its long ones."""
    given = [("tie", 0.7), ("tie", 0.1), ("tie", 0.0005), *[("long", 9e9)] * 3, *[("long", 1e-7)] * 10_000, ("none", None), ("huge", 1e30), ("huge", 1.0), ("odd", math.nan)]
    for rows in (given, given[::-1]):
        clips = spark.createDataFrame(rows, "source_file string, duration_s double").withColumn("shot", F.lit("x")).coalesce(1)
        for out in (composition.footage(clips), composition.sources_by_clips(clips, 9)):
            got = {r["source_file"]: r["footage_s"] for r in out.collect()}
            assert math.isnan(got.pop("odd")) and got == {"tie": 0.801, "long": 27_000_000_000.001, "none": None, "huge": 1e30}
            assert dict(out.dtypes)["footage_s"] == "double"


def test_consistency_ties_fall_as_added_in_order(spark, tmp_path):
    """Clips whose exact drift lies between two numbers of 5 places: sums in the order of frames tell which one, as the SQL has it, however rows are dealt."""
    duckdb = pytest.importorskip("duckdb")
    from framewise.plans import analytics

    path = "/root/testdata/sf0.01/events.parquet"
    spark.read.parquet(path).repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    names = ["clip_id", "pairs", "worst", "mean", "least", "deviation", "drift", "jerk", "held"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({analytics.CONSISTENCY})").fetchall())
    got = sorted(tuple(r) for r in analytics.consistency_summary(spark, str(tmp_path)).select(*names).collect())
    assert len(got) == len(want) == 150
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[3:], b[3:], strict=True)), (a, b)


def test_indices_work_out_a_draw_once(spark):
    """A row's draw is a value that elements share, not worked out for each of them: it is in the plan a few times, not once an element's step."""
    u = sampling.draw(F.col("id").cast("string"), 7, "ends")
    n = (F.col("id") * 7 % 90).cast("int")
    rows = spark.range(200).select("id", n.alias("n"), sampling.dropped_ends_indices(n, 16, 3, 0.1, 0.9, u).alias("d"), sampling.kept_frames(F.lit(30), n).alias("k"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    for r in rows.collect():
        length = int(r["n"])
        m = min(16, math.floor(math.floor(length * (0.9 - 0.1)) / 3))
        assert (r["d"] is None) == (m <= 0) and (m <= 0 or (len(r["d"]) == m and r["d"] == sorted(r["d"]) and 0 <= r["d"][0] and r["d"][-1] < max(math.floor(length * 0.9), 1)))
        step = next(s for s in range(5, -1, -1) if s <= 3 and (length / (s + 1) >= 49 or s == 0)) + 1
        assert r["k"] == [i * step for i in range(min(49, math.ceil(length / step)))]


def test_pairs_are_scored_in_bounded_batches(spark):
    """Arrow batches are bounded by bytes, and what is worked on at a time by pairs; results do not depend on it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        rows = spark.range(300, numPartitions=1).select("id", *[F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i, k=k: (F.col("id") * k + i * i) % 251.0).alias(c) for c, k in (("a", 3), ("b", 5))])
        whole = frames.colour_pairs(rows, 16, 16)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
        got = {r["id"]: tuple(r)[1:] for r in whole.collect()}
        one_by_one = {r["id"]: tuple(r)[1:] for r in frames.colour_pairs(rows.where("id in (0, 127, 128, 299)").repartition(4, "id"), 16, 16).collect()}
        assert len(got) == 300 and {i: got[i] for i in one_by_one} == one_by_one
        parts_of = list(frames.in_slices(iter([__import__("pandas").DataFrame({"x": range(300)}), __import__("pandas").DataFrame({"x": []})])))
        assert [len(p) for p in parts_of] == [128, 128, 44]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


@pytest.mark.parametrize("most", [16_384, 3])
def test_keyed_vectors_prune_as_vectors_do(spark, monkeypatch, most):
    """Clauses and anchors that name their vectors are judged as those that hold them; null, zero, missing, short and non-finite vectors, null clips and repeated places too."""
    monkeypatch.setattr(similarity, "KEYED", most)
    rng = np.random.default_rng(5)
    given = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(-4, 36)] + [(50, None), (51, [0.0] * 6), (52, [1.0, 2.0]), (53, [float("nan")] * 6), (54, [1e308] * 6)]
    vectors = spark.createDataFrame(given, "key long, vector array<double>")
    keys = [k for k, _ in given] + [99, None]
    pick = lambda n: [(int(rng.integers(0, 8)) if i % 11 else None, int(rng.integers(0, 5)), keys[int(rng.integers(0, len(keys)))]) for i in range(n)]
    rows = spark.createDataFrame(pick(120), "clip_id long, clause_ord int, key long")
    anchors = spark.createDataFrame(pick(30), "clip_id long, clause_ord int, key long").where("clip_id <> 3")
    got = sorted(tuple(r) for r in similarity.too_close(rows, anchors, vectors, "clip_id", "clause_ord", 0.3).collect())
    whole = captions.prune_semantic(rows.join(vectors, "key", "left"), anchors.join(vectors, "key", "left"), 0.3).where("dropped").select("clip_id", "clause_ord").distinct()
    assert got == sorted(tuple(r) for r in whole.collect()) and len(got) > 5
    assert similarity.too_close(rows, anchors, vectors.limit(0), "clip_id", "clause_ord", 0.3).count() == 0


def test_caption_stages_send_no_vector_with_a_clause(spark):
    from framewise.plans import curation

    plan = curation.caption_stages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(vector" not in plan and "MapInArrow" in plan
