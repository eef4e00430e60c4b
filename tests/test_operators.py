"""Edge rules of the operators on small rows."""

import numpy as np
from pyspark.sql import functions as F

from framewise.operators import captions, composition, frames, geometry, planning, runs, sampling, tiling, validate
from framewise.sources import tables


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first()[0]


def test_to_seconds(spark):
    for text, seconds in (("3.5", 3.5), ("01:02", 62.0), ("1:00:02.25", 3602.25), ("9:1:00:02", 3602.0), (" 7 ", 7.0), ("a:1", None), ("", None)):
        assert one(spark, planning.to_seconds(F.lit(text))) == seconds


def test_plan_rules(spark):
    assert [one(spark, planning.choose_frames(F.lit(x))) for x in (5.0625, 5.06)] == [81, 49]
    assert [one(spark, planning.frame_rate(F.lit(x))) for x in ("24/1", "30000/1001", "5/2", "7/0", "16")] == [24, 30, 2, 7, 16]
    assert one(spark, planning.clip_id(F.lit("a/b.c.mp4"), F.lit(7), F.lit("wave hand"))) == "b.c_007_wave-hand"
    assert one(spark, planning.strategy(F.lit("x"), F.lit("show"), F.lit(""))) == "baked"
    assert one(spark, planning.resolve_path(F.lit("/x"), "/r")) == "/x"


def test_captions(spark):
    assert one(spark, captions.split_clauses(F.lit("A b. c, d and e while f;g ,"))) == ["A b", "c", "d", "e", "f;g"]
    assert one(spark, captions.blocked(F.lit("that is"), ("hat",))) and not one(spark, captions.blocked(F.lit("that is"), ("hat",), word_boundary=True))
    assert one(spark, captions.blocked(F.lit("CHAPEAU DORÉ"), ("doré",)))  # any case, of any letter
    df = spark.createDataFrame([("c", "An anchor,", "a hat. red coat")], "clip_id string, anchor string, suffix string")
    assert captions.prune(df, ("hat",)).first()["final"] == "An anchor, red coat."
    empty = spark.createDataFrame([("c", "An anchor,", None)], "clip_id string, anchor string, suffix string")
    assert captions.prune(empty, ("hat",)).first()["final"] == "An anchor." and captions.prune(empty, ("hat",), repair=False).first()["final"] == "An anchor, ."
    assert one(spark, captions.unquote(F.lit('"a"'))) == "a" and one(spark, captions.unquote(F.lit('"'))) == '"'
    rows = spark.range(10).withColumnRenamed("id", "ord")
    assert captions.every_nth(rows, "ord", 0.4).count() == 5 and captions.every_nth(rows, "ord", 0).count() == 1


def test_geometry(spark):
    df = spark.createDataFrame([(768, 1360)], ["h", "w"])
    got = geometry.closest_bucket(df, "w", "h", 592).first()
    assert (got["bucket_h"], got["bucket_w"]) == (768, 432)
    tie = spark.createDataFrame([(265, 1000)], ["h", "w"])
    assert geometry.closest_bucket(tie, "h", "w").first()["ratio"] == 0.26
    assert [one(spark, geometry.snap_4k1(F.lit(n))) for n in (49, 48, 4, 0)] == [49, 45, 1, 0]
    assert one(spark, geometry.align_patch(F.lit(49), 4, 2)) == 45


def test_schedule_and_samples(spark):
    assert sampling.schedule(37, 2, 2500, batch_size=2) == {"steps_per_epoch": 19, "epochs": 132, "resume_epoch": 0, "effective_batch": 4}
    plans = sampling.schedules(spark.createDataFrame([(37,), (0,)], "n_batches long"), 2, 2500, 2)
    assert [tuple(r) for r in plans.orderBy(F.desc("n_batches")).collect()] == [(37, 19, 132, 0, 4), (0, None, None, None, 4)]
    rows = spark.createDataFrame([(i, "rare" if i < 33 else "rest") for i in range(298)], ["id", "kind"])
    assert sampling.oversample(rows, "kind", {"rare": 3}).count() == 364
    kinds = spark.createDataFrame([("video",), ("image",), (None,)], "type string")
    assert sampling.balance_types(kinds, 0).count() == 2
    orders = [[r["id"] for r in sampling.epoch_order(rows.repartition(n), "id", 1, 0).orderBy("position").collect()] for n in (1, 16)]
    assert orders[0] == orders[1]
    assert one(spark, sampling.head_tail_indices(F.lit(5), 4, 4, 20)) == [4]


def test_tiling_brute_force(spark):
    windows = [(c, s, s + 9) for c in range(3) for s in range(0, 9000, 7)]
    cuts = [(c, at) for c in range(3) for at in range(3, 9000, 97 + c)]
    got = tiling.without_straddles(spark.createDataFrame(windows, ["clip", "w_start", "w_end"]), spark.createDataFrame(cuts, ["clip", "at"])).collect()
    want = {w for w in windows if not any(c == w[0] and w[1] < at < w[2] for c, at in cuts)}
    assert {tuple(r) for r in got} == want


def slow_ssim(a, b):
    g = np.outer(frames.gaussian(), frames.gaussian())

    def blur(x):
        p = np.pad(x, 5, mode="reflect")
        return np.array([[(p[i : i + 11, j : j + 11] * g).sum() for j in range(x.shape[1])] for i in range(x.shape[0])])

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    return (((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma**2 + mb**2 + 6.5025) * (va + vb + 58.5225))).mean()


def test_ssim():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 9)) * 255, rng.random((12, 9)) * 255
    assert abs(frames.ssim_stack(a[None], b[None])[0] - slow_ssim(a, b)) < 1e-9
    assert abs(frames.ssim_stack(a[None], a[None])[0] - 1) < 1e-12


def test_runs(spark):
    line = "  17/2500 [03:57<9:44:48, 14.13s/it, loss=0.0247, lr=2.55e-6]"
    lines = spark.createDataFrame([("r", 1, "Num examples = 75"), ("r", 2, line)], "run string, line_no long, value string")
    assert [tuple(r)[3:] for r in runs.log_points(lines).collect()] == [(17, 0.0247, 2.55e-6)]
    assert tuple(runs.elapsed(lines).first()) == ("r", "03:57", 14.13)
    assert runs.named_fields(lines, {"examples": r"Num examples = (\d+)"}).first()["examples"] == 75
    assert one(spark, runs.run_label(F.lit(132), F.lit(0.4), F.lit(5.0), F.lit(33))) == "ckpt132_s040_g50_f33"
    assert one(spark, runs.retention_flag(F.lit(0.7))) == "fading"


def test_validate(spark):
    keys = F.array(F.lit("file_path"), F.lit("text"), F.lit("extra"))
    assert one(spark, validate.key_set_fails(keys)) and not one(spark, validate.key_set_fails(keys, parity=True))


def test_props(spark):
    clips = spark.createDataFrame([("a", ["x", "x"]), ("b", ["y"])], ["clip_id", "props"])
    got = {r["prop"]: (r["mentions"], r["clips"], r["lonely"], r["lonely_clips"]) for r in composition.prop_frequency(clips).collect()}
    assert got == {"x": (2, 1, False, True), "y": (1, 1, True, True)}


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("source_file,in,out,character,action_label,bg_type,alpha_file,bg_plate,props\na.mp4,0,3,a,x,,,,p\nb.mp4,x,3,b,y,,,,\n")
    plan = planning.plan_clips(tables.read_segments(spark, f"{tmp_path}/s.csv")).orderBy("row_ord").collect()
    assert [(r["row_ord"], r["verdict"], r["bg_type"]) for r in plan] == [(1, "ok", "gray"), (2, "bad_time", "gray")]
    (tmp_path / "c.txt").write_text("one\n\ntwo\nthree\n")
    (tmp_path / "p.txt").write_text("1.mp4\n2.mp4\n")
    pairs, bad = tables.read_line_pairs(spark, f"{tmp_path}/c.txt", f"{tmp_path}/p.txt")
    assert [(r["text"], r["path"], r["aligned"]) for r in pairs.orderBy("ord").collect()] == [("one", "1.mp4", True), ("two", "2.mp4", False)]
    assert bad.count() == 1
    (tmp_path / "j.json").write_text('{"clip_id": "a", "anchor": "b", "suffix": "c"}\n\nno json\n')
    assert sorted((r["clip_id"] or "", r["_corrupt_record"] or "") for r in tables.read_captions(spark, f"{tmp_path}/j.json").cache().collect()) == [("", "no json"), ("a", "")]
    (tmp_path / "log.txt").write_text("a\rb\r\nc\n")
    assert [r["value"] for r in tables.read_log_lines(spark, f"{tmp_path}/log.txt").orderBy("line_no").collect()] == ["a", "b", "c"]
    assert tables.list_files(spark, str(tmp_path), "*.txt").count() == 3


SHEET = "source_file,in,out,character,action_label,bg_type,alpha_file,bg_plate,props\n"


def test_ordinals_count_within_files(spark, tmp_path):
    """Sheets of one, many and few rows, split into blocks and packed in any order: each counts from 1."""
    sizes = {"a": 1, "b": 900, "c": 3, "d": 0}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text(SHEET + "".join(f"{name}.mp4,{i},9,a,x,,,,p\n" for i in range(1, n + 1)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for split, cost in (("700", "0"), ("128m", "4m"), ("128m", "0")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            got = tables.read_segments(spark, f"{tmp_path}/*.csv").select("source_file", "in", "row_ord").collect()
            assert sorted((r["source_file"], r["row_ord"]) for r in got) == [(f"{k}.mp4", i) for k, n in sizes.items() for i in range(1, n + 1)]
            assert all(int(r["in"]) == r["row_ord"] for r in got)
            for name in ("x.log", "y.log"):
                (tmp_path / name).write_text("".join(f"line {i}\r" for i in range(1, 400)) + "end\n")
            lines = tables.read_log_lines(spark, f"{tmp_path}/*.log").collect()
            assert sorted((r["run"][-5:], r["line_no"]) for r in lines) == [(n, i) for n in ("x.log", "y.log") for i in range(1, 401)]
            assert all(r["value"] in (f"line {r['line_no']}", "end") for r in lines)
            for name, step in (("c.txt", 3), ("p.txt", 2)):  # blank lines in different places
                (tmp_path / name).write_text("".join("\n" if i % step == 0 else f"{name}{i}\n" for i in range(600)))
            pairs, bad = tables.read_line_pairs(spark, f"{tmp_path}/c.txt", f"{tmp_path}/p.txt")
            left, right = [i for i in range(600) if i % 3], [i for i in range(600) if i % 2]
            want = [(f"c.txt{a}", f"p.txt{b}", a == b) for a, b in zip(left, right, strict=False)]
            assert [(r["text"], r["path"], r["aligned"]) for r in pairs.orderBy("ord").collect()] == want
            assert bad.count() == len(left) - len(right)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_metadata_forms(spark, tmp_path):
    """An array of entries, an object that holds one, and CSV: the same rows in order."""
    import json

    entries = [{"file_path": f"{i}.mp4", "text": f"t{i}", "type": "video", "width": i, "more": [1]} for i in range(4)]
    (tmp_path / "a.json").write_text(json.dumps(entries))
    (tmp_path / "b.json").write_text(json.dumps({"data": entries, "version": 2}))
    (tmp_path / "c.csv").write_text("file_path,text,type,width,height,source_skit,source_shot,window\n" + "".join(f"{i}.mp4,t{i},video,{i},,,,\n" for i in range(4)))
    for name in ("a.json", "b.json", "c.csv"):
        got = tables.read_metadata(spark, f"{tmp_path}/{name}").orderBy("ord").collect()
        assert [(r["ord"], r["file_path"], r["text"], r["width"], r["height"]) for r in got] == [(i, f"{i}.mp4", f"t{i}", i, None) for i in range(4)], name
    got = runs.first_captions(tables.read_metadata(spark, f"{tmp_path}/b.json"), 2).collect()
    assert [r["text"] for r in got] == ["t0", "t1"]


def test_written_tables(spark, tmp_path):
    """Manifests, captions, spot checks and reports come back as they were written; nothing is overwritten."""
    rows = spark.createDataFrame([("a", 'x, "y"', 1.5), ("b", None, None)], "clip_id string, text string, score double")
    want = [("a", 'x, "y"', 1.5), ("b", None, None)]
    for kind, reader in (("parquet", spark.read), ("json", spark.read.schema(rows.schema)), ("csv", spark.read.schema(rows.schema).option("header", True).option("escape", "\\"))):
        tables.write_table(rows, f"{tmp_path}/{kind}", kind, ("clip_id", "text", "score"))
        assert [tuple(r) for r in getattr(reader, kind)(f"{tmp_path}/{kind}").orderBy("clip_id").collect()] == want
    tables.write_table(rows, f"{tmp_path}/order", "csv", ("score", "clip_id"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/order").columns == ["score", "clip_id"]
    try:
        tables.write_table(rows, f"{tmp_path}/json", "json")
        raise AssertionError("overwritten")
    except Exception as e:
        assert "ALREADY_EXISTS" in str(e).upper()
    assert [r["row"] for r in tables.markdown_rows(rows, ("clip_id", "score")).collect()] == ["| a | 1.5 |", "| b | – |"]
    try:
        tables.choose_columns(rows, "none")
        raise AssertionError("found")
    except ValueError as e:
        assert "clip_id, text, score" in str(e)


def test_checkpoints_and_completion(spark):
    files = [("r", "checkpoint-5", True), ("r", "checkpoint-40/", True), ("r", "checkpoint-7", False), ("r", "logs", True), ("r", "", True), ("s", None, True), ("t", "x/checkpoint-3", True)]
    found = runs.find_checkpoints(spark.createDataFrame(files, "root string, path string, has_weights boolean"))
    assert sorted((r["root"], -1 if r["step"] is None else r["step"], r["is_final"]) for r in found.collect()) == [("r", -1, True), ("r", 5, False), ("r", 40, False),
        ("s", -1, True), ("t", 3, False)]
    told = {w: {r["root"]: (r["label"], r["found"], r["alternatives"]) for r in runs.resolve_checkpoint(found, w).collect()} for w in ("latest", "final", "5")}
    assert told["latest"] == {"r": ("checkpoint-40", True, None), "s": ("final", True, None), "t": ("checkpoint-3", True, None)}
    assert told["final"] == {"r": ("final", True, None), "s": ("final", True, None), "t": ("checkpoint-3", True, None)}
    assert told["5"] == {"r": ("checkpoint-5", True, None), "s": (None, False, ""), "t": (None, False, "3")}
    kept = {r["step"]: r["remove"] for r in runs.retention(found.where("root = 'r'"), 2).collect()}
    assert kept == {5: True, 40: False}
    lines = spark.createDataFrame([("a", 1, "Steps: 100%|x"), ("b", 1, "3/9 [00:01<1, loss=1, lr=1]"), ("c", 1, "9/9 [00:01<1, loss=1, lr=1]"), ("d", 1, None)],
        "run string, line_no int, value string")
    plan = spark.createDataFrame([("b", 9), ("c", 9), ("d", 0)], "run string, total_steps long")
    assert {r["run"]: r["completed"] for r in runs.completion(lines, runs.log_points(lines), plan).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_drift_of_published_series(spark):
    """First and last correlation with the first frame of 33 frames: 1.0 and 0.3275 drift by 0.6725."""
    rows = [("c", i, None if i == 0 else 0.9, 1.0 - i * (1.0 - 0.3275) / 32) for i in range(33)]
    got = frames.first_frame_drift(spark.createDataFrame(rows, "clip_id string, frame_idx int, adjacent double, versus_first double")).first()
    assert (got["frames"], got["first"], got["last"], got["palette_drift"]) == (33, 1.0, 0.3275, 0.6725)
    assert one(spark, frames.correlation(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(4.0), F.lit(8.0)))) == 1.0
    assert one(spark, frames.correlation(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(4.0)))) == 1.0


def test_frame_index_rules(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 30, 77, 400):
        for head, tail, frames_, stride in ((0.1, 0.9, 16, 3), (0.0, 1.0, 49, 2), (0.2, 0.3, 4, 4)):
            u = float(rng.random())
            got = one(spark, sampling.dropped_ends_indices(F.lit(n), frames_, stride, head, tail, F.lit(u)))
            m = min(frames_, int(n * (tail - head) // stride))
            if m == 0:
                assert got is None
                continue
            end = int(tail * n)
            span = min(end, (m - 1) * stride + 1)
            low, high = (0, 0) if end == span else (int(head * end), end - span)
            assert len(got) == m and low <= got[0] <= high
            assert got == np.linspace(got[0], got[0] + span - 1, m, dtype=int).tolist()
        assert 0 <= one(spark, sampling.single_frame(F.lit(n), F.lit(0.999999))) < n
        kept = one(spark, sampling.kept_frames(F.lit(30), F.lit(n)))
        skip = min(5, max(0, -(-30 // 8) - 1))
        while skip and n / (skip + 1) < 49:
            skip -= 1
        assert kept == list(range(0, n, skip + 1))[:49]
    assert one(spark, sampling.strided_indices(F.lit(9), 1, 3, F.lit(0.5))) == [4]


def slow_edges(a):
    p = np.pad(a, 1, mode="reflect")
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    out = np.zeros(a.shape)
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            w = p[i : i + 3, j : j + 3]
            out[i, j] = np.hypot((w * kx).sum(), (w * kx.T).sum())
    return out


def test_edges_flat_areas_and_loops(spark):
    """Edge similarity and flat-area error by direct loops; first and last frames by clip."""
    rng = np.random.default_rng(4)
    a = rng.random((12, 14)) * 255
    a[:6, :8] = 90.0
    b = np.clip(a + rng.normal(size=a.shape) * 9, 0, 255)
    flat = np.full((12, 14), 7.0)
    rows = [(1, a.ravel().tolist(), b.ravel().tolist()), (2, flat.ravel().tolist(), b.ravel().tolist())]
    got = {r["id"]: r for r in frames.structural(spark.createDataFrame(rows, "id int, a array<double>, b array<double>"), 12, 14).collect()}
    ea, eb = slow_edges(a), slow_edges(b)
    top = ea.max()
    g = np.outer(frames.gaussian(), frames.gaussian())
    blur = lambda x: np.array([[(np.pad(x, 5, mode="reflect")[i : i + 11, j : j + 11] * g).sum() for j in range(14)] for i in range(12)])
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    ma, mb = blur(ea), blur(eb)
    va, vb, cov = blur(ea * ea) - ma**2, blur(eb * eb) - mb**2, blur(ea * eb) - ma * mb
    want = (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean()
    assert abs(got[1]["edge_ssim"] - want) < 1e-9 and abs(got[1]["ssim"] - slow_ssim(a, b)) < 1e-9
    calm = ea < 0.06 * top + 1e-6
    assert calm.any() and abs(got[1]["flat_mae"] - np.abs(a - b)[calm].mean()) < 1e-9
    assert abs(got[2]["flat_mae"] - np.abs(flat - b).mean()) < 1e-9
    clips = [("x", 2, a), ("x", 0, b), ("x", 1, flat), ("y", 5, a)]
    df = spark.createDataFrame([(c, i, v.ravel().tolist()) for c, i, v in clips], "clip_id string, frame_idx int, pixels array<double>")
    ends = {r["clip_id"]: r for r in frames.loop_closure(df, 12, 14).collect()}
    assert abs(ends["x"]["ssim"] - slow_ssim(b, a)) < 1e-9 and ends["x"]["closed"] == (ends["x"]["ssim"] >= 0.92) and ends["y"]["closed"]
    assert one(spark, frames.psnr_exact(F.array(F.lit(1.0)), F.array(F.lit(1.0)))) == 99.0


def test_order_in_parts(spark):
    """Ranks, running counts and rows before, over parts of any width, with gaps, a null group and single rows."""
    from framewise.operators import parts

    rng = np.random.default_rng(8)
    rows = [(g, int(i), float(rng.integers(0, 9))) for g, n in (("hot", 400), ("one", 1), (None, 30)) for i in rng.choice(3_000, n, replace=False)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(5)
    for span in (1, 7, 1_000, 4_096):
        got = parts.previous(parts.running_count(parts.ranked(df, "g", "i", span), "g", "i", F.col("v") > 4, "c", span), "g", "i", "v", "p", span).collect()
        assert len(got) == len(rows)
        for g in ("hot", "one", None):
            own = sorted((i, v) for h, i, v in rows if h == g)
            mine = sorted((r["i"], r["__rn"], r["__n"], r["c"], r["p"]) for r in got if r["g"] == g)
            want = [(i, k + 1, len(own), sum(v > 4 for _, v in own[: k + 1]), own[k - 1][1] if k else None) for k, (i, v) in enumerate(own)]
            assert mine == want


def test_hot_clips_and_variants(spark):
    """A clip of many anchors and clauses has the cosine that brute force gives."""
    rng = np.random.default_rng(6)
    a, c = rng.normal(size=(700, 5)), rng.normal(size=(300, 5))
    table = lambda v, names: spark.createDataFrame([("hot", i, x.tolist()) for i, x in enumerate(v)], names)
    clauses = table(c, "clip_id string, clause_ord int, vector array<double>").unionByName(spark.createDataFrame([("none", 0, [1.0] * 5)],
        "clip_id string, clause_ord int, vector array<double>"))
    got = {(r["clip_id"], r["clause_ord"]): r for r in captions.prune_semantic(clauses, table(a, "clip_id string, n int, vector array<double>"), 0.9).collect()}
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    best = (unit(c) @ unit(a).T).max(1)
    assert all(abs(got["hot", i]["best"] - x) < 1e-12 and got["hot", i]["dropped"] == (x > 0.9) for i, x in enumerate(best))
    assert got["none", 0]["best"] is None and not got["none", 0]["dropped"]
    assert one(spark, captions.trigger_variant(F.lit("A bird, runs"), F.lit("A bird"), "TOK")) == "TOK, runs"
    assert one(spark, captions.trigger_variant(F.lit("A bird, runs"), F.lit(""), "TOK")) == "A bird, runs"


def test_shares_lists_and_draws(spark):
    clips = spark.createDataFrame([("gray",)] * 7 + [("show",)] * 3, "bg_type string")
    got = {r["bg_type"]: (r["n"], r["share"], r["ok"]) for r in composition.share_gates(clips, "bg_type", {"gray": 0.7, "show": 0.2, "none": 0.0}, 0.05).collect()}
    assert got == {"gray": (7, 0.7, True), "show": (3, 0.3, False), "none": (0, 0.0, True)}
    files = spark.createDataFrame([("b",), ("a",)], "path string")
    assert composition.all_categories({"x": files, "y": files}).groupBy("category").count().count() == 2
    assert composition.first_by_path(files, 1).first()["path"] == "a"
    rows = spark.createDataFrame([(0, "image"), (1, None), (2, "video")], "ord int, type string")
    assert [r["ord"] for r in runs.first_eligible(rows, 2).collect()] == [1, 2]
    drawn = sampling.draw_with_replacement(rows, "ord", 50, 3).collect()
    assert len(drawn) == 50 and {r["ord"] for r in drawn} == {0, 1, 2}
    assert sampling.draw_with_replacement(rows.limit(0), "ord", 5, 3).count() == 0


def test_positions_of_hot_and_null_groups(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit("rare")).alias("type"),
        (F.col("id") % 7 > 0).alias("good")).repartition(7)
    got = sampling.epoch_order(rows, "id", 1, 2, ["type"]).withColumn("u", sampling.draw(F.col("id").cast("string"), 1, "order", 2)).collect()
    for kind in ("hot", "rare", None):
        mine = sorted((r for r in got if r["type"] == kind), key=lambda r: (r["u"], r["id"]))
        assert [r["position"] for r in mine] == list(range(len(mine))) and mine
    assert sampling.epoch_order(rows, "id", 1, 2, resume=2990).count() == 10
    assert sampling.epoch_order(rows.limit(0), "id", 1, 2).count() == 0
    used = sampling.substitute_bad(rows, "id", 3).collect()
    kind_of, good = {r["id"]: r["type"] for r in got}, {r["id"] for r in got if r["good"]}
    assert len(used) == 3000 and all(r["use"] in good and kind_of[r["use"]] == r["type"] for r in used)
    none = spark.createDataFrame([(1, "a", False), (2, "a", None)], "id long, type string, good boolean")
    assert [r["use"] for r in sampling.substitute_bad(none, "id", 3).collect()] == [None, None]


def test_carried_batches(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else None) for i in range(10)], "id long, kind string")
    got = sampling.carried_batches(rows, "id", ["kind"], 4, 5, 3).collect()
    of = lambda kind: sorted((r["batch"], r["position"], r["epoch"], r["batch_epoch"]) for r in got if r["kind"] == kind)
    assert [x[0] for x in of("a")] == [i // 4 for i in range(20)] and [x[2] for x in of("a")] == [i // 7 for i in range(20)]
    assert [x[3] for x in of("a")] == [0] * 4 + [1] * 8 + [2] * 8 and len(of(None)) == 8


def test_mask_plan(spark):
    clips = spark.createDataFrame([(i, 1 if i % 10 == 0 else 2 + i % 48, 8 + i % 90, 8 + i % 70) for i in range(3000)], "id long, frames int, height int, width int")
    got = sampling.mask_plan(clips, "id", 7).collect()
    assert {r["mask_mode"] for r in got if r["frames"] > 1} == set(range(10)) and {r["mask_mode"] for r in got if r["frames"] == 1} == {0, 1}
    for r in got:
        assert r["coverage"] is None or 0 <= r["coverage"] <= 1
        if r["mask_mode"] in (6, 9):
            assert len({b["frame"] for b in r["boxes"]}) == len(r["boxes"]) and (r["mask_mode"] == 9 or 1 <= len(r["boxes"]) <= max(r["frames"] // 2, 1))
            assert all(0 <= b["x_from"] < b["x_to"] <= r["width"] and 0 <= b["y_from"] < b["y_to"] <= r["height"] and b["frame"] < r["frames"] for b in r["boxes"])
        elif r["mask_mode"] != 5:
            assert 0 <= r["frame_from"] <= r["frame_to"] <= r["frames"] and 0 <= r["x_from"] <= r["x_to"] <= r["width"] and 0 <= r["y_from"] <= r["y_to"] <= r["height"]


def test_breakdown_problems(spark):
    clips = spark.createDataFrame([(1, 1, "plate", ["a"], ["p", "x", None], 49), (1, 2, None, None, ["p"], None)],
        "shot_id long, clip_no int, background string, characters array<string>, props array<string>, frames int")
    registry = spark.createDataFrame([("character", "a"), ("prop", "p"), ("character", "x")], "kind string, id string")
    got = {tuple(r) for r in validate.breakdown_problems(clips, registry).collect()}
    assert got == {(1, 1, "unknown_prop", "x"), (1, 1, "unknown_prop", None), (1, 2, "frames", None), (1, 2, "background", None)}


def test_colour_metrics(spark):
    import colorsys

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (2, 40, 3), np.uint8), rng.integers(0, 256, (2, 40, 3), np.uint8)
    b[:, :20] = a[:, :20]
    got = frames.hue_saturation(a)
    for image, counts in zip(a, got, strict=True):
        want = np.zeros(3000)
        for pixel in image:
            h, s, _ = colorsys.rgb_to_hsv(*(pixel / 255))
            want[int((round(h * 180) % 180) * 50 // 180) * 60 + int(round(s * 255) * 60 // 256)] += 1
        assert np.abs(want - counts).sum() <= 2  # one pixel at a rounding edge
    x, y = frames.hue_saturation(a), frames.hue_saturation(b)
    assert np.allclose(frames.histogram_correlation(a, b), [np.corrcoef(p, q)[0, 1] for p, q in zip(x, y, strict=True)])
    assert np.allclose(frames.histogram_correlation(a, a), 1)
    g = frames.gaussian()
    cube = g[:, None, None] * g[None, :, None] * g[None, None, :]
    p, q = rng.random((3, 12, 12)), rng.random((3, 12, 12))

    def blur(v):
        v = np.pad(v, 5, mode="edge")
        return np.array([[[(v[k : k + 11, i : i + 11, j : j + 11] * cube).sum() for j in range(12)] for i in range(12)] for k in range(3)])

    mp, mq = blur(p), blur(q)
    vp, vq, cov = blur(p * p) - mp**2, blur(q * q) - mq**2, blur(p * q) - mp * mq
    want = ((2 * mp * mq + 1e-4) * (2 * cov + 9e-4) / ((mp**2 + mq**2 + 1e-4) * (vp + vq + 9e-4))).mean()
    assert abs(frames.similarity_terms(p, q, (0, 1, 2))[0] - want) < 1e-12
    assert np.allclose(frames.thumbnail(np.arange(64.0 * 64).reshape(1, 64, 64))[0], np.arange(64.0 * 64).reshape(32, 2, 32, 2).mean(axis=(1, 3)))
    big = rng.random((3, 40, 36))
    assert abs(frames.multi_scale(big, big) - 1) < 1e-9 and frames.multi_scale(big[:, :15], big[:, :15]) is None
    pairs = spark.createDataFrame([(1, [0.0] * 768, [0.0] * 768)], "id int, a array<double>, b array<double>")
    assert [round(v, 9) for v in frames.colour_pairs(pairs, 16, 16).first()[1:]] == [1.0, 1.0, 1.0]
