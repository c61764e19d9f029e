"""Files in and out: CSV, JSON, images, resumable runs, streams and whole jobs."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from evenhand.functions.text import Lexicon
from evenhand.operators import realism
from evenhand.plans.audit import audit_from_files, stratified_audit
from evenhand.plans.curation import build_pairs, curate_records
from evenhand.plans.manifest import dual_rater_manifest, single_rater_manifest
from evenhand.schemas import CLASS_LABELS, CONVERSATION, MissingColumnsError
from evenhand.session import new_work_path, reliable_checkpoint, shared_dir
from evenhand.sources import images, sinks, tables
from evenhand.streaming.rowwise import read_record_stream, run_until_done


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def image_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    skin = np.full((40, 48, 3), (210, 160, 130))
    dark = skin.copy()
    dark[:10] = 0
    png(folder / "skin.png", skin)
    png(folder / "dark.png", dark)
    png(folder / "green.png", np.full((40, 48, 3), (20, 200, 30)))
    (folder / "broken.png").write_bytes(b"not an image")
    (folder / "notes.txt").write_text("x")
    return folder


def test_image_listing_and_path_resolution(spark, image_folder):
    listing = images.list_images(spark, str(image_folder))
    assert {r["stem"] for r in listing.collect()} == {"skin", "dark", "green", "broken"}
    items = spark.createDataFrame([("skin", None), ("none", "dark"), ("gone", None)], "image_id string, alt string")
    resolved = images.resolve_paths(items, listing, "image_id", (".jpg", ".png"), [("alt", ("", ".png"))])
    got = {r["image_id"]: r["path"] and r["path"].rsplit("/", 1)[1] for r in resolved.collect()}
    assert got == {"skin": "skin.png", "none": "dark.png", "gone": None}
    assert [r["image_id"] for r in images.missing_paths(resolved).collect()] == ["gone"]


def test_image_features_and_gate(spark, image_folder):
    decoded = images.read_images(spark, str(image_folder))
    assert decoded.count() == 3
    feats = images.image_features(decoded).withColumn("reason", realism.realism_reason())
    got = {r["path"].rsplit("/", 1)[1]: r for r in feats.collect()}
    skin = got["skin.png"]
    # sRGB (210, 160, 130) is L* 69.5, a* 14.3, b* 22.9.
    assert skin["L_mean"] / 2.55 == pytest.approx(69.5, abs=0.5)
    assert skin["a_mean"] - 128 == pytest.approx(14.3, abs=1.0) and skin["b_mean"] - 128 == pytest.approx(22.9, abs=1.0)
    assert skin["L_std"] == 0.0 and skin["border_hue_median"] == pytest.approx(11.0, abs=0.6)
    assert skin["border_sat_mean"] == pytest.approx(97.0, abs=1.0) and skin["border_val_mean"] == 210.0
    assert skin["reason"] == "ok" and skin["dark_fraction"] == 0.0
    expected = np.degrees(np.arctan2(skin["L_mean"] / 2.55 - 50, skin["b_mean"] - 128))
    assert skin["ita"] == pytest.approx(expected)
    assert got["dark.png"]["dark_fraction"] == 0.25
    assert got["green.png"]["reason"].startswith("border_non_skin_hue=")
    flags = {r["path"].rsplit("/", 1)[1]: r["f"] for r in feats.select(
        "path", images.vignette_flag(F.col("dark_fraction")).alias("f")).collect()}
    assert flags == {"skin.png": False, "dark.png": True, "green.png": False}


def test_ring_mask_gives_the_angle_and_patches_are_the_fallback(spark, tmp_path):
    left, right = (210, 160, 130), (90, 60, 40)
    both = np.full((40, 48, 3), left)
    both[:, 24:] = right
    png(tmp_path / "both.png", both)
    decoded = images.read_images(spark, str(tmp_path))
    ring = np.zeros((40, 48), np.uint8)
    ring[:, 24:] = 1
    few = np.zeros((40, 48), np.uint8)
    few[0, :12] = 1

    def tone(mask):
        rows = decoded.withColumn("ring", F.lit(None).cast("binary") if mask is None else F.lit(bytes(mask)))
        return images.tone_by_angle(rows, ring="ring", min_ring_pixels=100, patch=8, margin=2).first()

    plain = images.tone_by_angle(decoded, patch=8, margin=2).first()
    found = tone(ring.tobytes())
    dark = np.full((1, 1, 3), right)[..., ::-1]
    assert found["method"] == "perilesional_ring" and found["ita_std"] == 0.0
    assert found["ita"] == pytest.approx(float(images.angles_of(dark)[0, 0]))
    for mask in (few.tobytes(), b"", ring.tobytes()[:-1], None):
        assert tone(mask) == plain and plain["method"] == "multi_patch"


def test_masks_of_ring_and_centre_equal_their_positions():
    from evenhand.functions.arrays import border_positions, centre_positions

    for h, w in [(40, 48), (9, 7), (64, 33)]:
        ring, centre = images.ring_and_centre(h, w)
        assert np.flatnonzero(ring).tolist() == border_positions(h, w)
        assert np.flatnonzero(centre).tolist() == sorted(centre_positions(h, w))
    for h, w in [(1, 1), (2, 3), (3, 1)]:
        ring, centre = images.ring_and_centre(h, w)
        assert ring.all() and centre.any()


def test_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.PNG", "b.Png", "c.png"):
        png(tmp_path / name, np.full((8, 8, 3), (210, 160, 130)))
    (tmp_path / "d.txt").write_text("x")
    assert images.list_images(spark, str(tmp_path)).count() == 3
    assert images.read_images(spark, str(tmp_path)).count() == 3


def test_unreadable_image_as_placeholder(spark, image_folder):
    rows = images.read_images(spark, str(image_folder), on_error="placeholder").collect()
    bad = [r for r in rows if r["path"].endswith("broken.png")]
    assert len(rows) == 4 and (bad[0]["height"], bytes(bad[0]["data"])) == (1, bytes((128, 128, 128)))
    with pytest.raises(ValueError):
        images.read_images(spark, str(image_folder), on_error="ignore")


def test_csv_by_name_missing_and_optional_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("extra,confidence,image_id,predicted_label\nq,nan,a,Dark\nq,0.5,b,\n")
    got = tables.read_csv(spark, str(tmp_path / "t.csv"), CLASS_LABELS, ["image_id"]).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [(None, "a", "Dark", None), (None, "b", None, 0.5)]
    with pytest.raises(MissingColumnsError):
        tables.read_csv(spark, str(tmp_path / "t.csv"), CLASS_LABELS, ["image_path"])


def test_prediction_files_by_tag(spark, tmp_path):
    for tag, value in [("orig", 0.25), ("lambda_03", 0.75)]:
        (tmp_path / f"{tag}_predictions.csv").write_text(f"image_id,pred_idx,prob_A,prob_B\nx,1,{value},0.5\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    got = {r["model"]: r["prob_A"] for r in tables.read_predictions(spark, str(tmp_path), ["A", "B"]).collect()}
    assert got == {"orig": 0.25, "lambda_03": 0.75}
    assert tables.read_predictions(spark, str(tmp_path), ["A", "B"], ["orig"]).count() == 1
    with pytest.raises(MissingColumnsError):
        tables.read_predictions(spark, str(tmp_path), ["A", "C"])


def test_json_array_lines_and_optional_input(spark, tmp_path):
    schema = T.StructType().add("image_id", "string").add("n", "long")
    records = [{"image_id": "a", "n": 1}, {"image_id": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    assert tables.read_json_array(spark, str(tmp_path / "a.json"), schema).collect() == tables.read_json_lines(
        spark, str(tmp_path / "a.jsonl"), schema).collect()
    assert tables.read_json_lines(spark, str(tmp_path / "none.jsonl"), schema, optional=True).count() == 0
    with pytest.raises(Exception):
        tables.read_json_lines(spark, str(tmp_path / "none.jsonl"), schema)


def test_mixed_message_content_is_normalised(spark, tmp_path):
    record = {"messages": [{"role": "system", "content": "be [kind]"}, {"role": "user", "content": [
        {"type": "image", "image": "/a.jpg"}, {"type": "text", "text": "hi"}]}, {"role": "assistant", "content": "[]"}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(record) + "\n")
    df = tables.read_conversations(spark, str(tmp_path / "c.jsonl"))
    assert df.schema.simpleString() == CONVERSATION.simpleString()
    system, user, assistant = df.first()["messages"]
    assert [tuple(p) for p in system["content"]] == [("text", None, "be [kind]")]
    assert [tuple(p) for p in user["content"]] == [("image", "/a.jpg", None), ("text", None, "hi")]
    assert assistant["content"][0]["text"] == "[]"


def test_resumed_batch_adds_only_what_is_missing(spark, tmp_path):
    source = spark.range(100).withColumnRenamed("id", "k")
    seen = []

    def step(df):
        seen.append(df.count())
        return df

    path = str(tmp_path / "sink")
    sinks.resume_batch(source.where("k < 25"), path, "k", step)
    assert sinks.resume_batch(source, path, "k", step).count() == 100
    assert sinks.resume_batch(source, path, "k", step).count() == 100
    assert seen == [25, 75, 0]


def test_stream_continues_from_its_checkpoint(spark, tmp_path):
    schema = T.StructType().add("k", "long")
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"k": 1}\n{"k": 2}\n')
    stream = read_record_stream(spark, str(inbox), schema)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run_until_done(stream, lambda df: df.withColumn("d", F.col("k") * 2), out, mark)
    (inbox / "2.json").write_text('{"k": 3}\n')
    run_until_done(stream, lambda df: df.withColumn("d", F.col("k") * 2), out, mark)
    assert sorted(r["d"] for r in spark.read.parquet(out).collect()) == [2, 4, 6]


def test_sinks_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", None)], "id string, c double")
    sinks.write_kept_and_filtered(df, F.col("c") >= 0.5, str(tmp_path / "k"))
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"kept=true", "kept=false"}
    sinks.write_report(sinks.report_json({"rows": df, "again": df.select("id")}), str(tmp_path / "r"))
    parsed = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert parsed["rows"][0] == {"id": "a", "c": 0.9} and len(parsed["again"]) == 3


def test_shared_folder_comes_from_the_session(spark):
    assert new_work_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)
    copy = reliable_checkpoint(spark.range(5).selectExpr("id", "array(id) a"))
    assert copy.count() == 5 and "FileScan" in copy._jdf.queryExecution().toString()


def test_settled_tables_have_a_known_size(spark):
    from evenhand.session import broadcast_limit, planned_bytes, settle

    small = spark.range(3)
    assert settle(small) is small
    wide = spark.range(50_000_000).selectExpr("id % 3 as k", "repeat('x', 100) as s")
    classes = wide.groupBy("k").count()
    assert planned_bytes(classes) > broadcast_limit(spark) >= planned_bytes(settle(classes))
    joined = wide.join(settle(classes), "k")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()


def test_audit_job(spark):
    classes = ["A", "B"]
    items = [(f"i{i}", ["Light", "Dark", "Medium"][i % 3], 0.5 + (i % 6) / 10, classes[i % 2], f"s{i % 2}") for i in range(120)]
    base = spark.createDataFrame(items, "image_id string, stratum string, confidence double, true_class string, source string")
    predictions = [(m, i, t if m == "best" or int(i[1:]) % 4 else "A", [0.5, 0.5]) for m in ("orig", "best") for i, _, _, t, _ in items]
    preds = spark.createDataFrame(predictions, "model string, image_id string, pred_class string, probs array<double>")
    job = stratified_audit(
        base.select("image_id", "stratum", "confidence"), base.select("image_id", "true_class"), preds,
        ["orig", "best"], "orig", classes, classes, metadata=base.select("image_id", "source"), draws=50)
    rows = {(r["model"], r["stratum"]): r for r in job.metrics.collect()}
    assert rows[("best", "Overall")]["accuracy"] == 1.0 and rows[("best", "Overall")]["macro_auc"] == 0.5
    assert rows[("orig", "Overall")]["n"] == 100  # confidence 0.5 is below the first threshold
    assert {r["model"] for r in job.grid.collect()} == {"orig", "best"}
    strict = {(r["threshold"], r["model"], r["stratum"]): r["n"] for r in job.sensitivity_metrics.collect()}
    assert strict[(0.8, "orig", "Overall")] == 60
    assert {"macro_auc", "weighted_f1", "f1_A"} <= set(job.sensitivity_metrics.columns) and len(strict) == 16
    few = base.withColumn("confidence", F.when(F.col("stratum") == "Dark", 0.65).otherwise(F.col("confidence")))
    again = stratified_audit(few.select("image_id", "stratum", "confidence"), base.select("image_id", "true_class"), preds,
                             ["orig", "best"], "orig", classes, classes, draws=5)
    empty = again.sensitivity_metrics.where("threshold = 0.8 and stratum = 'Dark'").collect()
    assert [(r["n"], r["macro_f1"], r["macro_auc"]) for r in empty] == [(0, None, None)] * 2
    assert job.mcnemar.where("stratum = 'Overall'").first()["only_baseline_correct"] == 0
    assert job.intervals.count() == 8 and job.source_composition.count() == 7
    assert set(job.items()) >= {"metrics", "grid", "intervals", "mcnemar", "class_composition"}


def test_audit_from_files(spark, tmp_path):
    classes, space = ["MEL", "NV"], ["MEL", "NV", "UNK"]
    truth, strata = ["image,MEL,NV,UNK"], ["file,mst_name,confidence_val,has_vignette"]
    preds = {m: ["image_id,pred_idx,prob_MEL,prob_NV,prob_UNK"] for m in ("orig", "best")}
    for i in range(60):
        k, unk = i % 2, i % 10 == 9
        truth.append(f"i{i},{float(k == 0)},{float(k == 1)},{float(unk)}")
        strata.append(f"i{i}.jpg,{'Light' if i % 3 else 'Dark'},{0.95 if i % 5 else 0.65},{'True' if i == 0 else 'False'}")
        preds["best"].append(f"i{i},{k},{0.9 - 0.8 * k},{0.1 + 0.8 * k},0.0")
        preds["orig"].append(f"i{i},{2 if i % 7 == 0 else k},0.4,0.4,0.2")
    (tmp_path / "truth.csv").write_text("\n".join(truth))
    (tmp_path / "strata.csv").write_text("\n".join(strata))
    for m, lines in preds.items():
        (tmp_path / f"{m}_predictions.csv").write_text("\n".join(lines))
    (tmp_path / "meta.csv").write_text("isic_id,attribution\n" + "\n".join(f"i{i},site{i % 2}" for i in range(50)))

    def run(out, **kw):
        return audit_from_files(spark, str(tmp_path / "truth.csv"), str(tmp_path / "strata.csv"), str(tmp_path),
                                str(tmp_path / out), ["orig", "best"], "orig", classes, space, draws=20, **kw)

    rows = {(r["model"], r["stratum"]): r for r in run("out", metadata_csv=str(tmp_path / "meta.csv")).metrics.collect()}
    assert rows[("best", "Overall")]["n"] == 54 and rows[("best", "Overall")]["macro_f1"] == 1.0
    assert rows[("best", "Overall")]["macro_auc"] == 1.0 and rows[("orig", "Overall")]["macro_auc"] == 0.5
    grid = spark.read.option("header", True).csv(str(tmp_path / "out" / "grid"))
    assert grid.count() == 2 and set(grid.columns) == {"model", "Light", "Medium", "Dark", "Overall"}
    sites = spark.read.option("header", True).csv(str(tmp_path / "out" / "source_composition"))
    assert {"site0", "site1", "UNKNOWN"} == {r["source"] for r in sites.collect()}
    unknown = {(r["model"], r["stratum"]): r for r in run("unk", include_unknown=True, without_flagged=True).metrics.collect()}
    assert unknown[("best", "Overall")]["n"] == 59 and unknown[("best", "Overall")]["recall_UNK"] == 0.0


def test_manifests(spark):
    taxonomy = spark.createDataFrame(
        [("STRICT", "melanoma", "MEL"), ("HIERARCHY", "melanoma", "MEL"), ("HIERARCHY", "mole", "NV")],
        "arm string, raw_label string, label string")
    listing = spark.createDataFrame([(f, f"/d/{f}") for f in ("a.png", "u2.jpg", "c.jpg", "7.JPG")], "file string, path string")
    raw = spark.createDataFrame([
        ("a", "melanoma", "2", "3", "http://www.DermaAmin.com/x", None), ("b", "mole", "5.0", "x", None, "u2"),
        ("c", "mole", "7", "1", "http://o", None), ("c", "other", "1", "1", "http://o", None), ("gone", "mole", "1", "1", "http://o", None)],
        "md5hash string, label string, fitzpatrick_scale string, fitzpatrick_centaur string, url string, url_alphanum string")
    got = {(r["image_id"], r["mapping"]): r for r in dual_rater_manifest(raw, listing, taxonomy).collect()}
    assert set(got) == {("a", "STRICT"), ("a", "HIERARCHY"), ("b", "HIERARCHY")}
    a, b = got[("a", "STRICT")], got[("b", "HIERARCHY")]
    assert (a["path"], a["true_class"], a["fst_tertile"], a["source"], a["fitzpatrick_centaur"]) == (
        "/d/a.png", "MEL", "Light", "dermaamin", 3.0)
    assert (b["path"], b["fst_tertile"], b["source"], b["fitzpatrick_centaur"]) == ("/d/u2.jpg", "Dark", "unknown", None)
    single = spark.createDataFrame([(7, "melanoma", "0", None), (7, "mole", "5", "s"), (8, "mole", "1", "s")],
                                   "isic_id int, dx string, skin_tone_class string, attribution string")
    got = single_rater_manifest(single, listing, taxonomy, "dx", ["HIERARCHY"]).orderBy("skin_tone_class").collect()
    assert [(r["image_id"], r["tone_tertile"], r["source"]) for r in got] == [("7", "Dark", "unknown"), ("7", "Light", "s")]


def test_patch_angles_and_tone(spark, image_folder):
    decoded = images.read_images(spark, str(image_folder))
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.tone_by_angle(decoded, patch=8, margin=2).collect()}
    skin = got["skin.png"]
    assert skin["ita"] == pytest.approx(np.degrees(np.arctan2(69.5 - 50, 22.9)), abs=1.5)
    assert skin["ita_std"] == 0.0 and skin["confidence"] == "high" and skin["mst_name"] == "Light (MST 3-4)"
    assert got["dark.png"]["ita"] == pytest.approx(skin["ita"])  # the dark band is avoided
    patches = images.patch_angles(decoded, patch=8, margin=2).groupBy("path").count().collect()
    assert {r["path"].rsplit("/", 1)[1]: r["count"] for r in patches} == {"skin.png": 8, "green.png": 8, "dark.png": 5}


def test_patch_rule_is_the_same_for_columns_and_pixels(spark):
    rng = np.random.default_rng(2)
    masks = []
    for n in range(40):
        y, x = np.mgrid[0:60, 0:80]
        cy, cx, r = rng.integers(15, 45), rng.integers(20, 60), rng.integers(0, 60)
        masks.append((y - cy) ** 2 + (x - cx) ** 2 < r * r)
    df = spark.createDataFrame([(n, m.ravel().tolist()) for n, m in enumerate(masks)], "n int, mask array<boolean>")
    spots = realism.patch_positions(F.col("mask"), F.lit(60), F.lit(80), patch=12, margin=6)
    for r in df.select("n", spots.alias("s")).collect():
        assert [tuple(s) for s in r["s"]] == images.patch_corners(masks[r["n"]], 12, 6, 0.95)


def test_curation_job(spark):
    text = "alpha beta maybe " + "word " * 60
    rows = [(f"i{i}", text if i % 4 else "alpha", "mel" if i % 2 else "nv", "upper", "n", 0.5, {"a": 0.5}, "weak", "/p", "/o")
            for i in range(80)]
    records = spark.createDataFrame(rows, "image_id string, teacher_reasoning string, predicted_class string, "
        "gradcam_spatial_region string, predicted_name string, confidence double, all_scores map<string,double>, "
        "gradcam_intensity string, image_path string, gradcam_overlay_path string")
    lexicon = Lexicon(keywords={"mel": ["alpha", "beta"], "nv": ["alpha", "beta"]}, hedges=("maybe",))
    job = curate_records(records, lexicon, minimum=60)
    assert job.clean.count() == 60 and {r["reason"] for r in job.discarded.collect()} == {"keyword_fail"}
    report = {(r["section"], r["name"]): r["count"] for r in job.report.collect()}
    assert report[("total", "clean")] == 60 and report[("threshold", "meets_minimum")] == 1 and report[("reason", "safety_fail")] == 0
    splits = {r["split"]: r["count"] for r in job.conversations.groupBy("split").count().collect()}
    assert splits == {"train": 51, "validation": 6, "test": 3}
    candidates = spark.createDataFrame([("i1", 0, "bad"), ("i1", 1, text), ("zz", 0, "bad"), ("zz", 1, "bad")],
                                       "image_id string, n int, body string")
    pairs = build_pairs(candidates, records.select("image_id", "predicted_class", "gradcam_spatial_region"),
                        "image_id", "n", "body", lexicon).collect()
    assert [(p["image_id"], p["chosen"], p["rejected"]) for p in pairs] == [("i1", text, "bad")]


def test_each_model_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "one_predictions.csv").write_text("image_id,pred_idx,prob_A,prob_B\nx,1,0.1,0.9\n")
    (tmp_path / "two_predictions.csv").write_text("prob_B,image_id,prob_A,pred_idx\n0.9,x,0.1,1\n")
    got = tables.read_predictions(spark, str(tmp_path), ["A", "B"]).collect()
    assert {(r["model"], r["image_id"], r["pred_idx"], r["prob_A"], r["prob_B"]) for r in got} == {
        ("one", "x", 1, 0.1, 0.9), ("two", "x", 1, 0.1, 0.9)}
    with pytest.raises(FileNotFoundError):
        tables.read_predictions(spark, str(tmp_path), ["A", "B"], tags=["three"])


def test_files_of_one_read_must_share_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("predicted_label,image_id,confidence\nmel,x,0.5\n")
    (tmp_path / "b.csv").write_text("image_id,confidence,predicted_label\ny,0.5,mel\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(tmp_path), CLASS_LABELS, ["image_id"]).collect()


def test_pairs_carry_prompts_and_listed_keywords(spark):
    texts = [("k", 1, "wanted words here, consistent with this"), ("k", 2, "none of it"), ("m", 1, "same"), ("m", 2, "same")]
    candidates = spark.createDataFrame(texts, "key string, turn int, text string")
    metadata = spark.createDataFrame(
        [("k", "mel", "center", ["wanted", "words", "here"]), ("k", "zzz", "center", None)],
        "key string, predicted_class string, gradcam_spatial_region string, expected_keywords array<string>")
    messages = "array<struct<role: string, content: array<struct<type: string, image: string, text: string>>>>"
    chat = [("system", [("text", None, "s")]), ("user", [("text", None, "u")]), ("assistant", [("text", None, "a")])]
    conversations = spark.createDataFrame([("k", chat), ("m", chat)], f"key string, messages {messages}")
    lexicon = Lexicon(min_keywords=3)
    pairs = build_pairs(candidates, metadata, "key", "turn", "text", lexicon, conversations=conversations).collect()
    assert [(r["key"], r["chosen"], r["rejected"]) for r in pairs] == [("k", texts[0][2], texts[1][2])]
    assert [m["role"] for m in pairs[0]["prompt"]] == ["system", "user"]
    assert pairs[0]["chosen_details"]["keywords"]["matched"] == 3
