import json
import os

from pyspark.sql import functions as F

from emberline import constants as K
from emberline.functions.geo import with_bbox
from emberline.sources import manifest, sinks, tables


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_fire_tables_of_both_generations(spark, tmp_path):
    a = _write(tmp_path / "2017.csv", "Id,area,end_date,lat,lon,ratiocci,start_date\n001,5.5,2017-07-30,47.2,-107.7,0.9,2017-07-10\n")
    b = _write(tmp_path / "2021.csv", "Id,area,lat,lon,start_date,end_date,label_sel\nUS_1,12,47.1,-109.5,2021-10-02,2021-10-26,1\n")
    got = {r.Id: r for r in tables.load_fires(spark, [a], [b]).collect()}
    assert got["001"].label_sel is None and got["US_1"].ratiocci is None and got["US_1"].is_test
    assert str(got["001"].start_date) == "2017-07-10"


def test_bbox_by_id_and_index(spark, tmp_path):
    head = "Id,start_date,end_date,center_lat,center_lon,half_width_km,half_height_km,min_lon,min_lat,max_lon,max_lat,area,lat,lon,label_sel\n"
    rows = "".join(f"F{i},2021-01-01,2021-01-02,1,2,128,128,0,0,1,1,5,1,2,0\n" for i in range(4))
    path = _write(tmp_path / "b.csv", head + rows)
    assert tables.load_bboxes(spark, path, fire_id="F2").first().Id == "F2"
    assert [r.Id for r in tables.load_bboxes(spark, path, index=3).collect()] == ["F3"]


def test_manifests(spark, tmp_path):
    for p in ("f1/mask/20210705T180032_mask.tif", "f1/mask/notes.txt", "f2/VIIRS_Day/2021-07-05_VIIRS_Day.TIFF"):
        _write(tmp_path / "scenes" / p, "x")
    got = {(r.fire_id, r.source, str(r.ts)) for r in manifest.scene_manifest(spark, str(tmp_path / "scenes")).collect()}
    assert got == {("f1", "mask", "2021-07-05 18:00:32"), ("f2", "viirs_day", "2021-07-05 00:00:00")}
    _write(tmp_path / "raw/2020/366/18/a.nc", "x")
    _write(tmp_path / "raw/2020/001/b.nc", "x")
    days = {str(r.day) for r in manifest.raw_goes_manifest(spark, str(tmp_path / "raw")).collect()}
    assert days == {"2020-12-31", "2020-01-01"}


def test_event_directories(spark):
    dirs = spark.createDataFrame([("/g/2019/a",), ("/g/2018/a",), ("/g/b",), ("/g/2018/b",), ("/g/x/y/c",)], "dir string")
    fires = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "fire_id string")
    got = {r.fire_id: r.event_dir for r in manifest.resolve_event_dir(dirs, fires, "/g/").collect()}
    assert got == {"a": "/g/2018/a", "b": "/g/b", "c": "/g/x/y/c", "d": None}


def test_event_sources_fall_back_to_substrings(spark):
    dirs = spark.createDataFrame([("/g/f1/mask",), ("/g/f1/deep/frp",), ("/g/evt_f2_x/mask",), ("/g/f1x/mask",), ("/g/f1/other",)], "dir string")
    fires = spark.createDataFrame([("f1",), ("f2",)], "fire_id string")
    got = {(r.fire_id, r.dir, r.match) for r in manifest.resolve_event_sources(dirs, fires, ["mask", "frp"]).collect()}
    assert got == {("f1", "/g/f1/mask", "segment"), ("f1", "/g/f1/deep/frp", "segment"), ("f2", "/g/evt_f2_x/mask", "substring")}


def test_run_history_round_trip(spark, tmp_path):
    entry = {
        "timestamp": "2026-01-01T00:00:00Z",
        "plan": {"tool_name": "run_seq_model", "rationale": "r", "params": {"ts_length": 6}},
        "result": {"tool_name": "run_seq_model", "status": "success", "return_code": 0, "stdout": "f1 0.5", "stderr": "",
                   "command": ["-ts", "6"], "started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:00:05Z"},
        "evaluation": {"decision": "complete", "summary": "s", "metrics": {"f1": 0.5}},
    }
    _write(tmp_path / "state/a.json", json.dumps({"task": "af", "history": [entry, entry]}, indent=1))
    _write(tmp_path / "state/b.json", json.dumps({"task": "pred", "history": [entry]}, indent=1))
    runs = tables.load_runs(spark, str(tmp_path / "state"), task="af")
    assert [(r.step, r.params, r.metrics) for r in runs.orderBy("step").collect()] == [
        (1, {"ts_length": "6"}, {"f1": 0.5}), (2, {"ts_length": "6"}, {"f1": 0.5})]
    out = str(tmp_path / "runs")
    sinks.append_runs(runs, out, "1")
    sinks.append_runs(runs, out, "2")
    sinks.append_runs(runs, out, "1")  # a replay changes nothing
    back = sinks.read_runs(spark, out)
    assert back.count() == 2 * runs.count() and {r.batch for r in back.collect()} == {"1", "2"}


def test_dataset_write_replaces_only_its_partitions(spark, tmp_path):
    out = str(tmp_path / "ds")
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "fire_id string, split string")
    sinks.write_dataset(df, out, task="pred", ts_length=6, interval=1)
    sinks.write_dataset(df.where("split = 'train'").withColumn("fire_id", F.lit("z")), out, task="pred", ts_length=6, interval=1)
    got = {(r.fire_id, r.split) for r in spark.read.parquet(out).collect()}
    assert got == {("z", "train"), ("b", "val")}


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([("e", 1)], "event_id string, mask int")
    b = spark.createDataFrame([("f", 2)], "event_id string, frp int")
    path = str(tmp_path / "r.csv")
    sinks.write_csv_report([a, b], path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["event_id", "frp", "mask"] and back.count() == 2
    sinks.write_json_summary(a, str(tmp_path / "s.json"))
    assert spark.read.json(str(tmp_path / "s.json")).first().mask == 1


def test_geojson(spark, tmp_path):
    fires = spark.createDataFrame([("F", 47.182, -109.524)], "Id string, lat double, lon double")
    path = str(tmp_path / "g")
    sinks.write_geojson(with_bbox(fires), ["Id", "lat", "min_lon"], path)
    feature = json.loads(spark.read.text(path).first().value)
    ring = feature["geometry"]["coordinates"][0]
    assert feature["type"] == "Feature" and len(ring) == 5 and ring[0] == ring[4]
    assert ring[0] == [feature["properties"]["min_lon"], 46.024404181814894]


def test_sidecars(spark):
    rows = sinks.feature_names(spark, K.DAILY_FEATURES).collect()
    assert [r.feature_index for r in rows] == list(range(6)) and rows[5].feature_name == "goes_frp_max_max"
    sets = {r.name: r.channels for r in tables.feature_sets(spark).collect()}
    assert sets["af_core8"] == 8 and sets["pred_full43"] == 43 and len(sets) == 7


def test_prepared_names(spark):
    files = spark.createDataFrame(
        [("pred_train_img_seqtoseq_alll_6i_1.npy",), ("pred_val_label_seqtoseq_alll_4i_2.npy",), ("af_train_img_seqtoseq_alll_6i_1.npy",),
         ("pred_US_1_img_seqtoseql_6i_1.npy",)], "file_name string")
    got = {(r.split, r.kind, r.ts_length, r.interval) for r in manifest.prepared_catalog(files, "pred").collect()}
    assert got == {("train", "img", 6, 1), ("val", "label", 4, 2)}
    assert [(r.sample_id, r.kind) for r in manifest.prepared_test_files(files, "pred", 6, 1).collect()] == [("US_1", "img")]
