import gzip
import json

import pytest
from pyspark.sql import Row, Window, functions as F

from strideframe.operators import normalize as nz, reports as rp
from strideframe.plans import prepare
from strideframe.schema import ROW_LOG_COLUMNS
from strideframe.sources import files, records
from strideframe.sources.registry import SourceConfig, read_source, register_source
from tests.helpers import nodes, plain_plans, values

L = {"bus": 0, "car": 1, "train": 2}


def test_ragged_logs(spark, tmp_path):
    (tmp_path / "sensorfile_U1_car_123.csv").write_bytes(
        b"1000,android.sensor.accelerometer,1,2,3,extra\n1001,pressure,1000,,\n1002,pressure,1000\n1003,gyroscope,1\nbad\xff,x,1,2,3\n")
    found = read_source(spark, "path_logs", SourceConfig(str(tmp_path)), L)
    rows = values(found, "participant_id", "session_id", "vehicle_type", "label", "timestamp_ms", "ax", "p")
    assert len(rows) == 3
    assert {r[:4] for r in rows} == {("U1", "sensorfile_U1_car_123", "car", 1)}
    assert {(r[4], r[5], r[6]) for r in rows} == {(1000, 1.0, None), (1001, None, 1000.0), (1002, None, 1000.0)}


ROW = "p1,1,2,m,x,2024-01-01T00:00:00Z,CAR,{kind},pocket,1,2,3,{os}"


def test_row_logs(spark, tmp_path):
    lines = [",".join(ROW_LOG_COLUMNS), ROW.format(kind="android.sensor.accelerometer", os="ANDROID"),
             ROW.format(kind="CMAccelerometerData", os="iOS"), ROW.format(kind="relative altimeter", os="iOS"),
             ROW.format(kind="unknown", os="iOS"), ROW.format(kind="CMGyroData", os="iOS").replace("2024-01-01", "never")]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    found = read_source(spark, "row_logs", SourceConfig(str(tmp_path)), L)
    assert {r[0] for r in values(found, "session_id")} == {"p1#1#2"}
    assert {r[0] for r in values(found, "timestamp_ms")} == {1704067200000}
    assert sorted(r[0] for r in values(found.where("ax IS NOT NULL"), "ax")) == pytest.approx([1.0, 9.80665])
    assert values(found.where("p IS NOT NULL"), "p") == [(10.0,)]


def test_row_logs_need_their_columns(spark, tmp_path):
    (tmp_path / "log.csv").write_text("installationId,OS\np1,iOS\n")
    with pytest.raises(ValueError, match="journeyNumber"):
        files.read_row_logs(spark, str(tmp_path))


def test_row_logs_are_read_by_name(spark, tmp_path):
    line = ROW.format(kind="android.sensor.accelerometer", os="ANDROID").split(",")
    for name, order in (("a", range(len(line))), ("b", range(len(line) - 1, -1, -1))):
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(x[i] for i in order) for x in (ROW_LOG_COLUMNS, line)) + "\n")
    found = files.read_row_logs(spark, str(tmp_path))
    assert values(found, *ROW_LOG_COLUMNS) == [tuple(line)] * 2
    (tmp_path / "c.csv").write_text(",".join(c for c in ROW_LOG_COLUMNS if c != "OS") + "\n")
    with pytest.raises(ValueError, match="c.csv is missing columns: OS"):
        files.read_row_logs(spark, str(tmp_path))


def test_tagged_values_are_kept_at_any_depth(spark):
    item = {"m": {"M": {"s": {"SS": ["a", "b"]}, "deep": {"M": {"n": {"N": "1.5"}, "l": {"L": [{"S": "x"}, {"M": {"k": {"BOOL": True}}}]}}}}},
            "l": {"L": [{"N": "1"}, {"L": [{"S": "y"}]}, {"NULL": True}]}}
    df = spark.createDataFrame([(1, json.dumps(item))], "id long, d string")
    found = {r.attribute: (r.kind, r.text, r.whole, r.real, r.flag, r["items"]) for r in records.decode_tagged(df, "d", ["id"]).collect()}
    assert found == {
        "m.s": ("SS", None, None, None, None, ["a", "b"]), "m.deep.n": ("N", None, None, 1.5, None, None),
        "m.deep.l": ("L", None, None, None, None, ["x", None]), "m.deep.l.1.k": ("BOOL", None, None, None, True, None),
        "l": ("L", None, None, None, None, ["1", None, None]), "l.1": ("L", None, None, None, None, ["y"])}
    with pytest.raises(Exception, match="unsupported tag"):
        records.decode_tagged(spark.createDataFrame([(1, json.dumps({"m": {"M": {"x": {"Q": "1"}}}}))], "id long, d string"), "d", ["id"]).collect()
    deep = {"S": "end"}
    for k in range(25):
        deep = {"L": [deep]} if k % 5 == 4 else {"M": {"k": deep}}
    frame = records.decode_tagged(spark.createDataFrame([(1, json.dumps({"a": deep})), (2, json.dumps({"b": {"S": "x"}}))], "id long, d string"), "d", ["id"])
    found = {r.attribute: (r.id, r.text) for r in frame.where("kind = 'S'").collect()}
    assert len(found) == 2 and found["b"] == (2, "x") and max(a.count(".") for a in found) == 25
    assert sorted(v[1] for v in found.values()) == ["end", "x"]


def test_tagged_documents_are_read_once_and_odd_ones_by_spark(spark, monkeypatch):
    plain = [
        '{"a":{"S":"x"}}', '{"":{"S":""},"a.b":{"M":{"c":{"N":"1"}}}}', '{"b":{"BOOL":true},"c":{"BOOL":"false"},"n":{"NULL":true}}', "{}", None,
        ' {"m":{"M":{}},"l":{"L":[]},"s":{"BS":["p","q"]}}', '{"l":{"L":[{"L":[{"S":"y"},{"M":{"k":{"N":"2.5"}}}]},{"NULL":true},{"N":"3"},{"BOOL":false}]}}',
        '{"e":{"S":"\\ud83d\\ude00 \\u00e9 \u00e9\U0001f600\\n"}}', '{"d":' + '{"M":{"in":' * 30 + '{"S":"end"}' + "}}" * 30 + "}"]
    odd = [
        '{"a":{"N":5},"b":{"N":1.50},"c":{"N":-2e3}}', '{"a":{"S":{"x": 1}}}', '{"a":{"S":"1"},"a":{"S":"2"}}', '{"a":{"S":"1","N":"2"}}', '{"a":{"S":"x"}', '{"a":{"S":"x"}} more',
        '{"e":{"S":"\\ud83d"}}', "[]", "", "none", '{"l":{"L":[{"S":null},{"N":3}]}}', '{"n":{"NULL":5},"m":{"M":null}}', '{"s":{"SS":["a",null]},"t":{"NS":[1,2]},"u":{"SS":"a"}}',
        "{'a':{'S':'x'}}", '{"a":{"S":null}}']
    make = lambda texts: spark.createDataFrame([(k if k % 4 else None, "key", x) for k, x in enumerate(texts)], "id long, other string, d string")
    said = lambda texts: sorted(map(str, records.decode_tagged(make(texts), "d", ["id", "other"]).collect()))
    whole, level = records._read_whole, records._unnested
    monkeypatch.setattr(records, "_unnested", None)
    first = said(plain)
    assert len(first) == 13 and said([]) == []
    monkeypatch.setattr(records, "_unnested", level)
    both = said(plain + odd)

    def none_read(rows, column, keys):
        return rows.select(*[F.when(F.lit(False), F.lit(None)).cast(f.dataType).alias(f.name) if f.name not in keys and f.name != "_odd" else
                             F.col(column).cast("binary").alias("_odd") if f.name == "_odd" else F.col(f.name) for f in whole(rows, column, keys).schema]).where("_odd IS NOT NULL")
    monkeypatch.setattr(records, "_read_whole", none_read)
    assert said(plain) == first and said(plain + odd) == both


def test_drains_read_every_key_once(spark, tmp_path, monkeypatch):
    from strideframe import sinks
    make = lambda n: spark.createDataFrame([(f"s{k}", f"k{k // 2:03d}", "in" if k % 3 else "out") for k in range(n)] + [("none", None, "in")], "session_id string, sync_key string, sync_partition string")
    path = str(tmp_path / "t")
    assert records.drain_keys(make(0), "in", path) == 0
    assert records.drain_keys(make(20), "in", path, 5) == 3
    want = lambda n: sorted(f"s{k}" for k in range(n) if k % 3)
    held = lambda: sorted(r.session_id for r in sinks.read_appended(spark, path).collect())
    assert held() == want(20)
    # A drain that dies between reading and publishing loses nothing and repeats nothing.
    system = sinks._file_system
    monkeypatch.setattr(sinks, "_file_system", lambda s, p: (_ for _ in ()).throw(OSError("lost")) if "/_published/" in p else system(s, p))
    with pytest.raises(OSError):
        records.drain_keys(make(40), "in", path, 100)
    monkeypatch.setattr(sinks, "_file_system", system)
    assert held() == want(20)
    assert records.drain_keys(make(40), "in", path, 100) == 1 and held() == want(40)
    assert records.drain_keys(make(40), "in", path, 100) == 0


def test_drains_find_all_pages_by_the_same_passes(spark, tmp_path, monkeypatch):
    import random

    from strideframe import sinks
    from strideframe.operators.ordered import range_blocks
    # Blocks of few keys, with equal keys across the places where a page would end.
    monkeypatch.setattr(records, "range_blocks", lambda df, keys, order: range_blocks(df.withColumn("_x", F.lit(0)), ["_x"], order).drop("_x").withColumn("_block", (F.row_number().over(Window.orderBy(*order)) / 7).cast("int")))
    draw = random.Random(3)
    for name, times in (("one", lambda: 1), ("pairs", lambda: 2), ("mixed", lambda: draw.choice([1, 1, 1, 1, 4, 13]))):
        keys = [f"k{k:03d}" for k in range(60) for _ in range(times())]
        want, held = [], 0  # a loop over the sorted keys
        for at, k in enumerate(keys):
            held += 1
            if held >= 10 and (at + 1 == len(keys) or keys[at + 1] != k):
                want, held = [*want, k], 0
        want += [keys[-1]] if held else []
        draw.shuffle(keys)
        rows = spark.createDataFrame([(f"s{i}", k, "in") for i, k in enumerate(keys)], "session_id string, sync_key string, sync_partition string").repartition(3)
        assert records.page_ends(rows.select("sync_key"), "sync_key", 10) == want
        path, scans = str(tmp_path / name), []
        scan = records.incremental_key_scan
        monkeypatch.setattr(records, "incremental_key_scan", lambda *a: scans.append(a) or scan(*a))
        assert records.drain_keys(rows, "in", path, 10) == len(want) and len(scans) == 2
        monkeypatch.setattr(records, "incremental_key_scan", scan)
        batches = [[r[0] for r in spark.read.parquet(f"{path}/rows-{b.replace('.', '/_page=')}").select("sync_key").collect()] for b in sinks._published(spark, path)]
        assert sorted(max(b) for b in batches) == want and sorted(sum(batches, [])) == sorted(keys)
        assert sinks.read_appended(spark, path).columns == rows.columns and sinks.recorded_keys(spark, path).count() == len(set(keys))


def test_exports_without_rows_keep_their_header(spark, tmp_path):
    from strideframe import sinks
    sinks.write_delimited(spark.createDataFrame([], "a int, b string"), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == ["a", "b"]


def test_appends_are_all_or_nothing(spark, tmp_path):
    from strideframe import sinks
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("s1", 1), ("s1", 2), (None, 3)], "session_id string, x int")
    assert sinks.read_appended(spark, path) is None
    rows.limit(1).write.parquet(f"{path}/rows-half")  # a batch that was never published
    for _ in range(2):
        sinks.append_unseen(rows, path)
    assert sorted(r.x for r in sinks.read_appended(spark, path).collect()) == [1, 2, 3]
    sinks.append_unseen(spark.createDataFrame([("s1", 9), ("s2", 4)], "session_id string, x int"), path)
    assert sorted(r.x for r in sinks.read_appended(spark, path).collect()) == [1, 2, 3, 4]


def test_manifest_is_completed(spark, tmp_path):
    from strideframe import sinks
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    assert sinks.atomic_write(spark.range(7), path) is None
    assert spark.read.json(f"{path}/_manifest").first().rows == 5


def document(tmp_path, name, body, sidecar=None, zipped=False):
    text = json.dumps(body)
    if zipped:
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write(text)
    else:
        (tmp_path / f"{name}.json").write_text(text)
    if sidecar is not None:
        (tmp_path / f"{name}.json{'.gz' if zipped else ''}.metadata.json").write_text(json.dumps(sidecar))


SAMPLES = [{"ts": 0, "ax": 1.0, "ay": 2.0, "az": 3.0}, {"ts": 1000, "p": 1000.5}, {"ts": 2000, "p": 1.0}]


def test_documents_and_sidecars(spark, tmp_path):
    document(tmp_path, "one", {"session_id": "s1", "participant_id": "doc", "vehicle_type": "BUS", "samples": SAMPLES,
                               "trimmed_start_ms": 0, "trimmed_end_ms": 1000},
             {"participant_id": "side", "trimmed_start_ms": "1", "session_id": "other"}, zipped=True)
    document(tmp_path, "two", {"vehicle_type": "car", "session_id": "", "samples": SAMPLES})
    document(tmp_path, "three", {"vehicle_type": "car", "samples": []})
    document(tmp_path, "four", {"vehicle_type": "tram", "samples": SAMPLES})
    found = read_source(spark, "session_documents", SourceConfig(str(tmp_path)), L)
    assert values(found, "session_id", "participant_id", "device_id", "label", "timestamp_ms") == [
        ("s1", "side", "unknown_device", 0, 1000),
        ("two", "unknown_participant", "unknown_device", 1, 0), ("two", "unknown_participant", "unknown_device", 1, 1000),
        ("two", "unknown_participant", "unknown_device", 1, 2000)]


def test_samples_without_time_raise(spark, tmp_path):
    document(tmp_path, "bad", {"vehicle_type": "car", "samples": [{"ax": 1.0}]})
    with pytest.raises(Exception, match="samples without ts"):
        read_source(spark, "session_documents", SourceConfig(str(tmp_path)), L).collect()


def test_sessions_arrive_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    document(source, "one", {"session_id": "s1", "vehicle_type": "bus", "samples": SAMPLES})
    config = SourceConfig(str(source))
    assert prepare.ingest_sessions(spark, "session_documents", config, L, target).count() == 3
    document(source, "two", {"session_id": "s2", "vehicle_type": "car", "samples": SAMPLES[:2]})
    document(source, "late", {"session_id": "s1", "vehicle_type": "bus", "samples": [{"ts": 9, "p": 1.0}]})
    for _ in range(2):
        events = prepare.ingest_sessions(spark, "session_documents", config, L, target)
        assert sorted(r[0] for r in events.select("session_id").collect()) == ["s1"] * 3 + ["s2"] * 2
    members = spark.createDataFrame([("s1",), ("s9",)], "session_id string")
    assert values(prepare.missing_members(events, members)) == [("s9",)]


def test_short_sessions_stay_out(spark, tmp_path):
    document(tmp_path, "one", {"session_id": "s1", "vehicle_type": "bus", "samples": SAMPLES})
    events = prepare.ingest_sessions(spark, "session_documents", SourceConfig(str(tmp_path)), L, str(tmp_path / "out"), 2.5)
    assert events.count() == 0


def test_registry_names_are_unique():
    with pytest.raises(ValueError, match="already registered"):
        register_source("row_logs")(lambda *a: None)
    with pytest.raises(ValueError, match="unknown source"):
        read_source(None, "nothing", SourceConfig(""), L)


def test_cohort_truth_table(spark):
    rows = [("participant_009", None, "a"), ("participant_010", None, "b"), ("participant_010", "KR", "c"),
            ("participant_010", "AU", "d"), ("participant_011", "KR", "e")]
    df = spark.createDataFrame(rows, "participant_id string, collection_country_code string, path string")
    assert values(nz.cohort_filter(df, "AU", "participant_010"), "path") == [("a",), ("d",)]
    on_path = spark.createDataFrame([(None, None, "/in/raw/participant_010/x.json")], df.schema)
    assert nz.cohort_filter(on_path, "AU", "participant_010").count() == 0
    for bad in ((None, "Australia", "z"), ("participant_001", None, "/raw/participant_002/x")):
        with pytest.raises(Exception, match="bad country|participant mismatch"):
            nz.cohort_filter(spark.createDataFrame([bad], df.schema), "AU", "participant_010").collect()


UUIDS = [f"0000000{i}-0000-0000-0000-000000000000" for i in range(3)]


def log(tmp_path, name, total, ids):
    lines = [f"Collector ingest scan starting: files={total}"]
    lines += [f"Collector ingest file {i}/{total}: path=/raw/x/{u}.json.gz" for i, u in enumerate(ids, 1)]
    lines.insert(2, f"Collector ingest file 1/{total + 5}: path=/raw/x/{UUIDS[2]}.json.gz")
    (tmp_path / name).write_text("\n".join(lines) + "\n")


def test_log_membership_keeps_first_order(spark, tmp_path):
    log(tmp_path, "run.log", 2, [UUIDS[1], UUIDS[0], UUIDS[1]])
    found = records.log_membership(records.read_log_lines(spark, str(tmp_path)))
    assert values(found, "position", "session_id") == [(1, UUIDS[1]), (2, UUIDS[0])]


def test_short_log_raises(spark, tmp_path):
    log(tmp_path, "run.log", 2, [UUIDS[1], UUIDS[1]])
    with pytest.raises(Exception, match="fewer sessions"):
        records.log_membership(records.read_log_lines(spark, str(tmp_path))).collect()


def test_false_manifest_raises(spark, tmp_path):
    body = {"schema_version": 1, "run_id": "r", "session_count": 2, "session_id_digest": "0", "sessions": [
        {"session_id": "a", "participant_id": "p", "vehicle_type": "bus", "duration_seconds": 60.0, "sample_count": 1}]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    facts = records.manifest_validate(records.read_manifests(spark, str(tmp_path)), L, 7200.0)
    assert facts.first()["valid"] is False
    with pytest.raises(Exception, match="does not match"):
        records.require_valid(facts).collect()


def test_unknown_tag_raises(spark):
    df = spark.createDataFrame([(1, '{"a":{"Q":"x"}}')], "id int, d string")
    with pytest.raises(Exception, match="unsupported tag"):
        records.decode_tagged(df, "d", ["id"]).collect()


@pytest.mark.parametrize("seconds, text", [(0, "00:00:00"), (59.4, "00:00:59"), (360061, "100:01:01"), (2.5, "00:00:02"), (3599.5, "01:00:00")])
def test_clock_text(spark, seconds, text):
    from strideframe.functions.scalars import clock_text
    assert spark.range(1).select(clock_text(F.lit(float(seconds)))).first()[0] == text


def test_conflicting_copies_raise(spark):
    rows = spark.createDataFrame([("r", 0.5, "a"), ("r", 0.6, "b")], "run_id string, v double, path string")
    with pytest.raises(Exception, match="conflicting values"):
        rp.dedupe_conflicts(rows, "run_id", ["v"], "path").collect()


def test_ambiguous_prefix_raises(spark):
    runs = spark.createDataFrame([("abcdef",)], "run_id string")
    recorded = spark.createDataFrame([("abc", "x"), ("abcdefgh", "y")], "recorded_id string, condition string")
    assert values(rp.prefix_join(runs, recorded.limit(1)), "condition") == [("x",)]
    with pytest.raises(Exception, match="more than one condition"):
        rp.prefix_join(runs, recorded).collect()


def test_merge_is_idempotent_and_keeps_history(spark):
    source = spark.createDataFrame([("a", None, "done"), ("b", "a", "done")], "run_id string, parent_run_id string, status string")
    merged = rp.run_merge(source, source.where("false").selectExpr("run_id", "run_id source_run_id", "'s' source_sweep"), "s")
    rows = {r.source_run_id: r for r in merged.collect()}
    assert rows["b"].parent_run_id == rows["a"].run_id and rows["a"].parent_run_id is None
    assert rp.run_merge(source, merged, "s").count() == 0
    points = spark.createDataFrame([("a", "f1", 0.5, 1), ("a", "f1", 0.6, 2)], "run_id string, key string, value double, step int")
    assert {r.run_id for r in rp.merge_history(points, merged, "s").collect()} == {rows["a"].run_id}


def test_lost_record_raises(spark):
    local = spark.createDataFrame([("s", "p", "k", "received", "bag")], "session_id string, participant_id string, s3_key string, status string, pos string")
    assert rp.change_detection(local, local, "session_id", ["participant_id"]).count() == 0
    with pytest.raises(Exception, match="lost or altered"):
        rp.change_detection(local, local.where("false"), "session_id", ["participant_id"]).collect()
    with pytest.raises(Exception, match="lost or altered"):
        rp.change_detection(local, local.withColumn("participant_id", F.lit("q")), "session_id", ["participant_id"]).collect()


def test_prefixes_are_cut_to_lengths_of_the_other_side(spark):
    """Any mix of lengths gives what comparing all pairs gives; ids of one length are one row each in the exchange."""
    runs = ["", "a", "ab", "abc", "abcdef", "b", "bcd", "xyz", None, "abc"]
    recorded = [("", "e"), ("abcd", "x"), ("ab", "x"), ("ab", "x"), ("abcdefgh", "x"), ("bc", "y"), (None, "z")]
    runs_df = spark.createDataFrame([(r,) for r in runs], "run_id string")
    recorded_df = spark.createDataFrame(recorded, "recorded_id string, condition string")
    fits = lambda a, b: a is not None and b is not None and (a == b or (a and b and (a.startswith(b) or b.startswith(a))))
    expected = [(r, next((c for i, c in recorded if fits(r, i)), None)) for r in runs]
    assert sorted(map(str, rp.prefix_join(runs_df, recorded_df).collect())) == sorted(
        str(Row(run_id=r, condition=c)) for r, c in expected)
    ids = spark.range(64).select(F.md5(F.col("id").cast("string")).alias("run_id"))
    known = ids.select(F.substring("run_id", 1, 12).alias("recorded_id"), F.lit("c").alias("condition"))
    with plain_plans(spark):
        found = rp.prefix_join(ids, known)
        assert [r.condition for r in found.collect()] == ["c"] * 64
        assert sum(n.metrics().apply("numOutputRows").value() for n in nodes(found) if n.nodeName() == "Generate") <= 2 * 64
