import struct
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysurvey.functions.geodesy import Srs
from skysurvey.sources import binary as B, sinks as K, text as T
from skysurvey.streaming import frames as V


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_gcp_and_copy(spark, tmp_path):
    (tmp_path / "gcp.txt").write_text("﻿WGS84 UTM 16N\n\n# note\n609865.7 4950688.36 171.6 3000 2000 a.tif gcp1\n1 2 3\n")
    r = T.read_gcp(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].srs == "WGS84 UTM 16N" and r[0].filename == "a.tif" and r[0].extras == "gcp1" and r[0].z == 171.6
    moved = K.gcp_in_system(T.read_gcp(spark, str(tmp_path)), Srs("utm", 16), Srs("lonlat")).first()
    assert abs(moved.x + 85.6) < 0.2 and abs(moved.y - 44.7) < 0.2
    lines = [x.line for x in K.gcp_lines(T.read_gcp(spark, str(tmp_path)), "WGS84 UTM 16N").orderBy("place").collect()]
    assert lines[0] == "WGS84 UTM 16N" and lines[1].endswith("a.tif gcp1")


def test_small_formats(spark):
    c = T.parse_coords(files(spark, a="WGS84 UTM 17N\n435391 4522674\n")).first()
    assert (c.srs, c.east, c.north) == ("WGS84 UTM 17N", 435391.0, 4522674.0)
    ramp = T.parse_ramp(files(spark, a="0% 255 0 0\n50% 0 255 0\nnv 0 0 0\n")).collect()
    assert [r.stop for r in ramp] == [0.0, 50.0, None]
    assert T.parse_groups(files(spark, a="x.jpg 1\n\ny.jpg 2\n")).count() == 2
    assert T.parse_waypoints(files(spark, a="1 2 3\n4 5 6")).agg(F.sum("y")).first()[0] == 7
    ply = T.parse_ply_header(files(spark, a="ply\nformat ascii 1.0\nelement vertex 12\nproperty float x\nproperty float nx\nproperty uchar views\nend_header\n1 2 3")).first()
    assert ply.vertex_count == 12 and ply.has_normals and ply.has_views
    with pytest.raises(Exception, match="100 lines"):
        T.parse_ply_header(files(spark, a="ply\nelement vertex 1\n")).collect()


def test_boundary_rules(spark):
    two = '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0]]]}},{"geometry":{"type":"Polygon","coordinates":[[[0,0]]]}}]}'
    with pytest.raises(Exception, match="exactly one"):
        T.parse_boundary(files(spark, a=two)).collect()
    one = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6,7]]]}}'
    assert T.parse_boundary(files(spark, a=one)).first().ring[2].z == 7.0


def test_reconstruction(spark):
    doc = '[{"cameras":{"c1":{"focal":0.85,"width":10}},"shots":{"a.jpg":{"rotation":[0,0,1],"translation":[1,2,3],"camera":"c1","gps_dop":5.0}},"points":{"7":{"coordinates":[1,2,3]}}}]'
    cameras, shots, points = T.parse_reconstruction(files(spark, a=doc))
    assert cameras.first().focal == 0.85 and shots.first().translation == [1, 2, 3] and points.first().z == 3


def test_nvm_rename(spark):
    images = T.parse_nvm(files(spark, a="NVM_V3\n\n2\na.jpg 1 2\nb.jpg 3 4\n\n0\n"))
    names = spark.createDataFrame([("a.jpg", "x.jpg"), ("b.jpg", "y.jpg")], "filename string, new_name string")
    lines = [r.line for r in K.nvm_lines(images, names).orderBy("line_no").collect()]
    assert lines == ["NVM_V3", "", "2", "x.jpg 1 2", "y.jpg 3 4"]
    with pytest.raises(Exception, match="no new name"):
        K.nvm_lines(images, names.limit(1)).collect()


def _png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 2, 0, 0, 0)


def _tiff(tags):
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags.items())
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def test_image_headers(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 600, 800) + b"\x01" * 6
    assert B.image_size(_png(30, 20)) == (30, 20) and B.image_size(jpeg) == (800, 600) and B.image_size(_tiff({256: 7, 257: 9})) == (7, 9) and B.image_size(b"x") is None
    assert B.xmp_packets(b"..<x:xmpmeta>1</x:xmpmeta>..<x:xmpmeta>2</x:xmpmeta>") == ["<x:xmpmeta>1</x:xmpmeta>", "<x:xmpmeta>2</x:xmpmeta>"]
    app3 = b"\xff\xd8" + b"\xff\xe3" + struct.pack(">H", 4) + b"AB" + b"\xff\xe1" + struct.pack(">H", 3) + b"z" + b"\xff\xe3" + struct.pack(">H", 3) + b"C" + b"\xff\xda"
    assert B.thermal_payload(app3) == b"ABC"
    for name in ("a.PNG", "a_mask.png", "b.txt"):
        (tmp_path / name).write_bytes(_png(5, 6))
    found = B.scan_folder(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in found.select("path", "valid").collect()} == {"a.PNG": True, "a_mask.png": False, "b.txt": False}
    assert B.with_image_metadata(found.filter("valid")).first().width == 5


def test_las_source(spark, tmp_path):
    frame = pd.DataFrame({"x": [1.25, 2.5, 3.125], "y": [10.0, 20.0, 30.0], "z": [-1.0, 0.0, 1.0], "classification": [2, 1, 2], "red": [1, 2, 65535]})
    (tmp_path / "p.las").write_bytes(B.las_bytes(frame))
    spark.dataSource.register(B.LasDataSource)
    got = spark.read.format("las").option("rowsPerPartition", "2").load(str(tmp_path / "p.las"))
    rows = sorted(got.select("x", "z", "classification", "red").collect())
    assert [tuple(r) for r in rows] == [(1.25, -1.0, 2, 1), (2.5, 0.0, 1, 2), (3.125, 1.0, 2, 65535)]
    got.coalesce(1).write.format("las").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("las").load(str(tmp_path / "out" / "part-00000.las"))
    assert back.count() == 3
    binary = spark.read.format("binaryFile").load(str(tmp_path / "p.las"))
    assert B.las_from_binary(binary).agg(F.sum("red")).first()[0] == 65538


def test_stream_twin(spark, tmp_path):
    values = [5.0, 9.0, 16.0, 17.0, 30.0, 29.0, 41.0]
    rows = [(1, datetime(2024, 1, 1) + timedelta(seconds=i), v) for i, v in enumerate(values)]
    schema = "video long, ts timestamp, value double"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = V.stream_frames(stream, "video", "ts", "value").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.table("kept").collect()) == [5.0, 16.0, 30.0, 41.0]
    frames = spark.createDataFrame(rows, schema).withColumns({"blur": F.lit(500.0), "black": F.lit(0.0)})
    assert sorted(r.value for r in V.select_frames(frames, "video", "ts", "value").filter("verdict = 'kept'").collect()) == [5.0, 16.0, 30.0, 41.0]


def test_stream_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=10 * i), 1 + i % 2, float(i), 0.0) for i in range(30)]
    spark.createDataFrame(rows, "ts timestamp, track long, x double, y double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, track long, x double, y double").parquet(f"{tmp_path}/in")
    q = V.stream_positions(stream).writeStream.format("memory").queryName("positions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("positions").agg(F.sum("n")).first()[0] >= 20


def test_black_frames(spark):
    rng = np.random.default_rng(1)
    rows = [(f, int(v)) for f in range(3) for v in (rng.integers(0, 256, 100) if f else [0] * 100)]
    light = spark.createDataFrame(rows, "frame int, value int")
    ends = light.groupBy("frame").agg(F.min("value").alias("a"), F.max("value").alias("b")).agg(F.min("a").alias("low"), F.max(F.col("b") - F.col("a")).alias("span"))
    got = {r.frame: r.black for r in V.black_ratio(light, "frame", ends.select(V.absolute_black(F.col("low"), F.col("span")).alias("black_below"))).collect()}
    assert got[0] == 1.0 and got[1] < 0.6


SUBTITLES = [
    ("""<font size="36">SrtCnt : 1, DiffTime : 16ms\n2023-01-06 18:56:48,380,821\n[iso : 3200] [shutter : 1/60.0] [fnum : 280] [ev : 0] [focal_len : 240] [latitude: 47.5] [longitude: -8.25] [altitude: 412.5] </font>\n</font> """, (3200, 60.0, 2.8, 240, 47.5, -8.25, 412.5)),
    ("F/2.8, SS 206.14, ISO 150, EV 0, GPS (-82.6669, 27.7716, 10), D 2.80m, H 0.00m, H.S 0.00m/s, V.S 0.00m/s ", (150, 206.14, 2.8, None, 27.7716, -82.6669, 10.0)),
    ("F/6.3, SS 60, ISO 100, EV 0, RTK (120.083799, 30.213635, 28), HOME (120.084146, 30.214243, 103.55m), D 75.36m, H 76.19m, H.S 0.30m/s, F.PRY (-5.3, 2.1, 28.3), G.PRY (-40.0, 0.0, 28.2)", (100, 60.0, 6.3, None, 30.213635, 120.083799, 28.0)),
    ("[iso : 150] [shutter : 1/5000.0] [fnum : 170] [ev : 0] [focal_len : 240] [dzoom_ratio: 10000, delta:0],[latitude: -22.724555] [longitude: -47.602414] [rel_alt: 0.300 abs_alt: 549.679] </font>", (150, 5000.0, 1.7, 240, -22.724555, -47.602414, 549.679)),
    ("[iso : 100] [shutter : 1/400.0] [fnum : 280] [focal_len : 240] [latitude : 1.5] [longtitude : 2.5] [altitude: 3.5] </font>", (100, 400.0, 2.8, 240, 1.5, 2.5, 3.5)),
    ("No:1, F/2.8, SS 155.55, ISO 100, EV 0, A.T (126,109), Gain (1.000000,4096), B.L (-1020, -1020, -1020, -1020), Isp Info (PIPE 1,ADJ 0,De 0) GPS (-2.5927, 52.0035, 15), D 0.61m, H 1.00m", (100, 155.55, 2.8, None, 52.0035, -2.5927, 15.0)),
]


def test_subtitle_dialects(spark):
    files = spark.createDataFrame([(str(i), f"1\n00:00:00,000 --> 00:00:01,000\n{text}") for i, (text, _) in enumerate(SUBTITLES)], "path string, text string")
    rows = {int(r.path): r for r in T.parse_srt(files).collect()}
    for i, (_, want) in enumerate(SUBTITLES):
        assert tuple(rows[i][k] for k in ("iso", "shutter", "fnum", "focal_len", "latitude", "longitude", "altitude")) == want
