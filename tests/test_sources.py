import pytest
from pyspark.sql import functions as F

from bitloom.sources import text


def observation(point, frame, word):
    return [point, 1.5, -2.0, 3.25, frame, 10.0, 20.5, *[(word + k) % 2**32 for k in range(8)]]


ROWS = [observation(p, k, 4_294_967_290 + k) for k, p in enumerate([7, 7, 3, 7, 7, 7, 3])]


def test_histories_round_trip_and_group_by_runs(spark, tmp_path):
    names = [c.split(" ")[0] for c in text.HISTORY]
    df = spark.createDataFrame(ROWS, ", ".join(text.HISTORY)).coalesce(1)
    text.write_rows(df, str(tmp_path / "h"))
    back = text.read_history(spark, str(tmp_path / "h"))
    assert sorted(tuple(r) for r in back.select(*names).collect()) == sorted(map(tuple, ROWS))
    assert [r.run for r in back.orderBy("_line").collect()] == [0, 0, 1, 2, 2, 2, 3]
    points = {r.run: (r.point_id, r.x, r.w0) for r in text.points_of(back).collect()}
    assert points[2] == (7, 1.5, ROWS[5][7]) and len(points) == 4


def test_runs_go_on_across_parts_of_a_file(spark, tmp_path):
    lines = ["\t".join(map(str, observation(k // 300, k, k))) + "\t" for k in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\nbroken line\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        back = text.read_history(spark, str(tmp_path / "big.txt"))
        assert back.select("_line.block").distinct().count() > 1
        rows = back.orderBy("_line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.run for r in rows] == [k // 300 for k in range(3000)]


def test_frames_ids_and_groups(spark, tmp_path):
    (tmp_path / "ids").write_text("4\n8\n\n15\n")
    (tmp_path / "none").write_text("")
    assert sorted(r.frame_nr for r in text.read_frame_ids(spark, str(tmp_path / "ids")).collect()) == [4, 8, 15]
    with pytest.raises(ValueError):
        text.read_frame_ids(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([r[1:] for r in ROWS], ", ".join(text.OBSERVATION)).withColumn("frame_nr", F.col("frame_nr") % 2)
    assert {r.frame_nr: len(r.observations) for r in text.by_frame(df).collect()} == {0: 4, 1: 3}


def test_results_and_values(spark, tmp_path):
    pose = [float(k) for k in range(12)]
    df = spark.createDataFrame([(1, pose, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)])], "frame int, pose array<double>, points array<struct<x:double,y:double,z:double>>")
    df = df.select("frame", *text.pose_columns(F.col("pose")), F.lit(0.5).alias("t_reloc"), F.lit(0.1).alias("t_prep"), F.lit(0.2).alias("t_pair"), F.lit(9).alias("query_size"), F.lit(10).alias("map_size"), F.lit(5).alias("inliers"), "points")
    text.write_results(df, str(tmp_path / "out"))
    back = text.read_rows(spark, str(tmp_path / "out/poses"), text.RESULT).first()
    assert [back[f"p{k}"] for k in range(12)] == pose and back.inliers == 5
    assert text.read_rows(spark, str(tmp_path / "out/points3d"), ["frame int", "x double", "y double", "z double"]).count() == 2
    text.write_values(df, str(tmp_path / "v"), F.format_string("%d:%.1f", "frame", "p1"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["1:1.0"]


def test_a_vocabulary_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(0, 5, 6)], "c_id long, w0 long, w1 long"), 1.25, {"k": 1}

    for _ in range(2):
        centroids, parameters = text.load_or_build(spark, str(tmp_path / "voc"), build)
        assert centroids.first().w1 == 6 and parameters == {"k": "1", "cost": "1.25"}
    assert built == [1]
    images = spark.createDataFrame([(1, 2), (2, 3)], "image_id long, w0 long")
    assert text.descriptors_of(images, images.where("image_id = 2")).count() == 1


def test_vocabularies_of_another_kind_are_refused(spark, tmp_path):
    from bitloom.sources import text

    place = str(tmp_path / "v")
    text.save_vocabulary(spark.createDataFrame([(0, 1)], "c_id long, w0 long"), 0.5, place, k=1)
    assert text.load_vocabulary(spark, place)[1] == {"k": "1", "cost": "0.5"}
    for rows, said in (([("signature", text.SIGNATURE), ("version", "9")], "version 9"), ([("version", "1")], "no vocabulary")):
        spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").parquet(f"{place}/parameters")
        with pytest.raises(ValueError, match=said):
            text.load_vocabulary(spark, place)
