"""The format in Python: round trips, appending and overwriting, empty tables."""

from graniteql.sources import arrow_files


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_files, "PART", 50)
    arrow_files.register(spark)
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}", [1.5, None], {"a": i}) for i in range(300)] + [(None, "s1", None, None)]
    df = spark.createDataFrame(rows, "i long, s string, x array<double>, m map<string,int>").repartition(3)
    path = str(tmp_path / "t")
    df.write.format("arrowfiles").mode("append").save(path)
    back = spark.read.format("arrowfiles").load(path)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
    for condition in ("s = 's1'", "i > 250 and s <> 's2'", "i <= 10", "s is null", "s = 's1' and i is not null", "i = 5 or i = 6"):
        assert sorted(r["i"] or 0 for r in back.where(condition).collect()) == sorted(r["i"] or 0 for r in df.where(condition).collect())
    df.limit(5).write.format("arrowfiles").mode("append").save(path)
    assert spark.read.format("arrowfiles").load(path).count() == len(rows) + 5
    df.where("i < 9").write.format("arrowfiles").mode("overwrite").save(path)
    assert sorted(r["i"] for r in spark.read.format("arrowfiles").load(path).collect()) == list(range(9))


def test_empty_table(spark, tmp_path):
    arrow_files.register(spark)
    path = str(tmp_path / "t")
    spark.range(0).write.format("arrowfiles").mode("append").save(path)
    assert spark.read.schema("id long").format("arrowfiles").load(path).count() == 0
