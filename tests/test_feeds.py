"""Readers, writers and logs on small files."""

import json

from pyspark.sql import functions as F

from placewright.sources import readers as S
from placewright.streaming import logs


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tables_and_lists(spark, tmp_path):
    p = put(tmp_path / "stops.txt", "stop_id,stop_name,stop_lat,stop_lon,location_type\n1,Oak,37.1,-122.1,1\n2,Elm,37.2,-122.2,0\n")
    assert [tuple(r) for r in S.gtfs_stations(spark, p).collect()] == [("Oak", 37.1, -122.1)]
    p = put(tmp_path / "g.txt", "1\tPeak A\tx\t\t37.5\t-122.0\tT\tPK\n2\tTown\tx\t\t37.5\t-122.0\tP\tPPL\n3\tFar\tx\t\t50\t-122.0\tT\tMT\n")
    assert [r["name"] for r in S.gazetteer(spark, p, (37.0, -123.0, 38.0, -121.0)).collect()] == ["Peak A"]
    p = put(tmp_path / "c.csv", "name,address,city,lat,lon\nA,1 Main,X,,\nB,,Y,37.1,-122.1\n")
    assert [(r["query"], r["coarse"]) for r in S.csv_candidates(spark, p, (37.7, -122.4)).orderBy("name").collect()] == [("A, 1 Main, X", True), ("B, Y", False)]


def test_elements_and_rings(spark, tmp_path):
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 1.0}, {"lat": 1.0, "lon": 1.0}, {"lat": 0.0, "lon": 0.0}]
    els = [
        {"type": "node", "id": 1, "lat": 37.1, "lon": -122.1, "tags": {"name": "Oak"}},
        {"type": "node", "id": 2, "lat": 37.2, "lon": -122.2},
        {"type": "relation", "id": 9, "tags": {"ref": "N"}, "members": [{"type": "node", "ref": 1, "role": "stop"}, {"type": "node", "ref": 2, "role": "platform"}, {"type": "node", "ref": 1, "role": "x"}]},
        {"type": "way", "id": 5, "tags": {"name": "W"}, "geometry": ring},
        {"type": "way", "id": 6, "geometry": ring[:3]},
    ]
    e = S.osm_elements(spark, put(tmp_path / "o.json", json.dumps({"elements": els})))
    assert [(r["stop_name"], r["seq"]) for r in S.route_stops(e).collect()] == [("Oak", 0)]
    assert [(r["fid"], r["name"]) for r in S.closed_rings(e).collect()] == [("way/5", "W")]


def test_features_and_nested_json(spark, tmp_path):
    f = {"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    g = {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}}
    one = S.geojson_regions(spark, put(tmp_path / "f.json", json.dumps(f))).collect()
    two = S.geojson_regions(spark, put(tmp_path / "g.json", json.dumps({"type": "FeatureCollection", "features": [f, g]}))).orderBy("region_id").collect()
    assert one[0]["region_id"] == "A" and len(one[0]["rings"]) == 1 and [len(r["rings"]) for r in two] == [1, 2]
    p = put(tmp_path / "p.json", json.dumps({"park": {"tentacleRadiusMi": 1, "count": 1, "places": [{"id": "x", "name": "Oak", "lat": 1.0, "lon": 2.0}]}}))
    assert [(r["category"], r["name"]) for r in S.nested_pois(spark, p).collect()] == [("park", "Oak")]
    p = put(tmp_path / "r.json", json.dumps({"results": [{"facility_name": "OAK HOSPITAL", "state": "CA", "countyparish": "Alameda"}, {"facility_name": "X", "state": "NV", "countyparish": "Alameda"}]}))
    assert [r["name"] for r in S.registry(spark, p, "CA", ["ALAMEDA"]).collect()] == ["Oak Hospital"]
    p = put(tmp_path / "a.json", json.dumps({"features": [{"attributes": {"TYPE": "M", "NAME": " oak MUSEUM ", "CITY": None}}, {"attributes": {"TYPE": "Z", "NAME": "x"}}]}))
    assert [tuple(r) for r in S.feature_attributes(spark, p, ["M"]).collect()] == [("Oak Museum", "", "")]


def test_line_patterns(spark):
    pages = spark.createDataFrame([(1, "<p>Oak Zoo,</p><p>Reno</p><p>Accredited to 2030</p><script>x,</script><p>No,</p><p>a</p><p>b</p>")], "page_id long, html string")
    assert [tuple(r) for r in S.three_line_pattern(S.text_lines(pages, "page_id"), "page_id").collect()] == [("Oak Zoo", "Reno")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("park", 1, "Oak"), ("zoo", 2, "Elm")], "category string, pin long, name string")
    S.write_table(df, str(tmp_path / "t"), ["category"])
    S.write_json(df, str(tmp_path / "j"))
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    kids = spark.createDataFrame([(1, [(3, "Kid")])], "rep long, kids array<struct<pin: long, name: string>>")
    got = {r["category"]: json.loads(r["payload"]) for r in S.review_payload(df, kids).collect()}
    assert got["park"]["groups"][0]["rep"] == 1 and got["zoo"]["singles"][0]["pin"] == 2


LOG = "game_id long, question_id long, ts timestamp, seq long, action string"


def test_log_fold_and_stream_agree(spark, tmp_path):
    acts = [(1, 1, "add"), (1, 2, "add"), (1, 1, "toggle"), (2, 1, "add"), (1, 2, "delete"), (1, 1, "veto"), (2, 1, "toggle"), (2, 1, "toggle"), (1, 2, "add")]
    rows = [(g, q, None, i, a) for i, (g, q, a) in enumerate(acts)]
    log = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds("seq"))
    want = sorted(map(tuple, logs.fold_log(log).collect()))
    assert want == [(1, 1, False, True), (1, 2, True, False), (2, 1, True, False)]
    src = tmp_path / "in"
    for i in (0, 1, 2):
        log.where(F.col("seq").between(i * 3, i * 3 + 2)).coalesce(1).write.mode("append").parquet(str(src))
    state = logs.LogState()
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = s.writeStream.foreachBatch(state.upsert).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, state.state.collect())) == want
    again = logs.LogState(state.path)  # as after a restart, with the last batch delivered once more
    again.upsert(log.where(F.col("seq").between(6, 8)), 2)
    assert sorted(map(tuple, again.state_of(spark).collect())) == want
    again.upsert(log.withColumns({"action": F.lit("delete"), "seq": F.col("seq") + 1000, "ts": F.col("ts") + F.expr("interval 1 day")}).where("game_id % 2 = 0"), 3)
    assert sorted(map(tuple, again.state.collect())) == [r for r in want if r[0] % 2]


def test_running_ordinals_equal_the_window(spark, tmp_path):
    rows = [(1, "radar:5", i, None) for i in range(6)] + [(2, "radar:5", 9, None)]
    asks = spark.createDataFrame(rows, "game_id long, group_key string, question_id long, created_at timestamp").withColumn("created_at", F.timestamp_seconds("question_id"))
    for a, b in ((0, 3), (3, 10)):
        asks.where(F.col("question_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(asks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = logs.running_ordinals_compat(s).writeStream.format("memory").queryName("ordinals").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["question_id"]: r["ordinal"] for r in spark.table("ordinals").collect()}
    assert got == {**{i: i + 1 for i in range(6)}, 9: 1}


def test_ordinals_of_late_asks_equal_the_window(spark, tmp_path):
    """Asks that come out of order, over several batches, get their place in time; one key far ahead moves the watermark."""
    batches = [[(1, 0, 0), (1, 1, 20), (1, 2, 40)], [(1, 3, 30), (2, 4, 35), (1, 5, 20)], [(1, 6, 70), (2, 7, 5)], [(9, 8, 9000)]]
    rows = [r for b in batches for r in b]
    frame = lambda x: spark.createDataFrame(x, "game_id long, question_id long, t long").select("game_id", F.lit("radar:5").alias("group_key"), "question_id", F.timestamp_seconds(F.col("t") + 1000).alias("created_at"))
    for b in batches:
        frame(b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = spark.readStream.schema(frame(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = logs.running_ordinals(s, "60 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got = {r["question_id"]: r["ordinal"] for r in spark.table("late").collect()}
    finally:
        spark.conf.unset(key)
    want = {}
    for g in (1, 2):
        want |= {q: i + 1 for i, (_, q) in enumerate(sorted((t, q) for h, q, t in rows if h == g))}
    assert got == want
