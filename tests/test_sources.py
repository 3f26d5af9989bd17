import json
import random

import pytest
from pyspark.sql import functions as F

from tradebook.sources import files, json_check, tables


def put(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)
    return str(path)


def test_names(spark, tmp_path):
    p = put(tmp_path / "a.csv", "Name,Address\n  Vape Shack ,\n,x\n\"A, Inc\",\n")
    got = files.read_names_csv(spark, p).orderBy("row_id").collect()
    assert [(r["row_id"], r["business_name"]) for r in got] == [(1, "Vape Shack"), (3, "A, Inc")]
    with pytest.raises(ValueError):
        files.read_names_csv(spark, put(tmp_path / "b.csv", "Business Name\n \n"), require_rows=True)
    with pytest.raises(ValueError):
        files.read_business_csv(spark, put(tmp_path / "c.csv", "name\nx\n"))


def test_quoted_output_file(spark, tmp_path):
    p = put(tmp_path / "o.csv", 'id, business_name, address, state, zip_code, created_at\n'
            '3, "Blue Heron Books", "41 Quarry Lane Unit 7, Millbrook, Vermont", "VT", "05401-0042", "2031-07-09"\n')
    row = files.combine_chunks(spark, p).first()
    assert (row["id"], row["business_name"], row["zip_code"]) == (3, "Blue Heron Books", "05401-0042")


def test_chunks(spark, tmp_path):
    df = spark.range(250).select("id", F.concat(F.lit('n "'), F.col("id").cast("string")).alias("business_name"), F.lit("a\nb").alias("address"))
    files.write_chunked_csv(df.coalesce(1), f"{tmp_path}/c", 100, gzip=True)
    assert len(list((tmp_path / "c").glob("*.csv.gz"))) == 3
    back = files.combine_chunks(spark, f"{tmp_path}/c")
    assert back.columns == ["id", "business_name", "address", "state", "zip_code", "created_at"]
    assert back.count() == 250 and back.filter("id = 7").first()["address"] == "a\nb"


def test_files_are_matched_by_name(spark, tmp_path):
    put(tmp_path / "a.csv", "id,business_name,address,state,zip_code,created_at\n1,One,A St,CA,90001,x\n")
    put(tmp_path / "b.csv", "business_name,id,zip_code,state,created_at\r\nTwo,2,12181,NY,y\r\n")
    got = {r["id"]: tuple(r)[1:] for r in files.combine_chunks(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {1: ("One", "A St", "CA", "90001", "x"), 2: ("Two", None, "NY", "12181", "y")}
    rows = files.read_business_csv(spark, f"{tmp_path}/*.csv").select("id", "state").collect()
    assert sorted(map(tuple, rows)) == [("1", "CA"), ("2", "NY")]
    put(tmp_path / "c" / "x.csv", "Business Name,n\nA,1\nB,2\n")
    put(tmp_path / "c" / "y.csv", "n,Business Name\n3,C\n")
    put(tmp_path / "c" / "z.csv", "Shop,n\nD,4\n")
    names = files.read_names_csv(spark, f"{tmp_path}/c").orderBy("row_id").collect()
    assert [(r["row_id"], r["business_name"], r["n"]) for r in names] == [(1, "A", "1"), (2, "B", "2"), (3, "C", "3"), (4, "D", "4")]


def plain_root(text):
    def no_constant(x):
        return float(x)
    try:
        data = json.loads(text, parse_constant=no_constant)
    except json.JSONDecodeError:
        return None, 0
    pairs = json.loads(text, object_pairs_hook=lambda p: ("members", len(p)))
    if isinstance(data, dict):
        return "{", pairs[1]
    return ("[", len(data)) if isinstance(data, list) else ("v", 0)


def random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 4)
    if kind < 4:
        return rng.choice(['1', '-2.5e3', 'true', 'null', '"a,b"', '"x\\"y,"', '"\\u00e9 ,, é"', '""', 'NaN', '" [1,2} "'])
    blank = rng.choice(["", " ", "\n"])
    if kind < 6:
        return "[" + ("," + blank).join(random_json(rng, depth + 1) for _ in range(rng.randrange(5))) + blank + "]"
    return "{" + ",".join(f'"k{k},"{blank}:{random_json(rng, depth + 1)}' for k in range(rng.randrange(4))) + "}"


def test_json_summaries_against_the_parser():
    """Whole and damaged texts, cut into chunks at every comma."""
    rng = random.Random(4)
    for _ in range(3000):
        text = random_json(rng)
        if rng.random() < 0.6:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", ",", "]", "}", "{", "[", '"', ":", "1", "\\", "\t", "x", " 2"]) + text[at + rng.randrange(2):]
        cuts, chunks = rng.random(), []
        for k, piece in enumerate(text.split(",")):
            if not k or rng.random() < cuts:
                chunks.append(piece if not k else "," + piece)
            else:
                chunks[-1] += "," + piece
        got = json_check.fold([json_check.reduce_chunk(c, inside) for inside in (False, True)] for c in chunks)
        assert got == plain_root(text), (text, chunks)


def test_json_files_of_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_check, "CHUNK_BYTES", 1000)
    rows = ",".join('{"a": [1, 2, {"b": "x,y"}], "c": "%d"}' % k for k in range(2000))
    texts = {"whole": f"[{rows}]", "cut": f"[{rows}", "trail": '{"a":1} trailing garbage', "comma": "[1,2],", "none": "", "deep": "[" * 400 + "]" * 400,
             "open": '{"a": "' + "x," * 5000, "long": '{"a": "' + "x," * 5000 + '"}', "twice": "[1][2]", "mark": "\ufeff[1]", "late": f"[{rows}] x"}
    for name, text in texts.items():
        put(tmp_path / f"{name}.json", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")           # files of several blocks
    try:
        got = {r["path"].rsplit("/", 1)[1][:-5]: (r["root"], r["items"]) for r in json_check.json_roots(spark, f"{tmp_path}/*.json").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k for k, v in got.items() if v[0]} == {"whole", "deep", "long"}
    assert got["whole"] == ("[", 2000) and got["long"] == ("{", 1) and got["deep"] == ("[", 1)


def test_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tradebook import session
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_file_checks(spark, tmp_path):
    put(tmp_path / "a.json", '{"a": 1}')
    put(tmp_path / "b.json", "[1, 2, 3]")
    put(tmp_path / "c.json", "nope")
    put(tmp_path / "d.json", "5")
    got = {r["path"][-6:]: r["issue"] for r in files.check_json_files(spark, f"{tmp_path}/*.json", 2).collect()}
    assert got == {"a.json": None, "b.json": "Too many items in array (3)", "c.json": "Invalid JSON", "d.json": "Root must be an object or array"}
    assert files.check_source_files(spark, f"{tmp_path}/gone", "json").first()["issue"] == "File does not exist"
    assert files.check_source_files(spark, f"{tmp_path}/a.json", "json", 1e-6).first()["issue"].startswith("File size (0.0MB) exceeds")
    assert files.check_source_files(spark, f"{tmp_path}/a.json", "xml").first()["issue"] == "Unsupported file type: xml"


def test_logs(spark, tmp_path):
    p = put(tmp_path / "x.log", '{"timestamp": "t", "level": "INFO", "metadata": {"function": "f", "execution_time": 1.5}, "port": 8}\nbad\n\n')
    got = files.read_json_logs(spark, p).withColumn("port", F.try_variant_get("extras", "$.port", "int")).collect()
    assert [(r["level"], r["port"], r["_corrupt"]) for r in got] == [("INFO", 8, None), (None, None, "bad")]
    stats = files.log_file_stats(spark, str(tmp_path)).first()
    assert stats["file_count"] == 1 and stats["newest_file"] == "x.log"


def test_jdbc_options():
    o = tables.jdbc_options("jdbc:postgresql://h/db", user="u", password="p")
    assert o["driver"] == "org.postgresql.Driver" and o["user"] == "u"
    assert tables.split_options("id", 1, 9, 3) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "3"}
    with pytest.raises(ValueError):
        tables.split_options("id", 9, 1, 3)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r["column"]: (r["type"], r["rows"], r["nulls"]) for r in tables.table_profile(df).collect()} \
        == {"a": ("int", 2, 0), "b": ("string", 2, 1)}


def test_catalog_profile(spark, tmp_path):
    spark.range(1000).write.option("path", f"{tmp_path}/big").saveAsTable("tb_big")
    spark.range(10).write.option("path", f"{tmp_path}/small").saveAsTable("tb_small")
    got = [(r["table"], r["rows"]) for r in tables.catalog_profile(spark).collect() if r["table"].startswith("tb_")]
    assert got == [("tb_big", 1000), ("tb_small", 10)]


def test_observed_stats(spark, tmp_path):
    from tradebook.operators.dashboard import with_cleaning_stats

    out, seen = with_cleaning_stats(spark.range(10), F.col("id") > 3)
    out.write.parquet(f"{tmp_path}/o")
    assert seen.get == {"total_items": 10, "valid_items": 6, "invalid_items": 4}
