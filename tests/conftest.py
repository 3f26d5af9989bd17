import pytest

from tradebook.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=8, shuffle_partitions=8, driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def evaluate(spark):
    """Apply a Column function to a list of texts (or tuples) and return the values in order."""
    def run(fn, values, columns=("c",)):
        rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
        schema = "k int, " + ", ".join(c if " " in c else f"{c} string" for c in columns)
        df = spark.createDataFrame(rows, schema)
        out = df.select("k", fn(*[c.split(" ")[0] for c in columns]).alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["k"])]
    return run
