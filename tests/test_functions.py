import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity, time
from tidemark.schema import bool_, check_name, check_shape, checked, float_, int_, json_, misfit, one_of, str_, ts


@pytest.mark.parametrize(("text", "ms"), [("250ms", 250), ("10s", 10_000), ("5m", 300_000), ("2h", 7_200_000), ("1d", 86_400_000), (0, 0), (17, 17)])
def test_durations(text, ms):
    assert time.parse_duration(text) == ms
    assert time.parse_duration(time.format_duration(ms)) == ms


@pytest.mark.parametrize("bad", ["", "10", "s", "1.5s", "-1s", "10 s", -1, 1.5, True, None, 2**53])
def test_no_durations(bad):
    with pytest.raises(ValueError):
        time.parse_duration(bad)


def test_intervals_fit_a_timer():
    for bad in ("0s", 2**31):
        with pytest.raises(ValueError):
            time.parse_interval(bad)
    with pytest.raises(ValueError):
        time.check_divides(10_000, 25_000)


def test_windows():
    assert time.bucket_start(12_345, 1000) == 12_000
    # the window that the start falls into holds data in range
    assert list(time.bucket_range(500, 3000, 1000)) == [0, 1000, 2000] and list(time.bucket_range(0, 2000, 1000)) == [0, 1000]
    assert list(time.bucket_range(100, 200, 1000)) == [0] and not [*time.bucket_range(1500, 1500, 1000), *time.bucket_range(2000, 1000, 1000)]
    assert time.parse_duration(" 5m ") == 300_000
    with pytest.raises(ValueError):
        time.parse_duration("٣m")
    assert time.closed_up_to(1000, 12_345, 2000) == 10_000 and time.closed_up_to(1000, 500, 2000) == 0
    assert time.landing(5000, 3000, 1000) == 5000 and time.landing(1000, 3001, 1000) == 4000
    with pytest.raises(ValueError):
        time.bucket_start(-1, 1000)


AWKWARD = ["", "a|b", "back\\slash", "\\0", None, "1", "👍", "|", "\\|", "a\\"]


def test_series_keys_go_there_and_back(spark):
    rows = [(a, b) for a in AWKWARD for b in AWKWARD]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.withColumn("key", identity.dim_key([F.col("a"), F.col("b")])).withColumn("parts", identity.dim_parts(F.col("key"))).collect()
    assert len({r.key for r in out}) == len(rows)
    assert all(r.parts == [r.a, r.b] for r in out)


def test_numbers_print_shortest(spark):
    want = {1.0: "1", -0.0: "0", 0.1: "0.1", 1e21: "1e+21", 123456789012.5: "123456789012.5", 1e20: "100000000000000000000", 1e-7: "1e-7", 1.5e-6: "0.0000015", -2.5e-9: "-2.5e-9", 1e7: "10000000", 0.001: "0.001", 12345678.25: "12345678.25"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", identity.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == list(want.values())


def test_row_ids_tell_parts_apart(spark):
    df = spark.createDataFrame([(1, "1|2"), (11, "|2"), (1, "1|2")], "b long, k string")
    ids = [r[0] for r in df.select(identity.row_id("m", F.col("b"), F.col("k"))).collect()]
    assert ids[0] == ids[2] != ids[1] and all(len(i) == 32 for i in ids)
    identity.set_hasher(lambda parts: F.concat_ws("/", *parts))
    try:
        assert df.select(identity.row_id("m", F.col("b"), F.col("k"))).first()[0] == "m/1/1|2"
    finally:
        identity.set_hasher(None)


def test_uuids_sort_by_time(spark):
    ids = [r[0] for r in spark.range(1, 200).coalesce(1).select(identity.uuid7(F.col("id") * 1000)).collect()]
    assert ids == sorted(ids) and all(i[14] == "7" and i[19] in "89ab" and len(i) == 36 for i in ids)


def test_types_know_their_values():
    assert int_().problem(3) is None and int_().problem(2**53) and int_().problem(1.5) and int_().problem(True)
    assert float_().problem(float("nan")) and str_().problem(1) and bool_().problem(0) and ts().problem(5)
    assert one_of(["a", "b"]).problem("c") and json_().problem({"a": object()}) and json_().problem({"a": [1]}) is None
    for bad in ([], ["a", "a"], [1, "1"]):
        with pytest.raises(ValueError):
            one_of(bad)
    with pytest.raises(ValueError):
        int_().with_default("x")


def test_shapes_and_names():
    for shape in ({"id": str_()}, {"a": str_(), "A": str_()}, {"j": json_()}, {"bucket_open": str_()}):
        with pytest.raises(ValueError):
            check_shape(shape, ("id",))
    for name in ("", "a:b", "a b", "\ud800"):
        with pytest.raises(ValueError):
            check_name(name)


def test_checked_columns(spark):
    shape = {"kind": one_of(["a", "b"]), "n": int_().with_default(7), "x": float_().optional()}
    df = spark.createDataFrame([("a", None, 1.0), ("b", 3, None)], "kind string, n long, x double")
    out = df.select(*[c.alias(k) for k, c in checked(shape, {c: df[c] for c in df.columns}, "m").items()]).collect()
    assert [tuple(r) for r in out] == [("a", 7, 1.0), ("b", 3, None)]
    with pytest.raises(ValueError):
        checked(shape, {"other": df["n"]}, "m")
    bad = spark.createDataFrame([("c", 1, 1.0), (None, 1, 1.0), ("a", 2**53, 1.0), ("a", 1, float("nan")), ("a", 1, 1.0)], "kind string, n long, x double")
    assert [r[0] for r in bad.select(misfit(shape, {c: bad[c] for c in bad.columns})).collect()] == [True, True, True, True, False]
    bad = bad.coalesce(1)  # else whichever bad row's task is first decides what the error says
    with pytest.raises(Exception, match="kind"):
        bad.select(*[c.alias(k) for k, c in checked(shape, {c: bad[c] for c in bad.columns}, "m").items()]).collect()
