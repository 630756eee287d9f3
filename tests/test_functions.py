from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesift.functions import paths, sampling, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def samples(spark, start, end, fps=0.25):
    return [(x.frame_ms, x.sample) for x in one(spark, sampling.sample_frame_times(F.lit(start), F.lit(end), fps))]


def test_sample_frame_times(spark):
    assert samples(spark, 1000, 3000) == [(2000, "mid")]
    assert [t for t, _ in samples(spark, 1000, 4000)] == [2000, 3000]
    assert samples(spark, 0, 13000) == [(2000, "long_0000"), (6000, "long_0001"), (10000, "long_0002")]
    assert [t for t, _ in samples(spark, 0, 5500, 1.0)] == [500, 1500, 2500, 3500, 4500]
    assert samples(spark, 0, 6000, 0.05) == [(3000, "long_0000")]  # no grid point before the end
    assert samples(spark, -50, -60) == [(0, "mid")]


def test_fine_scan_times(spark):
    def scan(*args):
        return one(spark, sampling.fine_scan_times(*(F.lit(a) for a in args[:3]), *args[3:]))

    assert scan(1000, 500, 1500, 750, 8.0) == list(range(500, 1501, 125))
    assert scan(10, 500, 600, 750, 8.0) == [500]
    assert scan(1000, 0, 5000, 0, 8.0) == [1000]
    assert scan(1003, 0, 1100, 200, 10.0) == [803, 903, 1003]


def test_sizes_and_rounding(spark):
    assert tuple(one(spark, sampling.fit_within(F.lit(1920), F.lit(1080), 512))) == (512, 288)
    assert tuple(one(spark, sampling.fit_within(F.lit(100), F.lit(80), 512))) == (100, 80)
    assert tuple(one(spark, sampling.fit_within(F.lit(9000), F.lit(1), 512))) == (512, 1)
    assert tuple(one(spark, sampling.fit_within(F.lit(9000), F.lit(1), 0))) == (9000, 1)
    assert [one(spark, sampling.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, sampling.unique_ints(F.array(F.lit(3), F.lit(1), F.lit(3)))) == [1, 3]


def test_format_duration(spark):
    wanted = {None: "--", -1.0: "--", 59.0: "59s", 65.0: "1m 05s", 3661.0: "1h 01m", 90061.0: "1d 01h 01m", 59.5: "1m 00s"}
    for value, out in wanted.items():
        assert one(spark, text.format_duration(F.lit(value).cast("double"))) == out


def test_identifiers_and_paths(spark):
    def parts(x):
        p = one(spark, paths.video_id_parts(F.lit(x)))
        return p and tuple(p)

    assert parts("V3C1_00001") == ("V3C1", "00001") and parts("v3c2_7") == ("V3C2", "7")
    assert parts("v3c3_7") is None and parts("xv3c1_7") is None
    found = one(spark, paths.path_candidates("/r", F.lit("v3c1_05"), F.lit("/h.mp4")))
    assert found == ["/h.mp4", "/r/V3C1/videos/05/05.mp4", "/r/videos/05/05.mp4", "/r/05/05.mp4", "/r/V3C1/05.mp4", "/r/v3c1_05.mp4", "/r/v3c1_05/v3c1_05.mp4"]
    none = F.lit(None).cast("string")
    assert one(spark, paths.fallback_path(paths.path_candidates("/r", F.lit("a"), none), none)) == "/r/a.mp4"


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0))
    assert one(spark, vectors.prepare(v, 2)) == [0.6, 0.8]
    assert one(spark, vectors.normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.dot(v, v)) == 106.0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(-10, 60_000)), min_size=1, max_size=40), st.sampled_from([0.25, 1.0, 3.0]))
def test_sampled_frames_lie_in_their_segment(spark, segments, fps):
    df = spark.createDataFrame([(s, s + n) for s, n in segments], "a long, b long")
    for row in df.select("a", "b", sampling.sample_frame_times("a", "b", fps).alias("x")).collect():
        times = [x.frame_ms for x in row.x]
        assert times == sorted(set(times)) and times
        assert all(row.a <= t < max(row.a + 1, row.b) for t in times)
