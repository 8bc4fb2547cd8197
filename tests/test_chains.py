import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from winnow.sources.scratch import cut_lineage
from winnow.streaming import chains
from winnow.streaming import events as ev

from .test_streaming import loop_throttle, opened


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(-200, 3000), min_size=1, max_size=80), min_size=1, max_size=6),
    st.integers(1, 900),
    st.integers(1, 400),
)
def test_chains_equal_a_loop(spark, cases, width, bucket):
    df = spark.createDataFrame([(k, t) for k, ts in enumerate(cases) for t in ts], "k long, t long")
    got = opened(chains.chain_openings(df, ["k"], "t", width, bucket))
    assert got == {k: loop_throttle(ts, width) for k, ts in enumerate(cases)}


def test_null_keys_and_times(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), ("a", None), (None, 9), ("b", 5), ("b", 5)], "k string, t long")
    assert opened(chains.chain_openings(df, ["k"], "t", 5)) == {None: [0, 9], "b": [5]}
    assert chains.chain_openings(df.where("false"), ["k"], "t", 5).count() == 0


def test_next_event_of_each(spark):
    rng = random.Random(2)
    times = sorted(rng.sample(range(5000), 300))
    nodes = spark.createDataFrame([((0,), t) for t in times], "_key struct<k: int>, _t long")
    for width, bucket in ((1, 7), (50, 1000), (4000, 3), (9000, 100)):
        got = {r._t: r._next for r in chains.next_events(nodes, width, bucket).collect()}
        later = {t: [x for x in times if x >= t + width] for t in times}
        assert got == {t: xs[0] for t, xs in later.items() if xs}


def test_pointers_get_fewer(spark):
    """Each doubling starts only where the one before can end, so all of them together are few."""
    rng = random.Random(4)
    times = rng.sample(range(100_000), 4000)
    nodes = spark.createDataFrame([((0,), t) for t in times], "_key struct<k: int>, _t long")
    firsts = spark.createDataFrame([((0,), min(times))], "_key struct<k: int>, _t long")
    steps, sizes = cut_lineage(chains.next_events(nodes, 500, 5000), "steps"), []
    while n := steps.count():
        sizes.append(n)
        steps = cut_lineage(chains._doubled(steps, firsts), "steps")
    assert all(b < a for a, b in zip(sizes, sizes[1:])) and sum(sizes) < 3 * sizes[0]


def test_wide_timers_take_pointers(spark, monkeypatch):
    calls, real = [], ev.chain_openings
    monkeypatch.setattr(ev, "chain_openings", lambda *a: calls.append(a) or real(*a))
    times = list(range(0, 6000, 2))
    df = spark.createDataFrame([("a", t) for t in times], "k string, t long")
    wanted = {"a": loop_throttle(times, 900)}
    assert opened(ev.throttle(df, ["k"], "t", 900)) == wanted and not calls
    assert opened(ev.throttle(df, ["k"], "t", 900, block_events=100)) == wanted and len(calls) == 1
