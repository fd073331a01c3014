from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemill.plans import chains
from tidemill.plans.partitions import Partition, by_value, enumerate_days, extend, infer, of_value, overlapping, split
from tidemill.plans.periods import Period, add_months, floor
from tidemill.plans.windows import LoadWindow, bounds, cut_windows
from tidemill.spec import LoadSpec, Mode, SpecError


def d(*x):
    return datetime(*x)


GOLDEN = [
    ("ITER", Period.of(1, "month"), Period(), d(2024, 1, 15, 6, 30), d(2024, 3, 10, 9), [(d(2024, 1, 1), d(2024, 2, 1)), (d(2024, 2, 1), d(2024, 3, 1)), (d(2024, 3, 1), d(2024, 4, 1))]),
    ("DELTA", Period.of(1, "month"), Period.of(2, "days"), d(2024, 1, 15, 6, 30), d(2024, 3, 10, 9), [(d(2023, 12, 30), d(2024, 4, 1))]),
    ("DELTA", None, Period.of(1, "hour"), d(2024, 1, 15, 6, 30), d(2024, 3, 10, 9), [(d(2024, 1, 15, 5, 30), d(2024, 3, 10, 9))]),
    ("ITER", Period.of(1, "day"), Period(), d(2024, 1, 1, 6), d(2024, 1, 4, 9), [(d(2024, 1, k), d(2024, 1, k + 1)) for k in (1, 2, 3)]),
    ("ITER", Period.of(2, "days"), Period(), d(2024, 1, 1, 6), d(2024, 1, 4, 9), [(d(2024, 1, 1), d(2024, 1, 3)), (d(2024, 1, 3), d(2024, 1, 5))]),
    ("DELTA", Period.of(7, "days"), Period(), d(2024, 1, 1, 6), d(2024, 1, 4, 9), [(d(2024, 1, 1), d(2024, 1, 5))]),
    ("ITER", Period.of(1, "year"), Period(), d(2022, 5, 1), d(2023, 7, 1), [(d(2022, 1, 1), d(2023, 1, 1)), (d(2023, 1, 1), d(2024, 1, 1))]),
    ("ITER", Period.of(1, "hour"), Period(), d(2024, 1, 1, 6, 30), d(2024, 1, 1, 8, 10), [(d(2024, 1, 1, h), d(2024, 1, 1, h + 1)) for h in (6, 7, 8)]),
]


@pytest.mark.parametrize(("mode", "interval", "safety", "start", "end", "want"), GOLDEN)
def test_golden_windows(mode, interval, safety, start, end, want):
    assert [(w.start, w.end) for w in cut_windows(mode, start, end, interval, safety)] == want


def test_iter_needs_an_interval_and_unknown_modes_raise():
    with pytest.raises(SpecError):
        cut_windows(Mode.ITER, d(2024, 1, 1), d(2024, 1, 2))
    with pytest.raises(ValueError):
        cut_windows("SOMETIMES", d(2024, 1, 1), d(2024, 1, 2))


def test_bounds_come_from_the_watermark_before_tomorrow():
    spec = LoadSpec(1, "a", "DELTA", "DELTA", delta_field="t", mode="DELTA", delta_start=d(2020, 1, 1))
    now = d(2024, 5, 5, 12)
    assert bounds(spec, [], now) == (d(2020, 1, 1), now)
    assert bounds(spec, [d(2024, 5, 1), d(2024, 5, 4), d(2024, 5, 6)], now) == (d(2024, 5, 4), now)
    assert bounds(spec, [d(2024, 5, 4)], now, d(2023, 1, 1), d(2023, 2, 1)) == (d(2023, 1, 1), d(2023, 2, 1))
    assert bounds(spec.but(delta_start=None, mode=Mode.ITER), [], now)[0] == d(2000, 1, 1)
    assert LoadWindow(1, 2) == LoadWindow(1, 2)


def test_periods():
    assert add_months(d(2024, 1, 31), 1) == d(2024, 2, 29)
    assert Period.of(2, "quarters") == Period(months=6)
    assert [Period.of(1, u).unit for u in ("hour", "day", "month", "year")] == ["hour", "day", "month", "year"]
    assert Period.of(5, "minutes").unit is None and not Period()
    assert floor(d(2024, 8, 9, 7, 6, 5), "quarter") == d(2024, 7, 1)


@given(st.datetimes(d(1990, 1, 1), d(2050, 1, 1)), st.sampled_from(["day", "month", "quarter", "year"]))
def test_every_moment_has_its_partition(t, period):
    p = of_value(t, period)
    assert p.holds(t) and infer(p.start, p.end) == period
    assert not p.holds(p.end) and of_value(p.end, period).start == p.end


def test_partition_calendar():
    months = [of_value(d(2024, m, 1), "month") for m in (1, 2, 3)]
    assert [p.name for p in extend(months, d(2024, 5, 20))] == ["m_04_2024", "m_05_2024"]
    far = Partition(d(2999, 1, 1), d(2999, 2, 1))
    assert extend([*months, far], d(2024, 5, 20)) == []
    assert len(extend([*months, far], d(2024, 5, 20), d(2999, 1, 1))) == 2
    assert extend(months[:1], d(2024, 5, 20)) == [] and extend(months, d(2023, 1, 1)) == []
    with pytest.raises(ValueError):
        extend(months, None)
    assert overlapping(months, d(2024, 1, 31, 23, 59, 59), d(2024, 2, 1)) == months[:2]
    assert by_value(months, d(2024, 2, 29)) == months[1] and by_value(months, d(2025, 1, 1)) is None
    assert of_value(d(2024, 5, 1), "quarter").name == "q_2_2024" and of_value(d(2024, 5, 9), "day").name == "d_09_05_2024"


def test_splits():
    assert enumerate_days("x", "%Y%m%d", d(2024, 1, 1), d(2024, 1, 3)) == [f"x = '2024010{k}'" for k in (1, 2, 3)]
    assert enumerate_days("x", "%Y%m%d", None, d(2024, 1, 3)) == []
    parts = split(d(2024, 1, 1), d(2024, 7, 1))
    assert 16 <= len(parts) <= 17 and parts[0][0] == d(2024, 1, 1) and parts[-1][1] == d(2024, 7, 1)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert split(d(2024, 1, 1), d(2024, 1, 3)) == [(d(2024, 1, 1), d(2024, 1, 2)), (d(2024, 1, 2), d(2024, 1, 3))]
    assert split(d(2024, 1, 1), d(2024, 1, 1)) == []
    assert timedelta(1)


CHAINS = {
    "1": [[1]],
    "1>>2>>3": [[1], [2], [3]],
    "[1,2]>>3>>4": [[1, 2], [3], [4]],
    "1>>[2,3]>>4": [[1], [2, 3], [4]],
    "1,2,3": [[1, 2, 3]],
    "[1,2,3]": [[1, 2, 3]],
    "[[1]>>[2]]": [[1], [2]],
    "1>>[[2>>3],[4]]": [[1], [[[2], [3]], 4]],
    "9>>[[21>>22],[31>>32>>33],[41>>42]]": [[9], [[[21], [22]], [[31], [32], [33]], [[41], [42]]]],
}


@pytest.mark.parametrize("text", CHAINS)
def test_chain_parser(text):
    assert chains.nested(chains.parse(text)) == CHAINS[text]


@pytest.mark.parametrize("text", ["", "1>>", "[1,2", "1]", "a", "1 2", ">>1", "[]"])
def test_chains_that_cannot_be_read(text):
    with pytest.raises(chains.ChainError):
        chains.parse(text)


def test_chains_run_in_order_to_any_depth():
    done = []
    chains.run(chains.parse("1>>[2>>[3,4]>>5,6]>>7"), done.append)
    at = {x: k for k, x in enumerate(done)}
    assert sorted(done) == [1, 2, 3, 4, 5, 6, 7] and done[0] == 1 and done[-1] == 7
    assert at[2] < min(at[3], at[4]) and max(at[3], at[4]) < at[5]

    def fail(x):
        done.append(x)
        if x == 2:
            raise RuntimeError("no")

    done.clear()
    with pytest.raises(RuntimeError):
        chains.run(chains.parse("1>>[2>>3,4]>>5"), fail)
    assert set(done) == {1, 2, 4}


def test_lanes_and_dependencies():
    assert chains.lanes([5, 1, 4, 2, 3], 3) == [[1, 4], [2, 5], [3]]
    free, before = chains.order([1, 2, 3, 4], [(2, 1), (3, 2), (9, 1)], range(1, 10))
    assert free == [4] and before == {1: set(), 2: {1}, 3: {2}}
    assert chains.run_ordered(before, lambda x: x) == [1, 2, 3]
    with pytest.raises(chains.ChainError):
        chains.order([1, 2], [(1, 2), (2, 1)])
    with pytest.raises(chains.ChainError):
        chains.order([1], [(1, 77)], [1])
