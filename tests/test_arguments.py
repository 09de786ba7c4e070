from datetime import datetime, timedelta

import pytest
from hypothesis import given, strategies as st

from hindcast.functions.text import query_terms
from hindcast.functions.timeparse import parse_duration, parse_instant
from hindcast.operators.paging import clamp, decode_cursor, encode_cursor, query_hash

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize("text,seconds", [("720h", 2592000), ("1h30m", 5400), ("1.5s", 1.5), ("250ms", .25)])
def test_durations(text, seconds):
    assert parse_duration(text) == timedelta(seconds=seconds)


@pytest.mark.parametrize("text", ["30d", "h", "", "5", "1h 30m", "-2h"])
def test_unknown_durations_are_refused(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_instants():
    assert parse_instant("2024-01-20T18:30:00+02:00") == datetime(2024, 1, 20, 16, 30)
    assert parse_instant("2h", NOW) == datetime(2024, 1, 30, 22)
    assert parse_instant(None) is None


@given(st.integers(1, 10_000), st.integers(0, 59))
def test_duration_round_trip(hours, minutes):
    assert parse_duration(f"{hours}h{minutes}m") == timedelta(hours=hours, minutes=minutes)


def test_limits_are_clamped():
    assert [clamp(x, 20, 500) for x in (None, 0, -3, 7, 501)] == [20, 20, 20, 7, 500]


def test_cursor_of_another_query_is_refused():
    one, other = query_hash(app="a"), query_hash(app="b")
    cursor = encode_cursor(one, ts=1, id=2)
    assert decode_cursor(cursor, one)["id"] == 2
    for bad, name in ((cursor, other), ("not base64!", one), ("e30=", one)):
        with pytest.raises(ValueError):
            decode_cursor(bad, name)


def test_query_terms_follow_the_text_rule():
    assert query_terms("Chkeit, BESTEN  chkeit! x_1") == ["chkeit", "besten", "x", "1"]
    assert query_terms(None) == [] and query_terms("?!") == []
