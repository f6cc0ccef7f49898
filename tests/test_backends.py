"""Backends as data sources: windows that fail and are halved, days of which an hour fails, and pages of feeds."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from presswork.sources import backends as B

DAY = datetime(2024, 5, 1)


def test_halving():
    asked = []

    def ask(start, stop):
        asked.append((start.hour, (stop - start).total_seconds() / 3600))
        if stop - start > timedelta(hours=2):
            raise TimeoutError
        return [("a", 1), ("", 5), (None, 7), (" ", 3)]

    found = B.answered(ask, DAY, DAY + timedelta(hours=6))
    assert [(a.hour, b.hour) for a, b, _ in found] == [(0, 1), (1, 3), (3, 4), (4, 6)] and all(c == [("a", 1)] for *_, c in found)
    assert asked[0] == (0, 6.0)


def test_an_hour_that_fails():
    def ask(start, stop):
        if start <= DAY + timedelta(hours=4) < stop:
            raise ConnectionError("down")
        return []

    with pytest.raises(ConnectionError):
        B.answered(ask, DAY, DAY + timedelta(hours=6))


def test_days(spark):
    def ask(start, stop):
        if start.day == 2 and start.hour <= 13 < start.hour + (stop - start).total_seconds() / 3600:
            raise ConnectionError("down")
        if start.day == 3 and stop - start > timedelta(hours=1):
            raise TimeoutError("slow")
        return [] if start.day == 4 else [("a", int((stop - start).total_seconds() // 3600)), ("b", 1)]

    found = B.windows(spark, ask, date(2024, 5, 1), date(2024, 5, 4), hours=7)
    days = {(r["stat_date"].day, r["league_name"]): r["switch_cnt"] for r in B.complete_days(found).collect()}
    assert days == {(1, "a"): 24, (1, "b"): 4, (3, "a"): 24, (3, "b"): 24}
    ledger = {r["stat_date"].day: tuple(r[1:]) for r in B.day_ledger(found).collect()}
    assert ledger == {1: ("SUCCESS", 2, 28, None), 2: ("FAILED", 0, 0, "ConnectionError: down"), 3: ("SUCCESS", 2, 48, None), 4: ("SUCCESS", 0, 0, None)}


FEEDS = {
    "a": [{"items": [{"id": 1}, {"id": 2}], "total": 5, "has_more": True}, {"items": [{"id": 3}], "total": 5, "has_more": False}, {"items": [{"id": 4}, {"id": 5}], "total": 5, "has_more": False}],
    "b": [{"items": [], "total": 9, "has_more": True}], "d": [{"items": [{"id": 7}], "total": 0, "has_more": True}] * 200, "e": [{"items": {"id": 8}}],
}


def test_feed(spark):
    def fetch(source, offset, limit):
        if source == "c":
            return {"code": 7, "msg": "closed"}
        pages, at, k = FEEDS[source], 0, 0
        while at < offset:
            at += len(pages[k]["items"])
            k += 1
        return {"code": 0, "data": pages[k]}

    found = B.feed(spark, fetch, ["a", "b", "c", "d", "e"], most=20).collect()
    rows = lambda s: [(r["page"], r["item"]) for r in found if r["source"] == s and r["error"] is None]
    assert rows("a") == [(0, '{"id": 1}'), (0, '{"id": 2}'), (1, '{"id": 3}'), (2, '{"id": 4}'), (2, '{"id": 5}')]
    assert rows("b") == [] and len(rows("d")) == 20 and {(r["source"], r["error"]) for r in found if r["error"]} == {("c", "ValueError: code 7: closed"), ("e", "TypeError: items must be a list")}
    items = B.feed_items(B.feed(spark, fetch, ["a", "c"]), "id bigint").collect()
    assert sorted(r["id"] for r in items) == [1, 2, 3, 4, 5]
