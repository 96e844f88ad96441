from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.plans.filterql import Both, Call, Compare, FilterError, Not, date_value, parse, predicate, query

NOW = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)


def test_precedence_and_grouping():
    assert parse("a = 1 OR b = 2 AND NOT c = 3").where == Both("or", (Compare("a", "=", ("1",)), Both("and", (Compare("b", "=", ("2",)), Not(Compare("c", "=", ("3",)))))))
    assert parse("(a = 1 or b = 2) and c = 3").where.word == "and"


def test_values_lists_order_and_limit():
    q = parse("lei IN (lc-214-2025, 'it''s',) ORDER BY id DESC, type LIMIT 5")
    assert q.where == Compare("lei", "in", ("lc-214-2025", "it's")) and q.order == (("id", True), ("type", False)) and q.limit == 5
    assert parse("updated >= now()").where.values == (Call("now"),)
    assert parse("").where is None and parse("LIMIT 0").limit == 0


@pytest.mark.parametrize("text", ["type >", "type = ", "type IN ()", "(type = a", "type = a )", "type ! a", "type = ação", "ORDER type", "LIMIT x", "= a", "type NOT = a", "type IS a"])
def test_what_is_not_a_query(text):
    with pytest.raises(FilterError):
        predicate(parse(text).where)


@pytest.mark.parametrize("text", ["updated ~ x", "type > 3", "epoch = x", "epoch IN (1)", "nothing = 1", "updated > soon", "updated > now(1)", "type = f()", "type ~ x", "type IS EMPTY"])
def test_what_does_not_go_with_a_field(spark, text):
    with pytest.raises(FilterError):
        predicate(parse(text).where)


def test_dates():
    assert date_value("-7d", NOW) == datetime(2024, 5, 25, 12, tzinfo=timezone.utc)
    assert date_value("2024-01-01", NOW) == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert date_value(Call("endOfDay"), NOW).hour == 23
    assert (date_value("+1w", NOW) - NOW).days == 7 and (date_value("30m", NOW) - NOW).seconds == 1800


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except FilterError:
        pass


def test_three_valued_logic_and_null_order(spark):
    rows = [("a", "X", None, 1), ("b", None, ["domain:tax"], 2), ("c", "Y", [], 3)]
    df = spark.createDataFrame(rows, "id string, type string, tags array<string>, last_epoch int")
    ids = lambda t: [r["id"] for r in query(df, t).collect()]
    assert ids("type != X ORDER BY id") == ["c"]
    assert ids("NOT type = X ORDER BY id") == ["c"]
    assert ids("tag IS EMPTY ORDER BY id") == ["a", "c"]
    assert ids("domain = tax") == ["b"] and ids("domain IS EMPTY ORDER BY id") == ["a", "c"]
    assert ids("ORDER BY type") == ["a", "c", "b"] and ids("ORDER BY type DESC") == ["b", "c", "a"]
    assert ids("epoch >= 2 ORDER BY id LIMIT 1") == ["b"]
    with pytest.raises(FilterError):
        query(df, "ORDER BY domain")


def test_percent_and_underscore_are_plain(spark):
    df = spark.createDataFrame([("50%_x",), ("50ab",)], "body string")
    assert query(df, "text ~ '50%_X'").count() == 1
