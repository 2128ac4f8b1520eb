import pytest

from quillstream.model import (
    AppendCriteria, Direction, EphemeralEvent, EventFilter, EventQuery, EventReference, FilterItem, Limit, StreamId, Tag, Tags,
)


@pytest.mark.parametrize(
    "text,key,value",
    [("key", "key", None), ("key:", "key", None), (":value", None, "value"), ("k:v:w", "k", "v:w"), ("  k : v ", "k", "v")],
)
def test_tag_parse(text, key, value):
    assert Tag.parse(text) == Tag(key, value)


@pytest.mark.parametrize("text", [None, "", "  ", ":", " : "])
def test_no_tag(text):
    assert Tag.parse(text) is None


def test_tags_are_sets():
    tags = Tags.of("a:1", "b:2", "a:1", "big", "")
    assert len(tags) == 3 and tags.texts() == ["a:1", "b:2", "big"]
    assert tags.contains_all(Tags.of("a:1", "big")) and not tags.contains_all(Tags.of("a:2"))
    assert tags.contains_all(Tags.none())
    assert tags.merge(Tags.of("c")).texts() == ["a:1", "b:2", "big", "c"]
    assert tags.tag("b") == Tag("b", "2") and tags.tag("z") is None
    with pytest.raises(ValueError):
        Tag("a:b", "c")


def test_reference_order_and_text():
    a, b, c = EventReference("x", 5, 1), EventReference("y", 2, 2), EventReference("y", 2, 2, 1)
    assert a < b < c and a.happened_before(b) and c.happened_after(b)
    assert str(a) == "x:1:5" and str(c) == "y:2:2:1"
    assert EventReference.parse(str(c)) == c and EventReference.parse(str(a)) == a
    for bad in ["", "a", "a:1", "a:1:2:3:4", "a:x:1", "a:1:y", "a:1:0", "a:1:2:-1", ":1:2", "a:9223372036854775808:1"]:
        with pytest.raises(ValueError):
            EventReference.parse(bad)


def test_streams():
    one = StreamId("app", "domain")
    assert StreamId("app").purpose == "default"
    assert StreamId.any().can_read(one) and StreamId("app", None).can_read(one) and not StreamId("x", None).can_read(one)
    assert StreamId("app", None).can_append_to(one) and one.can_append_to(one)
    assert not StreamId(None, "domain").can_append_to(one) and not one.can_append_to(StreamId("app", "other"))
    assert str(one) == "app#domain" and not StreamId("app", None).is_specific


def test_limits():
    assert Limit(3).or_if_lower(Limit(2)) == Limit(2) and Limit().or_if_lower(Limit(2)) == Limit(2)
    assert Limit().or_if_lower(None) == Limit.none()
    for bad in (0, -1):
        with pytest.raises(ValueError):
            Limit(bad)


def test_filters():
    f = EventFilter.for_events(["A"], ["k:1"])
    assert f.matches("A", Tags.of("k:1", "x")) and not f.matches("A", Tags.of("x")) and not f.matches("B", Tags.of("k:1"))
    assert EventFilter.match_all().matches("Z", Tags()) and not EventFilter.match_none().matches("Z", Tags())
    bound = EventReference("b", 3, 3)
    assert f.with_until(bound).matches("A", Tags.of("k:1"), bound)
    assert not f.with_until(bound).matches("A", Tags.of("k:1"), EventReference("c", 4, 4))
    assert f.with_until(bound).until_if_earlier(EventReference("a", 1, 1)).until.position == 1
    assert f.until_if_earlier(bound).until == bound and f.until_if_earlier(None).until is None


def test_combining():
    a, b = EventFilter.for_events(["A"]), EventFilter.for_events(["B"])
    both = a.combine_with(b)
    assert both.matches("A", Tags()) and both.matches("B", Tags()) and not both.matches("C", Tags())
    assert a.combine_with(EventFilter.match_all()).is_match_all and a.combine_with(EventFilter.match_none()) == a
    assert len(a.combine_with(a).items) == 1
    with pytest.raises(ValueError):
        a.combine_with(b.with_until(EventReference("x", 1, 1)))
    q = EventQuery.for_events(["A"])
    for other in (EventQuery.for_events(["B"]).backwards(), EventQuery.for_events(["B"]).limited(3)):
        with pytest.raises(ValueError):
            q.combine_with(other)


def test_defaults_of_a_query():
    q = EventQuery(None, None, None)
    assert q.filter.is_match_none and q.direction is Direction.FORWARD and q.limit == Limit()
    assert AppendCriteria.of(EventQuery.for_events(["A"]).backwards().limited(1), None).filter == EventFilter.for_events(["A"])
    assert AppendCriteria.none().is_none
    with pytest.raises(ValueError):
        EphemeralEvent("", {})
    assert EventFilter((FilterItem(),)).matches("any", Tags())
