import json
import os
import threading
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream import schema as S
from quillstream.functions.serde import erasable, merge
from quillstream.functions.upcast import PythonUpcaster, RegistrationError, Registry, Upcaster, dropped, renamed
from quillstream.model import (
    AppendCriteria, EphemeralEvent, EventFilter, EventQuery, EventReference, FilterItem, LedgerError, LimitExceeded,
    OptimisticLockingError, StreamId, Tags,
)
from quillstream.sources import jsonio
from quillstream.sources.store import EventLedger, InitMode
from quillstream.streaming.projector import BookmarkReads, PayloadProjection, Projection, ProjectionError, Projector, fold_by_key

Q = EventQuery
TYPES = ["AccountOpened", "AccountClosed", "MoneyDeposited", "MoneyWithdrawn", "MoneyTransfered", "PerformanceReportEvent", "FirstDomainEvent", "First", "Second", "Third"]


def registry():
    r = Registry()
    for t in TYPES:
        r.event(t)
    return r


def ev(kind, data=None, *tags, key=None):
    return EphemeralEvent(kind, data or {}, Tags.of(*tags), key)


@pytest.fixture
def store(spark, tmp_path):
    made = EventLedger(spark, str(tmp_path / "store"))
    yield made
    made.close()


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    store = EventLedger(spark, str(tmp_path_factory.mktemp("bank")))
    domain = store.stream(StreamId("app", "domain"), registry())
    other = store.stream(StreamId("otherApp", "domain"), registry())
    perf = store.stream(StreamId("app", "performance-logging"), registry())
    for i in (1, 2, 3):
        domain.append(ev("AccountOpened", {"account": {"value": str(i)}}, f"account:{i}"))
    domain.append(ev("MoneyDeposited", {"amount": 800}, "account:1"))
    domain.append(ev("MoneyDeposited", {"amount": 200}, "account:2"))
    other.append(ev("FirstDomainEvent", {"value": "some random event"}, "account:3", "otherapp:tag"))
    domain.append(ev("MoneyWithdrawn", {"amount": 100}, "account:1"))
    domain.append(ev("MoneyTransfered", {"amount": 200}, "account:1", "from-account:1", "account:2", "to-account:2"))
    perf.append(ev("PerformanceReportEvent", {"value": "test"}, "account:1"))
    domain.append(ev("MoneyTransfered", {"amount": 50}, "account:1", "from-account:1", "account:3", "to-account:3"))
    domain.append(ev("AccountClosed", {}, "account:2"))
    return domain


def at(bank, position):
    row = bank.store.snapshot().where(F.col("position") == position).first()
    return EventReference(row["event_id"], row["position"], row["tx"])


def positions(stream, *args, **kw):
    return [e.reference.position for e in stream.query(*args, **kw)]


def test_bank_matrix(bank):
    everything = bank.store.stream(StreamId.any(), registry())
    assert len(positions(everything, Q.match_all())) == 11 and len(positions(bank, Q.match_all())) == 9
    assert positions(bank, Q.match_none()) == []
    for kinds, n in [(["AccountOpened"], 3), (["MoneyDeposited"], 2), (["MoneyTransfered"], 2), (["AccountOpened", "AccountClosed"], 4)]:
        assert len(positions(bank, Q.for_events(kinds))) == n
    a, b = Q.for_events(["AccountOpened", "AccountClosed"]), Q.for_events(["MoneyDeposited", "AccountClosed"])
    assert len(positions(bank, a.combine_with(b))) == 6
    one = Q.for_events(tags=["account:1"])
    assert positions(bank, one) == [1, 4, 7, 8, 10] and positions(bank, one.backwards()) == [10, 8, 7, 4, 1]
    assert len(positions(bank, Q.for_events(tags=["account:1", "account:2"]))) == 1
    assert positions(bank, Q.for_events(["MoneyTransfered"], ["to-account:3", "account:3", "from-account:1", "account:1"])) == [10]
    assert positions(bank, Q.for_events(tags=["otherapp:tag"])) == []


def test_bank_cursors_and_bounds(bank):
    one = Q.for_events(tags=["account:1"])
    refs = {p: at(bank, p) for p in range(1, 12)}
    assert [len(positions(bank, one, refs[p])) for p in (1, 4, 8, 10, 11)] == [4, 3, 1, 0, 0]
    assert [len(positions(bank, one.backwards(), refs[p])) for p in (1, 2, 7, 11)] == [0, 1, 2, 5]
    assert [len(positions(bank, one, refs[p], limit=2)) for p in (1, 8, 11)] == [2, 1, 0]
    everything = bank.store.stream(StreamId.any(), registry())
    assert [len(positions(everything, Q.match_all().until(refs[p]))) for p in (1, 6, 11)] == [1, 6, 11]
    assert positions(bank, one.backwards().until(refs[7])) == [7, 4, 1]


def test_limit_precedence(bank):
    q = Q.for_events(tags=["account:1"]).limited(2)
    assert len(positions(bank, q)) == 2
    assert len(positions(bank, q, at(bank, 1))) == 4  # with a cursor the query's own limit does not hold
    assert len(positions(bank, q, limit=3)) == 3


def test_lookup_and_plan(bank):
    ref = at(bank, 8)
    assert [e.reference.position for e in bank.event_by_id(ref.id)] == [8]
    assert bank.store.stream(StreamId("otherApp", None), registry()).event_by_id(ref.id) == []
    plan = bank.events(Q.for_events(["MoneyDeposited"]), limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan, plan
    assert "event_type" in plan.split("PushedFilters: ")[1], plan


def test_hard_limit(spark, tmp_path):
    store = EventLedger(spark, str(tmp_path), hard_limit=2)
    s = store.stream(StreamId("a"), registry())
    for i in range(3):
        s.append(ev("First", {"value": i}))
    s.append(ev("Second"))
    with pytest.raises(LimitExceeded):
        s.query(Q.for_events(["First"]))
    with pytest.raises(LimitExceeded):
        s.query(Q.match_all().limited(3))
    assert len(s.query(Q.for_events(["Second"]))) == 1 and len(s.query(Q.match_all().limited(2))) == 2


def test_append_rules(store):
    s = store.stream(StreamId("app", None), registry())
    with pytest.raises(LedgerError, match="not specific"):
        s.append(ev("First"))
    with pytest.raises(LedgerError, match="does not append"):
        s.append(ev("First"), to=StreamId("other", "x"))
    with pytest.raises(LedgerError, match="not known"):
        s.append(ev("Nope"), to=StreamId("app", "x"))
    assert s.append([], to=StreamId("app", "x")) == []
    with pytest.raises(LedgerError, match="single"):
        s.append([ev("First", key="k"), ev("First")], to=StreamId("app", "x"))
    got = s.append([ev("First", {"v": 1}), ev("Second")], to=StreamId("app", "x"))
    assert [e.reference.position for e in got] == [1, 2] and got[0].reference.tx == got[1].reference.tx
    assert store.stream().query(Q.match_all()) [0].data == {"v": 1}  # a raw stream reads
    with pytest.raises(LedgerError, match="not known"):
        store.stream(StreamId("app", "x")).append(ev("First"))  # and never appends
    with pytest.raises(ValueError):
        s.append(ev("First", {"v": float("nan")}), to=StreamId("app", "x"))


def test_optimistic_locking(store):
    s = store.stream(StreamId("app"), registry())
    watch = EventFilter.for_events(["First"])
    s.append(ev("First"), AppendCriteria.of(watch, None))
    with pytest.raises(OptimisticLockingError) as e:
        s.append(ev("First"), AppendCriteria.of(watch, None))
    assert e.value.filter == watch and e.value.expected is None
    last = s.query(Q.for_events(["First"]))[-1].reference
    s.append(ev("Second"))
    s.append(ev("First"), AppendCriteria.of(Q.for_events(["First"]).backwards().limited(1), last))
    with pytest.raises(OptimisticLockingError):
        s.append(ev("First"), AppendCriteria.of(watch, last))
    s.append(ev("Third"), AppendCriteria.of(watch, EventReference("future", 99, 99)))
    s.append(ev("Third", {}, "customer:123"), AppendCriteria.of(EventFilter.for_events(tags=["customer:123"]), None))
    with pytest.raises(OptimisticLockingError):
        s.append(ev("Third"), AppendCriteria.of(EventFilter.for_events(tags=["customer:123"]), last))
    other = store.stream(StreamId("else"), registry())
    other.append(ev("First"), AppendCriteria.of(watch, None))  # the condition holds in the target stream only


def test_idempotency_survives_reopening(spark, store):
    s = store.stream(StreamId("app"), registry())
    assert len(s.append(ev("First", key="once"))) == 1 and s.append(ev("First", key="once")) == []
    again = EventLedger(spark, store.base).stream(StreamId("app"), registry())
    assert again.append(ev("Second", key="once")) == [] and again.store.snapshot().count() == 1


def test_two_writers_race(spark, tmp_path):
    stores = [EventLedger(spark, str(tmp_path)) for _ in range(2)]
    streams = [s.stream(StreamId("app"), registry()) for s in stores]
    wins, conflicts = [], []

    def work(s):
        for i in range(30):
            try:
                wins.append(s.append(ev("First", {}, f"slot:{i}"), AppendCriteria.of(EventFilter.for_events(tags=[f"slot:{i}"]), None)))
            except OptimisticLockingError:
                conflicts.append(i)

    threads = [threading.Thread(target=work, args=(s,)) for s in streams]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = stores[0].snapshot().orderBy("position").collect()
    assert len(wins) == 30 and len(conflicts) == 30
    assert [r.position for r in rows] == list(range(1, 31)) and len({r.event_tags[0] for r in rows}) == 30


def test_compaction_and_import(spark, store, sf):
    s = store.stream(StreamId("app"), registry())
    for i in range(6):
        s.append(ev("First", {"v": i}, key=f"k{i}"))
    before = s.query(Q.match_all())
    store.compact()
    assert s.query(Q.match_all()) == before and len(store.log.live_files()) == 1
    assert s.append(ev("First", key="k3")) == []
    assert s.append(ev("First"))[0].reference.position == 7
    from quillstream.queries import log_view

    fresh = EventLedger(spark, store.base + "-2")
    rows = log_view(spark, sf).drop("value")
    assert fresh.import_events(rows) == rows.count()
    t = fresh.stream(StreamId("shop", "u1"), Registry().event("view"))
    assert t.append(ev("view"))[0].reference.position == rows.count() + 1
    with pytest.raises(OptimisticLockingError):
        t.append(ev("view"), AppendCriteria.of(EventFilter.for_events(["view"]), None))


def test_modes_and_prefix(spark, tmp_path):
    with pytest.raises(Exception, match="no store"):
        EventLedger(spark, str(tmp_path / "x"), mode=InitMode.VALIDATE)
    a = EventLedger(spark, str(tmp_path / "x"), prefix="a_")
    a.stream(StreamId("app"), registry()).append(ev("First"))
    assert EventLedger(spark, str(tmp_path / "x"), prefix="b_").snapshot().count() == 0
    assert EventLedger(spark, str(tmp_path / "x"), prefix="a_", mode=InitMode.VALIDATE).snapshot().count() == 1
    assert EventLedger(spark, str(tmp_path / "x"), prefix="a_", mode=InitMode.INITIALIZE).snapshot().count() == 0
    for bad in ("a", "a-b_", "x" * 33 + "_"):
        with pytest.raises(ValueError):
            EventLedger(spark, str(tmp_path), prefix=bad)


def test_listeners(store):
    s, wide = store.stream(StreamId("app"), registry()), store.stream(StreamId.any(), registry())
    seen, later, marks = [], [], []
    s.on_append(lambda events: seen.append([e.type for e in events]))
    wide.on_append(lambda events: seen.append("wrong"))
    wide.on_append_eventually(lambda ref: later.append(ref.position))
    wide.on_bookmark(lambda reader, ref: marks.append((reader, ref.position)))
    got = s.append([ev("First"), ev("Second")])
    s.append(ev("Third"))
    s.place_bookmark("r", got[0].reference)
    store.close()
    assert seen == [["First", "Second"], ["Third"]] and later == [2, 3] and marks == [("r", 1)]


def test_bookmarks(store):
    s = store.stream(StreamId("app"), registry())
    refs = [s.append(ev("First"))[0].reference for _ in range(2)]
    assert s.bookmark("a") is None
    s.place_bookmark("a", refs[0], Tags.of("phase:first"))
    s.place_bookmark("a", refs[1], Tags.of("phase:second"))
    s.place_bookmark("b", refs[0])
    assert s.bookmark("a") == refs[1]
    assert {b.reader: b.tags for b in store.bookmarks()} == {"a": Tags.of("phase:second"), "b": Tags()}
    assert {r.reader: r.position for r in store.bookmarks_table().collect()} == {"a": 2, "b": 1}
    assert s.remove_bookmark("a") == refs[1] and s.remove_bookmark("a") is None
    s.place_bookmark("b", None)
    assert store.bookmarks() == [] and store.bookmarks_table().count() == 0


# ---- upcasting, erasure, evolution ----


def customers(spark, path):
    old = Registry()
    for t in ("CustomerRegisteredWithAddress", "CustomerLegacyAuditLog", "CustomerNameChanged", "CustomerChurned"):
        old.event(t)
    store = EventLedger(spark, path)
    s = store.stream(StreamId("app"), old)
    s.append(ev("CustomerRegisteredWithAddress", {"name": "John", "street": "123 Main St", "city": "Springfield"}, "customer:1"))
    s.append(ev("CustomerLegacyAuditLog", {"message": "m"}, "customer:1"))
    s.append(ev("CustomerNameChanged", {"name": "Jane"}, "customer:1"))
    s.append(ev("CustomerChurned", {}, "customer:1"))
    part = lambda d, *names: F.to_json(F.struct(*[F.get_json_object(d, f"$.{n}").alias(n) for n in names]))
    new = (
        Registry().event("CustomerRegistered", "name string").event("AddressRecorded").event("CustomerRenamed").event("CustomerChurned")
        .interface("Customer", ["CustomerRegistered", "CustomerRenamed", "CustomerChurned"])
        .legacy_event("CustomerRegisteredWithAddress", Upcaster(("CustomerRegistered", "AddressRecorded"), lambda d: [("CustomerRegistered", part(d, "name")), ("AddressRecorded", part(d, "street", "city"))]))
        .legacy_event("CustomerLegacyAuditLog", dropped())
        .legacy_event("CustomerNameChanged", PythonUpcaster(("CustomerRenamed",), lambda d: [("CustomerRenamed", {"name": d["name"].upper()})]))
    )
    return store.stream(StreamId("app"), new)


def test_multi_upcast(spark, tmp_path):
    s = customers(spark, str(tmp_path))
    got = s.query(Q.match_all())
    assert [(e.type, e.stored_type, e.reference.position, e.reference.index) for e in got] == [
        ("CustomerRegistered", "CustomerRegisteredWithAddress", 1, 0), ("AddressRecorded", "CustomerRegisteredWithAddress", 1, 1),
        ("CustomerRenamed", "CustomerNameChanged", 3, 0), ("CustomerChurned", "CustomerChurned", 4, 0),
    ]
    assert got[0].data == {"name": "John"} and got[1].data == {"street": "123 Main St", "city": "Springfield"} and got[2].data == {"name": "JANE"}
    assert [len(s.query(Q.match_all().limited(n))) for n in range(1, 6)] == [2, 2, 3, 4, 4]
    assert [len(s.query(Q.match_all().backwards().limited(n))) for n in range(1, 6)] == [1, 2, 2, 4, 4]
    assert [(e.reference.position, e.reference.index) for e in s.query(Q.match_all().backwards())] == [(4, 0), (3, 0), (1, 1), (1, 0)]
    assert [e.type for e in s.query(Q.for_events(["AddressRecorded"]))] == ["AddressRecorded"]
    assert [e.type for e in s.query(Q.for_events(["Customer"]))] == ["CustomerRegistered", "CustomerRenamed", "CustomerChurned"]
    assert len(s.event_by_id(got[0].reference.id)) == 2
    until = EventReference("x", 1, 1, 0)
    assert [e.type for e in s.query(Q.match_all().until(until))] == ["CustomerRegistered"]
    with pytest.raises(OptimisticLockingError):  # a legacy row that becomes a watched type conflicts
        s.append(ev("CustomerChurned"), AppendCriteria.of(EventFilter.for_events(["CustomerRenamed"]), None))


def test_registration_errors():
    with pytest.raises(RegistrationError, match="duplicate"):
        Registry().event("A").event("A")
    with pytest.raises(RegistrationError, match="no upcaster"):
        Registry().legacy_event("A", None)
    with pytest.raises(RegistrationError, match="unknown"):
        Registry().legacy_event("A", renamed("B")).check()


def test_erasure(spark, store):
    address = T.StructType([erasable("street", T.StringType()), erasable("number", T.StringType()), T.StructField("zip", T.StringType())])
    schema = T.StructType([T.StructField("id", T.StringType()), erasable("name", T.StringType()), erasable("email", T.StringType()), erasable("address", address, partly=True)])
    s = store.stream(StreamId("app"), Registry().event("CustomerRegistered", schema))
    data = {"id": "123", "name": "John", "email": "john@doe.com", "address": {"street": "someStreet", "number": "42", "zip": "XY-1234"}}
    s.append(ev("CustomerRegistered", data))
    row = store.snapshot().first()
    assert json.loads(row.event_data) == {"id": "123", "address": {"zip": "XY-1234"}}
    assert s.query(Q.match_all())[0].data == data
    old = store.log.live_files()
    store.erase(F.col("event_type") == "CustomerRegistered")
    assert s.query(Q.match_all())[0].data == {"id": "123", "address": {"zip": "XY-1234"}}
    assert not any(store.files.exists(n) for n in old)
    store.erase(F.lit(True), '{"name":"***","email":null,"address":{"street":"***"}}')
    assert s.query(Q.match_all())[0].data == {"id": "123", "name": "***", "email": None, "address": {"zip": "XY-1234", "street": "***"}}


def test_merge_replaces_all_but_objects():
    assert merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": None, "e": 2}, "d": {"x": 1}}) == {"a": {"b": 1, "c": None, "e": 2}, "d": {"x": 1}}


def test_payload_evolution(store):
    s = store.stream(StreamId("app"), Registry().event("OrderPlaced"))
    s.append(ev("OrderPlaced", {"orderId": "order-1", "product": "Widget"}))
    wider = store.stream(StreamId("app"), Registry().event("OrderPlaced", "orderId string, product string, email string"))
    assert wider.query(Q.match_all())[0].data["product"] == "Widget"
    narrower = store.stream(StreamId("app"), Registry().event("OrderPlaced", "orderId string"))
    with pytest.raises(Exception, match="Failed to deserialize event data"):
        narrower.query(Q.match_all())


# ---- projector ----


class Count(Projection):
    def __init__(self, q, fail_at=None, initial=None):
        self.q, self.fail_at, self.initial, self.seen, self.calls = q, fail_at, initial, [], []

    def query(self):
        return self.q

    def initial_query(self):
        return self.initial

    def when(self, event):
        if event.reference.position == self.fail_at:
            raise RuntimeError("poison")
        self.seen.append(event.data.get("value"))

    def before_batch(self):
        self.calls.append("before")

    def after_batch(self, last):
        self.calls.append("after")

    def cancel_batch(self):
        self.calls.append("cancel")


@pytest.fixture(scope="module")
def six(spark, tmp_path_factory):
    s = EventLedger(spark, str(tmp_path_factory.mktemp("six"))).stream(StreamId("app"), registry())
    for i, (t, n) in enumerate(zip(["First", "Second", "Third"] * 2, ["one", "two", "three", "four", "five", "six"])):
        s.append(ev(t, {"value": str(i + 1)}, f"nr:{n}"))
    return s


BOTH = Q.for_events(["First", "Third"])


@pytest.mark.parametrize("size,queries", [(500, 1), (1, 5), (2, 3)])
def test_projector_pages(six, size, queries):
    p = Count(BOTH)
    m = Projector(six, p, batch_size=size).run()
    assert (m.queries, m.streamed, m.handled, m.last.position) == (queries, 4, 4, 6) and p.seen == ["1", "3", "4", "6"]


def test_projector_bounds_and_resume(six):
    refs = {e.reference.position: e.reference for e in six.query(Q.match_all())}
    p = Projector(six, Count(BOTH))
    assert p.run_until(refs[4]).handled == 3 and p.run().handled == 1 and p.run().handled == 0
    assert Projector(six, Count(BOTH), start_after=refs[1]).run_until(refs[4]).handled == 2
    single = Projector(six, Count(BOTH), batch_size=1)
    assert single.run_single_batch().handled == 1 and single.run().handled == 3
    back = Projector(six, Count(Q.for_events(["First"]).backwards().limited(1))).run()
    assert back.last.position == 4
    three = Projector(six, Count(BOTH.backwards().limited(3))).run()
    assert (three.newest.position, three.last.position, three.handled) == (6, 3, 3)


def test_poison_event(six):
    p = Count(BOTH, fail_at=4)
    projector = Projector(six, p, batch_size=2, bookmark="poison")
    for _ in range(2):
        with pytest.raises(ProjectionError) as e:
            projector.run()
        assert e.value.reference.position == 4 and projector.cursor.position == 3
    assert p.seen == ["1", "3"] and p.calls.count("after") == 1 and six.bookmark("poison").position == 3


def test_bookmarked_projectors(six):
    first = Projector(six, Count(BOTH), bookmark="reader")
    assert first.run().handled == 4 and six.bookmark("reader").position == 6
    assert Projector(six, Count(BOTH), bookmark="reader").run().handled == 0
    assert Projector(six, Count(BOTH), bookmark="reader", bookmark_reads=BookmarkReads.MANUAL).run().handled == 4
    assert Projector(six, Count(BOTH), bookmark="reader", bookmark_reads=BookmarkReads.AT_CREATION).run().handled == 0


def test_savepoint(store):
    s = store.stream(StreamId("app"), registry())
    for t, v in [("First", "10"), ("First", "5"), ("Third", "savepoint:15"), ("First", "3"), ("First", "7")]:
        s.append(ev(t, {"value": v}))
    p = Count(Q.for_events(["First", "Third"]), initial=Q.for_events(["Third"]).backwards().limited(1))
    m = Projector(s, p).run()
    assert p.seen == ["savepoint:15", "3", "7"] and m.handled == 3 and m.queries == 2


def test_vanished_events_are_passed(spark, tmp_path):
    s = customers(spark, str(tmp_path))
    p = Count(Q.match_all())
    projector = Projector(s, p, batch_size=1)
    assert projector.run().handled == 4 and projector.cursor.position == 4


def test_payloads_and_subscription(store):
    class Sum(PayloadProjection):
        total = 0

        def query(self):
            return Q.match_all()

        def when_payload(self, kind, data):
            self.total += data["n"]

    s, fold = store.stream(StreamId("app"), registry()), Sum()
    Projector(s, fold, subscribe=True)
    s.append([ev("First", {"n": 2}), ev("First", {"n": 3})])
    store.close()
    assert fold.total == 5


def test_fold_by_key(six):
    events = six.events(Q.match_all())
    out = fold_by_key(events, ["event_type"], lambda key, rows: {"values": ",".join(json.loads(d)["value"] for d in rows["data"])}, "event_type string, values string")
    assert {r.event_type: r["values"] for r in out.collect()} == {"First": "1,4", "Second": "2,5", "Third": "3,6"}


# ---- streaming and JSON ----


def test_stream_delivers_each_commit_once(spark, store, tmp_path):
    from quillstream.streaming.source import into_table, project, read_stream, read_table

    s, out, check = store.stream(StreamId("app"), registry()), str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(3):
        s.append(ev("First", {"v": i}))
    project(read_stream(store), check, into_table(out, lambda df: df.select("position", "event_type"))).awaitTermination(120)
    assert sorted(r.position for r in read_table(spark, out).collect()) == [1, 2, 3]
    s.append([ev("Second"), ev("Third")])
    project(read_stream(store), check, into_table(out, lambda df: df.select("position", "event_type"))).awaitTermination(120)
    assert sorted(r.position for r in read_table(spark, out).collect()) == [1, 2, 3, 4, 5]


def test_json_round_trip(spark, bank, tmp_path):
    log = bank.store.snapshot()
    assert jsonio.write_event_files(log, str(tmp_path / "files")) == 11
    back = jsonio.read_events(spark, str(tmp_path / "files"))
    jsonio.validate_events(back)
    key = lambda r: (r.position, r.tx, r.event_id, r.event_type, r.stream_context, r.event_data, r.event_tags, r.event_timestamp)
    assert sorted(map(key, back.collect())) == sorted(map(key, log.collect()))
    jsonio.write_events(log, str(tmp_path / "lines"))
    assert sorted(map(key, jsonio.read_events_lines(spark, str(tmp_path / "lines")).collect())) == sorted(map(key, log.collect()))


def test_json_bookmarks(spark, store, tmp_path):
    s = store.stream(StreamId("app"), registry())
    s.place_bookmark("my reader/1", s.append(ev("First"))[0].reference, Tags.of("k:v", ":x", "y"))
    (mark,) = store.bookmarks()
    path = jsonio.write_bookmark(str(tmp_path / "b"), mark)
    assert path.endswith("my_reader_1.json")
    (tmp_path / "b" / "old.json").write_text('{"reader":"old","reference":{"id":"i","position":1,"tx":2}}')
    rows = {r.reader: r for r in jsonio.read_bookmarks(spark, str(tmp_path / "b")).collect()}
    assert rows["my reader/1"].tags == [":x", "k:v", "y"] and rows["old"].tags == [] and rows["old"].updated_at.year == 1970
    jsonio.delete_bookmark(str(tmp_path / "b"), "old")
    assert jsonio.read_bookmarks(spark, str(tmp_path / "b")).count() == 1


def test_a_stream_survives_erasure_and_compaction(spark, tmp_path):
    """Versions whose files are gone come from the snapshot, each once, whether a stream has seen some of them or not."""
    from quillstream.streaming.source import into_table, project, read_stream, read_table

    ledger = EventLedger(spark, str(tmp_path / "log"))
    stream = ledger.stream(StreamId("app", "domain"), Registry().event("First"))
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")

    def go():
        project(read_stream(ledger), offsets, into_table(out)).awaitTermination()
        return sorted(r.position for r in read_table(spark, out).collect())

    for i in range(4):
        stream.append(EphemeralEvent("First", {"n": i}))
    assert go() == [1, 2, 3, 4]
    stream.append(EphemeralEvent("First", {"n": 4}))
    ledger.compact()
    stream.append(EphemeralEvent("First", {"n": 5}))
    ledger.erase(F.lit(True))
    stream.append(EphemeralEvent("First", {"n": 6}))
    assert go() == [1, 2, 3, 4, 5, 6, 7]
    fresh = str(tmp_path / "fresh")
    project(read_stream(ledger), str(tmp_path / "fresh-offsets"), into_table(fresh)).awaitTermination()
    assert sorted(r.position for r in read_table(spark, fresh).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_long_numbers_keep_files_apart(spark, tmp_path):
    import os

    from quillstream.sources import jsonio

    rows = [(p, t, f"e{p}", None, "a", "b", "First", datetime(2024, 1, 1, tzinfo=timezone.utc), "{}", None, []) for p, t in
            [(99_999, 1), (100_000, 1), (100_001, 1), (1_000_010, 1), (1, 12_345_678_901), (2, 12_345_678_902)]]
    events = spark.createDataFrame(rows, S.EVENTS)
    folder = str(tmp_path / "files")
    assert jsonio.write_event_files(events, folder) == len(os.listdir(folder)) == 6
    back = jsonio.read_events(spark, folder)
    assert [(r.tx, r.position) for r in back.collect()] == sorted((r[1], r[0]) for r in rows)
    with pytest.raises(FileExistsError):
        jsonio.write_event_files(events, folder)


def test_another_process_is_heard(spark, tmp_path):
    """Two ledgers over one folder: what one commits, the other's listeners are told once; its own commits are not told twice."""
    import time

    one, two = (EventLedger(spark, str(tmp_path / "log")) for _ in range(2))
    told = []
    near = one.stream(StreamId("app", "domain"), Registry().event("First"))
    near.on_append_eventually(lambda r: told.append(r.position))
    one.watch(0.05)
    far = two.stream(StreamId("app", "domain"), Registry().event("First"))
    two.stream(StreamId("other", "x"), Registry().event("First")).append(EphemeralEvent("First", {}))
    far.append([EphemeralEvent("First", {}), EphemeralEvent("First", {})])
    until = time.time() + 10
    while told != [3] and time.time() < until:
        time.sleep(0.05)
    near.append(EphemeralEvent("First", {}))
    time.sleep(0.3)
    one.close()
    assert told == [3, 4]


def test_strict_bookmarks_point_into_the_log(spark, tmp_path):
    ledger = EventLedger(spark, str(tmp_path / "log"), strict_bookmarks=True)
    (event,) = ledger.stream(StreamId("a", "b"), Registry().event("First")).append(EphemeralEvent("First", {}))
    ledger.place_bookmark("r", event.reference)
    with pytest.raises(LedgerError):
        ledger.place_bookmark("r", EventReference("x", 2, 2))
    assert ledger.bookmark("r") == event.reference
    other = EventLedger(spark, str(tmp_path / "log"))
    other.place_bookmark("s", event.reference)
    assert {b.reader for b in ledger.bookmarks()} == {"r", "s"}


def test_pages_by_cursor_end_where_the_query_says(spark, sf):
    from quillstream import queries as Q
    from quillstream.model import EventQuery
    from quillstream.plans import reader as R

    for ranges in (7, 100_000):
        pages = sorted(tuple(r) for r in Q.page_boundaries(spark, sf, size=40, rows_of_a_range=ranges).collect())
        log, query, cursor, want = Q.log_view(spark, sf), EventQuery.for_events(["click"]), None, []
        while True:
            rows = sorted((r.tx, r.position) for r in R.query_log(log, query.limited(40), cursor=cursor).collect())
            if rows:
                want.append((len(want) + 1, len(rows), *rows[-1]))
                cursor = EventReference("x", rows[-1][1], rows[-1][0])
            if len(rows) < 40:
                break
        assert pages == want and len(want) > 2


def test_keys_of_imported_events_are_known(spark, tmp_path):
    ledger = EventLedger(spark, str(tmp_path / "log"))
    row = (1, 1, "e1", "once", "a", "b", "First", datetime(2024, 1, 1, tzinfo=timezone.utc), "{}", None, [])
    ledger.import_events(spark.createDataFrame([row], S.EVENTS))
    stream = ledger.stream(StreamId("a", "b"), Registry().event("First"))
    for _ in range(2):
        assert stream.append(EphemeralEvent("First", {}, idempotency_key="once")) == []
        ledger.compact()
    assert len(stream.append(EphemeralEvent("First", {}, idempotency_key="new"))) == 1


def test_checkpoints_hold_what_entries_held(spark, tmp_path):
    """A store opened from a checkpoint reads few entries and answers as one that has read them all."""
    base = str(tmp_path / "log")
    one = EventLedger(spark, base)
    one.log.every = 5
    stream = one.stream(StreamId("app", "domain"), registry())
    refs = [stream.append(ev("First", {"v": i}, f"n:{i}", key=f"k{i}"))[0].reference for i in range(23)]
    assert one.files.exists("_checkpoint.json") and len(one.log._seen) <= 10
    two = EventLedger(spark, base)
    again = two.stream(StreamId("app", "domain"), registry())
    assert two.log.refresh() == 23 and 15 <= two.log.floor and len(two.log._seen) <= 8 and two.log.last_position() == 23
    assert two.log.live_files() == one.log.live_files() and two.snapshot().count() == 23
    assert two.snapshot(7).count() == 7 and [c.version for c in two.log.commits(3, 9)] == [4, 5, 6, 7, 8, 9]
    assert [again.append(ev("First", key=f"k{i}")) for i in (0, 9, 22)] == [[], [], []]
    for known, refused in ((refs[2], True), (refs[21], True), (refs[22], False)):  # below the checkpoint, above it, the newest
        criteria = AppendCriteria.of(EventFilter.for_events(["First"]), known)
        if refused:
            with pytest.raises(OptimisticLockingError):
                again.append(ev("Second"), criteria)
        else:
            assert again.append(ev("Second"), criteria)[0].reference.position == 24
    for i in range(12):  # the first process hears of the other's versions and sets its own checkpoint
        again.append(ev("Third", key=f"t{i}"))
    assert stream.append(ev("Third", key="t0")) == [] and one.snapshot().count() == 36
    assert sorted(r.position for r in one.snapshot().collect()) == list(range(1, 37))


def test_bookmarks_from_a_checkpoint(spark, tmp_path):
    one = EventLedger(spark, str(tmp_path / "log"))
    one.log.every = 4
    refs = [one.stream(StreamId("app"), registry()).append(ev("First"))[0].reference for _ in range(3)]
    for i in range(9):
        one.place_bookmark(f"r{i % 2}", refs[i % 3])
    one.remove_bookmark("r1")
    two = EventLedger(spark, str(tmp_path / "log"))
    assert two.files.exists("_bookmarks.json") and two.bookmarks() == one.bookmarks()
    assert two.bookmark("r0") == refs[2] and two.bookmark("r1") is None and two._bookmark_files == 10
    two.place_bookmark("r1", refs[0])
    assert one.bookmark("r1") == refs[0]
    assert {(r.reader, r.position, r.event_id) for r in one.bookmarks_table().collect()} == {("r0", 3, refs[2].id), ("r1", 1, refs[0].id)}


def test_an_import_may_keep_transactions(spark, tmp_path, sf):
    from quillstream.queries import log_view
    from quillstream.streaming.source import into_table, project, read_stream, read_table

    rows = log_view(spark, sf).drop("value")
    top, n = rows.agg(F.max("tx"), F.count("*")).first()
    ledger = EventLedger(spark, str(tmp_path / "log"))
    ledger.log.every = 3
    mark = EventReference("0", 1, 3)
    from quillstream.model import Bookmark

    assert ledger.import_events(rows, keep_tx=True, bookmarks=[Bookmark("seeded", mark, Tags.of("a:b"), datetime.now(timezone.utc))]) == n
    assert ledger.bookmark("seeded") == mark and ledger.log.refresh() == top
    key = lambda r: (r.position, r.tx)
    assert sorted(map(key, ledger.snapshot().collect())) == sorted(map(key, rows.collect()))
    stream = ledger.stream(StreamId("shop", "u1"), Registry().event("view").event("click"))
    middle = EventReference("x", n // 2, top // 2)
    with pytest.raises(OptimisticLockingError):
        stream.append(ev("view"), AppendCriteria.of(EventFilter.for_events(["view"]), middle))
    for i in range(7):
        got = stream.append(ev("view"))[0].reference
        assert (got.tx, got.position) == (top + 1 + i, n + 1 + i)
    fresh = EventLedger(spark, ledger.base)
    assert fresh.log.refresh() == top + 7 and fresh.snapshot().count() == n + 7
    assert [c.version for c in fresh.log.commits(top // 2, top + 2)] == [1, top + 1, top + 2]
    out = str(tmp_path / "out")
    running = project(read_stream(fresh, max_commits=2), str(tmp_path / "offsets"), into_table(out), available_now=False, interval="0 seconds")
    running.processAllAvailable()
    running.stop()
    assert sorted(r.position for r in read_table(spark, out).collect()) == list(range(1, n + 8))
    assert len(os.listdir(out)) >= 4  # two commits a batch, the import being one commit
    part = str(tmp_path / "part")
    project(read_stream(fresh, start_version=top // 2), str(tmp_path / "offsets2"), into_table(part)).awaitTermination()
    assert read_table(spark, part).count() == rows.where(F.col("tx") > top // 2).count() + 7
    with pytest.raises(LedgerError):
        EventLedger(spark, str(tmp_path / "low")).import_events(rows.withColumn("tx", F.lit(0).cast("long")), keep_tx=True)
    empty = EventLedger(spark, str(tmp_path / "none"))
    assert empty.import_events(rows.limit(0), keep_tx=True) == 0
    assert empty.stream(StreamId("shop", "u1"), Registry().event("view")).append(ev("view"))[0].reference.position == 1


def test_a_projector_reads_ahead(six):
    """Pages are the same whatever is read ahead; the log is asked rarely."""
    refs = {e.reference.position: e.reference for e in six.query(Q.match_all())}
    for ahead, asked in ((1, 5), (3, 3), (4, 2), (100, 2)):  # the last query of each finds nothing
        p = Count(BOTH)
        projector = Projector(six, p, batch_size=1, read_ahead=ahead)
        calls, fetch = [], projector._fetch
        projector._fetch = lambda *a: calls.append(a) or fetch(*a)  # noqa: B023
        m = projector.run()
        assert (m.queries, m.handled, p.seen, p.calls.count("after")) == (5, 4, ["1", "3", "4", "6"], 4), ahead
        assert len(calls) == asked and projector.cursor.position == 6
    limited = Projector(six, Count(BOTH.backwards().limited(3)), batch_size=2, read_ahead=100)
    assert limited.run().handled == 3
    assert Projector(six, Count(BOTH), batch_size=2, read_ahead=3).run_until(refs[4]).handled == 3
    single = Projector(six, Count(BOTH), batch_size=2, read_ahead=100)
    assert single.run_single_batch().handled == 2 and single.cursor.position == 3 and single.run().handled == 2


def test_a_table_follows_the_log(spark, tmp_path):
    """Upcast events, null keys, runs that die before their bookmark, runs without anything new, two projectors of one table."""
    from quillstream.plans.reader import tag_value
    from quillstream.streaming.projector import TableProjector, add_up, newest

    s = customers(spark, str(tmp_path / "log"))

    def delta(events):
        return events.groupBy(tag_value("customer").alias("who.is"), "event_type").agg(F.count("*").alias("n"), F.max("position").alias("last"))

    def projector(folder="table"):
        return TableProjector(s, Q.for_events(["Customer", "AddressRecorded"]), ["who.is", "event_type"], delta, {"n": add_up, "last": newest}, str(tmp_path / folder), "table")

    one = projector()
    assert one.table() is None
    assert one.run().position == 4
    first = {("1", "CustomerRegistered"): (1, 1), ("1", "AddressRecorded"): (1, 1), ("1", "CustomerRenamed"): (1, 3), ("1", "CustomerChurned"): (1, 4)}
    table = lambda p: {(r[0], r.event_type): (r.n, r.last) for r in p.table().collect()}
    assert table(one) == first and one.run().position == 4
    s.append([ev("CustomerChurned", {}), ev("CustomerChurned", {}, "customer:1")])
    dying = projector()
    dying.stream = type("Dying", (), {"store": s.store, "registry": s.registry, "id": s.id, "place_bookmark": lambda *a: 1 / 0})()
    with pytest.raises(ZeroDivisionError):
        dying.run()
    assert table(one) == first and s.bookmark("table").position == 4
    second = first | {(None, "CustomerChurned"): (1, 5), ("1", "CustomerChurned"): (2, 6)}
    assert projector().run().position == 6 and table(one) == second
    s.append(ev("CustomerChurned", {}))
    one.run()
    assert table(one) == second | {(None, "CustomerChurned"): (2, 7)}
    with pytest.raises(ValueError):
        TableProjector(s, Q.match_all().limited(3), ["k"], delta, {}, "x", "y")


def test_out_of_order_in_ranges_of_any_size(spark, sf):
    from quillstream.operators.analytics import out_of_order
    from quillstream.queries import log_view

    log = log_view(spark, sf)
    want = None
    for size in (7, 100, 100_000):
        got = sorted(map(tuple, out_of_order(log, size).collect()))
        want = want or got
        assert got == want and got
    assert out_of_order(log.limit(0)).count() == 0


def test_the_tag_index_leaves_files_out_and_no_rows(spark, tmp_path):
    """Files without the tags are not read; what came after the index, an erasure or a compaction is."""
    ledger = EventLedger(spark, str(tmp_path / "data" / "it's 100%"))
    s = ledger.stream(StreamId("app"), registry())
    for i in range(8):
        s.append([ev("First", {"v": i}, f"n:{i}", "all", "a'b"), ev("Second", {}, f"n:{i % 2}")])
    found = lambda *tags, kinds=(): [e.reference.position for e in s.query(Q.for_events(list(kinds), list(tags)))]
    read = lambda *items: len(ledger._paths(ledger.log.live_files(), EventFilter(items)))
    want = {t: found(*t) for t in (("n:5",), ("n:1",), ("all",), ("n:1", "all"), ("a'b", "n:6"), ("none",))}
    assert len(want["n:1",]) == 5 and ledger.index_tags() == 8
    item = lambda *tags: FilterItem(frozenset(), Tags.of(*tags))
    assert [read(item("n:5")), read(item("n:1")), read(item("n:1", "all")), read(item("none")), read(item())] == [1, 4, 4, 0, 8]
    assert read(item("n:5"), item("n:6", "a'b")) == 2 and read(item("n:5"), FilterItem(frozenset({"First"}), Tags())) == 8
    assert {t: found(*t) for t in want} == want and found() == list(range(1, 17))
    s.append(ev("Third", {}, "n:5"))
    assert read(item("n:5")) == 2 and found("n:5") == want["n:5",] + [17]
    with pytest.raises(OptimisticLockingError):
        ledger.log._floor = 9  # as after a checkpoint: the files decide
        s.append(ev("Third"), AppendCriteria.of(EventFilter.for_events(tags=["n:3"]), None))
    ledger.erase(F.col("position") == 1, "{}")
    assert {t: found(*t) for t in want} == want | {("n:5",): want["n:5",] + [17]}
    ledger.compact()
    ledger.index_tags()
    assert found("n:5") == want["n:5",] + [17] and found("none") == []


# ---- what the driver is sent ----


def sent_to_driver(spark, run):
    """What run returns, and the bytes of results that its tasks sent to the driver."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(60_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.resultSize() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    got = run()
    return got, sum(n for stage, n in total().items() if stage not in before)


def test_a_projector_gets_each_row_once(spark, tmp_path):
    """A page was once a top-k whose every task sent a whole page; rows then crossed twice more to be upcast."""
    log = spark.range(16_000).select(
        (F.col("id") + 1).alias("position"), F.col("id").cast("string").alias("event_id"), F.lit("app").alias("stream_context"), F.lit("").alias("stream_purpose"),
        F.lit("First").alias("event_type"), F.current_timestamp().alias("event_timestamp"),
        F.concat(F.lit('{"value":"'), *[F.sha2(F.concat("id", F.lit(f":{i}")), 256) for i in range(4)], F.lit('"}')).alias("event_data"), F.array().cast("array<string>").alias("event_tags"),
    )
    store = EventLedger(spark, str(tmp_path / "store"))
    store.import_events(log.orderBy(F.sha2(F.col("event_id"), 256)).repartition(8))
    stream = store.stream(StreamId.any(), registry())
    rows, once = sent_to_driver(spark, lambda: store.snapshot().collect())
    p = Count(Q.match_all())
    done, sent = sent_to_driver(spark, lambda: Projector(stream, p, batch_size=500, read_ahead=1_000).run())
    want = [json.loads(r.event_data)["value"] for r in sorted(rows, key=lambda r: r.position)]
    assert p.seen == want and (done.queries, done.last.position) == (33, 16_000)
    assert sent < 2 * once, (sent, once)
    page, sent = sent_to_driver(spark, lambda: Projector(stream, Count(Q.match_all()), batch_size=500).run_single_batch())
    assert page.handled == 500 and sent < once / 8, (sent, once)


def test_events_that_come_during_a_run_are_folded(store):
    s = store.stream(StreamId("app"), registry())
    s.append([ev("First", {"value": str(i)}) for i in range(4)])

    class Appending(Count):
        def when(self, event):
            super().when(event)
            if event.data["value"] == "0":
                s.append([ev("First", {"value": f"later {i}"}) for i in range(3)])

    p = Appending(Q.match_all())
    Projector(s, p, batch_size=2, read_ahead=2).run()
    assert p.seen == ["0", "1", "2", "3", "later 0", "later 1", "later 2"]


@pytest.mark.parametrize("name", ["ledger_projection", "ledger_projector_resumed", "ledger_poison"])
def test_piecewise_queries_build_no_event_on_the_driver(spark, monkeypatch, name):
    import duckdb

    from quillstream.queries import QUERIES, SQL
    from quillstream.streaming import projector as module

    def refuse(row):
        raise AssertionError("an event was sent to the driver")

    monkeypatch.setattr(module, "event_of", refuse)
    monkeypatch.setattr(module, "RANGE_ROWS", 300, raising=False)
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    duckdb.sql("CREATE OR REPLACE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    want = duckdb.sql(SQL[name])
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())


def test_pieces_make_the_same_pages(spark, tmp_path, monkeypatch):
    """Pages that span ranges, rows that upcast to two events or none, both directions, bounds, failures: as on the driver."""
    from quillstream.queries import history, log_view
    from quillstream.streaming import projector as module
    from quillstream.streaming.projector import PiecewiseProjection

    monkeypatch.setattr(module, "RANGE_ROWS", 40)
    store = EventLedger(spark, str(tmp_path / "store"))
    store.import_events(log_view(spark, "/root/testdata/sf0.001").drop("value").repartition(3), keep_tx=True)

    class Driver(Projection):
        def __init__(self, q, fail_at=None):
            self.q, self.fail_at, self.seen, self.calls = q, fail_at, [], []

        def query(self):
            return self.q

        def when(self, event):
            r = event.reference
            if r.position == self.fail_at:
                raise ValueError("poison")
            self.seen.append((r.tx, r.position, r.index, event.type, event.stored_type, str(event.data), str(event.stream), event.tags.texts(), event.timestamp))

        def before_batch(self):
            self.calls.append("before")

        def after_batch(self, last):
            self.calls.append(("after", last, len(self.seen)))

        def cancel_batch(self):
            self.calls.append("cancel")

    class Pieces(Driver, PiecewiseProjection):
        def piece(self):
            return Pieces(self.q, self.fail_at)

        def found(self):
            return self.seen

        def merge(self, found):
            self.seen += found

    stream = store.stream(StreamId.any(), history())
    middle = EventReference("x", 31, 11)
    for q in (Q.match_all(), Q.match_all().backwards(), Q.for_events(["payment_made", "view"]), Q.match_all().until(middle), Q.match_none(), Q.match_all().limited(7)):
        for size in (7, 20, 50):
            made = []
            for kind in (Driver, Pieces):
                p = kind(q)
                projector = Projector(stream, p, batch_size=size)
                m = projector.run()
                made.append((p.seen, p.calls, m, projector.cursor))
            assert made[0] == made[1], (q, size)
    kept, views = [], [e.reference.position for e in stream.query(Q.for_events(["view"]))]
    for kind in (Driver, Pieces):
        p = kind(Q.for_events(["tap", "view"]), fail_at=views[-5])
        projector = Projector(stream, p, batch_size=2)
        with pytest.raises(ProjectionError, match="poison") as e:
            projector.run()
        kept.append((e.value.reference, str(e.value), type(e.value.__cause__), projector.cursor, p.calls, projector.metrics))
    assert kept[0] == kept[1]


def test_a_stream_reads_files_apart_and_in_small_batches(spark, tmp_path):
    """Once a whole folder was one task, whose worker held many large batches of several files."""
    import pyarrow as pa

    from quillstream.streaming.source import LogReader

    wide = spark.range(60_000).select(
        (F.col("id") + 1).alias("position"), (F.col("id") + 1).alias("tx"), F.col("id").cast("string").alias("event_id"), F.lit("app").alias("stream_context"),
        F.lit("").alias("stream_purpose"), F.lit("First").alias("event_type"), F.current_timestamp().alias("event_timestamp"),
        F.concat(F.lit('{"value":"'), *[F.sha2(F.concat("id", F.lit(f":{i}")), 256) for i in range(8)], F.lit('"}')).alias("event_data"), F.array(F.lit("nr:1")).alias("event_tags"),
    )
    store = EventLedger(spark, str(tmp_path / "store"))
    store.import_events(wide.repartition(3), keep_tx=True)
    s = store.stream(StreamId("app", "one"), registry())
    for i in range(3):
        s.append(ev("First", {"value": str(i)}))

    def read(begin):
        reader = LogReader(store.base, 0, 0)
        parts = reader.partitions({"version": begin}, reader.latestOffset())
        positions, most, floor = [], 0, pa.total_allocated_bytes()
        for part in parts:
            for batch in reader.read(part):
                assert batch.num_rows <= 5_000
                most = max(most, pa.total_allocated_bytes() - floor)
                positions += batch.column("position").to_pylist()
        return parts, sorted(positions), most

    everything = list(range(1, 60_004))
    parts, positions, most = read(0)
    assert len(parts) == 6 and positions == everything and most < 16e6, most  # 31 MB of payloads
    assert read(60_001)[1] == everything[60_001:] and read(31_234)[1] == everything[31_234:]
    store.erase(F.lit(False))
    for begin in (0, 31_234, 60_001):
        parts, positions, most = read(begin)
        assert positions == everything[begin:] and most < 16e6 and all(len(p.names) <= 1 for p in parts)
