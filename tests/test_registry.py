import threading
from datetime import datetime, timedelta

import pytest

from tidemill.plans.periods import Period
from tidemill.registry import Chain, Locked, Registry, RegistryError
from tidemill.spec import Extraction, LoadSpec, Mode, SpecError, Status

NOW = datetime(2024, 5, 5, 12)
SPEC = LoadSpec(1, "demo.t", "DELTA", "DELTA_UPSERT", ("k",), "t", mode="DELTA", delta_start=datetime(2024, 5, 1), group="g")


@pytest.fixture
def reg(tmp_path):
    r = Registry(tmp_path, clock=lambda: NOW)
    r.add(SPEC)
    return r


def test_planning_goes_on_from_the_last_watermark(reg):
    (a,) = reg.plan(1)
    assert (a.extraction_from, a.extraction_to, a.status) == (datetime(2024, 5, 1), NOW, Status.NEW)
    assert reg.plan(1) == [a]
    reg.update(a.load_id, extraction_to=datetime(2024, 5, 3))
    assert reg.watermarks(1) == []
    reg.set_success(a.load_id)
    (b,) = reg.plan(1)
    assert b.extraction_from == datetime(2024, 5, 3) and b.load_id == a.load_id + 1
    reg.set_error(b.load_id)
    assert reg.plan(1)[0].extraction_from == datetime(2024, 5, 3)


def test_windows_that_are_open_are_not_planned_again(reg):
    how = dict(mode=Mode.ITER, interval=Period.of(1, "day"))
    first = reg.plan(1, datetime(2024, 5, 1), datetime(2024, 5, 3, 1), **how)
    assert len(first) == 2
    more = reg.plan(1, datetime(2024, 4, 30), datetime(2024, 5, 1), **how)
    assert [r.extraction_from.day for r in more] == [30]
    reg.add(SPEC.but(object_id=2, extraction="FULL", mode="FULL", active=False))
    assert len(reg.plan(2)) == 1
    assert reg.plan_group("g").keys() == {1}


def test_fields_are_typed(reg):
    (a,) = reg.plan(1)
    with pytest.raises(RegistryError):
        reg.update(a.load_id, colour=1)
    with pytest.raises(TypeError):
        reg.update(a.load_id, extraction_to="yesterday")
    with pytest.raises(RegistryError):
        reg.run(99)
    assert reg.update(a.load_id, row_cnt=5).row_cnt == 5 and reg.run(a.load_id).row_cnt == 5


def test_specifications(reg):
    with pytest.raises(SpecError):
        LoadSpec(3, "x", load="SOMETIMES")
    with pytest.raises(SpecError, match="merge_key"):
        LoadSpec(3, "x", load="DELTA_MERGE").check()
    with pytest.raises(SpecError):
        LoadSpec(3, "x", duplicates="maybe")
    reg.add(SPEC.but(where=" "))
    reg.remove(1)
    assert [h["change_type"] for h in reg.history] == ["INSERT", "UPDATE", "DELETE"]
    with pytest.raises(RegistryError):
        reg.merge_key(1)
    reg.add(SPEC.but(load_function="f", where="  "))
    assert (reg.merge_key(1), reg.load_function(1), reg.where_clause(1), reg.constant("ext"), reg.constant("no")) == (("k",), "f", None, "ext_", None)


def test_one_of_many_gets_the_lock(reg):
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(reg.lock(k, "a/b"))) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(got) == 1 and len(reg.locks("a/b")) == 1
    with pytest.raises(Locked):
        reg.wait_lock(99, "a/b", tries=2, pause=0.01)
    reg.wait_lock(99, "a/b", tries=1, take_over=True)
    assert reg.unlock(load_id=98) == 0 and reg.unlock(load_id=99) == 1
    reg.lock(1, "x")
    reg.lock(2, "y")
    assert reg.unlock() == 2


def test_numbers_are_dense_and_logs_typed(reg):
    ids = []
    threads = [threading.Thread(target=lambda: ids.append(reg._next("s"))) for _ in range(25)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(ids) == list(range(1, 26))
    reg.log("ERROR", "bad", "here", 7)
    reg.log("INFO", "good")
    assert [x["is_error"] for x in reg.logs()] == [True, False] and len(reg.logs(load_id=7)) == 1
    with pytest.raises(ValueError):
        reg.log("NOISE", "x")


def test_chain_runs(reg):
    with pytest.raises(RegistryError):
        reg.open_instance("c")
    reg.chains["c"] = Chain("c", "1>>2")
    i = reg.open_instance("c", NOW - timedelta(days=1), NOW)
    assert reg.instance_in_process(i.instance_id).started == NOW
    assert reg.instance_success(i.instance_id).finished == NOW
    assert reg.instance_error(i.instance_id).status is Status.ERROR and len(reg.instances()) == 1
    with pytest.raises(RegistryError):
        reg.update_instance(i.instance_id, colour=1)


def test_exists_by_kind(reg):
    (a,) = reg.plan(1)
    from tidemill.plans.windows import LoadWindow

    w = LoadWindow(a.extraction_from, a.extraction_to)
    inner = LoadWindow(a.extraction_from, a.extraction_to - timedelta(hours=1))
    assert reg.exists(1, w, Extraction.DELTA, False) and reg.exists(1, inner, Extraction.DELTA, False)
    assert reg.exists(1, w, Extraction.DELTA, True) and not reg.exists(1, inner, Extraction.DELTA, True)
    assert not reg.exists(2, w, Extraction.FULL, False)


def test_all_of_it_is_found_again(reg, tmp_path):
    from tidemill.spec import Grouping, SourceSpec

    full = SPEC.but(object_id=7, interval=Period.of(1, "month"), delta_safety=Period.of(2, "hours"), grouping=Grouping(("a",), having="n > 1", order_by=("a",), limit=3), source=SourceSpec("csv", "/x", {"sep": ";"}, rename={"k": "key"}, relaxed={"t": "string"}, reject_limit=2), load_start=NOW, columns=("v",), first=NOW)
    reg.add(full)
    reg.add(full.but(active=False), user="me")
    reg.chains["c/d"] = Chain("c/d", "1>>7", schedule="daily")
    reg.constants["ext"] = "external_"
    reg.dependencies += [(7, 1)]
    (a,) = reg.plan(1)
    again = Registry(tmp_path, clock=lambda: NOW)
    assert again.spec(7) == full.but(active=False) and again.spec(1) == SPEC
    assert again.chains == {"c/d": Chain("c/d", "1>>7", schedule="daily")} and again.constant("ext") == "external_" and again.constant("bkp") == "bkp_"
    assert again.dependencies == [(7, 1)] and again.plan(1) == [a]
    assert [(h["change_type"], h["change_username"], h["object_id"]) for h in again.history] == [("INSERT", "", 1), ("INSERT", "", 7), ("UPDATE", "me", 7)]
    assert again.history[2]["spec"] == full
    del again.chains["c/d"]
    again.remove(7)
    assert set(Registry(tmp_path).specs) == {1} and Registry(tmp_path).chains == {}


def test_failed_windows_come_again_in_order(reg):
    how = dict(mode=Mode.ITER, interval=Period.of(1, "day"))
    first = reg.plan(1, datetime(2024, 5, 1), datetime(2024, 5, 4, 1), **how)
    reg.set_error(first[0].load_id)
    reg.set_success(first[1].load_id)
    # the watermark doesn't pass the window that failed
    assert reg.watermarks(1) == [datetime(2024, 5, 1)]
    again = reg.plan(1, **how)
    assert [r.extraction_from.day for r in again] == [1, 3, 4] and [r.load_id for r in again][:2] == [first[0].load_id, first[2].load_id]
    for r in again:
        reg.set_success(r.load_id)
    assert max(reg.watermarks(1)) == datetime(2024, 5, 5)


def test_a_run_whose_process_is_gone_comes_again(reg):
    (a,) = reg.plan(1)
    reg.lock(a.load_id, SPEC.name)
    reg.set_in_process(a.load_id)
    assert [r.load_id for r in reg.plan(1)] != [a.load_id] and reg.run(a.load_id).status is Status.IN_PROCESS
    reg.unlock(a.load_id)
    assert a.load_id in [r.load_id for r in reg.plan(1)]


def test_runs_are_found_by_object(reg, monkeypatch):
    reg.add(SPEC.but(object_id=2))
    for k in (1, 2):
        reg.plan(k)
    opened = []
    real = reg.files.read
    monkeypatch.setattr(reg.files, "read", lambda n: opened.append(n) or real(n))
    assert len(reg.runs(2)) == 1 and len([n for n in opened if n.startswith("runs/")]) == 1


def test_state_on_the_session_s_file_system(spark, tmp_path):
    r = Registry(f"file://{tmp_path}/state", lambda: NOW, spark)
    r.add(SPEC)
    (a,) = r.plan(1)
    assert r.lock(1, "a/b") and not r.lock(2, "a/b") and r.unlock(1) == 1
    r.log("INFO", "x", load_id=a.load_id)
    again = Registry(f"file://{tmp_path}/state", lambda: NOW, spark)
    assert again.plan(1) == [a] and again.spec(1) == SPEC and len(again.logs()) == 1
