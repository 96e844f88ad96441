"""Writes that die at each step, commits that collide, batches that fail, rows that are refused, and message bodies."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import quality
from lodestone.operators import store as S
from lodestone.streaming import watch


def batch(spark, *rows):
    return spark.createDataFrame([(i, "T", i, b) for i, b in rows], "id string, type string, title string, body string")


def state(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in S.TABLES}


class Killed(BaseException):
    pass


def test_a_write_that_dies_at_any_step_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "s"))
    S.run_epoch(store, batch(spark, ("a", "1"), ("b", "1")))
    before, reader = state(store), store.read("concept")
    names = list(S.TABLES)
    for act in (S.run_epoch, S.upsert_batch, S.reindex):
        for step in range(len(names) + 1):
            wrote = [0]
            kind = type(reader)
            true_write = kind.write.fget

            def write(self, step=step, wrote=wrote, true_write=true_write):
                if self.columns in ([f.name for f in t] for t in S.TABLES.values()):
                    if wrote[0] == step:
                        raise Killed
                    wrote[0] += 1
                return true_write(self)

            def commit(self, number, what):
                raise Killed

            with monkeypatch.context() as m:
                if step < len(names):
                    m.setattr(kind, "write", property(write))
                else:
                    m.setattr(S.Store, "_commit", commit)
                with pytest.raises(Killed):
                    act(store, batch(spark, ("a", "2"), ("c", "1")))
            assert state(store) == before, (act.__name__, step)
    S.reindex(store, batch(spark, ("z", "1")))
    assert [r["id"] for r in store.read("concept").collect()] == ["z"] and sorted(r["id"] for r in reader.collect()) == ["a", "b"]
    assert store.numbers() == [0, 1] and sorted(r["id"] for r in store.read("concept", 0).collect()) == ["a", "b"]


def test_of_two_writers_from_one_state_one_fails(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    S.run_epoch(store, batch(spark, ("a", "1")))
    base = store.latest()
    store.write({"concept": store.read("concept", base)}, base)
    after = state(store)
    with pytest.raises(S.CommitConflict):
        store.write({"concept": store.read("concept", base).limit(0)}, base)
    assert state(store) == after and store.numbers() == [0, 1]
    assert not [p for p in (tmp_path / "s" / "commits").iterdir() if "crc" not in p.name and not p.name.endswith(".json")]


def test_a_batch_with_a_key_comes_in_once(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    assert S.upsert_batch(store, batch(spark, ("a", "1")), key="k").count() == 1
    assert S.upsert_batch(store, batch(spark, ("a", "2")), key="k").count() == 0 and store.next_epoch() == 1
    assert S.upsert_batch(store, batch(spark, ("a", "2")), key="k2").count() == 1


def test_failed_batches_are_tried_again(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.md").write_text("A")
    errors, seen, broken = [], [], [True]

    def callback(df, key):
        names = sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
        if broken[0]:
            raise ValueError(str(names))
        seen.append((key, names))

    run = lambda: watch.on_changes(watch.watch_folder(spark, str(folder)), callback, checkpoint, every=None, on_error=errors.append).awaitTermination()
    run()
    assert len(errors) == 1 and list(watch.failed_batches(spark, f"{checkpoint}/retry").values())[0][0].endswith("/a.md")
    (folder / "b.md").write_text("B")
    run()
    assert len(errors) == 3 and len(watch.failed_batches(spark, f"{checkpoint}/retry")) == 2  # the first again, and the second
    broken[0] = False
    (folder / "c.md").write_text("C")
    run()
    assert [n for _, n in seen] == [["a.md"], ["b.md"], ["c.md"]] and len({k for k, _ in seen}) == 3
    assert watch.failed_batches(spark, f"{checkpoint}/retry") == {} and watch.retry_failed(spark, callback, f"{checkpoint}/retry") == 0
    watch.retry_failed(spark, callback, str(tmp_path / "none"))
    assert len(seen) == 3


def test_enrich_takes_and_refuses_row_by_row(spark):
    schema = "id string, type string, title string, description string, body string, content_sha string, source_uri string, intent_terms string"
    long = "a body of more than forty characters, with nothing that deviates"
    rows = [(i, "T", f"Title {i}", "", long + i, i, "u", t) for i, t in (("good", ""), ("bad", None), ("none", " "), ("has", "terms"), ("late", ""))]
    rows.append(("off", "T", "Title off", "", long + " on kubernetes", "x", "u", ""))
    df, calls = spark.createDataFrame(rows, schema), []

    def fixer(todo):
        calls.append(sorted(r["id"] for r in todo.collect()))
        text = F.when(F.col("id") == "bad", "ask kafka").when((F.col("id") == "late") & F.lit(len(calls) < 2), "ask kafka").otherwise(F.concat(F.lit(" about "), "id"))
        return todo.where("id <> 'none'").select("id", text.alias("intent_terms"))

    after, items = quality.enrich(df, fixer, rounds=4)
    got = {r["id"]: (r["status"], r["round"]) for r in items.collect()}
    assert got == {"good": ("applied", 1), "late": ("applied", 2), "bad": ("rejected", 3), "none": ("no-change", 3), "off": ("rejected", 3)}
    assert calls == [["bad", "good", "late", "none", "off"], ["bad", "late", "none", "off"], ["bad", "none", "off"]]
    terms = {r["id"]: r["intent_terms"] for r in after.collect()}
    assert terms == {"good": "about good", "late": "about late", "bad": None, "none": " ", "has": "terms", "off": ""}
    same, items = quality.enrich(df, fixer, rounds=1, only=["good"], apply=False)
    assert [(r["id"], r["status"]) for r in items.collect()] == [("good", "proposed")] and sorted(map(str, same.collect())) == sorted(map(str, df.collect()))
    again, _ = quality.enrich(df, fixer, rounds=1, only=["has"], again=True)
    assert again.where("id = 'has'").first()["intent_terms"] == "about has"


def test_message_bodies(spark):
    body = {r["id"]: r["body"] for r in S.message_catalogue(spark).collect()}["messages/camt.056.md"]
    want = (
        "# camt.056 — FI to FI Payment Cancellation Request\n\nRequest to cancel/return a payment — drives Pix devolução requests.\n\n"
        "Termos / Terms: payment cancellation request, solicitação de cancelamento, pedido de devolução Pix\n\n"
        "## Key fields\n\n| Field | Description |\n|-------|-------------|\n| `OrgnlEndToEndId` | original e2e id |\n| `CxlRsnInf` | cancellation reason |\n\n"
        "## Related messages\n\n- [camt.029](messages/camt.029.md)\n- [pacs.004](messages/pacs.004.md)\n\n"
    )
    assert hashlib.sha256(body.encode()).hexdigest() == hashlib.sha256(want.encode()).hexdigest()
    bare = S.message_catalogue(spark, [("x.1", "x", "T", "S", "", (), ())]).first()
    assert bare["body"] == "# x.1 — T\n\nS\n\n" and bare["type"] == "IsoMessage"


def test_log_and_export(spark, tmp_path):
    import tarfile

    from lodestone.sources import parsers

    folder = tmp_path / "b"
    docs = spark.createDataFrame([("x/a.md", '{"t": 1}', "A é"), ("b.md", "{}", "B")], "id string, meta string, body string")
    for _ in range(2):
        parsers.write_bundle(docs, folder.as_uri())
    S.append_log(str(folder), "one")
    S.append_log(folder.as_uri(), "twö")
    assert (folder / "log.md").read_text(encoding="utf-8") == "- one\n- twö\n"
    (folder / ".git").mkdir()
    (folder / ".git" / "HEAD").write_text("x")
    assert S.export_bundle(str(folder), str(tmp_path / "b.tgz")) == 3
    with tarfile.open(tmp_path / "b.tgz") as t:
        assert sorted(t.getnames()) == ["b.md", "log.md", "x/a.md"]
    assert (folder / "x" / "a.md").read_text(encoding="utf-8").endswith("A é")


def test_periodic_job_runs_one_at_a_time_after_an_interval(spark, tmp_path):
    import time

    runs, began = [], time.time()
    query = watch.periodic(spark, lambda n: runs.append((n, time.time())), str(tmp_path / "p"), every="1 second")
    while len(runs) < 2 and time.time() - began < 60:
        time.sleep(0.2)
    query.stop()
    assert len(runs) >= 2 and runs[0][0] > 0 and runs[0][1] - began > 0.5
