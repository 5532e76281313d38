import json
import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from albumweave.operators import second
from albumweave.sources import events, versions
from albumweave.streaming import progress, worker


# What tasks call here travels by value, as the package's own functions do.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(spark, event, n, start=0):
    return spark.createDataFrame([(event, i, f"f{event}{i}", f"p{event}{i}", [1.0, 0.0]) for i in range(start, start + n)], "event_id string, row_ix long, face_id string, photo_id string, v array<float>")


def test_event_tables_overwrite_whole_events(spark, tmp_path):
    path = f"file://{tmp_path}/faces"
    assert events.read(spark, path).count() == 0
    events.overwrite(rows(spark, "a", 3).union(rows(spark, "b", 2)), path)
    events.overwrite(rows(spark, "a", 1), path)
    got = events.read(spark, path)
    assert {(r.event_id, r["count"]) for r in got.groupBy("event_id").count().collect()} == {("a", 1), ("b", 2)}
    # Columns that the files lack take their defaults.
    r = events.read(spark, path, event_id="b").first()
    assert r.cluster_id is None and r.face_width == 0.0 and r.source_key == ""
    events.remove(spark, path, ["a"])
    assert events.read(spark, path).select("event_id").distinct().count() == 1


def test_caches_round_trip(spark):
    scores = spark.createDataFrame([("e", "b", "c", 1.5), ("e", "a", "c", -1.0)], events.SCORES)
    text = events.encoded_scores(scores)
    assert events.encoded_scores(scores.orderBy("source_face_id")).first() == text.first()
    assert sorted(map(tuple, events.decoded_scores(text).collect())) == sorted(map(tuple, scores.collect()))
    assert events.decoded_scores(spark.createDataFrame([("e", "{broken")], "event_id string, body string")).count() == 0
    verdicts = spark.createDataFrame([("e", "f", True, "B", {"Statue": 80.0, "Doll": 1.0}, 0)], "event_id string, face_id string, nonhuman boolean, rule string, labels map<string,double>, n_faces int")
    assert events.decoded_verdicts(events.encoded_verdicts(verdicts)).first().asDict() == verdicts.first().asDict()


def extract(new):
    """An image's name tells its face: a letter for the person, digits for a slight turn of it; n has no face, x fails."""
    turn = F.regexp_extract("image_id", "[0-9]+", 0).cast("double") / 20
    who = F.ascii("image_id") - 97
    v = F.array(F.cos(who * 1.5 + turn), F.sin(who * 1.5 + turn)).cast("array<float>")
    seen = ~F.col("image_id").startswith("n")
    return new.select("event_id", F.concat(F.lit("f-"), "image_id").alias("face_id"), F.col("image_id").alias("photo_id"), F.when(seen, v).alias("v"), F.lit(100.0).alias("face_width"), F.when(F.col("image_id").startswith("x"), "unreadable").alias("error"))


def classify(job, *ids, event="e1", **options):
    return {"type": "classify_request", "job_id": job, "event_id": event, "images": [{"image_id": i, "s3_key": i} for i in ids], "options": options}


def delete(job, *ids, event="e1"):
    return {"type": "delete_request", "job_id": job, "event_id": event, "image_ids": list(ids)}


def correction(job, action, event="e1", **what):
    return {"type": "cluster_feedback", "job_id": job, "event_id": event, "action": action, action: what}


def take(spark, state, *bodies):
    """One batch of messages; results by job."""
    raw = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(bodies)], "at long, raw string").coalesce(1)
    return {r.job_id: r for r in worker.applied(spark, worker.numbered(raw), state, extract).collect()}


def albums(result):
    return sorted(sorted(c.image_ids) for c in result.clusters)


def test_stream_takes_each_message_once(spark, tmp_path):
    inbox, where = tmp_path / "in", {k: f"file://{tmp_path}/{k}" for k in ("state", "results", "poison", "check")}
    inbox.mkdir()

    def send(name, *messages):
        (inbox / name).write_text("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages))
        worker.start(worker.inbox(spark, str(inbox)), where["state"], where["results"], where["poison"], where["check"], extract).awaitTermination()

    send("1.txt", classify("j1", "a1", "a2", "n1", "x1"), "broken", '{"type":"x","job_id":"j3"}')
    send("2.txt", correction("j5", "confirm_distinct", event="none", cluster_ids=["x", "y"]), delete("j4", "a1", "a2"))
    assert worker.stored(spark, where["state"]).faces.count() == 0
    results = {r.job_id: r for r in spark.read.option("mergeSchema", True).parquet(where["results"]).collect()}
    assert {k: r.status for k, r in results.items()} == {"j1": "partial", "j3": "failed", "j4": "succeeded", "j5": "failed"}
    assert albums(results["j1"]) == [["a1", "a2"]] and results["j1"].common_album == ["n1"] and [(x.image_id, x.reason) for x in results["j1"].failed_images] == [("x1", "unreadable")]
    assert results["j4"].retired_cluster_ids == [results["j1"].clusters[0].cluster_id]
    assert spark.read.parquet(where["poison"]).count() == 2


def test_messages_of_an_event_are_taken_in_order(spark, tmp_path):
    """A first upload, corrections one after the other, and what they leave behind."""
    state = f"file://{tmp_path}/state"
    first = take(spark, state, classify("j1", "a1", "a2", "a3", "a4", "b1", "b2"), classify("j0", "b1", "b2", event="e2"))
    assert albums(first["j1"]) == [["a1", "a2", "a3", "a4"], ["b1", "b2"]]
    a, b = (c.cluster_id for c in first["j1"].clusters)
    other = first["j0"].clusters[0].cluster_id
    # Two corrections and a repeated upload in one batch: the second correction undoes a part of the first.
    got = take(spark, state, correction("j2", "merge", target_cluster_id=a, source_cluster_ids=[b]), classify("j3", "a1", "a2"), correction("j4", "confirm_distinct", event="e2", cluster_ids=[other, "gone"]))
    assert albums(got["j2"]) == albums(got["j3"]) == [["a1", "a2", "a3", "a4", "b1", "b2"]] and got["j2"].retired_cluster_ids == [b]
    links = worker.stored(spark, state).links
    assert links.where("kind = 'must'").count() == 5 and links.where("event_id = 'e2'").count() == 0 and got["j4"].status == "succeeded"
    got = take(spark, state, correction("j5", "split", cluster_id=a, groups=[["a1", "a2", "a3", "a4"], ["b1", "b2"]]), delete("j6", "a4"))
    assert albums(got["j5"]) == [["a1", "a2", "a3", "a4"], ["b1", "b2"]] and albums(got["j6"]) == [["a1", "a2", "a3"], ["b1", "b2"]]
    second = next(c.cluster_id for c in got["j6"].clusters if "b1" in c.image_ids)
    got = take(spark, state, correction("j7", "reassign", image_id="a3", from_cluster_id=a, to_cluster_id=second))
    assert albums(got["j7"]) == [["a1", "a2"], ["a3", "b1", "b2"]]
    links = {(r.kind, r.a, r.b) for r in worker.stored(spark, state).links.collect()}
    assert ("must", "f-a3", "f-b1") in links and ("cannot", "f-a1", "f-a3") in links and not any("f-a4" in x for x in links)
    assert {r.event_id for r in worker.stored(spark, state).faces.collect()} == {"e1", "e2"}


def test_an_event_that_cannot_be_done_does_not_hold_up_others(spark, tmp_path):
    inbox, where = tmp_path / "in", {k: f"file://{tmp_path}/{k}" for k in ("state", "results", "poison", "check")}
    inbox.mkdir()
    (inbox / "1.txt").write_text("\n".join(map(json.dumps, (classify("j1", "a1", "a2"), classify("j2", "b1", event="bad")))))

    def torn(new):
        return extract(new).withColumn("face_width", F.when(F.col("event_id") == "bad", F.raise_error(F.lit("torn")).cast("double")).otherwise(100.0))

    begin = lambda: worker.start(worker.inbox(spark, str(inbox)), where["state"], where["results"], where["poison"], where["check"], torn, attempts=2)
    worker.keep_running(begin, 2)
    assert {r.job_id: r.status for r in spark.read.parquet(where["results"]).collect()} == {"j1": "succeeded", "j2": "failed"}
    assert [r.event_id for r in spark.read.parquet(where["poison"]).select("message.event_id").collect()] == ["bad"]
    assert {r.event_id for r in worker.stored(spark, where["state"]).faces.collect()} == {"e1"}


def test_progress_keeps_the_furthest_tick(spark):
    ticks = spark.createDataFrame([("j", 3, 9), ("j", 6, 9), ("j", 3, 9)], "job_id string, processed int, total int")
    assert tuple(worker.progress(ticks).first()) == ("j", 6, 9)


def folders(path):
    return len([x for x in path.iterdir() if x.name.startswith("settled-")])


def test_a_stream_leaves_nothing_behind_and_answers_a_job_once(spark, tmp_path, monkeypatch):
    """Ten messages in as many batches: working tables and old versions go; the same job, asked again, is not answered."""
    shared = tmp_path / "shared"
    monkeypatch.setattr("albumweave.operators.graph.shared_dir", lambda spark: f"file://{shared}")
    shared.mkdir()
    inbox, where = tmp_path / "in", {k: f"file://{tmp_path}/{k}" for k in ("state", "results", "poison", "check")}
    inbox.mkdir()
    held = []
    for k in range(10):
        body = delete(f"j{k}", "nothing", event=f"none{k % 2}") if k % 5 else classify("j0", "a1", "a2")
        (inbox / f"{k}.txt").write_text(json.dumps(body))
        worker.start(worker.inbox(spark, str(inbox)), where["state"], where["results"], where["poison"], where["check"], extract).awaitTermination()
        held.append((folders(shared), len(versions.versions(spark, where["state"])), len(list((tmp_path / "state" / "faces").iterdir()))))
    assert {h[0] for h in held} == {0} and {h[1] for h in held[2:]} == {2} and max(h[2] for h in held) <= 5
    jobs_ = [r.job_id for r in spark.read.option("mergeSchema", True).parquet(where["results"]).collect()]
    assert sorted(jobs_) == sorted({*jobs_}) and {r.job_id for r in versions.read(spark, f"{where['check']}-ledger", "jobs", spark.createDataFrame([], worker.LEDGER).schema).collect()} == set(jobs_)


def test_a_writer_that_dies_leaves_the_state_as_it_was(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    schema = spark.createDataFrame([], "event_id string, x long").schema
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    of = lambda t, touched=None: sorted(map(tuple, versions.read(spark, root, t, schema, touched).collect()))
    assert of("t") == []
    versions.commit(spark, root, {"t": make(("a", 1), ("b", 2)), "u": make(("a", 5))}, make(("a", 0), ("b", 0)))
    versions.commit(spark, root, {"t": make(("a", 3)), "u": make()}, make(("a", 0)))
    assert of("t") == [("a", 3), ("b", 2)] and of("u") == [] and of("t", make(("b", 0))) == [("b", 2)]

    def dies(*args):
        raise OSError("the machine is gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "manifest", dies)  # both tables are written by then
        with pytest.raises(OSError):
            versions.commit(spark, root, {"t": make(("a", 9), ("b", 9)), "u": make(("b", 9))}, make(("a", 0), ("b", 0)))
    assert of("t") == [("a", 3), ("b", 2)] and of("u") == []
    versions.commit(spark, root, {"t": make(("b", 4)), "u": make()}, make(("a", 0), ("b", 0)), make(("b", 0)))
    assert of("t") == [("b", 4)] and of("u") == []


def turned(axis, degrees=0.0, n=12):
    v = [0.0] * n
    v[axis], v[axis + 1] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    if axis in (4, 6) and not degrees:  # somewhat like the first person, or nobody would count the face
        v[0], v[axis] = 0.3, math.sqrt(1 - 0.09)
    return v


#: What is on the images of the tests below: axis and turn of each face, and its width.
SCENE = {
    "a1": [(0, 0, 100)], "a2": [(0, 15, 150)], "b1": [(2, 0, 100)], "b2": [(2, 15, 100)],
    "join": [(4, 0, 100)], "ask": [(6, 0, 100)], "doll1": [(8, 0, 100)], "doll2": [(8, 15, 100)],
    "crowd": [(0, 0, 100), (0, 14, 100)], "c2": [(4, 0, 90)], "c3": [(4, 14, 90)], "c4": [(4, -14, 90)],
}
KINDS = {"face_id": "string", "v": "array<float>", "face_width": "double", "source_key": "string", "bbox": "struct<x:double,y:double,w:double,h:double>"}


def seen(image):
    if image["image_id"].startswith("torn"):
        raise OSError("torn")
    return [{"face_id": f"f-{image['image_id']}-{k}", "v": turned(axis, turn), "face_width": float(w), "source_key": image["image_id"], "bbox": {"x": 1.5 * k, "y": 0.0, "w": float(w), "h": float(w)}} for k, (axis, turn, w) in enumerate(SCENE.get(image["image_id"], []))]


def take_scene(spark, state, *bodies, judges=None):
    raw = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(bodies)], "at long, raw string").coalesce(1)
    return {r.job_id: r for r in worker.applied(spark, worker.numbered(raw), state, progress.extractor(seen, KINDS), judges).collect()}


def test_faces_of_one_photo_are_no_person_unless_someone_says_so(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    r = take_scene(spark, state, classify("j1", "crowd", "c2", "c3", "c4"))["j1"]
    assert albums(r) == [["c2", "c3", "c4"]] and r.common_album == [] and [(u.image_id, u.reason) for u in r.uncertain] == [("crowd", "unmatched")]
    # Someone says that an album is two people: one of them is left with a photo alone, and stays.
    got = take_scene(spark, state, correction("j2", "split", cluster_id=r.clusters[0].cluster_id, groups=[["c2"], ["c3", "c4"]]))["j2"]
    assert albums(got) == [["c2"], ["c3", "c4"]]
    # A photo that loses its album's other ones is no album any more.
    state = f"file://{tmp_path}/other"
    first = take_scene(spark, state, classify("j1", "a1", "a2"))["j1"]
    after = take_scene(spark, state, delete("j2", "a2"))["j2"]
    assert albums(first) == [["a1", "a2"]] and after.clusters == [] and after.retired_cluster_ids == [first.clusters[0].cluster_id]
    assert [(u.image_id, u.reason, [tuple(b) for b in u.face_bboxes], u.causes) for u in after.uncertain] == [("a1", "unmatched", [], [])]  # like nobody else: not counted


def test_second_judgements_between_two_passes(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def note(*what):
        (asked / f"{len(list(asked.iterdir()))}-{'-'.join(what)}-{id(what)}").touch()

    def compare(a, b):
        note("pair", a["face_id"], b["face_id"])
        if a["source_key"] == "join" and "b" in b["source_key"]:
            return 5.0
        return {("join", "a2"): 99.0, ("ask", "a2"): 88.0}.get((a["source_key"], b["source_key"]), 5.0)

    def labels(face):
        note("label", face["face_id"])
        return {"Doll": 97.0} if face["source_key"].startswith("doll") else {"Person": 99.0}

    def count(face):
        note("count", face["face_id"])
        return 0

    state, calls = f"file://{tmp_path}/state", lambda kind: len([x for x in asked.iterdir() if f"-{kind}-" in x.name])
    images = ("a1", "a2", "b1", "b2", "join", "ask", "doll1", "doll2")
    judges = second.Judges(compare, labels, count)
    r = take_scene(spark, state, classify("j1", *images), judges=judges)["j1"]
    assert albums(r) == [["a1", "a2", "join"], ["b1", "b2"]] and sorted(r.common_album) == ["doll1", "doll2"]
    a = next(c for c in r.clusters if "a1" in c.image_ids)
    assert len(a.representative_vector) == 12 and abs(sum(x * x for x in a.representative_vector) - 1) < 1e-6
    u = next(u for u in r.uncertain)
    assert (u.image_id, u.album_id, len(r.uncertain)) == ("ask", "__uncertain__", 1)
    assert [(s.cluster_id, s.similarity, tuple(s.face_bbox)) for s in u.suggestions] == [(a.cluster_id, 88.0, tuple(u.face_bboxes[0]))]
    held = worker.stored(spark, state)
    assert {(x.kind, x.a, x.b) for x in held.links.collect()} == {("attach", "f-join-0", "f-a2-0")}
    assert {x.face_id for x in held.nonhuman.collect()} == {"f-doll1-0", "f-doll2-0"}
    # Two unplaced faces and two albums are four pairs; each of eight faces is labelled, the dolls are counted.
    assert calls("pair") == 4 == held.scores.count() and calls("label") == 8 == held.verdicts.count() and calls("count") == 2
    # The same again asks nothing and says the same; nothing stays of an event whose photos go.
    again = take_scene(spark, state, classify("j2", *images), judges=judges)["j2"]
    assert albums(again) == albums(r) and [len(u.suggestions) for u in again.uncertain] == [1] and calls("pair") == 4 and calls("label") == 8
    take_scene(spark, state, delete("j3", *images), judges=judges)
    assert all(x.count() == 0 for x in vars(worker.stored(spark, state)).values())


def test_judges_that_fail_change_nothing(spark, tmp_path):
    def fails(*_):
        raise TimeoutError

    r = take_scene(spark, f"file://{tmp_path}/state", classify("j1", "a1", "a2", "join", "torn"), judges=second.Judges(fails, fails, fails))["j1"]
    assert albums(r) == [["a1", "a2"]] and [u.image_id for u in r.uncertain] == ["join"]
    assert [(f.image_id, f.reason) for f in r.failed_images] == [("torn", "OSError: torn")]
    held = worker.stored(spark, f"file://{tmp_path}/state")
    assert held.scores.count() == held.verdicts.count() == 0


def test_ticks_are_told_beside_the_results(spark, tmp_path):
    marks, told = f"file://{tmp_path}/marks", []
    extract_ = progress.extractor(seen, KINDS, marks)
    images = [f"n{i}" for i in range(7)]
    asked = spark.createDataFrame([("e", i, i, "j", 7) for i in images], "event_id string, image_id string, s3_key string, job_id string, total long")
    first = asked.where("image_id < 'n4'")
    assert extract_(first).where("error IS NULL AND v IS NULL").count() == 4
    sink = lambda batch: told.extend(tuple(r) for r in batch.collect())
    progress.start(spark, marks, sink, f"file://{tmp_path}/check").awaitTermination()
    assert sorted(told) == [("j", 0, 7), ("j", 3, 7)]
    extract_(asked).count()  # a task that is run again marks its images again
    progress.start(spark, marks, sink, f"file://{tmp_path}/check").awaitTermination()
    assert sorted(told) == [("j", 0, 7), ("j", 3, 7), ("j", 6, 7), ("j", 7, 7)]

    def broken(batch):
        raise OSError("no queue")

    progress.start(spark, marks, broken, f"file://{tmp_path}/check2").awaitTermination()
    # A folder that can't be written leaves the faces alone.
    (tmp_path / "file").touch()
    assert progress.extractor(seen, KINDS, f"file://{tmp_path}/file/marks")(first).count() == 4
