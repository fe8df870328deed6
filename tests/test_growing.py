"""Archives that grow, late and repeated records, one pass with several outputs."""

import json
import os

import pytest

from planewatch import constants as K
from planewatch.plans import derive
from planewatch.session import scratch_dir
from planewatch.sources import archive as A
from planewatch.sources import tail
from planewatch.streaming import ingest, ledger
from tests.test_streaming import T0, attempt, batch_documents, request, write_files

COLUMNS = ["trace_id", "duration_ns"]
SCHEMA = "document_id string, event_ts timestamp, trace_id string, duration_ns long"


def append(path, *records, end="\n"):
    with open(path, "ab") as f:
        f.write(b"\n".join(r if isinstance(r, bytes) else json.dumps(r).encode() for r in records) + end.encode())


def read_tail(spark, path, folder, range_bytes=None):
    stream = tail.tail_lines(spark, path, range_bytes)
    return sorted((r.file.rsplit("/", 1)[1], r.block, r.raw) for r in ingest.run_to_end(stream, f"{folder}/out", f"{folder}/cp").collect())


def whole_lines(path):
    """What a reader of complete lines finds: name, place, text."""
    out = []
    for file in path.iterdir():
        place = 0
        for line in file.read_bytes().split(b"\n")[:-1]:
            out.append((file.name, place, line.decode()))
            place += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [None, 1, 37])
def test_appended_lines_are_read_once(spark, tmp_path, range_bytes):
    path, folder = tmp_path / "g", scratch_dir(spark, "tail")
    path.mkdir()
    append(path / "a.ndjson", *[f"line {i} é".encode() for i in range(30)], b"", b"half")
    append(path / "_skipped", b"x")
    append(path / "b.ndjson", b"no end of line", end="")
    want = [x for x in whole_lines(path) if x[0] != "_skipped"]
    assert read_tail(spark, str(path), folder, range_bytes) == want
    append(path / "a.ndjson", b"a line begun earlier", end="")
    append(path / "c.ndjson", b"", b"new file")
    append(path / "b.ndjson", b", now there is one", b"z" * 500)
    want = [x for x in whole_lines(path) if x[0] != "_skipped"]
    assert read_tail(spark, str(path), folder, range_bytes) == want  # after a restart, from the checkpoint
    assert read_tail(spark, str(path), folder, range_bytes) == want  # nothing new


def test_replaced_files_are_read_from_the_top(spark, tmp_path):
    path, folder = tmp_path / "g", scratch_dir(spark, "tail")
    path.mkdir()
    append(path / "short", *[b"old %d" % i for i in range(20)])
    append(path / "long", b"old")
    assert len(read_tail(spark, str(path), folder)) == 21
    (path / "short").write_bytes(b"new 1\nnew 2\nne")
    (path / "long").write_bytes(b"another beginning\nand more\n")
    got = [x[2] for x in read_tail(spark, str(path), folder)]
    assert len(got) == 25 and {"new 1", "new 2", "another beginning", "and more"} < set(got)


def test_reader_alone(tmp_path):
    """Edges of ranges, long lines, files that come and go; without a session."""
    reader = tail.TailReader({"path": str(tmp_path), "rangeBytes": 3, "lineBytes": 5})
    assert reader.latestOffset() == {"files": {}} == reader.initialOffset()
    append(tmp_path / "a", b"abcdefgh", b"", b"i")
    first = reader.latestOffset()
    lines = [v.as_py() for p in reader.partitions(reader.initialOffset(), first) for b in reader.read(p) for v in b.column("value")]
    assert lines == ["abcde", "", "i"]
    assert reader.partitions(first, reader.latestOffset()) == []
    (tmp_path / "a").unlink()
    assert reader.partitions(first, reader.latestOffset()) == []
    append(tmp_path / "a", b"x")
    again = reader.latestOffset()
    assert [p.start for p in reader.partitions(first, again)] == [0]
    assert tail.TailReader({"path": str(tmp_path)}).latestOffset() == again  # another process finds the same


def test_table_of_a_growing_archive_equals_a_backfill(spark, tmp_path):
    path, folder = tmp_path / "g", scratch_dir(spark, "sink")
    path.mkdir()
    file = path / "spend.ndjson"

    def run():
        ingest.write_batches(spark, str(path), K.GATEWAY, f"{folder}/table", f"{folder}/cp", growing=True)

    append(file, attempt("a", "t1", 0), attempt("b", "t2", 1))
    run()
    append(file, attempt("a", "t9", 5), b"not json")
    run()
    append(file, attempt("c", "t3", 9))
    append(file, json.dumps(attempt("d", "t4", 9)).encode()[:30], end="")
    run()
    stored = {r.document_id: r.trace.id for r in ingest.latest_documents(spark, f"{folder}/table", K.GATEWAY).collect()}
    assert stored == {"a": "t9", "b": "t2", "c": "t3"}
    assert stored == {r.document_id: r.trace.id for r in batch_documents(spark, str(path), K.GATEWAY).collect()}
    assert ingest.quarantined(spark, f"{folder}/table").count() == 1


def test_every_record_is_accounted_for(spark, tmp_path):
    no_time = {**attempt("n", "t8", 0), "startTime": None}
    path = write_files(
        tmp_path / "g",
        [attempt("a", "t1", 0, request_duration_ms=1), attempt("a", "t1", 0, request_duration_ms=2), attempt("b", "t2", 1000), no_time, {"status": "success"}],
        [attempt("late", "t3", 100), attempt("a", "t1", 0), attempt("in time", "t4", 900), no_time, attempt("h", "t1", 5000, api_key=K.HEALTH_MARKER)],
        [attempt("b", "t2", 1000), attempt("late", "t3", 100), attempt("later", "t5", 4000), no_time, attempt("x", "t6", 4701)],
        [attempt("later", "t5", 4000), attempt("y", "t7", 90_000)],
        [attempt("x", "t6", 4701), attempt("late too", "t9", 4702)],
    )
    first = tmp_path / "g" / "part-000.ndjson"
    stamp = os.stat(first).st_mtime
    append(first, b"  ")
    os.utime(first, (stamp, stamp))
    table, folder = scratch_dir(spark, "ledger"), scratch_dir(spark, "ledger-cp")
    ledger.ingest(spark, path, K.GATEWAY, table, folder, COLUMNS, files_per_batch=1)
    names = ["lines", "blank", "parse_errors", "skipped", "stored", "late", "duplicates"]
    got = [tuple(r) for r in ledger.counts(spark, table).orderBy("batch_id").select(names).collect()]
    total = [sum(c) for c in zip(*got, strict=True)]
    assert total == [20, 1, 1, 1, 9, 3, 8]
    for lines, blank, bad, skipped, stored, late, duplicates in got:
        assert lines == blank + bad + skipped + stored + duplicates and late <= stored
    rows = {r.document_id: r for r in ledger.records(spark, table, SCHEMA).collect()}
    assert sorted(rows) == ["a", "b", "in time", "late", "late too", "later", "n", "x", "y"]
    assert rows["a"].duration_ns == 1_000_000 and rows["n"].event_date == ledger.NO_DAY
    assert sorted(r.document_id for r in ledger.late_records(spark, table, SCHEMA).collect()) == ["late", "late too", "later"] == sorted(i for i, r in rows.items() if r.late)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = write_files(tmp_path / "g", [attempt("a", "t1", 0), attempt("b", "t2", 1)], [attempt("b", "t2", 1), attempt("c", "t3", 2)])
    first, second = (spark.read.text(f"{path}/part-00{n}.ndjson").selectExpr("value AS raw", "timestamp_seconds(0) AS at", f"'{n}' AS file", "0L AS block") for n in (0, 1))
    table = scratch_dir(spark, "ledger")
    ledger.take_batch(first, 0, K.GATEWAY, table, COLUMNS)
    assert ledger.take_batch(second, 1, K.GATEWAY, table, COLUMNS)["stored"] == 1
    again = [ledger.take_batch(second, 1, K.GATEWAY, table, COLUMNS), ledger.take_batch(first, 0, K.GATEWAY, table, COLUMNS)]
    assert [a["stored"] for a in again] == [1, 2]
    assert sorted(r.document_id for r in ledger.records(spark, table, SCHEMA).collect()) == ["a", "b", "c"]


def test_rows_behind_the_watermark_are_told(spark, tmp_path):
    path = write_files(tmp_path / "g", [attempt("a", "t1", 10_000)], [attempt("b", "t2", 9990), attempt("old", "t3", 0)], [attempt("c", "t4", 10_010), attempt("older", "t5", -5)])
    stream = ingest.deduplicated(ingest.stream_events(spark, path, K.GATEWAY, files_per_batch=1)).select("document_id")
    folder, told = scratch_dir(spark, "dropped"), []
    out = ingest.run_to_end(stream, f"{folder}/out", f"{folder}/cp", told.append)
    # Spark refuses rows by the watermark before the last one: the first late row is still taken.
    assert sorted(r.document_id for r in out.collect()) == ["a", "b", "c", "old"] and told == [1]


def test_one_pass_gives_documents_quarantine_and_counters(spark, tmp_path):
    gateway = write_files(
        tmp_path / "g",
        [attempt("a", "t1", 0), {"status": "success"}, attempt("h", "t1", 1, api_key=K.HEALTH_MARKER), {"request_id": "b", "spend": "x"}],
        [attempt("a", "t9", 5), attempt("c", "t1", 7)],
    )
    content = write_files(tmp_path / "c", [request("t1", 0), request("t2", 1), {"id": ""}])
    with open(tmp_path / "c" / "part-000.ndjson", "ab") as f:
        f.write(b"\n{broken\n")
    run = derive.BackfillRun(spark, {K.GATEWAY: gateway, K.CONTENT: content}, scratch_dir(spark, "backfill"))
    plain = derive.backfill(spark, {K.GATEWAY: gateway, K.CONTENT: content})
    names = sorted(set(plain.columns) - {"ingest_seq"})
    assert sorted(map(str, run.all_documents().select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    for dataset, path in ((K.GATEWAY, gateway), (K.CONTENT, content)):
        decoded = derive.decode(A.number_lines(A.scan_lines(spark, path)), dataset)
        used = decoded.filter(~A.is_blank(decoded["raw"]))
        assert sorted((r.reason, r.excerpt) for r in run.quarantine(dataset).collect()) == sorted((r.reason, r.excerpt) for r in A.bad_lines(used, dataset).collect())
        assert run.counters(dataset).collect() == A.ingest_counters(decoded, derive.events_from_decoded(used, dataset), dataset).collect()
    assert [r.document_id for r in run.rows(K.GATEWAY, derive.HEALTH).collect()] == ["h"]
    assert run.documents(K.GATEWAY, skip_health=False).count() == 3
    with pytest.raises(ValueError):
        derive.BackfillRun(spark, {K.GATEWAY: str(tmp_path / "nowhere")}, scratch_dir(spark, "backfill"))
    assert T0 and derive.BackfillRun(spark, {K.GATEWAY: gateway, K.CONTENT: str(tmp_path / "no")}, scratch_dir(spark, "backfill")).all_documents().count() == 2


@pytest.mark.parametrize("dataset", [K.GATEWAY, K.CONTENT])
def test_each_line_is_decoded_once(spark, tmp_path, dataset):
    path = write_files(tmp_path / "g", [{}])
    lines = A.number_lines(A.scan_lines(spark, path))
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    decoded, events, every = (
        df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
        for df in (derive.decode(lines, dataset), derive.events_from_decoded(derive.decode(lines, dataset), dataset), derive.classified(lines, dataset))
    )
    assert decoded == 1 and every == events  # further ones are parts of the record, decoded in either case
