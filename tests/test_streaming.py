"""The streaming sequencer and the store sink, against hand-built messages and the batch form."""

import json
import os

import pytest

from tidemark.functions.ticks import SCAN_COLUMNS
from tidemark.operators.sequencing import DEFAULT_WINDOW_NS
from tidemark.sources.store import TickStore
from tidemark.streaming.ingest import IngestConfig, StoreSink, ingest, ndjson_stream
from tidemark.streaming.sequencer import OUTPUT, Tracker

T0 = 1_609_459_200_000_000_000
MS = 1_000_000
#: Milliseconds from the first, sequence and id, in the order of arrival.
MESSAGES = [(0, 1, "t-1"), (1, 2, "t-2"), (4, 5, "t-5"), (3, 4, "t-4"), (2, 3, "t-3"), (5, 5, "t-5-dup"), (6, 6, "t-6")]


def line(ms, seq, trade_id, symbol="A"):
    return json.dumps({"type": "trade", "symbol": symbol, "exchange_ts_ns": T0 + ms * MS, "ingest_ts_ns": T0 + ms * MS + 100, "price": "2", "size": "1", "trade_id": trade_id, "sequence": seq})


def flush(symbol="A"):
    return json.dumps({"type": "flush", "symbol": symbol})


def put(folder, name, lines, at):
    p = folder / name
    p.write_text("\n".join(lines) + "\n")
    os.utime(p, (1_700_000_000 + at, 1_700_000_000 + at))


def in_order(store):
    return [r.trade_id for r in store.scan().orderBy("exchange_ts_ns", "sequence").collect()]


def row(ms, seq, trade_id):
    tick = {"kind": "trade", "symbol": "A", "exchange_ts_ns": T0 + ms * MS, "ingest_ts_ns": 0, "sequence": seq, "price_ticks": 1, "size_ticks": 1, "side": None, "trade_id": trade_id}
    return [tick[c] for c in SCAN_COLUMNS]


def test_tracker():
    t = Tracker(DEFAULT_WINDOW_NS)
    assert [t.push(row(*m)) for m in MESSAGES] == [[]] * 7
    t = Tracker(DEFAULT_WINDOW_NS, *t.state()[:4], t.state()[4])  # as after a restart
    out = t.flush()
    at = SCAN_COLUMNS.index("trade_id")
    assert [r[at] for r in out] == ["t-1", "t-2", "t-3", "t-4", "t-5", "t-5-dup", "t-6"]
    events = {r[at]: tuple(r[len(SCAN_COLUMNS) :][:4]) for r in out}
    assert events["t-5"] == (False, "gap", 3, 2) and events["t-4"][:2] == events["t-3"][:2] == (True, "out_of_order")
    assert events["t-5-dup"] == (False, None, None, None) and [r[-1] for r in out] == [*range(7)]
    t = Tracker(DEFAULT_WINDOW_NS)
    assert [len(t.push(row(*m))) for m in ((0, 1, "a"), (1, 0, "b"), (60, 2, "c"))] == [0, 0, 2]
    assert t.high_water == 2


def test_ingest_and_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = TickStore(spark, tmp_path / "store", "trades")

    def run():
        return ingest(ndjson_stream(spark, str(folder)), store, str(tmp_path / "checkpoint"), IngestConfig(max_files=1))

    put(folder, "1.ndjson", [line(*m) for m in MESSAGES[:4]], 1)
    put(folder, "2.ndjson", [line(*m) for m in MESSAGES[4:]] + [line(60, 7, "t-7")], 2)
    done = run()
    first = done.counters
    assert (done.latency_p50_ns, done.latency_p99_ns, done.symbols) == (100.0, 100.0, ["A"]) and done.started_at_ns < done.finished_at_ns
    assert in_order(store) == ["t-1", "t-2", "t-3", "t-4", "t-5", "t-5-dup", "t-6"]
    assert first == {"written": 7, "gaps": 1, "out_of_order": 2, "reordered": 2, "received": 8}
    # a restart goes on with the row that was held and reads no file again
    put(folder, "3.ndjson", [line(61, 8, "t-8"), flush(), line(0, 1, "b", "B/C"), flush("B/C")], 3)
    assert run().counters["written"] == 3
    assert in_order(store)[-2:] == ["t-7", "t-8"] and store.symbols() == ["A", "B/C"]
    assert sum(m.row_count for m in store.manifests()) == store.scan().count() == 10
    # another checkpoint is another stream, whose batches replace none of the first's
    other = ingest(ndjson_stream(spark, str(folder)), store, str(tmp_path / "other"), IngestConfig(max_files=1))
    assert other.counters["written"] == 10 and store.scan().count() == 20
    put(folder, "4.ndjson", ["{}"], 4)
    with pytest.raises(Exception, match="bad tick on line 1"):
        run()


def test_sink_writes_a_batch_once(spark, tmp_path):
    store = TickStore(spark, tmp_path, "trades")
    rows = [(*row(i, i + 1, f"t-{i}"), False, None, None, None, i) for i in range(10)]
    batch = spark.createDataFrame(rows, OUTPUT)
    for _ in range(2):
        StoreSink(store, max_rows_per_file=4)(batch, 3)
    assert store.scan().count() == 10 and store.count_files_scanned() == 3
    StoreSink(store)(batch, 4)
    StoreSink(store, stream="other")(batch, 4)
    assert store.scan().count() == 30
