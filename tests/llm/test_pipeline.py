"""The pipeline's stages, each against brute force on the rows its predecessor kept."""

import hashlib
import random

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "which river carries more water than any other one on this earth today"


def documents():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    shared = "\n".join(" ".join(word() for _ in range(6)) for _ in range(4))
    texts = []
    for i in range(240):
        lines = [" ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(8)) for _ in range(6)]
        if i % 10 == 1:
            lines[2:2] = shared.split("\n")
        if i % 40 == 2:
            lines[1] = f"so {ITEM.upper()} then"
        texts.append("\n".join(lines))
    texts += [texts[5], texts[7].rsplit(" ", 1)[0] + " changed", texts[7]]
    return [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s1", 0)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(name, rows before, rows after) of each stage."""
    at = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, *_ in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == COLUMNS
            after.write.parquet(f"{at}/{name}")
            after = spark.read.parquet(f"{at}/{name}")
        out[name] = tuple({r.doc_id: r for r in x.collect()} for x in (docs, after))
        docs = after
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()} == out["encode"][1]
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_quality(steps):
    before, after = steps["quality"]
    assert {i for i in after if i < 240} == {i for i in before if i < 240 and i % 3}


def test_line_dedup(steps):
    before, after = steps["line_dedup"]
    seen, want = set(), {}
    for i in sorted(before):
        text = before[i].text
        x, gone = (text or "").split("\n"), set()
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if any(y.strip(" ") for y in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        want[i] = "\n".join(y for k, y in enumerate(x) if k not in gone) if gone else text
    gone = {i for i, t in want.items() if t != before[i].text and not t.split()}
    assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if i not in gone}
    assert gone and before.keys() - after.keys() == gone and any(want[i] != before[i].text for i in after)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    sets, root = {i: shingles(r.text) for i, r in before.items()}, {i: i for i in before}
    for _ in before:  # labels sink to the smallest id reachable
        moved = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[b], moved = root[a], True
        if not moved:
            break
    assert set(after) == {i for i in root if root[i] == i}
    assert all(after[i] == before[i] for i in after)


def test_decontaminate(steps):
    before, after = steps["decontaminate"]
    item = shingles(ITEM)
    assert set(after) == {i for i, r in before.items() if len(item & shingles(r.text)) < 0.8 * len(item)} != set(before)


def test_encode(steps):
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import vocabulary

    before, after = steps["encode"]
    lib = Tokenizer.from_file(vocabulary())
    assert {i: r.decoded_sha256 for i, r in after.items()} == {i: hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in before.items()}
    assert {i: list(r.ids) for i, r in after.items()} == {i: lib.encode(r.text or "", add_special_tokens=False).ids for i, r in before.items()}


def test_copies_among_the_originals_leave_one_row(steps):
    """Of what brute force links on the texts that line dedup got, one keeps the shared text to the end."""
    before, after = steps["line_dedup"][0], steps["near_duplicates"][1]
    sets = {i: shingles(r.text) for i, r in before.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    whole = {i for i, r in after.items() if r.text == before[i].text}
    assert pairs and all(a not in whole or b not in whole for a, b in pairs)
    assert all(r.text is None or r.text == before[i].text or r.text.split() for i, r in after.items())


def test_empty_tables_and_odd_rows(spark, tmp_path):
    at, schema = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines int"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(1, "a b c\n" * 30_000, "en", "s", 1, "x", 1), (2, None, None, None, None, None, None), (None, "one line here", "en", "s", 13, "x", 1), (3, "same", "en", "s", 4, "x", 1), (3, "same", "en", "s", 4, "x", 1)]
    for name, own in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(own, schema)
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            if stage != "line_dedup":
                assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        out = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
        assert sorted((r.doc_id or 0) for r in out) == ([0, 1, 2, 3, 3] if own else [])


def test_batches_between_jvm_and_workers_are_bounded_in_bytes(spark):
    import pyarrow as pa

    from tidemark.llm.common import BATCH_BYTES, ship

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()
    rows = own.range(0, 6_000, 1, 1).selectExpr("repeat('x', 2000) as text")
    ship(own)
    got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 1 and sum(got) >= 12_000_000 and max(got) <= 1.25 * BATCH_BYTES
    own.conf.set(key, "4000000")  # a setting of the session's own stays
    ship(own)
    assert own.conf.get(key) == "4000000"


def test_workers_give_memory_back():
    import subprocess
    import sys

    code = """
import numpy as np, re, sys
from tidemark.llm.common import lean
held = lambda: int(re.search(r'RssAnon:\\s+(\\d+)', open('/proc/self/status').read())[1])
def run(batches):
    parts = [np.ones(1 << 12) for _ in range(4_000)]
    keep = np.ones(1 << 12)  # above them
    del parts
    yield held()
    run.keep = keep
big, = lean(run)(())
print(big, held())
"""
    big, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert big - after > 100_000
