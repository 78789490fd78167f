"""Corpus operators on inputs where a bounded or partial run would show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, quality


def test_co_training_sees_every_unlabelled_document(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(20)), "en", "s0" if i % 3 else "s1", 200) for i in range(9_300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    y = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    seen, found = [], quality._surest

    def watched(pool, models, used, most):
        ids = [x.doc_id for x in pool.select("doc_id").collect()]
        best = found(pool, models, used, most)
        table = pool.toPandas()
        for v, x in enumerate(quality._split(table["f"].tolist())):
            odds = models[v].odds(x)
            for label, sure in ((0, -odds), (1, odds)):
                want = sorted((-round(s, 9), i) for s, i in zip(sure, table["doc_id"], strict=True) if 1 / (1 + np.exp(-s)) >= quality.SURE and i not in used)[:most]
                at = dict(zip(table["doc_id"], sure, strict=True))
                got = [(-round(at[i], 9), i) for i, _ in best.get((v, label), ())]
                assert [s for s, _ in got] == [s for s, _ in want]
        seen.append((ids, used.copy()))
        return best

    monkeypatch.setattr(quality, "_surest", watched)
    assert quality.fit(d, y) is not None
    assert len(seen) == quality.ROUNDS and all(sorted(ids) == [*range(300, 9_300)] for ids, _ in seen)
    assert len(seen[1][1]) > 300 and min(seen[-1][1]) >= 300
    monkeypatch.undo()
    # labels of all documents leave an empty pool, and repeated ids are chosen once
    full = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(9_300)], "doc_id long, quality int")
    assert quality.fit(d, full) is not None
    two = d.where("doc_id < 600").unionByName(d.where("doc_id between 300 and 599").withColumn("source", F.lit("s2")))
    assert quality.fit(two, y) is not None


@pytest.mark.parametrize("block", [2, 512])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(8):
        for _ in range(6):
            w = [f"{x}g{g}" for x in base]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"z{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(90, rows[3][1]), (90, rows[3][1]), (91, None)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(57)} if t else set() for i, t in rows}
    want = {i: sum(1 for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_groups(d, 4, 85, 100, n_links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = {x.doc_id: x.n_links for x in got.collect()}
    assert got == want and max(want.values()) > 2
    assert any(want[i] not in (0, 1, 5) for i in want)
