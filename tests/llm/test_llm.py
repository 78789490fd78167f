"""The corpus operators against brute force, on small fixtures with the awkward cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import benchmarks, bpe, jaccard, licenses, lines, quality, rules, suffixes, toxicity, warc

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "A b"), (904, "a B"), (905, "x" * 70), (906, "x" * 70), (None, "x" * 70), (905, "x" * 70)]
TYPE = "doc_id long, text string"


def corpus():
    r = random.Random(5)
    rows = []
    for g in range(25):
        base = [r.choice("abcdefghijklmnop") + str(g) for _ in range(r.randint(1, 60))]
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    return rows + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), TYPE).withColumn("n", F.lit(1)).withColumn("component", F.lit("x")).repartition(3)


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()  # noqa: B905


@pytest.mark.parametrize(("k", "num"), [(4, 85), (1, 80)])
def test_jaccard(docs, k, num):
    rows = [x for x in corpus() if x[0] is not None]
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, k, num, 100).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_suffixes(docs):
    first, want = {}, {}
    rows = sorted({(i, (t or "").encode()) for i, t in corpus() if i is not None})
    for i, b in rows:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == want and any(x[1] for x in want.values())


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    t, lib = bpe.transducer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(2)
    texts = ["", " ", "a\x1cb \x85 c\xa0\xa0d  e", "<|endoftext|>x<|endoftext|>", "²½ Ⅷ x٣", "don't I'LL", "é" * 3000, "ab" * 4000, "😀 \n\n x"]
    texts += ["".join(r.choice("etaoinshr é\n'1!") for _ in range(r.randint(0, 900))) for _ in range(60)]
    for text, parts in zip(texts, t.encode_many(texts), strict=True):
        ids = np.frombuffer(b"".join(parts), "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert "".join(t.decode(iter([np.array(ids, "<u4").tobytes()]))) == text == lib.decode(ids, skip_special_tokens=False)
    with pytest.raises((ValueError, IndexError)):
        list(t.decode(iter([np.array([60_000], "<u4").tobytes()])))


def test_bpe_frames(docs):
    e = bpe.bpe_encode(docs)
    texts = {r.doc_id: r.text for r in bpe.bpe_decode(e).collect()}
    assert texts[900] == "" and texts[3] == corpus()[3][1]
    assert {r.doc_id: r.n_tokens for r in bpe.bpe_digests(docs).collect()}[900] == 0


def test_lines(spark):
    block = "one\ntwo\nthree\nfour"
    d = spark.createDataFrame([(1, block, "k"), (2, "new\n" + block + "\nend", "k"), (3, "a\nb", "k"), (4, None, "k"), (5, "", "k"), (6, "\n\n\n\n", "k"), (7, "\n\n\n\n", "k"), (None, block, "k")], "doc_id long, text string, h1 string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.h1) for r in lines.dedup_lines(d).collect()}
    assert got[None] == (block, 4, 0, "k") and got[1] == ("", 4, 4, "k") and got[2] == ("new\nend", 6, 4, "k")
    assert got[4] == (None, 0, 0, "k") and got[6][2] == got[7][2] == 0 and got[3][0] == "a\nb"


def test_benchmarks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([(1, "x y " + item.upper() + " z"), (2, "alpha beta gamma other things"), (3, None), (4, ""), (None, item)], TYPE)
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert [tuple(r) for r in benchmarks.contained(d, b).collect()] == [(1, 7, 4, 4)]
    assert benchmarks.contained(d, b.limit(0)).count() == 0


def test_rules(docs, spark):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert got[900].base_failed and not got[900].kept and got[901].n_words == 0
    t = rules.Text("a b c d e a b c d e x\nq\nq")
    assert (t.repeat_words(), t.dup_lines) == (10, 1)
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x Under the MIT License, under the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, "licensed under the GNU General Public License, version 3")], TYPE)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, "mit")
    assert got[2].labels == "apache-2" and got[2].first_word == 3 and got[3].score == 0 and got[4].labels == "gpl-3"


def test_toxicity(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + ["idiot"] * (i % 4 == 0))) for i in range(600)]
    d = spark.createDataFrame([*rows, (700, None), (701, "1D10T " + word()), (702, "plain " + word())], TYPE)
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(d, y).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i, _ in rows) and got[701].predicted == 1 and got[700].predicted == got[702].predicted == 0
    assert toxicity.score_toxicity(d, y.limit(0)).where("score > 0").count() == 0


def test_quality(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(40)), "en", f"s{i % 5}", 200) for i in range(300)] + [(999, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.classify(d, y).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(300)) and len(got) == 301
    assert quality.classify(d, y.limit(0)).where("kept").count() == 301


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(p, path)
    for split in (32 << 20, 97):
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path, split).collect()}
        assert got == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (5, "response", None), 4: (5, "response", None), 5: (0, "response", None), None: (1200, "revisit", 2)}
