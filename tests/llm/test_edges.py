"""Awkward input for the corpus operators: clashing columns, repeated ids, long texts, empty tables."""

import hashlib
import hashlib
import io
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import benchmarks, bpe, licenses, lines, quality, rules, suffixes, toxicity, warc

TYPE = "doc_id long, text string"
CLASH = ["__l", "__gone", "__starts", "__d", "__t", "__bucket", "__bits", "__bit", "c0", "maybe", "starts", "d", "t", "l", "gone", "h1", "spans", "__key", "component"]


def clashing(df):
    """``df`` with a column of every name that an operator might use itself."""
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH if c not in df.columns])


def brute_lines(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        x, gone = t.split("\n"), set()
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if any(y.strip(" ") for y in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        out.append((i, "\n".join(y for k, y in enumerate(x) if k not in gone) if gone else t, len(x), len(gone)))
    return out


def test_lines_clashes_long_text_and_empty(spark):
    r = random.Random(8)
    block = "\n".join(f"line {i}" for i in range(5))
    long = "\n".join(f"{r.random()}" for _ in range(60_000))
    rows = [(1, block), (2, "top\n" + block), (3, long), (4, "x\n" + long[: len(long) // 2]), (5, "plain")]
    d = clashing(spark.createDataFrame(rows, TYPE)).withColumn("n_lines", F.lit("old"))
    got = lines.dedup_lines(d)
    assert sorted(got.columns) == sorted([*d.columns, "n_removed"])
    assert sorted((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()) == brute_lines(rows)
    assert all(x[c] == f"own {c}" for x in got.collect() for c in CLASH)
    assert lines.dedup_lines(d.limit(0)).count() == 0
    twice = spark.createDataFrame([*rows[:2], rows[1]], TYPE)
    assert [x.text for x in lines.dedup_lines(twice).orderBy("doc_id").collect()] == [block, "top", "top"]


def brute_suffixes(rows):
    """By (id, text): bytes, removed bytes, spans and digest of what is left."""
    known, first, want = sorted({(i, (t or "").encode()) for i, t in rows if i is not None}), {}, {}
    for i, b in known:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in known:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want[i, b] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(left).hexdigest())
    return want


@pytest.mark.parametrize("hot", [1, 3, 1 << 16])
def test_suffixes_hot_anchors_equal_ids_and_long_texts(spark, monkeypatch, hot):
    r = random.Random(hot)
    some = lambda n, letters="abcdefghij ": "".join(r.choice(letters) for _ in range(n))
    hub = some(40)  # one passage between ever other neighbours
    passages = [some(r.randint(60, 200)) for _ in range(6)]
    rows = [(i, some(r.randint(0, 60)) + hub + some(r.randint(0, 60), "ab\0")) for i in range(120)]
    rows += [(200 + i, some(r.randint(0, 30)) + "".join(r.sample(passages, 2)) + some(20)) for i in range(40)]
    rows += [(300 + i, "ab" * r.randint(20, 90)) for i in range(10)]
    a, b = some(120), some(120)
    rows += [(400, a), (401, a), (401, b), (402, some(150_000) + a + some(10)), (403, None), (403, ""), (None, a)]
    # long enough to be cut into pieces
    monkeypatch.setattr(suffixes, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr(suffixes, "BLOCK", 1 << 10)
    d = clashing(spark.createDataFrame(rows, TYPE)).repartition(3)
    got = suffixes.remove_repeats(d, texts=True).collect()
    want = brute_suffixes(rows)
    have = sorted(((x.doc_id, *x[1:5]) for x in got if x.doc_id is not None), key=str)
    assert have == sorted(((i, *want[i, (t or "").encode()]) for i, t in rows if i is not None), key=str)
    assert [x.n_removed for x in got if x.doc_id is None] == [0]
    assert [x.n_removed for x in got if x.doc_id == 401 and hashlib.sha256(x.kept).hexdigest() == hashlib.sha256(b.encode()).hexdigest()] == [0]
    assert suffixes.remove_repeats(d.limit(0)).count() == 0


def test_benchmarks_by_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 12, 40, 90, 400])))) for i in range(60)] + [(3, "a second text of the item"), (90, None), (91, "--"), (None, "no id here at all")]
    rows = []
    for i in range(200):
        w = [word() for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1] or ""
            own = t.split(" ")
            if len(own) > 8 and r.random() < 0.5:  # some have lost a part, more or less than allowed
                own = own[: round(len(own) * r.choice([0.7, 0.8, 0.85, 0.9]))]
            at = r.randint(0, len(w))
            w[at:at] = own
        rows.append((i, " ".join(w).upper()))
    rows += [(500, None), (501, ""), (502, " ".join(word() for _ in range(50_000)) + " " + items[5][1]), (7, "again " + items[6][1]), (7, "again " + items[6][1]), (None, items[6][1])]

    def sets(pairs):
        out = {}
        for i, t in pairs:
            w = [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
            if i is not None and w:
                out.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
        return out

    have, wanted = sets(rows), sets(items)
    want = sorted((d, i, len(s & t), len(t)) for d, s in have.items() for i, t in wanted.items() if 5 * len(s & t) >= 4 * len(t) and s & t)
    d, b = clashing(spark.createDataFrame(rows, TYPE)), clashing(spark.createDataFrame(items, "item_id long, text string"))
    for sketch in (benchmarks.SKETCH, None):
        assert sorted(tuple(x) for x in benchmarks.contained(d, b, sketch).collect()) == want and len(want) > 60
    assert benchmarks.contained(d.limit(0), b).count() == 0


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode("utf-8", "surrogatepass").lower())


def brute_chain(words, template):
    """The largest number of template words in chains of matches that can't be prolonged to the right."""
    n = [[0] * (len(template) + 1) for _ in range(len(words) + 1)]
    for i in range(len(words)):
        for j in range(len(template)):
            n[i + 1][j + 1] = n[i][j] + 1 if words[i] == template[j] else 0
    longest = [max(row) for row in n]
    found = set()
    for i in range(1, len(words) + 1):
        if longest[i] >= licenses.LEAST and (i == len(words) or longest[i + 1] != longest[i] + 1):
            found |= {(i - longest[i], j - longest[i], longest[i]) for j in range(len(template) + 1) if n[i][j] == longest[i]}
    found = sorted(found)
    best: list[int] = []
    for k, (a, b, m) in enumerate(found):
        value = m
        for (c, d, o), v in zip(found, best):  # noqa: B905
            over = max(0, c + o - a, d + o - b)
            if c < a and d < b and a - c - o <= licenses.GAP and over < m:
                value = max(value, v + m - over)
        best.append(value)
    return max(best, default=0)


def test_licenses_by_brute_force(spark):
    r = random.Random(21)
    templates = [(label, words_of(t)) for label, t in licenses.TEMPLATES] + [(label, words_of(p)) for p, label in licenses.PHRASES.items()]
    filler = ["the", "software", "of", "license", "under", "mit", "by", "nc", "cc", "granted", "zebra", "quartz", "Ünï", "2"]
    rows = []
    for i in range(120):
        w = [r.choice(filler) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            t = [x.decode() for x in r.choice(templates)[1]]
            for _ in range(r.randint(0, 4)):  # words lost, changed or put in
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 2)] = r.choice([[], ["other"], ["two", "more"]])
            at = r.randint(0, len(w))
            w[at:at] = t[r.choice([0, 0, len(t) // 4]) :]
        rows.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    rows += [(500, None), (501, ""), (502, "\ud83d\ude00 -- \n"), (3, rows[3][1]), (503, "word " * 30_000 + "under the MIT license")]
    for i, text in rows[:-1]:
        words = words_of(text)
        places = sorted((k, label) for p, label in ((words_of(p), x) for p, x in licenses.PHRASES.items()) for k in range(len(words)) if words[k : k + len(p)] == p)
        shares = [(label, brute_chain(words, t) / len(t)) for label, t in templates]
        base = {label for _, label in places}
        want = (
            i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
            ",".join(sorted(base | {x for x, s in shares if s >= licenses.COVER})), 1.0 if base else max(s for _, s in shares),
        )
        got = licenses._scanner().scan(text)
        assert (i, *got[:7]) == want
        assert all(0 <= first <= last < len(words) and share >= licenses.COVER for _, first, last, share in got[7])
    d = clashing(spark.createDataFrame(rows, TYPE))
    out = licenses.scan_licenses(d).collect()
    assert len(out) == len(rows)
    for x in out:
        text = next(t for i, t in rows if i == x.doc_id)
        assert tuple(x)[1:8] == licenses._scanner().scan(text)[:7]
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_a_longer_match_hides_no_template():
    s = licenses.Scanner([("a", "x p q r s t"), ("b", "p q r s t")], {})
    assert s.scan("x p q r s t")[5] == "a,b" and s.scan("p q r s t")[7] == [("a", 0, 4, 5 / 6), ("b", 0, 4, 1.0)]


def test_rules_by_sql_order_and_odd_rows(spark):
    r = random.Random(6)
    words = ["alpha", "beta", "GAMMA", "ÄÖ", "Ⅷ", "***", "||", "x" * 60, "12", "don't"]
    rows = [(i, r.choice([" ", "\n", " \t"]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(i, "\n".join([f"some line number {i} of the text"] * 2 + [f"line {k} of text {i} is its own" for k in range(r.randint(0, 6))])) for i in range(300, 340)]
    rows += [(500, None), (501, ""), (502, "a b c d e " * 300), (503, "Ünïcödé " * 9), (None, None)]
    d = clashing(spark.createDataFrame(rows, TYPE))
    got = rules.quality_rules(d)
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    c.register("documents", frame)
    want = c.execute(rules.ORACLE_SQL.replace("on b.doc_id = c.doc_id", "on b.doc_id is not distinct from c.doc_id").replace("on b.doc_id = p.doc_id", "on b.doc_id is not distinct from p.doc_id"))
    assert got.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {x.kept for x in got.collect()} == {True, False}
    # rules that reject more in less time come first, and the order changes nothing
    assert rules.rule_order({"a": (1, 1.0), "b": (2, 1.0), "c": (2, 0.5), "d": (0, 0.1)}) == ["c", "b", "a", "d"]
    texts = [rules.Text(t) for _, t in rows[:50]]
    assert all(rules.judge(t, [*rules.RULES]) == rules.judge(t, [*rules.RULES][::-1]) for t in texts)
    assert sorted(rules.estimated_order(d)) == sorted(rules.RULES) and rules.quality_rules(d.limit(0)).count() == 0


def test_toxicity_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels)
    n = {(r.toxic, r.predicted): r["count"] for r in got.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.99 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_folding_exceptions_and_odd_rows(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + (["scum"] if i % 4 == 0 else ["pool", "scum"] if i % 4 == 1 and i < 100 else []))) for i in range(800)]
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    odd = [(900, "plain scum$ word " + word()), (901, "you $cum there " + " ".join(word() for _ in range(27))), (902, "a pool scum of water " + word()), (903, None), (904, ""), (905, "scum " + "quiet words here " * 40_000), (906, "SCUM! " * 30), (None, "scum")]
    d = clashing(spark.createDataFrame([*rows, *odd, rows[4]], TYPE))
    got = {}
    for x in toxicity.score_toxicity(d, y).collect():
        assert got.setdefault(x.doc_id, tuple(x)) == tuple(x) and 0 <= x.score <= 1
    assert got[900][4] == 0 and got[901][3] == 1 and got[902][4] == 0 and got[903][2] == got[904][2] and got[906][3] == 1 and got[905][2] < got[901][2]
    assert got[None][1] and len(got) == len(rows) + len(odd)
    assert toxicity.score_toxicity(d.limit(0), y).count() == 0
    lexicon = toxicity.Lexicon({"scum ": 3.0}, ("pond scum",))
    assert [lexicon.features(t)[2] for t in ("pond scum", "scum pond scum", "pond scums", "sçum")] == [0, 1, 0, 0]


def test_quality_held_out_rows(spark):
    """Trained on half of the labels, judged on the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    got = quality.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    good, bad = (n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)), n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0)))
    print(n)
    assert good >= 0.95 and bad >= 0.9


def test_quality_clashes_conflicts_and_empty(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(40)), "en", f"s{i % 5}", 200) for i in range(240)]
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "good words here " * 40_000, "en", "s1", 640_000), (None, "x y z", None, "s1", 5), rows[7]]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("__quality", F.lit("old")).withColumn("score", F.lit(7))
    y = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(1, 0), (3, None), (None, 1)], "doc_id long, quality int")
    out = quality.scored(d, y)
    assert sorted(out.columns) == sorted(d.columns) and out.count() == len(rows)
    got = {x.doc_id: x for x in out.collect()}
    assert all(got[i]["__quality"].kept == (i % 3 != 0) for i in range(2, 240)) and all(x.score == 7 for x in got.values())
    assert quality.classify(d.limit(0), y).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, 200, 1 << 16])
def test_bpe_stream_in_blocks_of_any_size(monkeypatch, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK", chunk)
    t, lib = bpe.Transducer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(chunk)
    runs = ["a" * 700, "etaoin" * 150, "é" * 500, "7" * 600, " " * 900, "\n \t" * 250, "*=" * 400, "\u4e2d\u6587" * 300, "\xa0" * 600]
    texts = ["", " ", "don't I'LL we're they'v", "x'", "a  b   c", "<|endoftext|>" * 3 + " <|endof", *runs, *("a" + x + " b" for x in runs), *(" " + x + "\n" for x in runs)]
    texts += ["".join(r.choice("eta s'lr\n1!\u00e9\u4e2d") for _ in range(r.randint(0, 300))) for _ in range(40)]
    texts += ["".join(r.choice([*runs, " ", "'re", "x", "9"]) for _ in range(4)) for _ in range(10 if chunk > 2 else 2)]
    for text, parts in zip(texts, t.encode_many(texts), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:40]
    # what is held doesn't grow with the text
    s, most = bpe.Stream(t), 0
    for _ in range(300):
        s.take("ab" * 50)
        most = max(most, len(s.held) + len(s.tail))
    assert most <= 2 * t.window + 100


def test_bpe_digests_against_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    rows = [(1, "some words, don't they"), (2, None), (3, ""), (3, "again <|endoftext|>"), (4, "long words " * 30_000), (5, "\u00fc" * 80_000), (None, "x"), (1, "some words, don't they")]
    d = clashing(spark.createDataFrame(rows, TYPE)).withColumn("ids", F.lit("own"))
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digests(d).collect()), key=str) == sorted(want, key=str)
    got = bpe.bpe_encode(d, decoded=True).collect()
    assert sorted(((x.doc_id, x.n_tokens, hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest(), x.decoded_sha256) for x in got), key=str) == sorted(want, key=str)
    assert bpe.bpe_digests(d.limit(0)).count() == bpe.bpe_encode(d.limit(0), decoded=True).count() == 0


def test_warc_members_over_many_ranges_and_look_alikes(spark, tmp_path):
    r = random.Random(9)
    big = "".join(r.choice("0123456789abcdef") for _ in range(3_000_000))  # does not compress below a range
    inner = warc.member("response", 77, "http://inner", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None).decode("latin-1")
    rows = [(1, "http://a", big), (2, None, big), (3, "u", "y" * (17 << 20)), (4, "u", inner), (5, "u", "WARC/1.1\r\n\r\n"), (6, "u\r\nX: y", "small"), (6, "u", "small"), (7, "u", None)]
    p = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = f"file://{tmp_path}/w"
    warc.write_warc(p, path)
    want = sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows)
    for split in (32 << 20, 200_000, 4_999):
        got = warc.read_warc(spark, path, split, payloads=split == 200_000).collect()
        assert sorted((tuple(x)[:5] for x in got), key=lambda x: x[:2]) == want
        if split == 200_000:
            assert {x.page_id: x.payload for x in got if x.page_id != 1} == {i: (h or "").encode() for i, _, h in rows if i != 1}
    assert warc.round_trip(p.limit(0)).count() == 0
    # a gzip member that looks like a record at first, and one that isn't whole, are passed over
    fakes = warc._gzip(b"WARC/1.1 but no header at all\r\n\r\nrest") + warc._gzip(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n") + b"\x1f\x8b\x08 broken" + warc._gzip(b"WARC/" + b"9" * 100_000)
    one = warc.member("response", 5, None, b"real", hashlib.sha1(b"real").hexdigest(), None)
    f = io.BytesIO(fakes + one + warc.MAGIC)
    assert [(at, b"".join(block)[-4:]) for at, _, block in warc.records(f, 0, 1 << 20)] == [(len(fakes), b"real")]
    f = io.BytesIO(one[:-20])
    with pytest.raises(Exception, match="ends within"):
        [b"".join(block) for _, _, block in warc.records(f, 0, 1 << 20)]
