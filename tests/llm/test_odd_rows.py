"""Nulls, repeats, ties, long texts and clashing columns, operator by operator, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from sextant.llm import decontam, embeddings, exchange, features, jaccard, langid, packing, quality, suffixes, token_orc, toxicity
from sextant.llm.encode import Encoder, vocabulary
from sextant.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, _id long, _hex string, _spans string, own string, rid long, tag long, page long, n long, it long, th long, h long, _salt int, _row long, key long, token long"
WORDS = [f"v{i:03d}" for i in range(300)]


def rows():
    rng = np.random.default_rng(21)
    base = [" ".join(rng.choice(WORDS, 120)) for _ in range(6)]
    long = "x" * 40_000 + " " + " ".join(rng.choice(WORDS, 12_000))
    texts = [
        (1, base[0]), (2, base[0] + " more"), (None, base[0]), (None, base[1]), (4, base[1]), (None, None), (None, base[2]), (None, base[2] + " x"),
        (6, base[3]), (6, base[4]), (8, base[4] + " y"), (7, base[3] + " z"), (9, ""), (9, None), (10, base[5]), (10, base[5]), (10, base[5]), (11, long), (2**53 + 1, long[:60_000] + " cut"),
        (12, "one"), (13, "One"), (14, " \t"), (2**60, base[5] + " big"),
    ]
    return [(i, t, "en", *([5] * 1), "a", "b", "c", *([3] * 6), 1, 2, *([3] * 4)) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r[:18] for r in rows()], SCHEMA).repartition(3)


def sets_of(text, width):
    w = (text or "").lower().split()
    return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def classes(data, width, percent, unite):
    """The smallest doc_id of each row's class, by comparing all rows."""
    sets = [sets_of(r[1], width) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            same = unite and data[a][0] is not None and data[a][0] == data[b][0]
            if sets[a] and sets[b] and (same or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    return sets, [find(x) for x in range(len(data))]


def test_jaccard_of_odd_rows(spark, odd):
    data = rows()
    sets, root = classes(data, 3, 90, True)
    least = {}
    for r, c in zip(data, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(data, sets, root, strict=True))
    assert Counter(map(tuple, jaccard.jaccard_classes(spark, odd).collect())) == want
    assert want[(None, 118, 1)] == 1 and want[(2**53 + 1, len(sets[18]), 2**53 + 1)] == 1


def test_keep_one(spark, odd):
    data = rows()
    sets, root = classes(data, 5, 80, False)
    best = {}
    for r, s, c in zip(data, sets, root, strict=True):
        if s:
            key = (r[0] is None, r[0] or 0)
            best[c] = min(best.get(c, key), key)
    got = jaccard.keep_one(spark, odd)
    assert got.columns == odd.columns
    got = got.collect()
    assert sum(not sets_of(r.text, 5) for r in got) == sum(not s for s in sets)
    kept = [r for r in got if sets_of(r.text, 5)]
    assert len(kept) == len(best)
    ids = Counter((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert ids == Counter(best.values())


def test_long_lists_are_chained(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 5)
    rng = np.random.default_rng(8)
    data = []
    for k in range(60):
        w = list(rng.choice(WORDS[:40], 30)) if k % 3 else WORDS[:30]
        w[k % 30] = f"only{k % 7}"
        data.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark, spark.createDataFrame(data, "doc_id long, text string"), width=1, percent=80, chunk=4, wide=6).collect()}
    _, root = classes(data, 1, 80, True)
    least = {c: min(i for i, x in enumerate(root) if x == c) for c in set(root)}
    assert got == {i: least[c] for i, c in enumerate(root)}


def test_counts_above_a_byte(spark):
    def use(page, counts):
        import pyarrow as pa

        return pa.table({"n": pa.array(counts, pa.int64())})

    docs = spark.createDataFrame([(i, bytes([1] * 40 + [i % 251]), None) for i in range(900)], "doc_id long, text binary, tag long").repartition(5)
    stored = exchange.pages(spark, docs, page_bytes=1_000)
    got = Counter(r.n for r in exchange.exchange(stored, lambda p: p.data.astype(np.uint64) << np.uint64(50), use, "n long", ranges=7, exact=True).collect())
    n = Counter(b for i in range(900) for b in [1] * 40 + [i % 251])
    assert got == Counter(n[b] for i in range(900) for b in [1] * 40 + [i % 251])


def test_suffixes_of_odd_rows(spark, odd):
    data = rows()
    length = 40
    n = Counter(b[s : s + length] for r in data for b in [(r[1] or "").encode()] for s in range(len(b) - length + 1))
    want = Counter()
    for r in data:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[r[0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, suffixes.removal_report(spark, odd, length=length).collect())) == want
    cut = suffixes.remove_repeats(spark, odd, length=length)
    assert cut.columns == odd.columns and cut.count() == len(data)


def test_ranks_of_equal_keys(spark):
    """Runs that tasks share get one rank, and only keys of one row go."""
    keys = [7] * 50 + list(range(100, 140)) + [200, 200, 300]
    df = spark.createDataFrame([(k, k, i, 1) for i, k in enumerate(keys)] + [(999, 999, 5, 2)], "a long, b long, page long, n long")
    got = suffixes.rerank(spark, df, "a").collect()
    n = Counter(r.a for r in got)
    assert n[7] == 50 and n[200] == 2 and n[999] == 1
    assert len({r["rank"] for r in got if r.a == 7}) == 1
    assert len({r["rank"] for r in got}) == len(n)


def test_token_counts_of_odd_rows(odd):
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    want = Counter((r[0], len((r[1] or "").encode()), len(enc.whole(r[1] or "")), len(enc.whole(r[1] or "")) > 2_048) for r in rows())
    assert Counter(map(tuple, token_counts(odd).collect())) == want


def test_packing_of_odd_rows(spark, odd):
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    got = packing.pack_documents(spark, odd).collect()
    size = Counter(len(enc.whole(r[1] or "")) + 1 for r in rows())
    assert sum(r.length for r in got) == sum(k * v for k, v in size.items())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2_048
    pieces = Counter((r.doc_id, r.piece, r.start, r.length) for r in got)
    ids = Counter(r[0] for r in rows())
    assert pieces[(10, 0, 0, got[[x.doc_id for x in got].index(10)].length)] == ids[10]


def test_sums_are_exact():
    index = packing.SumIndex([3, 5, 8, 9, 20], 32)
    left = np.ones(33, int)
    assert sorted(zip(*(x.tolist() for x in index.pairs(13)), strict=True)) == [(8, 5)]
    assert sorted(zip(*(x.tolist() for x in index.pairs(28)), strict=True)) == [(20, 8)]
    assert {tuple(r) for x in index.triples(16, left) for r in x.tolist()} == {(8, 5, 3)}
    for total in range(3, 32):
        want = {(x, y, z) for x in (3, 5, 8, 9, 20) for y in (3, 5, 8, 9, 20) for z in (3, 5, 8, 9, 20) if x >= y >= z and x + y + z == total}
        assert {tuple(r) for x in index.triples(total, left) for r in x.tolist()} == want
    # 20 + 8 + 4 fits by a pair, 16 + 16 by a single, 30 by nothing
    assert sorted(packing.plan_packing({20: 1, 8: 1, 4: 1, 16: 2, 30: 1}, 32)) == [((16, 16), 1), ((20, 8, 4), 1), ((30,), 1)]


def test_decontamination_of_odd_rows(spark, odd):
    data = rows()
    w = data[0][1].split()
    bench = spark.createDataFrame([(1, " ".join(w[10:40])), (1, " ".join(w[60:90])), (None, " ".join(w[:30])), (2, " ".join(w[5:12])), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(spark, odd, bench).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)}


def windows(text):
    w = [x for x in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_decontamination_by_all_windows(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    # Some items with single words changed, so that not all hits are verbatim.
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    for k, (i, t) in enumerate(sorted(items.items())):
        v = t.split()
        v[len(v) // 2] = "changed"
        texts[10_000 + i] = f"some words before {' '.join(v if k % 2 else v[:-2])} and some after it"
    want = {}
    bags = {i: Counter(windows(t)) for i, t in items.items()}
    for doc, t in texts.items():
        own = windows(t)
        held = set(own)
        for item, bag in bags.items():
            n = bag.total()
            if n and sum((h in held) * c for h, c in bag.items()) >= 0.8 * n - 1e-9:
                for s in range(max(len(own) - n, 0) + 1):
                    c = Counter(own[s : s + n])
                    inter = (bag & c).total()
                    if 5 * inter >= 4 * (n + c.total() - inter):
                        want[doc, item] = max(want.get((doc, item), 0), inter / (n + c.total() - inter))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(spark, frame, bench).collect()}
    assert len(want) > 5 and got == pytest.approx(want)


def test_simhash_with_wide_counters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3, -5, 7, 7, 1 << 62, -1],), ([],), ([-1],)], "hs array<long>")
    assert all(a == b for a, b in df.select(decontam.simhash(F.col("hs")), decontam.simhash(F.col("hs"), 32)).collect())
    # A count above 65,535 would run into the next 16-bit counter.
    many = spark.range(1).select(F.array_repeat(F.lit(1).cast("long"), 70_000).alias("hs"))
    assert many.select(decontam.simhash(F.col("hs"), 32)).first()[0] == 1


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_links_near_the_bound(spark, dim):
    """Recall of pairs a little above the bound, and of repeated and null ids."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((150, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((150, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.95, (150, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y])
    rows = [(i, [float(a) for a in r], 1) for i, r in enumerate(v)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    link = (v @ v.T >= 0.93) & ~np.eye(300, dtype=bool)
    found = np.asarray([got[i].n_links for i in range(300)])
    assert (found <= link.sum(axis=1)).all() and found.sum() >= 0.9 * link.sum()


def test_vectors_of_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1, 0), (5, b, 1, 0), (3, a, 1, 0), (None, a, 1, 0), (7, b, 1, 0), (7, b, 2, 0), (8, [], 1, 0), (9, [1.0], 1, 0), (1, [float("inf")] * 3, 1, 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep long")).collect())
    assert got == Counter([(5, 1, 3, False), (5, 1, 5, True), (3, 1, 3, True), (None, 0, None, True), (7, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (1, 0, 1, True)])


def test_near_vectors_in_cells(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1, 24)) + 0.05 * rng.standard_normal((120, 24))
    df = spark.createDataFrame([(i, [float(a) for a in r], 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    n = (u @ u.T >= 0.93).sum(axis=1) - 1
    for chunk in (16, 2_048):
        got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark, df, chunk=chunk).collect()}
        assert sum(got.values()) >= 0.95 * n.sum() and all(got[i] <= n[i] for i in got)


def test_orc_of_odd_rows(spark, odd, tmp_path):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    path = str(tmp_path / "o")
    token_orc.write_orc(odd, path)
    got = token_orc.with_crc(token_orc.read_orc(spark, path)).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], zlib.crc32(np.asarray([*enc.whole(r[1] or "").tolist(), 2], "<u4").tobytes())) for r in rows())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_orc_files_have_stripes_indexes_and_filters(spark, tmp_path):
    docs = spark.range(6_000).selectExpr("id * 2 as doc_id", "concat('some words of row ', id, ' ', repeat(sha2(cast(id as string), 256), 6)) as text")
    path = str(tmp_path / "o")
    token_orc.write_orc(docs.coalesce(1), path, stripe_bytes=64 << 10, index_rows=1_000)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stripes, kinds, strides = [], set(), set()
    for f in (tmp_path / "o").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        strides.add(reader.getRowIndexStride())
        rows = reader.rows()
        stripes.append(len(reader.getStripes()))
        for s in reader.getStripes():
            kinds |= {str(x.getKind()) for x in rows.readStripeFooter(s).getStreamsList()}
        rows.close()
    assert strides == {1_000} and max(stripes) > 1
    assert "ROW_INDEX" in kinds and any("BLOOM_FILTER" in k for k in kinds)
    one = token_orc.read_orc(spark, path).where("doc_id = 4000")
    assert "PushedFilters: [IsNotNull(part), IsNotNull(doc_id), EqualTo(doc_id,4000)]" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,4000)" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_votes_by_plain_cosine(spark):
    """The scores of op4 are similarity-weighted votes of the nearest labelled vectors."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    for r in docs.collect():
        c = quality.text_terms(r.text)
        if not c.any():
            assert got[r.doc_id] == pytest.approx(m.prior)
            continue
        x = np.zeros(quality.TERMS)
        for block, weight in zip(quality.BLOCKS, quality.WEIGHTS, strict=True):
            y = np.asarray([np.log(1 + 1_000 * v / max(c[block][: quality.BUCKETS].sum(), 1)) * i for v, i in zip(c[block], m.idf[block], strict=True)])
            x[block] = weight * y / max(np.sqrt((y * y).sum()), 1e-12)
        q = x @ m.basis
        q /= np.sqrt((q * q).sum())
        cosine = [float(q @ v) for v in m.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: m.neighbours]
        w = [max(cosine[k], 1e-6) ** m.sharpness for k in near]
        assert got[r.doc_id] == pytest.approx(sum(a * m.labels[k] for a, k in zip(w, near, strict=True)) / sum(w), abs=0.02)


def test_labels_of_held_out_rows_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for train, score, column, mod, rest in ((quality.train, quality.score, "quality", 5, 0), (toxicity.train, toxicity.score, "toxic", 3, 1)):
        flipped = labels.selectExpr("doc_id", f"case when pmod(crc32(cast(cast(doc_id as string) as binary)), {mod}) = {rest} then 1 - {column} else {column} end as {column}")
        a, b = ({r.doc_id: r.score for r in score(docs, train(docs, x)).collect()} for x in (labels, flipped))
        assert a == b


def test_lexicon_by_plain_search():
    """Hits of the automaton equal those of trying every term at every place."""
    rng = np.random.default_rng(4)
    parts = ["bad", "badly", "worse", "a", "xbad", "bads", "worst", "ok", "bad!", "no", "wor5e"]
    lex = toxicity.Lexicon({"bad": 1.0, "worse": 2.5}, {"wors": 0.5, "ba": 0.25}, ("worse ok", "no bad"))
    for _ in range(300):
        s = toxicity.fold(" ".join(rng.choice(parts, rng.integers(0, 9))))
        spared, found = [], {}
        for at in range(len(s)):
            if at and s[at - 1].isalpha():
                continue
            for t in lex.exceptions:
                if s.startswith(t, at) and not s[at + len(t) : at + len(t) + 1].isalpha():
                    spared.append(range(at, at + len(t)))
            for t, w in lex.words.items():
                if s.startswith(t, at) and not s[at + len(t) : at + len(t) + 1].isalpha():
                    found[at] = max(found.get(at, 0), w)
            for t, w in lex.beginnings.items():
                if s.startswith(t, at):
                    found[at] = max(found.get(at, 0), w)
        assert lex.hits(s)[0] == pytest.approx(sum(w for at, w in found.items() if not any(at in r for r in spared)))


def test_exceptions_are_learned(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        w = list(rng.choice(WORDS, 30))
        toxic = i % 4 == 0
        if toxic:
            w[3:3] = ["filth"]
        elif i % 16 == 1:
            w[3:3] = ["filth", "pit"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lex = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.fold("filth") in lex.words and toxicity.fold("filth pit") in lex.exceptions
    assert lex.score("you are filth here") > lex.score("the filth pit here")


def test_toxic_rows_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    t = toxicity.score_toxicity(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (t[t.toxic == 1].predicted).mean() >= 0.9 and (t[t.toxic == 0].predicted).mean() < 0.01


def test_many_classes(spark):
    """A column with thousands of values gives a sample of the commonest."""
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(100)] + [(1_000 + i, "x", f"odd {i}") for i in range(3_000)]
    got = features.labelled_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 40).toPandas()
    assert {"a", "b"} <= set(got.lang) and got.lang.nunique() <= features.CLASSES and got.groupby("lang").size().max() <= 40


def test_own_language_only(spark):
    """A row is learned by its own lang, not by that of another row with its doc_id."""
    one, two = "der die das und ist nicht ein " * 4, "the and of to in is not a " * 4
    base = [(i, one if i % 2 else two, "de" if i % 2 else "en") for i in range(80)]
    extra = [(i, two if i % 2 else one, None) for i in range(80)]  # other texts under the same ids
    a, b = (langid.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (base, base + extra))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf) and a.temperature == b.temperature


def test_leader_step_and_logits():
    """The fit equals naive follow-the-regularised-leader over dense weights."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append(("ab"[i % 2], at.astype(np.int64), rng.integers(1, 5, 4).astype(float)))
    df = np.bincount(np.concatenate([r[1] for r in rows]), minlength=langid.BUCKETS)
    m = langid.fit(rows, df, 30, alpha=0.3, l1=0.05, l2=0.1, epochs=2)
    order = np.random.default_rng(5)
    train = order.permutation(30)
    z, n = np.zeros((13, 2)), np.zeros((13, 2))

    def weights():
        w = np.zeros((13, 2))
        for i in range(13):
            for c in range(2):
                if abs(z[i, c]) > 0.05:
                    w[i, c] = -(z[i, c] - np.sign(z[i, c]) * 0.05) / ((1.0 + np.sqrt(n[i, c])) / 0.3 + 0.1)
        return w

    for _ in range(2):
        for r in order.permutation(train):
            lang, at, count = rows[r]
            x = np.zeros(13)
            x[at] = np.log1p(count) * (np.log(31 / (1 + df[at])) + 1)
            x /= np.linalg.norm(x)
            x[12] = 1.0
            w = weights()
            e = np.exp(x @ w - (x @ w).max())
            p = e / e.sum()
            for i in [*at.tolist(), 12]:
                for c in range(2):
                    g = (p[c] - (lang == "ab"[c])) * x[i]
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / 0.3 * w[i, c]
                    n[i, c] += g * g
    assert np.allclose(m.weights[:12], weights()[:12]) and np.allclose(m.bias, weights()[12])


@pytest.mark.parametrize("make", [lambda d: langid.identify_languages(d), lambda d: token_counts(d)])
def test_rows_come_out_as_often_as_they_came(odd, make):
    assert Counter(r.doc_id for r in make(odd).collect()) == Counter(r[0] for r in rows())


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 1), (None, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    ids = Counter(r[0] for r in rows())
    for got in (quality.classify_quality(odd, labels), toxicity.score_toxicity(odd, labels)):
        got = got.collect()
        assert Counter(r.doc_id for r in got) == ids and all(0 <= r.score <= 1 for r in got)
    empty = odd.limit(0)
    assert quality.classify_quality(empty, labels).collect() == toxicity.score_toxicity(empty, labels).collect() == []


def test_sample_is_bounded(spark):
    from sextant.llm.features import labelled_rows

    many = spark.createDataFrame([(1, "same", "en")] * 900 + [(i, f"t{i}", "de") for i in range(900)], "doc_id long, text string, lang string")
    got = Counter(r.lang for r in labelled_rows(many, "lang", 50).collect())
    assert got["de"] <= 50 and got.get("en", 0) <= 50
