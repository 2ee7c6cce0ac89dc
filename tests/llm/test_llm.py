"""Operators for training text against brute force, on small tables with awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from sextant.llm import decontam, embeddings, jaccard, langid, packing, quality, suffixes, token_orc, toxicity
from sextant.llm.common import connected_components
from sextant.llm.encode import Encoder, vocabulary
from sextant.llm.token_counts import resync_count, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, length long, label int"
WORDS = [f"w{i:03d}" for i in range(400)]


def corpus():
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(WORDS, 150)) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1].replace(base[1][200:204], "edit", 1), base[2] + " tail words here", base[3][:700] + " x", "", None, "   ", "one", "one two", "One TWO", "a" * 900, base[4] + "\n" + base[5], "naïve <|endoftext|> Ünï 漢字 don't 'twas  12\t\n"]
    return [(i, t, "en", "s", 1, 7, 7, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    enc = Encoder(vocabulary(name))
    rng = np.random.default_rng(2)
    odd = ["".join(rng.choice(list("ab's t'll 12 ''-re've\n\té½ÀßA漢́ "), rng.integers(1, 30))) for _ in range(800)] + ["<|endoftext|>a", ""]
    assert [x.tolist() for x in enc.encode(odd)] == [enc.whole(t).tolist() for t in odd]
    for t in [*odd[:200], "a" * 400, "<|endoftext|>" * 40, "word " * 200]:
        assert resync_count(enc.tokenizer, t, 24, 5) == len(enc.whole(t))


def test_token_counts(docs, empty):
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, chunk_chars=64, overlap=8).collect()}
    assert got == {i: (len((t or "").encode()), len(enc.whole(t or ""))) for i, t, *_ in corpus()}
    assert token_counts(empty).collect() == []


def test_jaccard(spark, docs, empty):
    rows = corpus()
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark, docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard.jaccard_classes(spark, empty).collect() == []
    assert len(jaccard.jaccard_classes(spark, docs.union(docs)).collect()) == 2 * len(rows)


def test_group_links_in_chunks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.03], rng.integers(0, 2**60, 3).astype(np.uint64)])) for _ in range(60)]
    i, j = jaccard.group_links(sets, 90)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    text = [(k, " ".join(f"t{x}" for x in s.tolist())) for k, s in enumerate(sets)]
    df = spark.createDataFrame(text, "doc_id long, text string")
    one = sorted(map(tuple, jaccard.jaccard_classes(spark, df, percent=80).collect()))
    for chunk, wide in ((7, 5), (3, 40)):
        assert one == sorted(map(tuple, jaccard.jaccard_classes(spark, df, percent=80, chunk=chunk, wide=wide).collect()))


def test_packing(spark, docs, empty):
    rng = np.random.default_rng(4)
    for cap in (10, 64, 2048):
        counts = dict(Counter(rng.integers(1, cap + 1, 300).tolist()))
        plan = packing.plan_packing(counts, cap)
        used = Counter()
        for sizes, n in plan:
            assert sum(sizes) <= cap
            for s in sizes:
                used[s] += n
        assert used == counts
        assert sum(n for _, n in plan) <= 1.12 * sum(k * v for k, v in counts.items()) / cap + 1
    got = packing.pack_documents(spark, docs, capacity=64).collect()
    ids = {i: [*Encoder(vocabulary("word_bpe_49k.json")).whole(t or "").tolist(), 0] for i, t, *_ in corpus()}
    by: dict = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 64
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert packing.pack_documents(spark, empty).collect() == []


def test_suffixes(spark, docs, empty):
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    n = Counter(b[s : s + 40] for b in texts.values() for s in range(len(b) - 39))
    got = {r.doc_id: r for r in suffixes.removal_report(spark, docs, length=40).collect()}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 39):
            if n[b[s : s + 40]] > 1:
                gone[s : s + 40] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert suffixes.removal_report(spark, empty).collect() == []
    assert suffixes.remove_repeats(spark, docs, length=40).columns == docs.columns


def test_decontamination(spark, empty):
    rng = np.random.default_rng(5)
    items = [(k, " ".join(rng.choice(WORDS, 30))) for k in range(5)] + [(9, None), (10, "too short")]
    plain = [" ".join(rng.choice(WORDS, 200)) for _ in range(6)]
    w = items[1][1].split()
    texts = [plain[0] + " " + items[0][1].upper() + ". " + plain[1], plain[2] + " " + " ".join([*w[:28], "other", w[29]]) + " " + plain[3], " ".join([*w[:10], *rng.choice(WORDS, 10), *w[20:]]), plain[4], None, "", items[2][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), bench).collect()}
    assert got == {(0, 0), (1, 1), (6, 2)}
    assert decontam.contaminated(spark, empty, bench).collect() == []
    assert decontam.contaminated(spark, spark.createDataFrame([(0, "x")], "doc_id long, text string"), bench.limit(0)).collect() == []


def test_decontamination_of_moved_parts(spark):
    rng = np.random.default_rng(10)
    items = [(k, list(rng.permutation(WORDS)[:n])) for k, n in enumerate((40, 59, 59, 59))]
    moved = [a[k:] + a[:k] for (_, a), k in zip(items, (20, 10, 29, 49), strict=True)]
    # The straight window of item 1 is similar enough, but the one with the moved part is more so.
    a = items[1][1]
    texts = [*moved, a[:30] + a[30:55] + a[-4:][::-1], a[27:] + a[:27] + ["so"] * 2, items[2][1][30:] + items[0][1][:20]]
    docs = []
    for i, t in enumerate(texts):
        at = int(rng.integers(0, 9))
        docs.append((i, " ".join([*(f"pre{i}x{k}" for k in range(at)), *t, *(f"post{i}x{k}" for k in range(30))])))
    docs.append((len(docs), " ".join(moved[0])))  # nothing around it

    def bags(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, text in docs:
        d = bags(text.split())
        for k, w in items:
            b = Counter(bags(w))
            m = sum(b.values())
            for s in range(max(len(d) - m, 0) + 1):
                c = Counter(d[s : s + m])
                inter = (b & c).total()
                sim = inter / (m + c.total() - inter)
                if sim >= 0.8:
                    want[i, k] = max(want.get((i, k), 0), sim)
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (len(docs) - 1, 0)} <= set(want)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(spark, frame, bench).collect()}
    assert got == pytest.approx(want)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 16))
    x = np.concatenate([x, x[:20] + 0.05 * rng.standard_normal((20, 16)), x[:5]])
    rows = [(i, [float(np.float32(v)) for v in r], i % 40 % 3) for i, r in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None] * 16, 0), (104, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, df, chunk=16).collect()}
    v = np.asarray([r[1] for r in rows[:65]], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.asarray([r[2] for r in rows[:65]])
    link = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(65, dtype=bool)
    found = np.asarray([got[i].n_links for i in range(65)])
    assert (found <= link.sum(axis=1)).all() and found.sum() >= 0.9 * link.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(100, 105))
    assert embeddings.near_vectors(spark, df.limit(0)).collect() == []


def test_orc_round_trip(spark, docs, empty, tmp_path):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    token_orc.write_orc(docs, str(tmp_path / "o"))
    got = token_orc.with_crc(token_orc.read_orc(spark, str(tmp_path / "o"))).orderBy("doc_id").collect()
    at = 0
    for r, (i, t, *_) in zip(got, corpus(), strict=True):
        ids = [*enc.whole(t or "").tolist(), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    token_orc.write_orc(empty, str(tmp_path / "e"))
    assert token_orc.read_orc(spark, str(tmp_path / "e")).collect() == []


def test_classifiers(spark, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.95
    t = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.9
    langs = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (langs.lang_pred == langs.lang).mean() > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "the end of it")], "doc_id long, text string")
    m = langid.train(docs)
    assert {(r.doc_id, r.lang_pred == "und") for r in langid.predict(odd, m).collect()} == {(1, True), (2, True), (3, True), (None, False)}
    none = labels.limit(0)
    assert quality.classify_quality(odd, none).count() == 4 and toxicity.score_toxicity(odd, none).count() == 4
    assert langid.identify_languages(empty).collect() == []


def test_toxicity_folding():
    lex = toxicity.Lexicon({toxicity.fold("idiot"): 5.0, toxicity.fold("trash"): 5.0}, {toxicity.fold("digust"): 2.0}, (toxicity.fold("trash can"),), curve=(-4.0, 3.0, 1.0))
    assert all(lex.hits(t)[0] > 0 for t in ("an IDIOT!", "1d10t", "іdiоt", "$uch tr4sh", "an id!ot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "ｉｄｉｏｔ", "ídïot", "di9usting"))
    assert all(lex.hits(t)[0] == 0 for t in ("the trash can", "idiotic", "", None))


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {tuple(r) for r in connected_components(spark, e).collect()} == {(5, 1), (4, 1), (3, 1), (2, 1), (9, 8)}


def test_names_do_not_depend_on_steps(monkeypatch):
    import pyarrow as pa

    from sextant.llm.exchange import Page, page_row

    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 700, 5, 0, 450, 199, 200, 3_000, 0)]
    texts.append(texts[1][100:600] + texts[4])
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = ends - [len(t) for t in texts]
    low = suffixes.first_ranks(data, starts, ends, 200)[2]
    none = pa.nulls(len(texts), pa.int64())
    page = Page(page_row(1, none, none, ends, data.tobytes(), np.unique(low)[::2].tobytes()))
    found = []
    for step in (1, 600, 1 << 20):
        monkeypatch.setattr(suffixes, "STEP_BYTES", step)
        found.append(np.sort(suffixes._doubled(200)[0](page)).tolist())
    assert len(found[0]) > 500
    assert found[0] == found[1] == found[2]


def test_components_of_stars_and_chains(spark):
    star = [(5_000 + i, i % 40) for i in range(1_500)] + [(9_999, i) for i in range(1_200)]  # ends above the limit of a hot node
    edges = star + [(i, i + 1) for i in range(20_000, 20_060)] + star[:9] + [(3, 3)]
    up = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    got = [tuple(r) for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, top(x)) for x in up)
