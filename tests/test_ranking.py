"""Dense ranking and passage search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions.blocks import unit_rows
from sextant.operators import ranking as R


def _vectors(rng, n, dim):
    rows = [(i, int(rng.integers(0, n // 2)), [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    rows[3] = (3, 1, [0.0] * dim)
    rows[4] = (4, 2, None)
    rows[5] = (5, 3, [1.0, None, *[0.0] * (dim - 2)])
    rows[6] = (6, 3, [1.0] * (dim + 1))
    rows[7] = (7, 3, [float("inf"), *[0.0] * (dim - 1)])
    rows[8] = (8, 3, [])
    return [(i, i, v) for i, _, v in rows]


def _score(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return None
    na, nb = (math.sqrt(sum(x * x for x in v)) or 1.0 for v in (a, b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / na / nb


@pytest.mark.parametrize("late_first", [True, False])
@pytest.mark.parametrize("skip_self", [True, False])
def test_dense_rank_equals_brute_force(spark, late_first, skip_self):
    rng = np.random.default_rng(4)
    docs = _vectors(rng, 60, 5)
    asks = [(i, v) for i, _, v in docs if i % 4 == 0 or i < 9]
    frame = spark.createDataFrame(docs, "doc long, ord long, vec array<double>").repartition(5)
    got = R.dense_rank(frame, spark.createDataFrame(asks, "qid long, vec array<double>").repartition(3), 7, late_first=late_first, skip_self=skip_self).collect()
    found = {(r.qid, r.rank): (r.doc, r.score) for r in got}
    for q, v in asks:
        ranked = [(-s if (s := _score(d, v)) is not None else math.inf, -o if late_first else o, i) for i, o, d in docs if not (skip_self and i == q)]
        ranked = sorted((round(s, 6) if s != math.inf else s, o, i) for s, o, i in ranked)[:7]
        for place, (s, _, i) in enumerate(ranked, 1):
            doc, score = found.pop((q, place))
            assert (score is None) == (s == math.inf) and (score is None or score == pytest.approx(-s, abs=1.1e-6))
            assert doc == i
    assert not found


def test_dense_rank_takes_null_names_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", 0, [1.0, 0.0]), (None, 1, [1.0, 1.0])], "doc string, ord long, vec array<float>")
    asks = spark.createDataFrame([("a", [1.0, 0.0]), (None, [0.0, 1.0])], "qid string, vec array<float>")
    got = {(r.qid, r.doc): r.score for r in R.dense_rank(docs, asks, 2).collect()}
    assert got == {("a", "a"): 1.0, ("a", None): 0.707107, (None, None): 0.707107, (None, "a"): 0.0}
    assert R.dense_rank(docs, asks, 2, skip_self=True).count() == 0
    assert R.dense_rank(docs.limit(0), asks).count() == 0 and R.dense_rank(docs, asks.limit(0)).count() == 0


def test_dense_rank_keeps_equal_rows_of_a_huge_tie(spark):
    docs = spark.range(9_000).selectExpr("id doc", "id ord", "array(1D, 2D) vec")
    got = R.dense_rank(docs, spark.createDataFrame([(1, [2.0, 4.0])], "qid long, vec array<double>"), 4).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in got] == [(x, 1.0) for x in (8_999, 8_998, 8_997, 8_996)]


def test_unit_rows_of_a_slice():
    import pyarrow as pa

    m, n = unit_rows(pa.array([[9.0], [3.0, 4.0], None, [0.0, 0.0], [float("nan")]], pa.list_(pa.float64()))[1:])
    assert n.tolist() == [2, -1, 2, -1] and m.tolist() == [[0.6, 0.8], [0, 0], [0, 0], [0, 0]]


def test_holding_equals_containment(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "be", "gamma", "de", "eps", "zeta"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 25)))) for _ in range(80)] + ["", None]
    passages = []
    for n in range(1, 9):
        for _ in range(6):
            t = texts[int(rng.integers(0, 80))]
            own = t.split()
            if len(own) >= n:
                at = int(rng.integers(0, len(own) - n + 1))
                p = " ".join(own[at : at + n])
                passages += [p, p[1:], p[:-1]]  # the outer words may be cut
    passages += ["", "alpha, be gamma", "  "]
    asked = list(enumerate(passages))
    got = R.holding(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), spark.createDataFrame(asked, "qid long, passage string"))
    want = sorted((q, d) for q, p in asked for d, t in enumerate(texts) if t is not None and p in t)
    assert sorted((r.qid, r.doc) for r in got.collect()) == want


def test_hits_of_a_group_equal_the_whole_ranking(spark):
    """With the ranks among all documents, whether a sample settles a query or a floor finds it; most pairs are never scored."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(60, 0, -1) / 1830)) for _ in range(600)] + ["", None]
    docs = spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(texts)], "doc string, ord long, text string").repartition(5)
    asks = [(i, texts[i] if i % 3 else " ".join(rng.choice(words, 4)) if i % 2 else "none") for i in range(0, 600, 2)]
    queries = spark.createDataFrame(asks, "qid long, query string")
    groups, group = F.array(F.floor(F.col("ord") / 5), F.floor(F.col("ord") / 5) - 1), F.floor(F.col("qid") / 5)
    for late in (True, False):
        every = R.bm25_hits(docs, queries, 7, late_first=late)
        want = sorted((r.qid, r.rank, r.doc, r.score) for r in every.where(F.array_contains(groups, group)).collect())
        got = R.bm25_hits_of_group(docs, queries, 7, groups=groups, group=group, late_first=late, sample=50, bucket=40).collect()
        assert len(want) > 100 and sorted((r.qid, r.rank, r.doc, r.score) for r in got if r.rank) == want
        assert {r.qid for r in got} == {r.qid for r in every.select("qid").distinct().collect()}


def test_hits_of_a_group_are_looked_for_once(spark):
    """A plan that uses them several times reads them, and doesn't search again."""
    docs = spark.createDataFrame([("d0", 0, "a b"), ("d1", 1, "b c")], "doc string, ord long, text string")
    queries = spark.createDataFrame([(0, "a"), (1, "c b")], "qid long, query string")
    hits = R.bm25_hits_of_group(docs, queries, 2, groups=F.array("ord"), group=F.col("qid"))
    assert "CoGroups" not in hits._jdf.queryExecution().toString()
    assert sorted((r.qid, r.doc, r.rank) for r in hits.collect()) == [(0, "d0", 1), (1, "d1", 1)]


def _shuffled(spark):
    """Rows that all stages so far have written for others to read."""
    empty = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_hits_of_a_group_send_no_row_for_each_shard(spark, monkeypatch):
    """Queries meet all shards of the documents, but aren't written again for each of them; with the same hits in one round or two."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 12)) for _ in range(200)]
    docs = spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(texts)], "doc string, ord long, text string").cache()
    queries = spark.createDataFrame(list(enumerate(texts)), "qid long, query string").cache()
    count, rows = {}, {}
    for size in (1 << 20, 1 << 11):  # one shard a sort of texts, or more
        for early in (1, 3) if size < 1 << 20 else (1,):
            monkeypatch.setattr(R, "SMALL", size)
            before = _shuffled(spark)
            hits = R.bm25_hits_of_group(docs, queries, 5, groups=F.array(F.floor(F.col("ord") / 4)), group=F.floor(F.col("qid") / 4), sample=20, early=early)
            rows[size, early] = sorted((r.qid, r.rank, r.doc, r.score) for r in hits.collect() if r.rank)
            count[size, early] = _shuffled(spark) - before
    every = R.bm25_hits(docs, queries, 5).where(F.floor(F.col("ord") / 4) == F.floor(F.col("qid") / 4)).collect()
    assert rows[1 << 20, 1] == rows[1 << 11, 1] == rows[1 << 11, 3] == sorted((r.qid, r.rank, r.doc, r.score) for r in every)
    assert count[1 << 20, 1] > 200 and count[1 << 11, 1] < 1.5 * count[1 << 20, 1]


def test_a_frame_written_leaves_no_shuffle_behind(spark, tmp_path):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, name = files.getAllFiles().size(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    got = R._written(spark.range(1_000).repartition(3, "id").withColumn("part", F.col("id") % 2), str(tmp_path / "x"), "part")
    assert files.getAllFiles().size() <= before and spark.conf.get(name, None) == was
    assert sorted(r.id for r in got.where("part = 1").collect()) == list(range(1, 1_000, 2))


def test_documents_that_tie_and_have_no_order_have_a_rank_each(spark):
    docs = spark.createDataFrame([("a", 0, "x y"), ("b", 1, "x y"), ("b", 1, "x y"), ("c", 2, "x y"), ("d", None, "x y")], "doc string, ord long, text string")
    queries = spark.createDataFrame([(0, "x")], "qid long, query string")
    for late, want in ((True, [("c", 1), ("b", 2), ("b", 3), ("a", 4)]), (False, [("d", 1), ("a", 2), ("b", 3), ("b", 4)])):
        hits = R.bm25_hits_of_group(docs, queries, 4, groups=F.array(F.lit(0)), group=F.col("qid"), late_first=late)
        assert sorted(((r.doc, r["rank"]) for r in hits.collect()), key=lambda x: x[1]) == want


def test_floors_leave_out_what_cannot_reach_them():
    import pyarrow as pa

    from sextant.functions.blocks import TokenIndex

    index = TokenIndex(pa.array(["a b b", "a c", "c c d", ""]))
    worth = R._worth(index, 2.0)
    asked = R._asked(index, pa.array([["a", "b"], ["a", "d", "zz"], ["c"], ["zz"]]), pa.array([[1.0, 3.0], [1.0, 3.0, 9.0], [2.0], [5.0]]))
    best = {q: s.max() for q, _, s in R._scored(index, worth, asked, range(4))}
    assert set(best) == {0, 1, 2}
    assert set(R._may_reach(index, worth, asked, np.array([best[0], best[1], best[2], 0.1]) - R.SLACK)) == {0, 1, 2}
    assert list(R._may_reach(index, worth, asked, np.array([best[0] + 1.0, best[1] + 1.0, best[2] + 1.0, 0.1]))) == []


def test_texts_that_reach_a_floor_are_those_of_the_whole_scoring():
    """With the same scores to the last bit, though the lists of common terms are left out and queries are taken some at a time."""
    import pyarrow as pa

    from sextant.functions.blocks import TokenIndex

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=np.arange(400, 0, -1) / 80_200)) for _ in range(900)] + ["", None, "alone"]
    index = TokenIndex(pa.array(texts))
    worth = R._worth(index, 20.0)
    terms = [list(dict.fromkeys((texts[i] or "").split())) + ["unknown"] for i in range(0, 903, 3)] + [[]]
    asked = R._asked(index, pa.array(terms, pa.list_(pa.string())), pa.array([[float(x) for x in rng.random(len(t)) + 0.1] for t in terms], pa.list_(pa.float64())))
    scored = {q: (hit, s) for q, hit, s in R._scored(index, worth, asked, range(len(terms)))}
    best = np.array([scored[q][1].max() if q in scored else 1.0 for q in range(len(terms))])
    for share in (1.0, 0.5, -1.0):
        floor = best * share - R.SLACK
        want = {q: {(t, x) for t, x in zip(hit.tolist(), s.tolist(), strict=True) if x >= floor[q]} for q, (hit, s) in scored.items()}
        for cells in (1, 5_000, 1 << 20):
            got = {int(q): set(zip(hit.tolist(), s.tolist(), strict=True)) for q, hit, s in R._reaching(index, worth, asked, floor, cells)}
            assert got == {q: w for q, w in want.items() if w}
    assert len(scored) > 250


def test_blocks_come_in_small_batches(spark):
    """A batch of blocks of 4 MB is held by a worker: Spark's 64 MB of them, on every core, are not."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64MB")
    docs = spark.createDataFrame([("d", 1, "a b")], "doc string, ord long, text string")
    assert [r.doc for r in R.bm25_hits(docs, spark.createDataFrame([(1, "b")], "qid long, query string"), 3).collect()] == ["d"]
    assert spark.conf.get(name) == "4m"


def test_a_floor_of_the_best_k_keeps_them_in_long_and_short_lists():
    """Candidates are cut to those that may be among the best k; ties at the k-th, and texts of common terms alone, stay."""
    import pyarrow as pa

    from sextant.functions.blocks import TokenIndex

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3_000)]
    weight = 1 / np.arange(1, 3_001)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=weight / weight.sum())) for _ in range(1_500)] + ["w0 w1"] * 40
    index = TokenIndex(pa.array(texts))
    worth = R._worth(index, 30.0)
    terms = [list(dict.fromkeys(texts[i].split())) for i in range(0, 1_540, 7)]
    asked = R._asked(index, pa.array(terms), pa.array([[float(x) for x in rng.random(len(t)) + 0.1] for t in terms]))
    common = R._Common(index, worth)
    assert 0 < len(common.matrix) < len(index.terms)
    scored = {q: (hit, s) for q, hit, s in R._scored(index, worth, asked, range(len(terms)))}
    kth = R._kth_best(index, common, asked, 5)
    for q, (_, s) in scored.items():
        exact = np.sort(s)[-5] if len(s) >= 5 else -1.0
        assert kth[q] == -1.0 if exact == -1.0 else exact - 0.01 < kth[q] <= exact
    for share in (1.0, 0.6, 0.2):
        floor = np.array([scored[q][1].max() * share - R.SLACK for q in range(len(terms))])
        got = {int(q): set(zip(hit.tolist(), s.tolist(), strict=True)) for q, hit, s in R._reaching(index, worth, asked, floor, 5_000, k=5)}
        for q, (hit, s) in scored.items():
            least = max(floor[q], np.sort(s)[-5] if len(s) >= 5 else 0.0)
            every = set(zip(hit.tolist(), s.tolist(), strict=True))
            assert {x for x in every if x[1] >= least} <= got[q] <= {x for x in every if x[1] >= floor[q]}


def test_texts_of_one_sort_come_together():
    """Sorts by the words that texts share; empty texts, and none, are no error."""
    import pyarrow as pa

    from sextant.functions.blocks import TokenIndex

    rng = np.random.default_rng(12)
    sorts = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    texts = [" ".join(rng.choice(sorts[i % 3], 30)) for i in range(300)]
    vocabulary, centres, share = R._sorts(pa.array([*texts, "", None]))
    near = (R._shares_of_terms(TokenIndex(pa.array(texts)), vocabulary) @ centres.T).argmax(axis=1)
    assert len(centres) >= 3 and share.sum() == pytest.approx(1.0)
    assert all(len({i % 3 for i in np.flatnonzero(near == x)}) == 1 for x in set(near.tolist()))
    for few in ([], [""], [None], ["one"], ["same text"] * 5):
        _, centres, share = R._sorts(pa.array(few, pa.string()))
        assert len(centres) == len(share) <= 1


def test_common_terms_weigh_what_a_join_gives_them(spark, tmp_path):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, int(rng.integers(0, 9))))) for i in range(200)] + [(200, None)], "doc long, text string")
    asks = [(i, " ".join(rng.choice([*words, "unknown"], int(rng.integers(0, 9))))) for i in range(60)] + [(60, None), (61, "unknown"), (3, "w1 w1")]
    queries = spark.createDataFrame(asks, "qid long, query string").repartition(3)
    plain = lambda df: {r.qid: (r.avgdl, sorted(zip(r.terms, r.weights, strict=True))) for r in df.collect()}
    want = plain(R._weighed(docs, queries))
    assert len(want) > 40
    for most in (0, 1, 40, 1_000):
        assert plain(R._weighed_apart(docs, queries, 5, str(tmp_path / str(most)), most)) == want


def test_pairs_without_a_common_term_score_a_real_zero():
    """Numpy counts nothing in integers, which can't hold the mark of a text that doesn't count."""
    import pyarrow as pa

    from sextant.functions.blocks import TokenIndex

    index = TokenIndex(pa.array(["a b", "c"]))
    got = R._OfTexts(index, R._worth(index, 1.5)).scores(R._asked(index, pa.array([["z"]]), pa.array([[1.0]])), 0, np.array([0, 0]), np.array([0, 1]))
    assert got.tolist() == [0.0, 0.0] and got.dtype == float
