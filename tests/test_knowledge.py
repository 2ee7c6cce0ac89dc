"""Builds that grow: merges against a projection of everything, commits of several writers, streams, caches and models."""

import json
import random
import sys
import threading
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sextant.control import models as Mo
from sextant.control import systems as Y
from sextant.functions.identity import claim_id
from sextant.operators import knowledge as K
from sextant.operators import ranking as R
from sextant.sources import store as St
from sextant.sources.cache import TextCache, cache_key
from sextant.streaming.builds import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests
CLAIM = "claim_id string, kind string, subject string, predicate string, object string, object_kind string, uris array<string>, ord long, extra int"


def claims_frame(spark, rows):
    """Rows (kind, subject, predicate, object, uris, ord) as claims named by what they say."""
    df = spark.createDataFrame([("", k, s, p, o, None if o is None else "x", u, i, 1) for k, s, p, o, u, i in rows], CLAIM)
    return df.withColumn("claim_id", claim_id(F.concat_ws(":", "kind", "subject"), F.col("predicate"), F.col("object"), F.lit("p"), F.col("uris")))


def some_claims(n, seed, start=0):
    rng = random.Random(seed)
    names = [f"e{i}" for i in range(12)]
    return [(rng.choice(["person", "place"]), rng.choice(names), rng.choice(["likes", "Knows", "is in"]), rng.choice([*names, "nothing", None, None]), [f"chunk://d{rng.randrange(4)}.md#chunk-{rng.randrange(3)}"] * rng.randrange(1, 3), start + i) for i in range(n)]


def prose(prompt):
    return F.concat(F.lit("about "), F.length(prompt).cast("string"))


def page_rows(pages):
    return sorted((r.page_id, r.kind, r.subject, r.n_values, r.n_claims, r.contradictions, tuple(r.uris), tuple(map(tuple, r.evidence)), r.prose, r.markdown) for r in pages.collect())


def test_merges_equal_a_rebuild(spark, tmp_path):
    store = St.BuildStore(spark, str(tmp_path / "store"), buckets=4)
    aliases = spark.createDataFrame([("KNOWS", "is acquainted with")], "alias string, canonical string")
    batches = [some_claims(40, 1), some_claims(1, 3, 50), some_claims(30, 4, 60)]
    done, builds = [], []
    for rows in batches:
        df = claims_frame(spark, rows)
        builds.append(K.merge_claims(store, df, aliases=aliases, generate=prose, embed=Y.mock_embed))
        done.append(df.withColumn("ord", F.struct(F.lit(len(done)).cast("long").alias("seq"), F.col("ord").alias("at"))))
        whole = done[0]
        for x in done[1:]:
            whole = whole.unionByName(x)
        want = K.project(R.top(whole.withColumn("qid", F.col("claim_id")), 1, F.col("ord")), aliases=aliases, generate=prose)
        got = K.pages_at(store, builds[-1])
        assert page_rows(got) == page_rows(want)
        texts = {r.page_id: r.digest for r in K.indexed_text(want, 1, True).collect()}
        assert {r.page_id: r.digest for r in store.latest(builds[-1], "vectors", K.SCHEMAS["vectors"]).collect()} == texts
    assert [b.version for b in builds] == [0, 1, 2] and [b.build_id for b in store.chain()] == [b.build_id for b in builds]
    assert K.merge_claims(store, claims_frame(spark, batches[0])) == store.head() == builds[-1]
    assert K.claims_at(store, builds[-1]).count() == whole.select("claim_id").distinct().count()
    assert page_rows(K.pages_at(store, store.find(builds[0].build_id))) == page_rows(K.project(done[0], aliases=aliases, generate=prose))  # an old build reads as it was
    before, index = K.pages_at(store, store.head()), K.page_index(store, store.head())
    rows = page_rows(before)
    again = store.compact()
    assert again.build_id == builds[-1].build_id and all(len(s) == 1 for s in again.segments.values())
    assert page_rows(K.pages_at(store, again)) == rows == page_rows(before) and store.compact() == again
    assert K.page_index(store, again).count() == index.count()
    assert store.vacuum(older_than_s=0) == 0 and store.vacuum(older_than_s=0, keep=1) > 0
    assert page_rows(K.pages_at(store, store.head())) == rows and store.versions() == [3]


class Logged:
    """An embedder that writes down what it is asked."""

    dim = 3

    def __init__(self, path):
        self.path = path
        self.note("made")

    def note(self, line):
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")

    def embed_batch(self, texts):
        self.note(len(texts))
        return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    def generate_batch(self, prompts):
        self.note(len(prompts))
        return [(f"said {p}", len(p)) for p in prompts]

    def score_batch(self, pairs):
        return [float(len(t) - len(q)) for q, t in pairs]

    def query(self, text, k):
        self.note(text)
        return [(f"{text}-{i}", 1.0 / (i + 1)) for i in (0, 0, 1, 2)]


def log_of(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_one_claim_embeds_one_page(spark, tmp_path):
    log, store = tmp_path / "log", St.BuildStore(spark, str(tmp_path / "store"), buckets=4)
    embed = Mo.embedder(lambda: Logged(str(log)))
    K.merge_claims(store, claims_frame(spark, [("a", f"s{i}", "p", f"o{i}", ["chunk://d#1"], i) for i in range(9)]), embed=embed)
    asked = sum(x for x in log_of(log) if x != "made")
    K.merge_claims(store, claims_frame(spark, [("a", "s3", "p", "another", ["chunk://d#2"], 1)]), embed=embed)
    assert (asked, sum(x for x in log_of(log) if x != "made")) == (9, 10)
    K.merge_claims(store, claims_frame(spark, [("a", "o5", "p", None, ["chunk://d#2"], 1)]), embed=embed)  # a new page, and the one that names it
    assert sum(x for x in log_of(log) if x != "made") == 12
    plan = store.latest(store.head(), "values", K.SCHEMAS["values"], buckets=[2])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    only = St.BuildStore(spark, str(tmp_path / "later"), buckets=2)
    K.merge_claims(only, claims_frame(spark, some_claims(20, 5)))
    assert K.page_index(only, only.head()).isEmpty()
    assert K.index_pages(only, Y.mock_embed, least=2).build_id == only.chain()[0].build_id
    assert K.page_index(only, only.head()).count() == K.pages_at(only, only.head()).where("n_claims >= 2").count() > 0


def test_of_two_writers_one_wins(spark, tmp_path):
    store = St.BuildStore(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    one, two = store.stage(None), store.stage(None)
    for stage in (one, two):
        stage.write("t", rows, by=["id"], keys=["id"])
    assert store.head() is None and store.latest(None, "t", "id string").collect() == []
    first = store.commit(None, one, "b1", added=2)
    with pytest.raises(St.BuildConflict):
        store.commit(None, two, "b2")
    assert store.head() == first and len(St.names_in(spark, f"{store.root}/data/t")) == 1
    assert sorted(r.id for r in store.latest(first, "t", "id string").collect()) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        store.find("b2")
    with pytest.raises(FileNotFoundError):
        store.chain("b2")
    assert St.BuildStore(spark, str(tmp_path / "s"), buckets=9).buckets == 2
    lost = store.stage(first)
    lost.write("t", rows, by=["id"], keys=["id"])  # a writer that died
    assert store.vacuum(older_than_s=3_600) == 0 and store.vacuum(older_than_s=0) == 1 and store.head() == first


def test_a_merge_that_loses_is_made_again(spark, tmp_path, monkeypatch):
    store = St.BuildStore(spark, str(tmp_path / "s"), buckets=2)
    other, real = claims_frame(spark, [("a", "x", "p", "y", ["chunk://d#1"], 0)]), store.commit
    seen = []

    def commit(head, stage, *a, **k):
        if not seen:
            seen.append(1)
            K.merge_claims(St.BuildStore(spark, store.root), other)
        return real(head, stage, *a, **k)

    monkeypatch.setattr(store, "commit", commit)
    K.merge_claims(store, claims_frame(spark, [("a", "y", "p", None, ["chunk://d#1"], 0)]))
    assert [b.added for b in store.chain()] == [1, 1]
    pages = {r.subject: r.markdown for r in K.pages_at(store, store.head()).collect()}
    assert "## See also\n- y (a)" in pages["x"]  # the later merge saw the earlier one's page
    monkeypatch.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(St.BuildConflict("always")))
    with pytest.raises(St.BuildConflict):
        K.merge_claims(store, claims_frame(spark, [("a", "z", "p", None, ["chunk://d#1"], 0)]), tries=2)


def test_a_file_is_made_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(St.put_new(spark, str(tmp_path / "f"), str(i)))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert Counter(won) == {True: 1, False: 5} and len(list(tmp_path.iterdir())) <= 2
    p, _ = St._path(spark, str(tmp_path / "g"))
    assert St.renamed_new(spark, p, ".g1", "one") and not St.renamed_new(spark, p, ".g2", "two") and St.read_text(spark, str(tmp_path / "g")) == "one"


def test_a_stream_of_claims(spark, tmp_path):
    rows = [some_claims(12, 7), some_claims(12, 8, 100)]
    (tmp_path / "in").mkdir()
    run = lambda: ingest(spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "checkpoint"), buckets=4, embed=Y.mock_embed).awaitTermination()
    for i, part in enumerate(rows):
        claims_frame(spark, part).coalesce(1).write.json(str(tmp_path / f"made{i}"))
        next((tmp_path / f"made{i}").glob("part-*")).rename(tmp_path / "in" / f"{i}.json")
        run()
    run()
    store = St.BuildStore(spark, str(tmp_path / "store"))
    assert len(store.chain()) == 2 and store.buckets == 4
    whole = [claims_frame(spark, part).withColumn("ord", F.struct(F.lit(i).cast("long").alias("seq"), F.col("ord").alias("at"))) for i, part in enumerate(rows)]
    one = R.top(whole[0].unionByName(whole[1]).withColumn("qid", F.col("claim_id")), 1, F.col("ord"))
    assert page_rows(K.pages_at(store, store.head())) == page_rows(K.project(one))
    ingest(spark.readStream.schema(CLAIM).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "other"), embed=Y.mock_embed).awaitTermination()
    assert len(store.chain()) == 2  # all of it again, from a new checkpoint


def test_a_model_is_asked_once_a_key(spark, tmp_path):
    log = tmp_path / "log"
    cache, generate = TextCache(spark, str(tmp_path / "cache")), Mo.texts_of(Mo.generator(lambda: Logged(str(log)), batch=4))
    rows = spark.createDataFrame([(i, f"t{i % 7}", 5) for i in range(40)] + [(99, None, 5)], "id long, text string, `a.b` int")
    key = cache_key(F.lit("v"), F.lit("m"), F.lit("p"), F.coalesce("text", F.lit("")))
    got = cache.through(rows, key, F.col("text"), generate)
    assert got.columns == ["id", "text", "a.b", "value"] and {r.id: r.value for r in got.collect()} == {i: f"said t{i % 7}" for i in range(40)} | {99: "said "}
    calls = [x for x in log_of(log) if x != "made"]
    assert sum(calls) == 8 and max(calls) <= 4
    assert cache.through(rows, key, F.col("text"), generate, into="text").count() == 41 and cache.fill(rows.select(key.alias("cache_key"), F.col("text").alias("prompt")), generate) is None
    assert sum(x for x in log_of(log) if x != "made") == 8
    cache.through(rows.withColumn("text", F.lit("new")), cache_key(F.lit("v"), F.lit("m"), F.lit("p"), F.lit("new")), F.lit("new"), generate)
    assert sum(x for x in log_of(log) if x != "made") == 9 and len(St.names_in(spark, cache.root)) == 2
    twice = spark.createDataFrame([("k" * 64, "late", 9, "kk"), ("k" * 64, "early", 3, "kk")], "cache_key string, value string, at long, prefix string")
    twice.write.partitionBy("prefix").parquet(f"{cache.root}/fill=other")
    assert cache.values(["kk"]).collect()[0].value == "early" and cache.values().count() == 10


def test_models_as_columns(spark, tmp_path):
    log = tmp_path / "log"
    make = lambda: Logged(str(log))
    df = spark.createDataFrame([(i, None if i % 10 == 3 else "e" * i) for i in range(250)], "i int, t string").coalesce(1)
    got = df.select("i", Mo.embedder(make)(F.col("t")).alias("v"), Mo.scorer(make)(F.lit("ab"), F.col("t")).alias("s")).collect()
    assert all((r.v, r.s) == ((None, None) if r.i % 10 == 3 else ([float(r.i), float(r.i), 1.0], r.i - 2.0)) for r in got)
    sizes = [x for x in log_of(log) if x != "made"]
    assert max(sizes) == 100 and sum(sizes) == 225 and log_of(log).count("made") == 2  # one each of two columns

    class Wrong(Logged):
        def embed_batch(self, texts):
            return [[1.0]] * len(texts)

        def generate_batch(self, prompts):
            return []

    with pytest.raises(Exception, match="of 3 numbers"):
        df.select(Mo.embedder(lambda: Wrong(str(log)))(F.col("t"))).collect()
    with pytest.raises(Exception, match="0 answers"):
        df.select(Mo.generator(lambda: Wrong(str(log)))(F.col("t"))).collect()
    log.unlink()
    found = Mo.retrieved(spark.createDataFrame([("1", "q"), ("2", None)], "key string, query string"), make, str(tmp_path / "found"), k=2)
    for _ in range(2):
        assert [tuple(r) for r in found.orderBy("rank").collect()] == [("1", 1, "q-0", 1.0), ("1", 2, "q-1", 0.5)]
    assert log_of(log).count("q") == 1


def test_nested_claims_are_told_apart_before_their_sets_are_made(spark):
    """Equal claims meet as hashes: no aggregate, and so no sort, holds proof sets."""
    from sextant.plans import queries as P

    plan = P.acl_visible(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[claim_id" in plan and "first(proof_sets" not in plan
