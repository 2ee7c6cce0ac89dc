"""The pipeline and the SQL of llm queries, on whole small tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sextant.llm import langid, queries
from sextant.llm.encode import Encoder, vocabulary

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ", `a.b` string, _hit long, tag long, own string, `x``y` int, th map<string,int>, kept array<map<string,string>>, data struct<a:int>"
EN = "the of and to in is that it was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr seiner worden will zwischen immer millionen was".split()


def documents():
    rng = np.random.default_rng(31)
    text = lambda words, n: " ".join(f"{rng.choice(words)}{rng.choice(words)}" if rng.random() < 0.4 else str(rng.choice(words)) for _ in range(n))
    rows = [(i, text(EN if i % 3 else DE, int(rng.integers(60, 120))), "en" if i % 3 else "de") for i in range(45)]
    passage = text(EN, 60)
    rows += [
        (45, rows[1][1], "en"), (46, rows[2][1] + " end", "en"), (47, rows[2][1] + " fin", "en"), (48, rows[4][1][:200] + " " + passage, "en"), (49, passage + " " + rows[5][1][:150], "en"),
        (50, None, "en"), (51, "", "de"), (52, "12 34 !", "en"), (None, text(EN, 50), "en"), (None, text(EN, 70), "en"), (None, rows[7][1], None), (53, text(DE, 80), None),
        (54, text(EN, 40), "en"), (54, text(DE, 60), "de"), (55, rows[8][1], "en"), (55, text(EN, 90), "en"), (56, text(EN, 2_500), "en"),
    ]
    rows += [rows[10]] * 3
    bench = [text(EN, 30), text(DE, 20), rows[11][1][20:170], "short one"]
    rows += [(60, f"{text(EN, 30)} {bench[0]} {text(EN, 20)}", "en"), (61, bench[1] + " " + text(DE, 50), "de"), (None, bench[0].upper() + ". " + text(EN, 30), "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], bench


def naive(rows, bench, model):
    rows = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    sets = [set(zip(*(lower(r[1]).split()[k:] for k in range(5)), strict=False)) or {tuple(lower(r[1]).split())} for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    best = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if root[k] not in best or key < best[root[k]][0]:
            best[root[k]] = (key, r)
    rows = [r for _, r in best.values()]
    n = Counter(b[s : s + 200] for r in rows for b in [r[1].encode()] for s in range(len(b) - 199))
    kept = []
    for r in rows:
        b = r[1].encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if n[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out, at = [], 0
        while at < len(b):
            end = at
            while end < len(b) and gone[end] == gone[at]:
                end += 1
            if not gone[at]:
                out.append(b[at:end].decode("utf-8", "ignore"))
            at = end
        if "".join(out).strip():
            kept.append((r[0], "".join(out)))
    clean = []
    for i, t in kept:
        own = shingles(t)
        if not any(similar(own, shingles(x)) for x in bench):
            clean.append((i, t))
    return clean


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = "".join(c.lower() if c.isalnum() else " " for c in t).split()
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def similar(own, item):
    bag, n = Counter(item), len(item)
    for s in range(max(len(own) - n, 0) + 1 if n else 0):
        c = Counter(own[s : s + n])
        inter = (bag & c).total()
        if 5 * inter >= 4 * (n + c.total() - inter):
            return True
    return False


def test_run_equals_brute_force(spark, tmp_path):
    rows, bench = documents()
    extra = [("p", k % 3, 1, "o", 4, {"m": k % 2}, [{"n": "v"}], (1,)) for k in range(len(rows))]
    extra[-3:] = extra[-1:] * 3  # the repeated rows stay equal
    spark.createDataFrame([(*r, *e) for r, e in zip(rows, extra, strict=True)], SCHEMA + ODD).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = naive(rows, bench, langid.train(docs))
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    pieces = Counter()
    for i, t in want:
        ids = [*enc.whole(t).tolist(), 0]
        for k, lo in enumerate(range(0, len(ids), 2_048)):
            part = ids[lo : lo + 2_048]
            pieces[i, k, lo, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    assert 40 < len(want) < len(rows) - 10 and sum(i is None for i, _ in want) == 2
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2_048


def test_empty_tables_pass_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = db.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(x[c] for c in cols) for x in df.collect()) == Counter(r.fetchall())
