"""Exact set-similarity join of word shingles with set-relation skipping.

Shingles of a document are ordered by how many documents have them (rarest
first). Two sets that are similar enough share a shingle among the first
n - ceil(t n) + 1 of both, and one of a kind can't be shared. Lists of
those shingles are read in blocks by size and position, and a pair of blocks that no
pair can satisfy is skipped. What is left falls into groups; within a cell of a group a
set's overlaps with all others are derived from those of the most similar set
done before, by the few shingles in which the two differ. Equal sets are one
set from the start. Results are classes, so no pairs are written.

No task gathers an unbounded list or group. Lists are dealt by (shingle, size), so a
frequent shingle's list spans many tasks, in which neighbours in size are grouped without
looking at positions. A group above ``chunk`` sets is compared with one chunk of its own first; sets that
this joins need no further comparison with each other, and the others meet all of the group in cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Forest, by_name, connected_components, hot_rows, join_hot, mix64, prefix_hash, release, row_hash, span_hash, spill, tidy, unspill
from .embeddings import _tree
from .exchange import Page, exchange, pages, ranges_for

CHUNK, WIDE = 128, 1_024  # sets of a chunk in the first round and in the second
HELD = 1 << 15  # entries of a list that are looked at together
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def page_sets(page: Page, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of a page's documents, document by document and
    sorted, and how many each document has."""
    data = _LOWER[page.data]
    n, docs = len(data), len(page.ends)
    if not n:
        return np.zeros(0, U64), np.zeros(docs, np.int64)
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[page.starts] = True
    edge[n] = True
    lo = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    hi = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    prefix = prefix_hash(data)
    word = span_hash(prefix, lo, hi)
    doc = np.searchsorted(page.ends, lo, side="right")
    words = np.bincount(doc, minlength=docs)
    h = mix64(word + U64(width)) if width else word
    if len(word) >= width:
        h = word[: len(word) - width + 1]
        for k in range(1, width):
            h = mix64(h) * U64(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k]
        own = doc[: len(h)]
        same = own == doc[width - 1 :]
        h, own = mix64(h[same]), own[same]
    else:
        h, own = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((words > 0) & (words < width))
    if len(few):  # the whole sequence as one
        first = np.searchsorted(doc, few)
        short = []
        for f, m in zip(first.tolist(), words[few].tolist(), strict=True):
            x = U64(m)
            for w in word[f : f + m]:
                x = mix64(np.asarray([x * U64(0xD1342543DE82EF95) + w], dtype=U64))[0]
            short.append(x)
        h, own = np.concatenate([h, np.asarray(short, dtype=U64)]), np.concatenate([own, few])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.bincount(own[new], minlength=docs)


SETS = "rid long, doc_id long, tag long, n long, sig1 long, sig2 long, tokens array<long>, places array<int>, items binary"


def _set_rows(width: int, percent: int):
    def keys(page: Page) -> np.ndarray:
        return page_sets(page, width)[0]

    def use(page: Page, counts: np.ndarray) -> pa.Table:
        h, n = page_sets(page, width)
        end = np.cumsum(n)
        sums = [np.concatenate([[0], np.cumsum(mix64(h ^ U64(s)))]).astype(U64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        sig = [(s[end] - s[end - n]).view(np.int64) for s in sums]
        own = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, counts, own))
        place = np.arange(len(h)) - np.repeat(end - n, n)
        reach = n - (percent * n + 99) // 100 + 1
        live = (counts[order] > 1) & (place < reach[own])
        t, p, d = h[order][live].view(np.int64), place[live], own[live]
        each = np.bincount(d, minlength=len(n))
        offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
        items = [h[e - k : e].tobytes() if m else None for e, k, m in zip(end.tolist(), n.tolist(), each.tolist(), strict=True)]
        return pa.table({
            "rid": pa.array(page.rows()), "doc_id": page.ids, "tag": page.tags, "n": pa.array(n, pa.int64()), "sig1": pa.array(sig[0]), "sig2": pa.array(sig[1]),
            "tokens": pa.ListArray.from_arrays(offsets, pa.array(t)), "places": pa.ListArray.from_arrays(offsets, pa.array(p, pa.int32())), "items": pa.array(items, pa.binary()),
        })

    return keys, use


def skip_blocks(n: np.ndarray, place: np.ndarray, percent: int, block: int = 128) -> list[np.ndarray]:
    """Groups of entries of one list, sorted by size, that may hold similar pairs.

    A pair fits if its sizes are close enough and what can still follow from both
    places is enough overlap. Blocks are tested by their best places and sizes.
    """
    m = len(n)
    if m < 2:
        return []
    starts = np.arange(0, m, block)
    small, large = n[starts], n[np.minimum(starts + block, m) - 1]
    rest = n - place  # at most so many shared shingles from here on
    most = np.maximum.reduceat(rest, starts)
    found = []
    for a in range(len(starts)):
        for b in range(a, len(starts)):
            if 100 * large[a] < percent * small[b]:
                break
            need = percent * (small[a] + small[b])
            if (100 + percent) * min(most[a], most[b]) < need:
                continue
            x, y = slice(starts[a], starts[a] + block), slice(starts[b], starts[b] + block)
            fit = lambda s, o: starts_of(s)[((100 + percent) * np.minimum(rest[s], most[o]) >= percent * (n[s] + small[o])) & (100 * np.minimum(n[s], large[o]) >= percent * np.maximum(n[s], small[o]))]
            starts_of = lambda s: np.arange(s.start, min(s.stop, m))
            both = np.union1d(fit(x, b), fit(y, a)) if a != b else fit(x, a)
            if len(both) > 1:
                found.append(both)
    return found


CANDIDATES = "a long, b long, token long, first long, last long"


def _candidates(percent: int):
    """Edges between sets that may be similar, from lists sorted by token, size and place.

    A list that may go on in another task, or has more than HELD entries, links neighbours whose sizes
    fit: at least what blocks would group. The first and last list of a task also come out as a
    row (a and b the ends, token, sizes of the ends), by which parts of one list are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends: list[tuple[int, int, int, int, int]] = []
        token, size, chained, head, tail = None, 0, True, (0, 0), (0, 0)

        def chain() -> None:
            nonlocal held, tail
            doc, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:2])
            if tail[1]:
                doc, n = np.append(tail[0], doc), np.append(tail[1], n)
            cut = np.flatnonzero(100 * n[:-1] < percent * n[1:]) + 1
            for g in np.split(doc, cut):
                ids = g.tolist()
                for x in ids[1:]:
                    forest.join(ids[0], x)
            held, tail = [], (int(doc[-1]), int(n[-1]))

        def close(last: bool) -> None:
            nonlocal held, chained
            if token is None:
                return
            if chained or last:
                if held:
                    chain()
                if last or not ends:
                    ends.append((head[0], tail[0], token, head[1], tail[1]))
            elif size > 1:
                doc, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
                if len(doc) == 2:
                    if 100 * n[0] >= percent * n[1] and (100 + percent) * min(n[0] - place[0], n[1] - place[1]) >= percent * (n[0] + n[1]):
                        forest.join(int(doc[0]), int(doc[1]))
                else:
                    for g in skip_blocks(n, place, percent):
                        ids = doc[g].tolist()
                        for x in ids[1:]:
                            forest.join(ids[0], x)
            held, chained = [], False

        for b in batches:
            tokens, doc, n, place = (b.column(k).to_numpy() for k in range(4))
            cut = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]]) if len(tokens) else np.zeros(1, np.int64)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if token is None or tokens[lo] != token:
                    close(False)
                    token, size, head, tail = int(tokens[lo]), 0, (int(doc[lo]), int(n[lo])), (0, 0)
                held.append((doc[lo:hi], n[lo:hi], place[lo:hi].astype(np.int64)))
                size += hi - lo
                if size > HELD:
                    chained = True
                    chain()
        close(True)
        a, b2 = forest.edges()
        k = len(a)
        more = list(zip(*ends, strict=True)) or [()] * 5
        cols = [[*a, *more[0]], [*b2, *more[1]], *([*[None] * k, *more[c]] for c in (2, 3, 4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "token", "first", "last"])

    return run


def candidate_edges(spark: SparkSession, lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges whose components hold every pair that may be similar; lists: token, rid, n, place."""
    order = ["token", "n", "place", "rid"]
    found = spill(spark, lists.select("token", "rid", "n", "place").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_candidates(percent)), CANDIDATES))
    before = Window.partitionBy("token").orderBy("first", "a")  # at most two rows a task
    parts = found.where("token is not null").withColumn("prior", F.lag("b").over(before)).withColumn("size", F.lag("last").over(before))
    out = found.where("token is null").select("a", "b").union(parts.where(100 * F.col("size") >= percent * F.col("first")).select("prior", "a"))
    out._sextant_path = found._sextant_path
    return out


def group_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of all similar pairs of a group; with ``side``, only of pairs across sides."""
    m = len(sets)
    n = np.asarray([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        o = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = 100 * o >= percent * (int(n.sum()) - o) and (side is None or side[0] != side[1])
        return (np.asarray([0]), np.asarray([1])) if hit else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(np.concatenate(sets), kind="stable")
    flat = np.concatenate(sets)[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    ident = np.empty(len(flat), np.int64)
    ident[order] = np.cumsum(new) - 1
    member = owner[order]  # the sets that have each item, item by item
    at = np.append(np.flatnonzero(new), len(flat))
    size = np.diff(at)
    end = np.cumsum(n)
    mine = [x[size[x] > 1] for x in (ident[e - k : e] for e, k in zip(end.tolist(), n.tolist(), strict=True))]
    known = np.zeros((m, m), np.int32)
    best, base = np.zeros(m, np.int64), np.full(m, -1)
    mark = np.zeros(len(size), bool)

    def tally(items: np.ndarray) -> np.ndarray:
        k = size[items]
        if not len(items):
            return np.zeros(m, np.int64)
        stop = np.cumsum(k)
        return np.bincount(member[np.repeat(at[items] - (stop - k), k) + np.arange(stop[-1])], minlength=m)

    out_i, out_j = [], []
    for x in range(m):
        own, y = mine[x], base[x]
        if y >= 0:
            mark[own] = True
            gone = mine[y][~mark[mine[y]]]
            mark[own] = False
            mark[mine[y]] = True
            come = own[~mark[own]]
            mark[mine[y]] = False
        if y >= 0 and size[gone].sum() + size[come].sum() < size[own].sum():
            c = known[y] - tally(gone) + tally(come)
        else:
            c = tally(own)
        known[x] = c
        better = c > best
        best[better], base[better] = c[better], x
        j = np.flatnonzero(100 * c[x + 1 :] >= percent * (n[x] + n[x + 1 :] - c[x + 1 :])) + x + 1
        if side is not None:
            j = j[side[j] != side[x]]
        out_i.append(np.full(len(j), x))
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _verify(percent: int):
    """A spanning forest of the links of each cell (rows sorted by cell)."""

    def links(rows: list[pa.RecordBatch], forest: Forest) -> None:
        t = pa.Table.from_batches(rows)
        ids = t.column("rid").to_numpy()
        if len(ids) < 2:
            return
        side = t.column("mine").to_numpy()
        across = len(np.unique(side)) > 1
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("items").to_pylist()]
        i, j = group_links(sets, percent, side if across else None)
        for a, b in zip(*_tree(i, j, len(ids)), strict=True):
            forest.join(int(ids[a]), int(ids[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[pa.RecordBatch] = []
        for b in batches:
            cell = b.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and held[0].column(0)[0].as_py() != cell[lo]:
                    links(held, forest)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            links(held, forest)
        a, b2 = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b2, pa.int64())], ["a", "b"])

    return run


def _verified(spark: SparkSession, cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each cell; cells: rid, mine, cell (pairs of one mine are left out where a cell has several)."""
    full = cells.join(sets.select("rid", "n", "items"), "rid").select("cell", "rid", "mine", "n", "items")
    return spill(spark, full.repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(tidy(_verify(percent)), "a long, b long"))


def _dealt(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(5)), parts).cast("int")


def similar_sets(spark: SparkSession, sets: DataFrame, groups: DataFrame, *, percent: int, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """(a, b) links that connect whatever is similar within the groups (node, root); sets: rid, n, items.

    First every chunk of a group with itself and the group's first chunk. Then, where that left a group in several
    components, all sets outside its largest component with each other and with that component.
    """
    ids = groups.select(F.col("node").alias("rid"), "root").union(groups.select("root", "root").distinct())
    sizes = groups.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    limit = hot_rows(ids.count())
    members = spill(spark, join_hot(ids, sizes, ["root"], F.col("size") > limit).withColumn("parts", F.ceil(F.col("size") / F.lit(chunk)).cast("int")))
    dealt = members.withColumn("mine", _dealt("rid", F.col("parts")))
    meets = F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))
    cells = dealt.select("rid", F.lit(0).alias("mine"), F.explode(meets).alias("part"), "root").select("rid", "mine", F.xxhash64("root", "part").alias("cell"))
    first = _verified(spark, cells, sets, percent)
    large = members.where("parts > 1")
    if large.isEmpty():
        unspill(members)
        return first
    roots = connected_components(spark, first)
    named = spill(spark, large.join(roots, F.col("rid") == F.col("node"), "left").select("rid", large["root"].alias("grp"), F.coalesce(roots["root"], F.col("rid")).alias("comp")))
    unspill(members, roots)
    each = named.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("grp").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"))
    open_groups = total.where("top.n < size").select("grp", F.col("top.comp").alias("main"), F.ceil(F.col("top.n") / F.lit(wide)).cast("int").alias("inner"), F.ceil((F.col("size") - F.col("top.n")) / F.lit(wide)).cast("int").alias("outer"), F.col("size"))
    todo = spill(spark, join_hot(named, open_groups, ["grp"], F.col("size") > limit))
    unspill(named)
    if todo.isEmpty():
        unspill(todo)
        return first
    outside, inside = todo.where("comp <> main").withColumn("mine", _dealt("rid", F.col("outer"))), todo.where("comp = main").withColumn("mine", _dealt("rid", F.col("inner")))
    pair = lambda kind, x, y: F.xxhash64("grp", F.lit(kind), x, y).alias("cell")
    among = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).select("rid", "mine", pair(0, F.least("mine", "other"), F.greatest("mine", "other")))
    across = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("inner") - 1))).select("rid", F.lit(-1).alias("mine"), pair(1, F.col("mine"), F.col("other")))
    back = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).select("rid", F.lit(-2).alias("mine"), pair(1, F.col("other"), F.col("mine")))
    second = _verified(spark, among.union(across).union(back), sets, percent)
    unspill(todo)
    return first.union(second)


def jaccard_rows(spark: SparkSession, docs: DataFrame, *, width: int, percent: int, unite: bool, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """rid, doc_id, tag, n, root, least of every row of ``docs`` (doc_id, text, tag).

    ``root`` names the class of a row with words (null else), ``least`` is its smallest doc_id. With ``unite`` the
    texts of one doc_id are one class.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), "tag")
    stored = pages(spark, rows)
    keys, use = _set_rows(width, percent)
    sets = spill(spark, exchange(stored, keys, use, SETS, ranges=ranges_for(spark, stored), exact=False))
    unspill(stored)
    release(spark)
    named = sets.where("n > 0")
    reps = spill(spark, named.groupBy("sig1", "sig2", "n").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    one = spill(spark, sets.where("items is not null").join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "tokens", "places", "items"))
    hot = F.col("copies") > hot_rows(sets.count())
    mine = spill(spark, join_hot(named.select("rid", "doc_id", "tag", "sig1", "sig2", "n"), reps.select("sig1", "sig2", "n", "rep", "copies"), ["sig1", "sig2", "n"], hot).select("rid", "doc_id", "tag", "n", "rep"))
    empty = spill(spark, sets.where("n = 0").select("rid", "doc_id", "tag", "n"))
    unspill(sets)
    lists = one.select("rid", "n", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "rid", "n", F.col("x.places").alias("place"))
    edges = candidate_edges(spark, lists, percent)
    groups = connected_components(spark, edges)
    unspill(edges)
    links = similar_sets(spark, one, groups, percent=percent, chunk=chunk, wide=wide)
    if unite:
        several = mine.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
        links = links.union(mine.join(several, "doc_id").select("rep", "lo"))
    roots = connected_components(spark, links)
    unspill(one, groups)
    known = reps.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "least", "copies", F.coalesce("root", "rep").alias("root"))
    smallest = known.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("sets"))
    classes = spill(spark, join_hot(known.drop("least"), smallest, ["root"], F.col("sets") > hot_rows(reps.count())).select("rep", "root", "least", "copies"))
    unspill(roots, reps)
    out = join_hot(mine, classes, ["rep"], hot).select("rid", "doc_id", "tag", "n", "root", "least")
    none = F.lit(None).cast("long")
    return out.unionByName(empty.select("rid", "doc_id", "tag", "n", none.alias("root"), none.alias("least")))


def jaccard_classes(spark: SparkSession, docs: DataFrame, *, width: int = 3, percent: int = 90, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are not read).

    Words are runs without white space, A-Z in lower case. Rows with a null or blank text have an
    empty set and link with nothing. Repeated rows come out as often as they came in; equal doc_ids are
    one node with all their texts. A row without a doc_id links as any other, and its component_id is
    the smallest doc_id of its class, null if that has none. An empty table gives no rows. Texts of any
    length are read whole; shingles are compared by 64-bit fingerprints.
    """
    found = jaccard_rows(spark, docs.select("doc_id", "text", F.lit(None).cast("long").alias("tag")), width=width, percent=percent, unite=True, chunk=chunk, wide=wide)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class of similar texts, all columns kept.

    The row with the smallest doc_id stays (rows without one come last; ties by a hash of the whole row, equal rows
    count as one). Classes are of texts: rows of one doc_id with different texts are judged apart. Rows whose text
    has no word are not similar to anything and all stay. Other columns may have any name and type; texts of any length are read
    whole, and an empty table stays empty.
    """
    mark, wordy = f"_row_{uuid.uuid4().hex}", F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    tagged = docs.withColumn(mark, row_hash(docs))
    found = jaccard_rows(spark, tagged.where(wordy).select("doc_id", "text", F.col(mark).alias("tag")), width=width, percent=percent, unite=False)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.tag").alias("tag"))
    best = spill(spark, best)
    same = tagged["doc_id"].cast("long").eqNullSafe(best["doc_id"]) & (tagged[mark] == best["tag"])
    kept = tagged.where(wordy).join(best, same, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.unionByName(tagged.where(~wordy)).select(*by_name(docs.columns))
