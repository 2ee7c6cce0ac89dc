"""Knowledge that grows: claims merged into a store of builds, with their pages, links and page vectors kept up to date.

A merge looks at the delta and at what the delta touches, never at the whole build. The tables of a build, by what they are
bucketed and found by:

    claims    claim_id          every claim, once
    values    page              the values of page sections: what is counted and cited; changed values are written again
    links     object            values that may point at a page, so that a new page finds who names it
    subjects  subject           pages by name, so that a new value finds the page it names
    pages     page              rendered pages
    vectors   page              embedded pages, with the digest of the text that was embedded

A new claim changes its own page; a new page, or a kind that takes over a name, also changes the pages that name it, in their
references only. Those pages are rendered again, the others stay as they are; only pages with new claims are summarised again, and
only pages whose text has changed are embedded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import build_id, joined_hash, page_id
from ..functions.text import strip
from ..sources.store import Build, BuildConflict, BuildStore
from . import claims as C
from . import ranking as R

VALUE = "kind string, subject string, predicate string, object string, object_kind string"
ORD = "struct<seq:long,at:long>"
SCHEMAS = {
    "claims": f"claim_id string, {VALUE}, uris array<string>, ord {ORD}",
    "values": f"{VALUE}, first {ORD}, claims array<string>, uris array<string>",
    "links": f"{VALUE}, first {ORD}",
    "subjects": "kind string, subject string",
    "pages": f"page_id string, kind string, subject string, n_values long, n_claims long, contradictions long, uris array<string>, evidence array<struct<predicate:string,uri:string>>, first {ORD}, prose string, markdown string",
    "vectors": f"page_id string, ord {ORD}, digest string, vec array<double>",
}
KEYS = ["kind", "subject", "predicate", "object", "object_kind"]
PAGE = ["kind", "subject"]
MANY = 100_000  # claims of a delta whose ids still stand in one row


def with_prose(page: Column, kind: Column, subject: Column, prose: Column) -> Column:
    """A page's text with its summary between the title and the facts; without one as it is."""
    title = F.concat(F.lit("# "), subject, F.lit(" ("), kind, F.lit(")"))
    said = strip(F.coalesce(prose, F.lit("")))
    return F.when(said == "", page).otherwise(F.concat(title, F.lit("\n\n"), said, F.lit("\n\n## Sources"), F.substr(page, F.length(title) + 1)))


def page_evidence(sections: DataFrame) -> DataFrame:
    """(kind, subject, evidence, first): what each page cites and where, in the order of its sections, values and URIs."""
    cited = F.flatten(F.transform("values", lambda v: F.transform(v["uris"], lambda u: F.struct(F.col("predicate").alias("predicate"), u.alias("uri")))))
    each = sections.select(*PAGE, "predicate", cited.alias("cited"), F.array_min(F.transform("values", lambda v: v["first"])).alias("first"))
    order = F.array_sort(F.collect_list(F.struct("predicate", "cited")))
    return each.groupBy(*PAGE).agg(F.flatten(F.transform(order, lambda x: x["cited"])).alias("evidence"), F.min("first").alias("first"))


def merged_values(prior: DataFrame, delta: DataFrame) -> DataFrame:
    """Values of two builds' claims as one, the prior one's first; ``changed`` if the delta has it, ``fresh`` if only the delta has it."""
    both = prior.withColumn("_new", F.lit(1)).unionByName(delta.withColumn("_new", F.lit(2)))
    order = F.array_sort(F.collect_list(F.struct("_new", "claims", "uris")))
    one = both.groupBy(*KEYS).agg(F.min("first").alias("first"), order.alias("x"), F.min("_new").alias("_lo"), F.max("_new").alias("_hi"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("x", lambda x: x[c])))
    return one.select(*KEYS, "first", flat("claims").alias("claims"), flat("uris").alias("uris"), (F.col("_hi") == 2).alias("changed"), (F.col("_lo") == 2).alias("fresh"))


def named_build(parent: str | None, added: DataFrame, n: int) -> str:
    """The id of the build that ``added`` makes of its parent; more than MANY claims are named by digests of 4,096 parts of them."""
    ids = added.select("claim_id")
    if n > MANY:
        part = ids.groupBy(F.pmod(F.xxhash64("claim_id"), F.lit(4_096)).alias("p")).agg(F.array_sort(F.collect_list("claim_id")).alias("ids"))
        ids = part.select(F.concat(F.col("p").cast("string"), F.lit(":"), joined_hash(F.array_join("ids", "|"))).alias("claim_id"))
    return ids.agg(build_id(F.lit(parent).cast("string"), F.collect_list("claim_id")).alias("b")).first().b


def merge_claims(store: BuildStore, new: DataFrame, *, aliases: DataFrame | None = None, generate: Callable[[Column], Column] | None = None, mode: str = "prose", embed: Callable[[Column], Column] | None = None, least: int = 1, embed_prose: bool = True, tries: int = 5) -> Build | None:
    """Add claims (claim_id, kind, subject, predicate, object, object_kind, uris, ord) to the store's head; the build that then is head.

    Claims that are there already are left out, and without another one the head stays (None in an empty store). ``aliases`` names
    predicates, ``generate`` summarises pages (prompt column to text column), ``embed`` turns a text column into vectors of pages with
    ``least`` claims or more. A merge that loses to another writer is made again from the new head.
    """
    for left in range(tries - 1, -1, -1):
        try:
            return _merge(store, new, aliases, generate, mode, embed, least, embed_prose)
        except BuildConflict:
            if not left:
                raise


def _merge(store, new, aliases, generate, mode, embed, least, embed_prose) -> Build | None:
    head = store.head()
    stage = store.stage(head)

    def read(t: str, near: DataFrame, *columns: str, latest: bool = True) -> DataFrame:
        """The rows of a table in the buckets that ``near`` falls in."""
        if head is None:
            return store.latest(None, t, SCHEMAS[t])
        return (store.latest if latest else store.rows)(head, t, SCHEMAS[t], buckets=store.buckets_of(near, *columns))

    try:
        rows = C.last_of(new.withColumn("ord", F.struct(F.lit(stage.seq).cast("long").alias("seq"), F.col("ord").cast("long").alias("at"))))
        rows = stage.keep("rows", rows.select("claim_id", *KEYS, "uris", "ord"))
        known = read("claims", rows, "claim_id", latest=False).select("claim_id")
        added = stage.write("claims", rows.join(known, "claim_id", "left_anti"), by=["claim_id"], keys=["claim_id"])
        n = added.count()
        if not n:
            stage.drop(segments=True)
            return head

        touched = added.select(*PAGE).distinct()
        there = read("subjects", touched, "subject")
        pages_new = stage.write("subjects", touched.join(there, PAGE, "left_anti"), by=["subject"], keys=PAGE)
        before = there.groupBy("subject").agg(F.max("kind").alias("_before"))
        names = pages_new.groupBy("subject").agg(F.max("kind").alias("_kind")).join(before, "subject", "left")
        names = stage.keep("names", names.where("_before IS NULL OR _kind > _before").select(F.col("subject").alias("object")))
        linked = read("links", names, "object", latest=False).join(names, "object", "left_semi").select(*PAGE).distinct()
        affected = touched.withColumn("own", F.lit(True)).unionByName(linked.withColumn("own", F.lit(False))).groupBy(*PAGE).agg(F.max("own").alias("own"))
        affected = stage.keep("affected", affected)

        prior = read("values", affected, *PAGE).join(affected, PAGE, "left_semi")
        delta = C.page_values(C.canonical_predicates(added, aliases) if aliases is not None else added)
        now = stage.keep("now", merged_values(prior, delta))
        stage.write("values", now.where("changed").drop("changed", "fresh"), by=PAGE, keys=KEYS)
        stage.write("links", now.where("fresh AND object IS NOT NULL").select(*KEYS, "first"), by=["object"], keys=KEYS)

        objects = now.where("object IS NOT NULL").select(F.col("object").alias("subject")).distinct()
        subjects = read("subjects", objects, "subject").join(objects, "subject", "left_semi").unionByName(pages_new)
        made = render(stage, now.drop("changed", "fresh"), subjects, affected, read("pages", affected, *PAGE), generate, mode)
        if embed is not None:
            _embed(store, stage, made, read("vectors", affected, *PAGE), embed, least, embed_prose)
        return store.commit(head, stage, named_build(head.build_id if head else None, added, n), added=n)
    except BuildConflict:
        raise
    except BaseException:
        stage.drop(segments=True)
        raise


def render(stage, values: DataFrame, subjects: DataFrame, affected: DataFrame, old: DataFrame, generate, mode: str) -> DataFrame:
    """Write the affected pages; a page of its own new claims (``own``) is summarised again, another one keeps its summary."""
    sections = stage.keep("sections", C.page_sections(values))
    made = C.pages(sections, C.cross_references(values, subjects)).join(page_evidence(sections), PAGE).join(affected, PAGE)
    kept = old.select("page_id", F.col("prose").alias("_kept"))
    if generate is None:
        prose = kept.withColumnRenamed("_kept", "prose")
    else:
        plain = C.pages(sections.join(affected.where("own"), PAGE, "left_semi"))
        said = stage.keep("prose", C.synthesised(plain, generate, mode=mode))  # asked for once
        prose = said.join(kept, "page_id", "full").select("page_id", F.coalesce("prose", "_kept").alias("prose"))
    full = made.drop("own").join(prose, "page_id", "left").select("page_id", *PAGE, "n_values", "n_claims", "contradictions", "uris", "evidence", "first", "prose", "markdown")
    return stage.write("pages", full, by=PAGE, keys=["page_id"])


def project(claims: DataFrame, *, aliases: DataFrame | None = None, generate=None, mode: str = "prose") -> DataFrame:
    """The pages of all ``claims`` at once, in the columns of the table; ``ord`` may be of any type. What merges make step by step."""
    values = C.page_values(C.canonical_predicates(claims, aliases) if aliases is not None else claims)
    sections = C.page_sections(values)
    made = C.pages(sections, C.cross_references(values)).join(page_evidence(sections), PAGE)
    if generate is None:
        made = made.withColumn("prose", F.lit(None).cast("string"))
    else:
        made = made.join(C.synthesised(C.pages(sections), generate, mode=mode), "page_id", "left")
    return made.select("page_id", *PAGE, "n_values", "n_claims", "contradictions", "uris", "evidence", "first", "prose", "markdown")


def indexed_text(pages: DataFrame, least: int, embed_prose: bool) -> DataFrame:
    """(page_id, kind, subject, ord, text, digest) of the pages that are embedded."""
    text = with_prose(F.col("markdown"), F.col("kind"), F.col("subject"), F.col("prose")) if embed_prose else F.col("markdown")
    return C.indexable(pages, least).select("page_id", *PAGE, F.col("first").alias("ord"), text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


def _embed(store: BuildStore, stage, pages: DataFrame, old: DataFrame, embed, least: int, embed_prose: bool) -> DataFrame:
    """Write the vectors of pages whose text has no vector yet."""
    asked = indexed_text(pages, least, embed_prose).join(old.select("page_id", "digest"), ["page_id", "digest"], "left_anti")
    asked = stage.keep("asked", asked)
    made = asked.select("page_id", *PAGE, "ord", "digest", embed(F.col("text")).alias("vec"))
    return stage.write("vectors", made, by=PAGE, keys=["page_id"])


def index_pages(store: BuildStore, embed: Callable[[Column], Column], *, least: int = 1, embed_prose: bool = True) -> Build | None:
    """Embed what the head has no vector for: a first index of a build that was made without one, or one of another text."""
    head = store.head()
    if head is None:
        return None
    stage = store.stage(head)
    _embed(store, stage, pages_at(store, head), store.latest(head, "vectors", SCHEMAS["vectors"]), embed, least, embed_prose)
    return store.commit(head, stage, head.build_id, kind="index")


def pages_at(store: BuildStore, build: Build | None) -> DataFrame:
    """The pages of a build."""
    return store.latest(build, "pages", SCHEMAS["pages"])


def claims_at(store: BuildStore, build: Build | None) -> DataFrame:
    """The claims of a build."""
    return store.rows(build, "claims", SCHEMAS["claims"]).drop("seq")


def page_index(store: BuildStore, build: Build | None) -> DataFrame:
    """(doc, ord, vec) of a build's embedded pages, in the order of their first claims."""
    v = store.latest(build, "vectors", SCHEMAS["vectors"])
    return v.select(F.col("page_id").alias("doc"), "ord", "vec")


def rank_pages(index: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """(qid, doc, ord, score, rank): the k nearest pages of (qid, vec); ties go to the later page."""
    return R.dense_rank(index, queries, k)


def page_citations(ranked: DataFrame, pages: DataFrame, *, chars: int = 240) -> DataFrame:
    """(qid, citations): each source that the ranked pages rest on once, where it is met first, by rank and then in the page's order.

    A source is an evidence URI without its scheme and chunk; its span names the page and the section.
    """
    cited = ranked.select("qid", "rank", F.col("doc").alias("page_id")).join(pages.select("page_id", *PAGE, "evidence"), "page_id")
    each = cited.select("qid", "rank", *PAGE, F.posexplode("evidence").alias("place", "e"))
    path = F.substring_index(F.regexp_replace("e.uri", "^chunk://", ""), "#", 1)
    span = F.substring(F.concat(F.col("kind"), F.lit(":"), F.col("subject"), F.lit(": "), F.col("e.predicate")), 1, chars)
    first = each.select("qid", F.struct("rank", "place").alias("at"), path.alias("source_path"), span.alias("span")).groupBy("qid", "source_path").agg(F.min(F.struct("at", "span")).alias("m"))
    order = F.array_sort(F.collect_list(F.struct("m.at", F.struct("source_path", "m.span").alias("c"))))
    return first.groupBy("qid").agg(F.transform(order, lambda x: x["c"]).alias("citations"))


def page_context(ranked: DataFrame, pages: DataFrame, *, answer_prose: bool = True) -> DataFrame:
    """(qid, context): the ranked pages' texts, a blank line between them."""
    text = with_prose(F.col("markdown"), F.col("kind"), F.col("subject"), F.col("prose")) if answer_prose else F.col("markdown")
    rows = ranked.select("qid", "rank", F.col("doc").alias("page_id")).join(pages.select("page_id", text.alias("text")), "page_id")
    order = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy("qid").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n\n").alias("context"))
