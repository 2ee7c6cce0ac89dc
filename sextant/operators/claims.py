"""Claims to entity pages, contradictions, cross references and incremental builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import build_id, claim_id, page_id
from ..functions.text import dropped_subject, strip, triples
from .ranking import small

#: Kinds of evidence.
EVIDENCE = ("raw_doc", "materialized_event", "human_attestation")
SOURCES = "array<struct<source_id:string,evidence_type:string,evidence_uri:string,span_start:int,span_end:int,source_version:string>>"
PROOF_SETS = f"array<struct<proof_set_id:string,sources:{SOURCES},acl_labels:array<string>,validated_at:timestamp,validator_model_id:string>>"
CLAIM = f"claim_id string, knowledge_build_id string, domain string, subject string, subject_type string, predicate string, object string, object_type string, proof_sets {PROOF_SETS}, prompt_id string, prompt_template_hash string, model_id string, model_snapshot string, sampling_params_hash string, asserted_at timestamp, retracted_at timestamp, superseded_by_claim_id string, ttl_days int, data_residency_region string"


def canonical_predicates(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Predicates by a vocabulary (alias, canonical), in any case; unknown ones stay."""
    v = small(aliases.select(F.lower("alias").alias("_alias"), F.col("canonical").alias("_canon")).groupBy("_alias").agg(F.min("_canon").alias("_canon")))
    return claims.join(v, F.lower("predicate") == F.col("_alias"), "left").withColumn("predicate", F.coalesce("_canon", "predicate")).drop("_alias", "_canon")


def relabelled(claims: DataFrame, types: DataFrame, *, drop_generic: bool = True) -> DataFrame:
    """Claims with the kind that ``types`` (subject, kind) has for their subject; those of subjects that never name an entity go."""
    t = small(types.select("subject", F.col("kind").alias("_kind")))
    kept = claims.where(~dropped_subject(F.col("subject"))) if drop_generic else claims
    return kept.join(t, "subject", "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind").select(*claims.columns)


def inferred_types(subjects: DataFrame, generate, kinds: tuple[str, ...], *, fallback: str = "entity:concept", batch: int = 50) -> DataFrame:
    """(subject, kind) from a text model that is asked for ``batch`` subjects at a time and answers 'subject | kind' lines.

    ``generate`` maps a prompt column to texts. What it leaves out, or names otherwise than ``kinds``, has the fallback.
    """
    w = Window.partitionBy(F.pmod(F.xxhash64("subject"), F.lit(256))).orderBy("subject")
    own = subjects.select("subject").distinct().withColumn("_g", F.struct(F.pmod(F.xxhash64("subject"), F.lit(256)).alias("b"), F.floor((F.row_number().over(w) - 1) / batch).alias("n")))
    asked = own.groupBy("_g").agg(F.array_join(F.array_sort(F.collect_list("subject")), "\n").alias("list"))
    prompt = F.concat(F.lit(f"Give each subject a type of: {', '.join(kinds)}. Answer with lines 'subject | type'.\n\n"), "list")
    lines = asked.select(F.explode(F.split(generate(prompt), "\n")).alias("x")).select(strip(F.regexp_replace(F.element_at(F.split("x", r"\|"), 1), r"^[-*•\s]+", "")).alias("subject"), strip(F.get(F.split("x", r"\|"), F.lit(1))).alias("kind"))
    said = lines.where(F.col("kind").isin(*kinds)).groupBy("subject").agg(F.min("kind").alias("kind"))
    return own.select("subject").join(said, "subject", "left").select("subject", F.coalesce("kind", F.lit(fallback)).alias("kind"))


def page_values(claims: DataFrame) -> DataFrame:
    """(kind, subject, predicate, object, object_kind, first, claims, uris): the values of every page section.

    Claims and URIs stand in the order in which they are met, each once. claims: (..., claim_id, uris, ord).
    """
    met = claims.groupBy("kind", "subject", "predicate", "object", "object_kind").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "claim_id", "uris"))).alias("met"))
    ids = F.array_distinct(F.transform("met", lambda x: x["claim_id"]))
    return met.select("kind", "subject", "predicate", "object", "object_kind", "first", ids.alias("claims"), F.array_distinct(F.flatten(F.transform("met", lambda x: x["uris"]))).alias("uris"))


def page_sections(values: DataFrame) -> DataFrame:
    """(kind, subject, predicate, n_values, contradicted, values in claim order)."""
    order = F.array_sort(F.collect_list(F.struct("first", "object", "object_kind", "uris", "claims")))
    return values.groupBy("kind", "subject", "predicate").agg(F.count(F.lit(1)).alias("n_values"), (F.count(F.lit(1)) > 1).alias("contradicted"), order.alias("values"))


def pages(sections: DataFrame, references: DataFrame | None = None, prose: DataFrame | None = None) -> DataFrame:
    """(page_id, kind, subject, n_values, n_claims, contradictions, uris, markdown).

    Sections stand in the order of their predicates. ``references`` (kind, subject, target_kind, target, predicate, first)
    become 'See also', ``prose`` (page_id, prose) comes before the sections.
    """
    cites = lambda v: F.array_join(F.transform(v["uris"], lambda u: F.concat(F.lit("[doc:"), F.regexp_replace(u, "^chunk://", ""), F.lit("]"))), " ")
    line = lambda v: F.regexp_replace(F.concat(F.lit("- "), F.coalesce(v["object"], F.lit("(asserted)")), F.lit(" "), cites(v)), r"(?U)\s+$", "")
    head = F.when(F.col("contradicted"), F.concat(F.lit("## ⚠ "), "predicate", F.lit(" (contradiction: "), F.col("n_values").cast("string"), F.lit(" values)"))).otherwise(F.concat(F.lit("## "), "predicate"))
    block = sections.select("kind", "subject", "n_values", "contradicted", F.struct("predicate", F.concat_ws("\n", head, F.array_join(F.transform("values", line), "\n")).alias("text"), F.flatten(F.transform("values", lambda v: v["uris"])).alias("uris"), F.flatten(F.transform("values", lambda v: v["claims"])).alias("claims")).alias("s"))
    made = block.groupBy("kind", "subject").agg(F.array_sort(F.collect_list("s")).alias("s"), F.sum("n_values").alias("n_values"), F.sum(F.col("contradicted").cast("long")).alias("contradictions"))
    made = made.withColumn("page_id", page_id(F.col("kind"), F.col("subject")))
    body = F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")
    parts = [F.concat(F.lit("# "), "subject", F.lit(" ("), "kind", F.lit(")"))]
    if prose is not None:
        made = made.join(prose.select("page_id", "prose"), "page_id", "left")
        said = strip(F.coalesce("prose", F.lit("")))
        parts.append(F.when(said != "", F.concat(said, F.lit("\n\n## Sources"))))
    parts.append(body)
    if references is not None:
        see = references.groupBy("kind", "subject").agg(F.array_sort(F.collect_list(F.struct("predicate", "first", "target", "target_kind"))).alias("see"))
        made = made.join(see, ["kind", "subject"], "left")
        rows = F.array_join(F.transform("see", lambda x: F.concat(F.lit("- "), x["target"], F.lit(" ("), x["target_kind"], F.lit(")"))), "\n")
        parts.append(F.when(F.size("see") > 0, F.concat(F.lit("## See also\n"), rows)))
    text = F.concat(F.regexp_replace(F.concat_ws("\n\n", *parts), r"(?U)\s+$", ""), F.lit("\n"))
    count = F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: x["claims"])))).cast("long")
    return made.select("page_id", "kind", "subject", "n_values", count.alias("n_claims"), "contradictions", F.array_distinct(F.flatten(F.transform("s", lambda x: x["uris"]))).alias("uris"), text.alias("markdown"))


def indexable(pages: DataFrame, least: int = 1) -> DataFrame:
    """Pages with at least so many claims."""
    return pages.where(F.col("n_claims") >= least)


def synthesised(pages: DataFrame, generate, *, mode: str = "prose") -> DataFrame:
    """(page_id, prose) from a text model, once a page; ``mode`` prose or tag_list."""
    ask = {"prose": "Write a short factual summary of this page. Keep its citations.", "tag_list": "List the page's facts as tags, separated by commas."}[mode]
    return pages.select("page_id", generate(F.concat(F.lit(ask + "\n\n"), "markdown")).alias("prose"))


def cross_references(values: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(kind, subject, target_kind, target, target_page_id, predicate, first): objects that are other pages' subjects, each target page once.

    Of pages with one subject and several kinds the last kind is meant. ``subjects`` (kind, subject) has the pages there are, if
    ``values`` has not all.
    """
    there = (values if subjects is None else subjects).groupBy(F.col("subject").alias("object")).agg(F.max("kind").alias("target_kind"))
    links = values.join(there, "object").where(~((F.col("object") == F.col("subject")) & (F.col("target_kind") == F.col("kind"))))
    first = links.groupBy("kind", "subject", F.col("object").alias("target"), "target_kind").agg(F.min(F.struct("predicate", "first")).alias("m"))
    return first.select("kind", "subject", "target_kind", "target", page_id(F.col("target_kind"), F.col("target")).alias("target_page_id"), "m.predicate", "m.first")


def claim_text(subject: Column, predicate: Column, obj: Column) -> Column:
    """What is embedded of a claim."""
    return strip(F.concat_ws(" ", subject, predicate, F.coalesce(obj, F.lit(""))))


def extracted_claims(chunks: DataFrame, generate, prompt: str, *, most: int = 5) -> DataFrame:
    """Claims (claim_id, subject, predicate, object, uris, ord, chunk_id) of chunks (chunk_id, ord, text) from a text model's 'a | b | c' lines.

    At most ``most`` a chunk; of equal claims the first stays.
    """
    said = chunks.select("chunk_id", "ord", F.posexplode(F.slice(triples(generate(F.col("text"))), 1, most)).alias("place", "t"))
    rows = said.select(F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), F.array(F.concat(F.lit("chunk://"), "chunk_id")).alias("uris"), F.struct("ord", "place").alias("ord"), "chunk_id")
    rows = rows.withColumn("claim_id", claim_id(F.col("subject"), F.col("predicate"), F.col("object"), F.lit(prompt), F.col("uris")))
    return first_of(rows, "claim_id")


def first_of(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """The first row of each key by ``ord``."""
    w = Window.partitionBy(key).orderBy("ord")
    return claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_of(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """The last row of each key by ``ord``, in the place of the first."""
    w = Window.partitionBy(key)
    return claims.withColumn("_n", F.row_number().over(w.orderBy(F.desc("ord")))).withColumn("_o", F.min("ord").over(w)).where("_n = 1").withColumn("ord", F.col("_o")).drop("_n", "_o")


def merge_build(prior: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims of the next build, claims added, subjects to be projected again).

    Claims that the prior build has are left out; of equal new ones the last stands in the first one's place. Without a
    new claim the next build is the prior one.
    """
    added = last_of(new).join(prior.select("claim_id"), "claim_id", "left_anti").select(*prior.columns)
    touched = added.select("kind", "subject").distinct()
    return prior.unionByName(added), added, touched


def merge_pages(prior_pages: DataFrame, claims: DataFrame, touched: DataFrame) -> DataFrame:
    """Pages of the next build: only touched subjects are projected again, references are resolved over all of them."""
    values = page_values(claims)
    again = pages(page_sections(values.join(touched, ["kind", "subject"], "left_semi")), cross_references(values))
    kept = prior_pages.join(touched, ["kind", "subject"], "left_anti")
    return kept.unionByName(again)


def next_build_id(parent: str | None, added: DataFrame) -> DataFrame:
    """One row (build_id, n); an empty delta has no row, the prior build stays. A build's claims were added by one batch."""
    ids = added.agg(F.collect_list("claim_id").alias("ids"))
    return ids.where("size(ids) > 0").select(build_id(F.lit(parent).cast("string"), F.col("ids")).alias("build_id"), F.size("ids").cast("long").alias("n"))


def visible(claims: DataFrame, labels: list[str]) -> DataFrame:
    """Claims (claim_id, proof_sets) with a proof set whose labels a reader has all."""
    own = F.array(*map(F.lit, labels)).cast("array<string>")
    return claims.where(F.exists("proof_sets", lambda p: F.size(F.array_except(p["acl_labels"], own)) == 0))


def broken_rules(claims: DataFrame) -> DataFrame:
    """(claim_id, rule) of nested claims (the columns of CLAIM) that break a rule."""
    digest = r"^[0-9a-f]{64}$"
    hex_ok = lambda c: F.coalesce(c.rlike(digest), F.lit(False))
    sets = F.coalesce("proof_sets", F.array().cast(PROOF_SETS))
    sources = F.flatten(F.transform(sets, lambda p: F.coalesce(p["sources"], F.array().cast(SOURCES))))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = {
        "claim_id": ~hex_ok(F.col("claim_id")),
        "knowledge_build_id": ~hex_ok(F.col("knowledge_build_id")),
        "prompt_template_hash": ~hex_ok(F.col("prompt_template_hash")),
        "sampling_params_hash": ~hex_ok(F.col("sampling_params_hash")),
        "superseded_by_claim_id": F.col("superseded_by_claim_id").isNotNull() & ~hex_ok(F.col("superseded_by_claim_id")),
        "at least one proof set": F.size(sets) == 0,
        "proof_set_id": F.exists(sets, lambda p: ~hex_ok(p["proof_set_id"])),
        "at least one source": F.exists(sets, lambda p: F.coalesce(F.size(p["sources"]), F.lit(0)) == 0),
        "source_id and evidence_uri": F.exists(sources, lambda e: blank(e["source_id"]) | blank(e["evidence_uri"])),
        "evidence_type": F.exists(sources, lambda e: ~F.coalesce(e["evidence_type"].isin(*EVIDENCE), F.lit(False))),
        "span_end requires span_start": F.exists(sources, lambda e: e["span_end"].isNotNull() & e["span_start"].isNull()),
        "span_end >= span_start": F.exists(sources, lambda e: F.coalesce(e["span_end"] < e["span_start"], F.lit(False))),
        "retracted_at >= asserted_at": F.coalesce(F.col("retracted_at") < F.col("asserted_at"), F.lit(False)),
        "ttl_days >= 1": F.coalesce(F.col("ttl_days") < 1, F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return claims.select("claim_id", F.explode(found).alias("rule"))


def claim_rows(claims: DataFrame) -> dict[str, DataFrame]:
    """Nested claims (claim_id, ..., proof_sets) to claims, proof sets, evidence and acl rows."""
    sets = claims.select("claim_id", F.explode("proof_sets").alias("ps"))
    return {
        "claims": claims.drop("proof_sets"),
        "proof_sets": sets.select("claim_id", "ps.proof_set_id", F.size("ps.sources").alias("source_count")),
        "evidence": sets.select("claim_id", "ps.proof_set_id", F.posexplode("ps.sources").alias("place", "source")),
        "acl": sets.select("claim_id", "ps.proof_set_id", F.explode(F.array_sort(F.array_distinct("ps.acl_labels"))).alias("acl_label")),
    }


def claims_from_rows(rows: dict[str, DataFrame]) -> DataFrame:
    """The nested form again."""
    key = ["claim_id", "proof_set_id"]
    ev = rows["evidence"].groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("sources"))
    acl = rows["acl"].groupBy(*key).agg(F.array_sort(F.collect_set("acl_label")).alias("acl_labels"))
    sets = rows["proof_sets"].select(*key).join(ev, key, "left").join(acl, key, "left")
    sets = sets.withColumn("acl_labels", F.coalesce("acl_labels", F.array().cast("array<string>")))
    nested = sets.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("proof_set_id", "sources", "acl_labels"))).alias("proof_sets"))
    return rows["claims"].join(nested, "claim_id", "left")
