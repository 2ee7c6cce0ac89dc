"""Text as column expressions: tokens, chunks, citations, subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_BLANKS = r"(?U)^\s+|\s+$"
#: Subjects that never name an entity.
GENERIC_SUBJECTS = ("subject", "predicate", "object", "triple", "fact", "system", "claim", "wiki", "page", "document", "design", "issue", "thing", "stuff", "user", "request", "response", "answer", "question", "data", "value", "result", "name", "id", "type")
#: Shapes of entity terms, in order of search.
ENTITY_SHAPES = (r"\b[A-Z][A-Za-z0-9]{3,}\b", r"\b[A-Z]{2,}[0-9]*\b", r"\b[a-z][a-z0-9]*(?:[-_][a-z0-9]+)+\b")


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def tokens(c: Column) -> Column:
    """Words of ASCII letters, digits and underscores, lowered after they are found."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9_]+)"), 1), F.lower)


def cap_words(c: Column, n: int) -> Column:
    """The first n words, joined by single spaces."""
    words = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def word_windows(c: Column, size: int = 350, overlap: int = 80) -> Column:
    """array<string>: windows of ``size`` words, each ``size - overlap`` words on; empty for a blank text."""
    made = F.transform(F.array(F.filter(F.split(F.coalesce(strip(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))))
    return F.coalesce(made[0], F.array().cast("array<string>"))


def paragraph_chunks(c: Column, separator: str = r"\n\s*\n", max_chars: int = 1_200, overlap_chars: int = 120) -> Column:
    """array<string>: paragraphs filled greedily into chunks; the next chunk opens with the last one's tail.

    A paragraph above the limit is a chunk of its own. Joints count two characters, but
    not the one after a tail.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["buf"] == "") | (acc["n"] + F.length(p) + 2 <= max_chars)
        tail = F.when(F.length(acc["buf"]) > overlap_chars, F.expr("''") if overlap_chars <= 0 else F.right(acc["buf"], F.lit(overlap_chars))).otherwise(acc["buf"] if overlap_chars > 0 else F.lit(""))
        grown = F.struct(acc["out"].alias("out"), F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p)).alias("buf"), (F.when(acc["buf"] == "", F.lit(0)).otherwise(acc["n"] + 2) + F.length(p)).alias("n"))
        opened = F.struct(F.concat(acc["out"], F.array(acc["buf"])).alias("out"), F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p)).alias("buf"), (F.length(tail) + F.length(p)).alias("n"))
        return F.when(fits, grown).otherwise(opened)

    return F.aggregate(parts, zero, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))))


def parent_id(c: Column) -> Column:
    """A chunk id without its suffix: '::' first, else '#chunk-'."""
    return F.when(F.contains(c, F.lit("::")), F.substring_index(c, "::", 1)).when(F.contains(c, F.lit("#chunk-")), F.substring_index(c, "#chunk-", 1)).otherwise(c)


def cited_paths(answer: Column) -> Column:
    """Paths of '[doc:path#chunk-n]' marks, each once."""
    marks = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[doc:([^\]]+)\]"), 1)
    return F.array_distinct(F.filter(F.transform(marks, lambda m: strip(F.substring_index(strip(m), "#chunk-", 1))), lambda p: p != ""))


def refusal(answer: Column) -> Column:
    """struct<refused, reason>: whether a text opens with 'REFUSE:', and the rest of that line."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+", "")
    said = strip(F.substring_index(F.substring(text, 8, 1_000_000), "\n", 1))
    refused = F.startswith(text, F.lit("REFUSE:"))
    return F.struct(refused.alias("refused"), F.when(refused & (said != ""), said).alias("reason"))


def normal_subject(c: Column) -> Column:
    """Lower case, no leading article, signs as spaces, single spaces."""
    s = F.regexp_replace(strip(F.lower(c)), r"(?U)^(the|a|an)\s+", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def canonical_subject(c: Column) -> Column:
    """A subject without its version, normalised."""
    return normal_subject(F.regexp_replace(strip(c), r"(?iU)\sv\d+\.\d+\.\d+$", ""))


def dropped_subject(c: Column) -> Column:
    """Whether a subject is blank, generic, too short, or a number or heading."""
    raw, norm = strip(c), normal_subject(c)
    heading = raw.rlike(r"(?i)^(pr\s*\d+|deliverable\s+[\d.]+|track\s+[a-z]|\d+(\.\d+)*)$")
    return F.coalesce((raw == "") | norm.isin(*GENERIC_SUBJECTS) | (F.length(norm) <= 2) | heading, F.lit(True))


def entity_terms(c: Column) -> Column:
    """array<string>: entity-like terms by shape, the first spelling of each, whatever its case."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({s})"), 1) for s in ENTITY_SHAPES]))
    made = F.transform(F.array(found), lambda a: F.filter(F.transform(a, lambda t, i: F.when(F.array_position(F.transform(a, F.lower), F.lower(t)) == i + 1, t)), lambda t: t.isNotNull()))
    return made[0]


def padded_text(c: Column, factor: int = 10) -> Column:
    """A text followed by each of its entity terms ``factor`` times."""
    terms = F.flatten(F.transform(entity_terms(c), lambda t: F.array_repeat(t, factor)))
    return F.when(F.size(terms) > 0, F.concat(c, F.lit("\n\n"), F.array_join(terms, " "))).otherwise(c)


def triples(c: Column) -> Column:
    """array<struct<s, p, o>> of lines 'a | b | c', bullets aside, with all parts there."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^[-*•\s]+", ""), r"\|"), strip))
    kept = F.filter(lines, lambda x: (F.size(x) == 3) & F.forall(x, lambda y: y != ""))
    return F.transform(kept, lambda x: F.struct(x[0].alias("s"), x[1].alias("p"), x[2].alias("o")))


def l2(v: Column) -> Column:
    """A vector at unit length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def judge_score(c: Column) -> Column:
    """The number after 'SCORE:', within 1 and 5; 3 without one."""
    said = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)SCORE:\s*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(said != "", F.least(F.greatest(said.cast("double"), F.lit(1.0)), F.lit(5.0))).otherwise(F.lit(3.0))


def hashed_buckets(c: Column, dim: int = 64) -> Column:
    """array<int>: buckets of a text's words and word pairs (sha1 modulo ``dim``, a divisor of 256)."""
    words = tokens(c)
    grams = F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))))[0]
    return F.transform(grams, lambda g: F.conv(F.right(F.sha1(g.cast("binary")), F.lit(2)), 16, 10).cast("int") % dim)


# Names and labels of imported data sets


def safe_filename(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen, one hyphen for a run of others; 'item' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("item"))


def normal_key(c: Column) -> Column:
    """Lower-case letters and digits, one underscore for a run of others."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def first_line(c: Column, limit: int = 120) -> Column:
    """The first line with more than blanks and heading signs, without them, cut."""
    bare = lambda x: strip(F.regexp_replace(strip(x), r"^#+|#+$", ""))
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]"), bare), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, limit), F.lit(""))


def imported_id(path: Column) -> Column:
    """The id that opens a file name 'dsid_X__title'; empty without one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^(dsid_[A-Za-z0-9]+)__", 1)


def imported_title(path: Column, content: Column) -> Column:
    """The title in a file name 'dsid_X__some-title.txt', or the content's first line."""
    named = F.regexp_extract(F.substring_index(path, "/", -1), r"^dsid_[A-Za-z0-9]+__(.+)\.txt$", 1)
    return F.when(named != "", F.initcap(strip(F.replace(named, F.lit("-"), F.lit(" "))))).otherwise(first_line(content))


def asset_source(name: Column) -> Column:
    """The source type of a release file 'Some Source_slice_3.zip'; empty for others."""
    return normal_key(F.regexp_extract(name, r"^(.+)_slice_\d+\.zip$", 1))


def question_tier(kind: Column) -> Column:
    """The tier of an imported question's type; one that the corpus can't answer is single_hop and marked by ``unanswerable``."""
    k = normal_key(F.coalesce(kind, F.lit("")))
    one = k.isin("basic", "semantic", "misc", "miscellaneous") | F.contains(k, F.lit("not_found"))
    return F.when(F.contains(k, F.lit("conflict")), "contradiction").when(one, "single_hop").otherwise("multi_hop")


def unanswerable(kind: Column) -> Column:
    return F.contains(normal_key(F.coalesce(kind, F.lit(""))), F.lit("not_found"))


def safe_url(c: Column) -> Column:
    """A URL without user, query and fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
