"""The evaluation loop: answers of systems to questions, their row metrics, summaries and paired comparisons.

Questions: the columns of sources.files.QUESTION. Answers: (system, qid, answer, citations, retrieved_sources,
answer_citations: arrays of struct<source_path, span>, latency_ms, retrieval_latency_ms, tokens_used, refused, refusal_reason).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cited_paths, judge_score, refusal
from . import metrics as M
from . import ranking as R

CITATIONS = "array<struct<source_path:string,span:string>>"
ANSWER = f"system string, qid string, answer string, citations {CITATIONS}, retrieved_sources {CITATIONS}, answer_citations {CITATIONS}, latency_ms double, retrieval_latency_ms double, tokens_used long, refused boolean, refusal_reason string"
#: The metrics of a row that are averaged, and those that systems are compared on.
MEANS = ("must_include_match", "answer_citation_precision", "answer_citation_recall", "retrieval_source_precision", "retrieval_source_recall", "abstention_correctness", "faithfulness", "relevance", "answer_length_chars")
PAIRED = ("must_include_match", "answer_citation_precision", "answer_citation_recall", "retrieval_source_precision", "retrieval_source_recall", "faithfulness", "relevance")
LEAST_QUESTIONS = 5


# Mock models, as column expressions. Real ones are functions of the same shape over pandas UDFs.


def mock_answer(prompt: Column) -> Column:
    """struct<text, tokens>: the question and the first three lines after citation marks of a prompt."""
    asked = F.regexp_replace(F.regexp_extract(prompt, r"Question:\s*(.+)", 1), r"(?U)^\s+|\s+$", "")
    blocks = F.regexp_extract_all(prompt, F.lit(r"\[doc:[^\]]+\]([^\[]+)"), 1)
    lines = F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, r"\r\n|[\n\r\u000b\u000c\u0085  ]"))), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    bullets = F.array_join(F.transform(F.slice(lines, 1, 3), lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.when(F.size(lines) > 0, F.concat(F.lit("(mock synthesis for: "), asked, F.lit(")\n"), bullets)).otherwise(F.concat(F.lit("(mock answer to: "), asked, F.lit(")")))
    return F.struct(text.alias("text"), F.greatest(F.lit(1).cast("long"), F.floor((F.length(prompt) + F.length(text)) / 4)).alias("tokens"))


def _long_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1), lambda w: F.length(w) > 3))


def _held(words: Column, text: Column) -> Column:
    """1 to 5 by the share of words that occur in a text, not rounded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return 1 + 4 * F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)


def mock_faithfulness(answer: Column, truth: Column) -> Column:
    words = _long_words(truth)
    return F.when(F.size(words) == 0, 3.0).otherwise(_held(words, answer))


def mock_relevance(question: Column, answer: Column) -> Column:
    words = _long_words(question)
    return F.when((F.size(words) == 0) | (F.coalesce(answer, F.lit("")) == ""), 1.0).otherwise(_held(words, answer))


class MockJudge:
    """Scores by shared words; ``faithfulness`` and ``relevance`` give columns."""

    def faithfulness(self, question: Column, answer: Column, evidence: Column, truth: Column) -> Column:
        return mock_faithfulness(answer, truth)

    def relevance(self, question: Column, answer: Column) -> Column:
        return mock_relevance(question, answer)


class PromptJudge:
    """Scores by a text model: ``generate(prompt column) -> column`` whose texts hold a line 'SCORE: x'."""

    def __init__(self, generate) -> None:
        self.generate = generate

    def _ask(self, what: str, **parts: Column) -> Column:
        prompt = F.concat_ws("\n\n", F.lit(f"Rate the {what} of the answer from 1 to 5. End with a line 'SCORE: <number>'."), *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in parts.items()])
        return judge_score(self.generate(prompt))

    def faithfulness(self, question: Column, answer: Column, evidence: Column, truth: Column) -> Column:
        return self._ask("faithfulness", Question=question, Answer=answer, Evidence=evidence, Reference=truth)

    def relevance(self, question: Column, answer: Column) -> Column:
        return self._ask("relevance", Question=question, Answer=answer)


def capped(generate, max_words: int):
    """A generator whose texts end after so many words."""
    from ..functions.text import cap_words

    def run(prompt: Column) -> Column:
        made = generate(prompt)
        return F.struct(cap_words(made["text"], max_words).alias("text"), F.least(made["tokens"], F.lit(max_words).cast("long")).alias("tokens"))

    return run


def prompt_of(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context. Cite sources as [doc:id]. Say 'REFUSE: <reason>' if it does not hold the answer.\n\nQuestion: "), question, F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("")))


def answers_from(system: str, questions: DataFrame, context: DataFrame, citations: DataFrame, generate=mock_answer, *, latency_ms: float = 0.0, detects_refusal: bool = True) -> DataFrame:
    """Answers of one system for all questions at once, from what it puts before the model (qid, context) and cites (qid, citations)."""
    rows = questions.select(F.col("id").alias("qid"), "question").join(context, "qid", "left").join(citations, "qid", "left")
    made = rows.withColumn("_made", generate(prompt_of(F.col("question"), F.col("context")))).withColumn("_said", refusal(F.col("_made.text")))
    none = F.array().cast(CITATIONS)
    refused, reason = (F.col("_said.refused"), F.col("_said.reason")) if detects_refusal else (F.lit(False), F.lit(None).cast("string"))
    return made.select(F.lit(system).alias("system"), "qid", F.col("_made.text").alias("answer"), F.coalesce("citations", none).cast(CITATIONS).alias("citations"), F.coalesce("citations", none).cast(CITATIONS).alias("retrieved_sources"), none.alias("answer_citations"), F.lit(float(latency_ms)).alias("latency_ms"), F.lit(None).cast("double").alias("retrieval_latency_ms"), F.col("_made.tokens").cast("long").alias("tokens_used"), refused.alias("refused"), reason.alias("refusal_reason"))


def answers_of(system: str, questions: DataFrame, ranked: DataFrame, generate=mock_answer, *, latency_ms: float = 0.0, chars: int = 160, detects_refusal: bool = True) -> DataFrame:
    """Answers of one system from its ranking (qid, rank, chunk_id, source_path, text), a citation for each chunk."""
    cites = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", R.citation(F.col("source_path"), F.col("text"), chars).alias("c")))), lambda x: x["c"]).alias("citations"))
    return answers_from(system, questions, R.context(ranked), cites, generate, latency_ms=latency_ms, detects_refusal=detects_refusal)


def run_rows(questions: DataFrame, answers: DataFrame, judge=None) -> DataFrame:
    """One row for each question and system with its metrics; a metric that can't be computed is null.

    Citations stated by the system count, else those in the text; sources retrieved, else the citations. Refused answers
    are not judged.
    """
    q = questions.select(F.col("id").alias("qid"), "tier", "question", "ground_truth_answer", "ground_truth_citations", "must_include_terms", "must_not_include_terms", (F.coalesce("unanswerable", F.lit(False)) | F.coalesce("expected_abstain", F.lit(False))).alias("abstain"))
    rows = answers.join(R.small(q), "qid")
    path = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast(CITATIONS)), lambda x: x["source_path"]))
    truth = F.array_distinct("ground_truth_citations")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    cited = F.when(some("answer_citations"), path(F.col("answer_citations"))).otherwise(cited_paths(F.col("answer")))
    found = F.when(some("retrieved_sources"), path(F.col("retrieved_sources"))).otherwise(path(F.col("citations")))
    rows = rows.withColumn("_cited", cited).withColumn("_found", found).withColumn("_truth", truth)
    none = F.lit(None).cast("double")
    judged = judge is not None
    evidence = F.array_join(F.transform("citations", lambda c: F.coalesce(F.nullif(c["span"], F.lit("")), c["source_path"])), "\n")
    score = lambda c: F.when(~F.col("refused"), c).cast("double")
    return rows.select(
        "system", "qid", "tier", *[c for c in answers.columns if c not in ("system", "qid")],
        M.required_share(F.col("answer"), F.col("must_include_terms")).alias("must_include_match"),
        M.forbidden_count(F.col("answer"), F.col("must_not_include_terms")).alias("must_not_include_violations"),
        M.precision(F.col("_cited"), F.col("_truth")).alias("answer_citation_precision"), M.recall(F.col("_cited"), F.col("_truth")).alias("answer_citation_recall"),
        M.abstention(F.col("abstain"), F.col("refused")).alias("abstention_correctness"),
        M.precision(F.col("_found"), F.col("_truth")).alias("retrieval_source_precision"), M.recall(F.col("_found"), F.col("_truth")).alias("retrieval_source_recall"),
        F.length("answer").cast("double").alias("answer_length_chars"),
        (score(judge.faithfulness(F.col("question"), F.col("answer"), evidence, F.col("ground_truth_answer"))) if judged else none).alias("faithfulness"),
        (score(judge.relevance(F.col("question"), F.col("answer"))) if judged else none).alias("relevance"),
    )


def rejudge(rows: DataFrame, questions: DataFrame, judge) -> DataFrame:
    """Rows with faithfulness and relevance scored anew; refused rows and rows of unknown questions stay as they are."""
    q = questions.select(F.col("id").alias("qid"), F.col("question").alias("_question"), F.col("ground_truth_answer").alias("_truth"), F.lit(True).alias("_known"))
    j = rows.join(R.small(q), "qid", "left")
    again = F.coalesce(F.col("_known"), F.lit(False)) & ~F.col("refused")
    evidence = F.array_join(F.transform("citations", lambda c: F.coalesce(F.nullif(c["span"], F.lit("")), c["source_path"])), "\n")
    new = {"faithfulness": judge.faithfulness(F.col("_question"), F.col("answer"), evidence, F.col("_truth")), "relevance": judge.relevance(F.col("_question"), F.col("answer"))}
    return j.withColumns({c: F.when(again, v.cast("double")).otherwise(F.col(c)) for c, v in new.items()}).select(*rows.columns)


def summary(rows: DataFrame) -> DataFrame:
    """(system, tier, metric, value): means by system (tier null) and by system and tier, in one pass.

    Nulls don't count, and a metric without a value has no row. Median latencies, tokens and the rate of refusals are of systems only.
    """
    means = [F.avg(c).alias(c) for c in MEANS]
    whole = [F.median("latency_ms").alias("latency_ms_p50"), F.median("retrieval_latency_ms").alias("retrieval_latency_ms_p50"), F.sum("tokens_used").cast("double").alias("tokens_used_total"), F.avg(F.col("refused").cast("double")).alias("refusal_rate")]
    names = ["latency_ms_p50", "retrieval_latency_ms_p50", "tokens_used_total", "refusal_rate"]
    wide = rows.groupingSets([["system"], ["system", "tier"]], "system", "tier").agg(*means, *whole, F.grouping("tier").alias("_all"))
    long = wide.unpivot(["system", "tier", "_all"], [*MEANS, *names], "metric", "value").where("value is not null")
    return long.where((F.col("_all") == 1) | ~F.col("metric").isin(names)).drop("_all")


def tier_counts(questions: DataFrame) -> DataFrame:
    """(tier, n) of questions; the three known tiers are there even without one."""
    spark = questions.sparkSession
    known = spark.createDataFrame([(t,) for t in M.TIERS], "tier string")
    n = questions.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "tier", "full_outer").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pairwise(spark: SparkSession, rows: DataFrame, questions: DataFrame, systems: list[str], *, alpha: float = 0.05, resamples: int = 2_000, metrics: tuple[str, ...] = PAIRED) -> DataFrame:
    """(metric, system_a, system_b, mean_a, mean_b, mean_diff, ci_low, ci_high, alpha, n, significant).

    A pair of systems, in the order given, is compared on a metric if both have a value for every question; of several rows of a system
    and question the last by answer counts. None are with fewer than two systems or five questions.
    """
    schema = "metric string, system_a string, system_b string, mean_a double, mean_b double, mean_diff double, ci_low double, ci_high double, alpha double, n long, significant boolean"
    n = questions.count()
    if len(systems) < 2 or n < LEAST_QUESTIONS:
        return spark.createDataFrame([], schema)
    order = F.create_map(*[x for i, s in enumerate(systems) for x in (F.lit(s), F.lit(i))])
    ids = questions.select(F.col("id").alias("qid"))
    long = rows.join(R.small(ids), "qid", "left_semi").where(F.col("system").isin(systems)).unpivot(["system", "qid"], list(metrics), "metric", "v")
    long = long.groupBy("metric", "system", "qid").agg(F.last("v").alias("v")).where("v is not null")
    full = long.groupBy("metric", "system").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") == n).select("metric", "system")
    long = long.join(R.small(full), ["metric", "system"]).withColumn("at", F.try_element_at(order, F.col("system")))
    a, b = (long.select("metric", "qid", F.col("system").alias(f"system_{x}"), F.col("v").cast("double").alias(x), F.col("at").alias(f"at_{x}")) for x in "ab")
    pairs = a.join(b, ["metric", "qid"]).where("at_a < at_b").select(F.struct("metric", "system_a", "system_b").alias("name"), "qid", "a", "b")
    got = M.bootstrap(spark, pairs, resamples=resamples, alpha=alpha)
    return got.select("name.*", "mean_a", "mean_b", "mean_diff", "ci_low", "ci_high", F.lit(alpha).alias("alpha"), "n", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


def run_eval(spark: SparkSession, questions: DataFrame, systems: dict[str, DataFrame], judge=None, *, alpha: float = 0.05, resamples: int = 2_000, keep=lambda df: df) -> dict[str, DataFrame]:
    """All systems' answers against all questions: rows, summary, tiers, pairwise.

    The rows are read several times: ``keep`` may write them and give them back as read, so that no model is asked again.
    """
    answers = reduce(DataFrame.unionByName, systems.values())
    rows = keep(run_rows(questions, answers, judge))
    return {"rows": rows, "summary": summary(rows), "tiers": tier_counts(questions), "pairwise": pairwise(spark, rows, questions, list(systems), alpha=alpha, resamples=resamples)}


def bridge(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of an evaluation as trace rows: one session a question, one turn a system; unknown questions are left out."""
    q = questions.select(F.col("id").alias("qid"), "question", F.coalesce("ground_truth_citations", F.array().cast("array<string>")).alias("gold_doc_ids"))
    j = rows.select("qid", "system", "answer", "citations").join(R.small(q), "qid")
    text = F.concat(F.lit("System `"), "system", F.lit("` answered: "), F.substring(F.coalesce("answer", F.lit("")), 1, 300))
    ids = F.filter(F.transform(F.coalesce("citations", F.array().cast(CITATIONS)), lambda c: c["source_path"]), lambda p: F.coalesce(p, F.lit("")) != "")
    return j.select(F.col("qid").alias("session_id"), F.col("system").alias("turn_id"), F.coalesce("question", F.lit("")).alias("user_question"), F.coalesce("question", F.lit("")).alias("retrieval_query"), ids.alias("retrieved_doc_ids"), "gold_doc_ids", F.struct(F.array(text).alias("public_trace")).alias("agent_state"))
