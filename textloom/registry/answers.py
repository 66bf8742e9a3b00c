"""Parsing and validating answers.

There are no stored answers among the tables, so they are derived from the
documents: every document gives one answer, and its id decides the shape the
answer comes in (clean, fenced, wrapped in prose, cut off, ...).  Both engines
build the same answers and then read them.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import jsonx as J, prompts as P
from textloom.functions.text import line_list
from textloom.operators.matrix import SEVERITY_LEVELS, risk_matrix as risk_matrix_of
from textloom.operators.model_map import Replay, Rules, model_map, prompt_hash
from textloom.plans import distill as D, evaluate as E, faq as Q, issues as I, rollup as R, toolstep as S
from textloom.operators import sets
from textloom.operators.once import add_checked, add_once, resolve
from textloom.operators.sampling import first_n, sample_n
from textloom.registry.base import documents, spread, sql_text, sql_trim, table

FENCE = "```"


# One answer per document ------------------------------------------------------
def _answers(spark, d):
    body = F.to_json(F.struct("doc_id", "lang", "text", F.col("n_chars").alias("n")))
    shape = F.col("doc_id") % 7
    response = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}")))
        .when(shape == 2, F.concat(F.lit("Here you are: "), body, F.lit(" Anything else?")))
        .when(shape == 3, F.concat(body, F.lit(" done")))
        .when(shape == 4, F.concat(body, F.lit("}")))
        .when(shape == 5, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.col("text"))
    )
    return documents(spark, d).select("doc_id", response.alias("response"))


def _read(df, parser):
    parsed = add_once(df, F.struct(parser(F.col("response")).alias("v")))
    return parsed.select(
        "doc_id", F.col("v").isNotNull().alias("ok"), J.is_object(F.col("v")).alias("is_object"),
        F.try_variant_get("v", "$.lang", "string").alias("lang"),
        F.try_variant_get("v", "$.n", "bigint").alias("n"),
        F.try_variant_get("v", "$.text", "string").alias("text"),
    )


def parse_strict(spark, d):
    return _read(_answers(spark, d), J.parse_strict)


def parse_lenient(spark, d):
    return _read(_answers(spark, d), J.parse_lenient)


def parse_unfenced(spark, d):
    return _read(_answers(spark, d), J.parse_unfenced)


def parse_braces(spark, d):
    return _read(_answers(spark, d), J.parse_braces)


def parse_or_text(spark, d):
    p = _answers(spark, d).select("doc_id", J.parse_or_text(F.col("response")).alias("p"))
    return p.select(
        "doc_id", "p.is_json", F.when(~F.col("p.is_json"), F.col("p.text")).alias("kept_text"),
        F.try_variant_get("p.value", "$.lang", "string").alias("lang"),
        F.try_variant_get("p.value", "$[0].lang", "string").alias("first_lang"),
    )


# Issue records ----------------------------------------------------------------
def _analyzed(spark, d, check_domains=False):
    words = F.array("lang", "source")
    level = F.element_at(F.array(*[F.lit(x) for x in SEVERITY_LEVELS]), (F.col("n_chars") % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    analysis = F.struct(
        F.struct(level.alias("level"), F.lit("by length").alias("justification")).alias("severity"),
        F.struct(
            F.col("lang").alias("label"), ((F.col("n_chars") % 120) / 100.0).alias("confidence"), words.alias("keywords")
        ).alias("category"),
        F.struct(F.col("source").alias("domain"), F.col("lang").alias("subcategory")).alias("type"),
        F.col("text").alias("summary"),
        words.alias("impacted_entities"),
        none.alias("likely_consequences"),
    )
    record = F.struct(
        F.lit("made up").alias("id"), F.col("text").alias("input_text"), F.lit(True).alias("is_issue"),
        analysis.alias("issue_analysis"),
        F.struct(
            F.array("source").alias("persons"), none.alias("organizations"), words.alias("locations"),
            none.alias("dates"), F.array(F.col("n_chars").cast("string")).alias("misc"),
        ).alias("named_entities"),
        F.struct(words.alias("steps"), F.lit("none").alias("reasoning")).alias("explanation"),
    )
    body, shape = F.to_json(record), F.col("doc_id") % 6
    bare = F.to_json(record.dropFields("issue_analysis"))
    response = (
        F.when(shape == 1, F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}")))
        .when(shape == 2, F.concat(F.substring(bare, 1, F.length(bare) - 1), F.lit(',"issue_analysis":null}')))
        .when(shape == 3, bare)
        .when(shape == 4, F.replace(body, F.lit('"is_issue":true'), F.lit('"is_issue":"maybe"')))
        .otherwise(body)
    )
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text", response.alias("_answer"))
    return I.analyze_issues(docs, Rules(F.col("_answer")), check_domains=check_domains)


def validate_issue(spark, d):
    return _analyzed(spark, d).select("id", "ok", "error")


def validate_issue_domains(spark, d):
    return _analyzed(spark, d, True).select("id", "ok", "error")


def issue_facts(spark, d):
    return I.issue_facts(I.issue_records(_analyzed(spark, d)))


def issue_entities(spark, d):
    return I.issue_entities(I.issue_records(_analyzed(spark, d)))


def risk_matrix(spark, d):
    return risk_matrix_of(I.issue_records(_analyzed(spark, d)))


# Question-answer generation ---------------------------------------------------
PERSONAS = {"student": "You are a new student.", "teacher": "You teach this subject."}


def _faq_answered(spark, d):
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    ask = lambda n: F.concat("persona", F.lit(f" {n} on "), "lang")
    said = F.concat("source", F.lit(" has "), F.col("n_chars").cast("string"))
    pairs = F.array(pair(ask(1), said), pair(ask(2), F.col("text")), pair(ask(3), F.col("lang")), pair(ask(4), said))
    body, shape = F.to_json(pairs), F.col("doc_id") % 5
    response = (
        F.when(shape == 1, F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}")))
        .when(shape == 2, F.replace(body, F.concat(F.lit(',"answer":"'), "lang", F.lit('"')), F.lit("")))
        .when(shape == 3, F.concat(F.lit('{"items":'), body, F.lit("}")))
        .otherwise(body)
    )
    chunks = documents(spark, d).withColumn("chunk_id", F.col("doc_id")).withColumn("course", F.col("source"))
    return Q.answer_faqs(chunks, PERSONAS, "Write {k} pairs.", 3, Rules(response))


def faq_explode(spark, d):
    return Q.faq_rows(_faq_answered(spark, d))


def faq_outcomes(spark, d):
    a = _faq_answered(spark, d)
    return a.groupBy("persona").agg(
        F.count_if("parsed.ok").alias("parsed"), F.count_if(~F.col("parsed.ok")).alias("failed"),
        F.sum("parsed.bad_pairs").alias("bad_pairs"), F.sum(F.size("parsed.pairs")).alias("pairs"),
    )


def faq_prompts(spark, d):
    chunks = documents(spark, d, "doc_id", "text")
    p = Q.faq_prompts(chunks, PERSONAS, "Write {k} pairs.", 3)
    return p.select("doc_id", "persona", "prompt")


def _persona_set(spark, d, lang):
    docs = table(spark, d, "documents").filter(F.col("lang") == lang)
    return docs.select("doc_id", F.col("lang").alias("persona"), F.col("source").alias("course"))


def merge_personas(spark, d):
    """One set per language of the table, and one that does not exist."""
    langs = table(spark, d, "documents").select("lang").distinct().limit(1001).collect()
    if len(langs) > 1000:
        raise ValueError("more than 1000 personas")
    found = {r["lang"]: _persona_set(spark, d, r["lang"]) for r in langs}
    return sets.merge_personas({**found, "xx": None})


def merge_sources(spark, d):
    """Documents know their course, benchmark items take the name of theirs."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("course"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sets.merge_sources({"documents": docs, "benchmark": items})


def faq_counts(spark, d):
    return sets.counts_by(merge_sources(spark, d), "course")


def sample_seeded(spark, d):
    return sample_n(table(spark, d, "documents").select("doc_id", "lang"), 25, "doc_id", 42)


def sample_per_source(spark, d):
    return sample_n(table(spark, d, "documents").select("doc_id", "source"), 3, "doc_id", 7, by="source")


# Evaluation sets and judgements -----------------------------------------------
def eval_set(spark, d):
    """Paraphrases in three lines, blank lines and a repeat among them; the
    Spanish ones failed."""
    question = F.concat(F.lit("What of "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit("?"))
    faq = documents(spark, d).select(
        F.col("doc_id").alias("faq_id"), question.alias("question"), F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("source_text"), F.col("lang").alias("answer"),
    )
    lines = F.concat(F.lit(" Tell me: "), "question", F.lit(" \n\n"), "question", F.lit("\n  \nSo, "), "question",
                     F.lit("\nWell, "), "question", F.lit("\n"))
    items = E.make_eval_set(faq, Rules(F.when(F.col("answer") != "es", lines)), None, 3)
    return items.drop("source_text")


def lines(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return docs.select("doc_id", F.posexplode(line_list(F.col("text"))).alias("line_no", "line"))


def _judged(spark, d, failed_as_zero=False):
    n = F.col("n_chars")
    c, m, r = n % 5 + 1, n % 3 + 3, n % 2 + 4
    mean = F.round((c + m + r) / 3.0, 1)
    body = F.to_json(F.struct(
        mean.alias("overall_score"), c.alias("correctness"), m.alias("completeness"), r.alias("relevance"),
        F.col("generated_answer").alias("justification"),
    ))
    shape = F.col("doc_id") % 4
    response = (
        F.when(shape == 1, F.concat(F.lit("Score: "), body, F.lit(" (final)")))
        .when(shape == 2, F.lit("I cannot say."))
        .otherwise(body)
    )
    rows = documents(spark, d).select(
        "doc_id", "source", "n_chars", F.concat(F.lit("On "), "lang", F.lit("?")).alias("question"),
        F.col("text").alias("generated_answer"), F.col("lang").alias("answer"),
    )
    return E.judge(rows, Rules(response), failed_as_zero=failed_as_zero)


def judge_scores(spark, d):
    j = _judged(spark, d)
    return j.select(
        "doc_id", "judge_ok", "llm_judge_score", "llm_judge_correctness", "llm_judge_completeness",
        "llm_judge_relevance", E.consistent_judgement().alias("consistent"),
    )


def judge_means(spark, d):
    j = _judged(spark, d)
    return j.groupBy("source").agg(
        *[F.round(F.avg(c), 6).alias(m) for c, m in zip(E.JUDGE_FIELDS, E.JUDGE_MEANS)],
        F.count_if("judge_ok").alias("judged"),
    )


def _judged_projects(spark, d):
    """Evaluation rows with both kinds of scores; a length decides the rank at
    which the right chunk was found, and one language only has originals."""
    rank = F.col("n_chars") % 7
    facts = _judged(spark, d).select(
        "doc_id",
        F.concat(F.lit("projects/"), "answer", F.lit("/"), "source", F.lit("/individual")).alias("project_path"),
        ((F.col("answer") == "es") | (F.col("doc_id") % 5 == 0)).alias("is_original"),
        F.when(rank > 0, rank.cast("int")).alias("correct_chunk_position"),
        *[((rank > 0) & (rank <= k)).cast("int").alias(f"_in_{k}") for k in E.DEFAULT_KS],
        *E.JUDGE_FIELDS,
    )
    details = E.with_metrics(facts, ["project_path", "is_original", *E.JUDGE_FIELDS])
    return E.project_metrics(details, ["project_path"])


_ROLLED = ("hit_at_3", "mrr", "precision_at_5", "recall_at_1", "ndcg_at_5", *E.JUDGE_MEANS)


def judged_projects(spark, d):
    p = _judged_projects(spark, d)
    return p.select("project_path", "total_questions", "judged", *[F.round(c, 6).alias(c) for c in _ROLLED])


def judged_rollup(spark, d):
    """Parents over their projects; judge means weighted by all questions."""
    r = R.parent_summaries(_judged_projects(spark, d))
    top = R.overall_summary(_judged_projects(spark, d), judge_weight="judged")
    shape = lambda df, key: df.select(
        F.col(key).alias("level"), "total_questions", "total_evaluated", *[F.round(c, 6).alias(c) for c in _ROLLED]
    )
    return shape(r, "parent").unionByName(shape(top, "project_folder"))


def error_counts(spark, d):
    return D.error_counts(_labelled(spark, d))


def last_per_question(spark, d):
    """Many documents ask the same; the last one of each question stays."""
    rows = documents(spark, d).select(
        "doc_id", F.concat(F.lit("About "), "source", F.lit(" in "), "lang").alias("question"), "n_chars"
    )
    return E.last_per_question(rows, "doc_id")


# Model boundary ---------------------------------------------------------------
def replay_join(spark, d):
    """Stored answers exist for two of the languages, keyed by prompt digest."""
    docs = documents(spark, d, "doc_id", "text", "lang")
    known = table(spark, d, "documents").filter(F.col("lang").isin("en", "fr"))
    stored = known.select(
        prompt_hash(F.col("text")).alias("prompt_hash"), F.concat(F.lit("answer "), F.md5("text")).alias("response")
    )
    out = model_map(docs, "text", Replay(stored))
    return out.select("doc_id", "lang", "response", "error", "attempts", "backend")


# Records, training text, scoring ----------------------------------------------
EXAMPLE = {"document_id": "d1", "severity_level": "low", "explanation": "why", "score": 1, "notes": None}


def _records(spark, d):
    """A user prompt of every kind the field can take."""
    n = F.col("doc_id") % 6
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("texto")))
    user = (
        F.when(n == 0, F.to_json(F.array("lang")))
        .when(n == 1, whole)
        .when(n == 2, F.to_json(F.struct("lang")))
        .when(n == 3, F.col("n_chars").cast("string"))
        .otherwise(F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))
    )
    system = (
        F.when(F.col("n_chars") % 5 == 0, "null").when(F.col("n_chars") % 5 == 1, "7").otherwise('"Label the text."')
    )
    return documents(spark, d).select(
        "doc_id", "lang", "text", "n_chars",
        F.inline_outer(F.array(F.struct(
            F.parse_json(system).alias("system_prompt"), F.parse_json(user).alias("user_prompt")
        ))),
    )


def _labelled(spark, d, field=None):
    body = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("severity_level"),
        F.col("text").alias("explanation"), F.col("n_chars").alias("score"), F.lit("drop me").alias("extra"),
    ))
    shape = F.col("n_chars") % 4
    response = (
        F.when(shape == 1, F.replace(body, F.lit('"severity_level"'), F.lit('"severity"')))
        .when(shape == 2, F.concat(body, F.lit(" ok?")))
        .otherwise(body)
    )
    return D.label_records(_records(spark, d), EXAMPLE, Rules(response), field)


def label_records(spark, d):
    return _labelled(spark, d).select("doc_id", "teacher_output", "error")


def label_field(spark, d):
    return _labelled(spark, d, "explanation").select("doc_id", "teacher_output", "error")


def _training(spark, d):
    """Labelled records as variants; quality labels are the teacher's output."""
    docs = documents(spark, d, "doc_id", "text", "lang", "n_chars")
    marked = docs.join(table(spark, d, "labels"), "doc_id", "left")
    out = F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality", "toxic"))).otherwise("null")
    user = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    whole = F.concat(
        F.lit('{"system_prompt":"Rate the text.","user_prompt":'), user, F.lit(',"teacher_output":'), out, F.lit("}")
    )
    shape = F.col("n_chars") % 5
    record = (
        F.when(shape == 0, F.to_json(F.array("lang")))
        .when(shape == 1, F.concat(F.lit('{"user_prompt":'), user, F.lit("}")))
        .otherwise(whole)
    )
    return add_once(marked.select("doc_id", "text", "lang", "n_chars", "quality", "toxic"),
                    F.struct(F.parse_json(record).alias("record"))).select("doc_id", "record")


def require_keys(spark, d):
    return D.require_keys(_training(spark, d), "record", D.RECORD_KEYS).select("doc_id")


def drop_counts(spark, d):
    return D.drop_counts(_training(spark, d), "record", D.RECORD_KEYS)


def sft_text(spark, d):
    return D.sft_texts(D.sft_examples(_training(spark, d), order_by="doc_id"), "</s>").select("doc_id", "text")


def batch_score(spark, d):
    """The model answers with its own prompt: in JSON, in prose or bare."""
    shape = F.col("doc_id") % 3
    seen = F.to_json(F.struct(F.length("prompt").alias("seen")))
    response = F.when(shape == 0, seen).when(shape == 1, F.concat(F.lit(" Sure: "), seen, F.lit("\n"))).otherwise(
        F.concat(F.lit("  seen "), F.length("prompt").cast("string"), F.lit(" "))
    )
    scored = D.batch_score(_training(spark, d), Rules(response))
    return scored.select("doc_id", "system_prompt", "student_output", "is_json")


# Tool steps -------------------------------------------------------------------
def _steps(spark, d):
    return spread(table(spark, d, "events"), "event_id").select(
        "event_id", "props",
        F.lit("Read the event.").alias("system_prompt"), F.lit("What is k?").alias("user_prompt"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props")).alias("input_dict"),
        F.lit('{"k": int}').alias("output_schema"),
    )


def tool_prompt(spark, d):
    return S.tool_prompts(_steps(spark, d)).select("event_id", "prompt")


def tool_step(spark, d):
    shape = F.col("event_id") % 4
    response = (
        F.when(shape == 1, F.lit("{}")).when(shape == 2, F.concat(F.lit("["), "props", F.lit("]")))
        .when(shape == 3, F.concat(F.lit("k: "), "props")).otherwise(F.col("props"))
    )
    done = S.step_result(S.tool_step(_steps(spark, d), Rules(response)), "reader")
    return done.select("event_id", "raw_output", "json_output", "error", "reader")


def tool_chain(spark, d):
    """Two named steps over the same rows; the second one finds no object in every third answer."""
    n = F.col("event_id")
    shape = F.when(n % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit('{"n":'), n.cast("string"), F.lit("}")))
    columns = {c: F.col(c) for c in ("system_prompt", "user_prompt", "input_dict", "output_schema")}
    other = {**columns, "user_prompt": F.lit("Which number?"), "output_schema": F.lit('{"n": int}')}
    done = S.tool_chain(_steps(spark, d), {"reader": (columns, Rules(F.col("props"))), "counter": (other, Rules(shape))})
    return done.select("event_id", "reader", "counter")


# Lanes of refused answers, prompts, samples --------------------------------------
LANE_ANSWER = T.StructType([J.required("doc_id", T.LongType()), J.required("lang", T.StringType()), J.nullable("n", T.LongType())])


def answer_lanes(spark, d):
    """What a refused answer becomes: null, a default, or no row."""
    checked = add_checked(_answers(spark, d).withColumnRenamed("doc_id", "id"), J.parse_strict(F.col("response")), LANE_ANSWER)
    kind = checked.schema["checked"].dataType["payload"].dataType
    default = F.struct(F.lit(-1).cast("long").alias("doc_id"), F.lit("none").alias("lang"), F.lit(0).cast("long").alias("n")).cast(kind)
    lanes = [resolve(checked, "null"), resolve(checked, "default", default), resolve(checked, "drop")]
    out = [df.select(F.lit(name).alias("lane"), "id", "payload.lang", "payload.n", "error") for name, df in zip(("null", "default", "drop"), lanes)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def model_prompts(spark, d):
    """Prompts that paraphrase, judge, show an example, and ask a trained model."""
    docs = documents(spark, d, "doc_id", "text", "lang", "source")
    text = F.col("text")
    kinds = {
        "paraphrase": P.paraphrase_prompt(F.col("source"), 3),
        "judge": P.judge_prompt(F.col("source"), text, F.col("lang")),
        "example": P.example_system_prompt(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), {"é": 1, "list": ["x"]}),
        "inference": P.inference_prompt(F.col("lang"), text, preamble=True),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("kind"), prompt.alias("prompt")) for name, prompt in kinds.items()])
    return docs.select("doc_id", F.inline(rows))


def first_rows(spark, d):
    """The first 700 documents by id: more than a partition of a small table holds."""
    return first_n(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 700, "doc_id")


QUERIES = {
    "tool_chain": tool_chain,
    "answer_lanes": answer_lanes,
    "model_prompts": model_prompts,
    "first_rows": first_rows,
    "parse_strict": parse_strict,
    "parse_lenient": parse_lenient,
    "parse_unfenced": parse_unfenced,
    "parse_braces": parse_braces,
    "parse_or_text": parse_or_text,
    "validate_issue": validate_issue,
    "validate_issue_domains": validate_issue_domains,
    "issue_facts": issue_facts,
    "issue_entities": issue_entities,
    "risk_matrix": risk_matrix,
    "faq_explode": faq_explode,
    "faq_outcomes": faq_outcomes,
    "faq_prompts": faq_prompts,
    "merge_personas": merge_personas,
    "merge_sources": merge_sources,
    "faq_counts": faq_counts,
    "sample_seeded": sample_seeded,
    "sample_per_source": sample_per_source,
    "eval_set": eval_set,
    "lines": lines,
    "judge_scores": judge_scores,
    "judge_means": judge_means,
    "judged_projects": judged_projects,
    "judged_rollup": judged_rollup,
    "error_counts": error_counts,
    "last_per_question": last_per_question,
    "replay_join": replay_join,
    "label_records": label_records,
    "label_field": label_field,
    "require_keys": require_keys,
    "drop_counts": drop_counts,
    "sft_text": sft_text,
    "batch_score": batch_score,
    "tool_prompt": tool_prompt,
    "tool_step": tool_step,
}

# Oracles ----------------------------------------------------------------------
_EXAMPLE = '\n\nAnswer only with a JSON object that has the keys and types of this example:\n{\n  "é": 1,\n  "list": [\n    "x"\n  ]\n}'
_MARKING = (
    "\n\nMark the text by what is known to be right. Reply with one JSON object and nothing else. "
    "Give whole numbers under the keys correctness, completeness and relevance, a decimal number under "
    "overall_score, and a short reason under justification."
)
_PROMPTS_SQL = f"""
  SELECT doc_id, unnest(['paraphrase', 'judge', 'example', 'inference']) AS kind, unnest([
    concat({sql_text('Ask the same question in 3 other ways, one per line, without numbering.' + chr(10) * 2 + 'Question: "')}, source, '"'),
    concat({sql_text('A reader asked:' + chr(10))}, source, {sql_text(chr(10) * 2 + 'The text to mark:' + chr(10))}, text,
           {sql_text(chr(10) * 2 + 'What is known to be right:' + chr(10))}, lang, {sql_text(_MARKING)}),
    concat(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, {sql_text(_EXAMPLE)}),
    concat({sql_text(P.SFT_PREAMBLE + '### Instruction:' + chr(10))}, lang, {sql_text(chr(10) * 2 + '### Input:' + chr(10))}, {sql_trim('text')},
           {sql_text(chr(10) * 2 + '### Response:' + chr(10))})]) AS prompt
  FROM documents"""
_OPEN, _CLOSE = f"concat('{FENCE}json', chr(10))", f"concat(chr(10), '{FENCE}')"
_BODY = "CAST(to_json({'doc_id': doc_id, 'lang': lang, 'text': text, 'n': n_chars}) AS VARCHAR)"
_ANSWERS = f"""
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN b WHEN 1 THEN concat({_OPEN}, b, {_CLOSE})
    WHEN 2 THEN concat('Here you are: ', b, ' Anything else?') WHEN 3 THEN concat(b, ' done')
    WHEN 4 THEN concat(b, '}}') WHEN 5 THEN concat('[', b, ']') ELSE text END AS r
  FROM (SELECT *, {_BODY} AS b FROM documents)"""
_SPAN = r"'(?s)\{.*\}'"


def _valid(*candidates: str) -> str:
    tests = " ".join(f"WHEN json_valid({c}) THEN {c}" for c in candidates)
    return f"CASE {tests} END"


def _parsed(expr: str) -> str:
    return f"""
      SELECT doc_id, v IS NOT NULL AS ok, coalesce(json_type(v) = 'OBJECT', false) AS is_object,
             json_extract_string(v, '$.lang') AS lang, CAST(json_extract(v, '$.n') AS BIGINT) AS n,
             json_extract_string(v, '$.text') AS text
      FROM (SELECT doc_id, {expr} AS v FROM ({_ANSWERS}))"""


_LEVEL = "['low', 'moderate', 'high', 'critical'][n_chars % 4 + 1]"
_ISSUES = f"""
  SELECT doc_id, n_chars, lang, source, text, {_LEVEL} AS severity, (n_chars % 120) / 100.0 AS confidence,
         doc_id % 6 AS shape FROM documents"""
_ISSUE_ERROR = ("CASE shape WHEN 3 THEN '$.issue_analysis: missing' WHEN 4 THEN '$.is_issue: not boolean' END")
_HAS_ANALYSIS = "shape IN (0, 1, 5)"

_PAIRS = " UNION ALL ".join(
    f"SELECT doc_id, source, text, lang, doc_id % 5 AS shape, '{p}' AS persona, {n} AS pos, "
    f"concat('{p} {n + 1} on ', lang) AS question, {a} AS answer FROM documents"
    for p in PERSONAS
    for n, a in enumerate(("concat(source, ' has ', n_chars)", "text", "lang"))
)
_GOOD_PAIR = "shape <> 3 AND NOT (shape = 2 AND pos = 2)"
_MERGED = (
    "SELECT doc_id AS id, text, source AS course FROM documents "
    "UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark"
)
_QUESTION = "concat('What of ', source, ' ', doc_id, '?')"
_JUDGED = """
  SELECT doc_id, source, doc_id % 4 <> 2 AS judge_ok, n_chars % 5 + 1 AS c, n_chars % 3 + 3 AS m, n_chars % 2 + 4 AS r
  FROM documents"""
_SCORE = "round(CAST(c + m + r AS DOUBLE) / 3.0, 1)"
_JUDGED_ROWS = f"""
  SELECT concat('projects/', d.lang, '/', d.source, '/individual') AS project_path,
         d.lang = 'es' OR doc_id % 5 = 0 AS is_original, nullif(d.n_chars % 7, 0) AS pos, judge_ok, c, m, r,
         {_SCORE} AS score
  FROM ({_JUDGED}) JOIN documents d USING (doc_id)"""
_JUDGED_PROJECTS = """
  SELECT project_path, count(*) AS total_questions, count(*) FILTER (WHERE judge_ok) AS judged,
         avg(CAST(coalesce(pos <= 3, false) AS DOUBLE)) AS hit_at_3, avg(coalesce(1.0 / pos, 0.0)) AS mrr,
         avg(CASE WHEN pos <= 5 THEN 1 / 5.0 ELSE 0.0 END) AS precision_at_5,
         avg(CAST(coalesce(pos <= 1, false) AS DOUBLE)) AS recall_at_1,
         avg(CASE WHEN pos <= 5 THEN 1.0 / log2(pos + 1.0) ELSE 0.0 END) AS ndcg_at_5,
         avg(score) FILTER (WHERE judge_ok) AS avg_llm_score, avg(c) FILTER (WHERE judge_ok) AS avg_correctness,
         avg(m) FILTER (WHERE judge_ok) AS avg_completeness, avg(r) FILTER (WHERE judge_ok) AS avg_relevance
  FROM (SELECT *, bool_or(NOT is_original) OVER (PARTITION BY project_path) AS has FROM (@ROWS@))
  WHERE NOT is_original OR NOT has GROUP BY project_path""".replace("@ROWS@", _JUDGED_ROWS)


def _rolled(weight: str) -> str:
    w = f"CASE WHEN avg_llm_score IS NOT NULL THEN {weight} END"
    plain = [f"round(sum({c} * total_questions) / sum(total_questions), 6) AS {c}" for c in _ROLLED[:5]]
    judged = [f"round(sum({c} * ({w})) / nullif(sum({w}), 0), 6) AS {c}" for c in _ROLLED[5:]]
    return (
        "CAST(sum(total_questions) AS BIGINT) AS total_questions, "
        f"CAST(coalesce(sum({w}), 0) AS BIGINT) AS total_evaluated, " + ", ".join(plain + judged)
    )


_TEXT_JSON = "CAST(to_json(text) AS VARCHAR)"
_LABELLED = """
  SELECT doc_id, lang, text, n_chars, n_chars % 5 AS s, doc_id % 6 AS u, n_chars % 4 AS shape FROM documents"""
_LABEL_ERROR = """
  CASE WHEN s = 1 THEN 'system_prompt must be a string or null'
       WHEN u IN (0, 3) THEN 'user_prompt must be a string or an object'
       WHEN u = 2 THEN 'user_prompt object lacks a required key'
       WHEN shape = 1 THEN '$.severity_level: missing' WHEN shape = 2 THEN 'not JSON' END"""
_TRAINING = """
  SELECT d.doc_id, d.text, d.n_chars % 5 AS shape, l.doc_id IS NOT NULL AS labelled, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
_NL = "chr(10)"
_SFT_HEAD = sql_text(
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request."
)
_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SEEN = (
    f"length(concat('### Instruction:', {_NL}, 'Rate the text.', {_NL}, {_NL}, '### Input:', {_NL}, {_TRIMMED}, "
    f"{_NL}, {_NL}, '### Response:', {_NL}))"
)

ORACLE = {
    "parse_strict": _parsed(_valid("r")),
    "parse_lenient": _parsed(
        _valid("r", f"regexp_extract(r, '(?s){FENCE}json(.*?){FENCE}', 1)", f"regexp_extract(r, {_SPAN}, 0)")
    ),
    "parse_unfenced": _parsed(_valid(f"regexp_replace(r, '{FENCE}json|{FENCE}', '', 'g')")),
    "parse_braces": _parsed(
        _valid(f"CASE WHEN regexp_extract(r, {_SPAN}, 0) <> '' THEN regexp_extract(r, {_SPAN}, 0) ELSE r END")
    ),
    "parse_or_text": rf"""
      SELECT doc_id, v IS NOT NULL AS is_json, CASE WHEN v IS NULL THEN t END AS kept_text,
             json_extract_string(v, '$.lang') AS lang, json_extract_string(v, '$[0].lang') AS first_lang
      FROM (SELECT doc_id, t, {_valid("regexp_extract(t, '(?s)[{[].*[}]]|[{[].*[]}]', 0)", "t")} AS v
            FROM (SELECT doc_id, regexp_replace(r, '^\s+|\s+$', '', 'g') AS t FROM ({_ANSWERS})))""",
    "validate_issue": f"SELECT doc_id AS id, {_ISSUE_ERROR} IS NULL AS ok, {_ISSUE_ERROR} AS error FROM ({_ISSUES})",
    "validate_issue_domains": f"""
      SELECT doc_id AS id, e IS NULL AS ok, e AS error FROM (
        SELECT doc_id, coalesce({_ISSUE_ERROR}, CASE WHEN {_HAS_ANALYSIS} AND confidence > 1.0
               THEN '$.issue_analysis.category.confidence: outside 0..1' END) AS e FROM ({_ISSUES}))""",
    "issue_facts": f"""
      SELECT CAST(doc_id AS VARCHAR) AS id, true AS is_issue,
             CASE WHEN {_HAS_ANALYSIS} THEN severity END AS severity,
             CASE WHEN {_HAS_ANALYSIS} THEN lang END AS category,
             CAST(CASE WHEN {_HAS_ANALYSIS} THEN confidence END AS DOUBLE) AS confidence,
             CASE WHEN {_HAS_ANALYSIS} THEN source END AS domain,
             CASE WHEN {_HAS_ANALYSIS} THEN lang END AS subcategory,
             CASE WHEN {_HAS_ANALYSIS} THEN text END AS summary
      FROM ({_ISSUES}) WHERE shape NOT IN (3, 4)""",
    "issue_entities": f"""
      SELECT CAST(doc_id AS VARCHAR) AS id, kind, unnest(names) AS entity FROM (
        SELECT doc_id, 'persons' AS kind, [source] AS names FROM ({_ISSUES}) WHERE shape NOT IN (3, 4)
        UNION ALL SELECT doc_id, 'locations', [lang, source] FROM ({_ISSUES}) WHERE shape NOT IN (3, 4)
        UNION ALL SELECT doc_id, 'misc', [CAST(n_chars AS VARCHAR)] FROM ({_ISSUES}) WHERE shape NOT IN (3, 4))""",
    "risk_matrix": f"""
      SELECT source AS domain, {", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in SEVERITY_LEVELS)},
             CAST(0 AS BIGINT) AS other FROM ({_ISSUES}) WHERE {_HAS_ANALYSIS} GROUP BY source""",
    "faq_explode": f"""
      SELECT concat(source, '/', doc_id, '/', persona, '/', CASE WHEN shape = 2 AND pos > 2 THEN pos - 1 ELSE pos END)
             AS faq_id, text AS source_text, CAST(doc_id AS VARCHAR) AS chunk_id, question, answer,
             source AS course, persona
      FROM ({_PAIRS}) WHERE {_GOOD_PAIR}""",
    "faq_outcomes": f"""
      SELECT persona, count(*) FILTER (WHERE pos = 0 AND shape <> 3) AS parsed,
             count(*) FILTER (WHERE pos = 0 AND shape = 3) AS failed,
             count(*) FILTER (WHERE shape = 2 AND pos = 2) AS bad_pairs,
             count(*) FILTER (WHERE {_GOOD_PAIR}) AS pairs
      FROM ({_PAIRS}) GROUP BY persona""",
    "faq_prompts": " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS persona, concat({sql_text(v)}, {_NL}, {_NL}, 'Write 3 pairs.', {_NL}, {_NL}, "
        f"'Return exactly k = 3 items.', {_NL}, {_NL}, {_NL}, 'Base text:', {_NL}, '\"\"\"', text, '\"\"\"') AS prompt "
        "FROM documents"
        for p, v in PERSONAS.items()
    ),
    "merge_personas": "SELECT doc_id, lang AS persona, source AS course FROM documents",
    "merge_sources": _MERGED,
    "faq_counts": f"SELECT course, count(*) AS n FROM ({_MERGED}) GROUP BY course",
    "sample_seeded": "SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 25",
    "sample_per_source": """
      SELECT doc_id, source FROM documents
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat('7:', doc_id)), doc_id) <= 3""",
    "eval_set": f"""
      WITH q AS (SELECT doc_id, lang, {_QUESTION} AS question FROM documents),
      a AS (
        SELECT doc_id, lang, question AS original, 0 AS pos, question FROM q
        UNION ALL SELECT doc_id, lang, question, 1,
               CASE WHEN lang = 'es' THEN question ELSE concat('Tell me: ', question) END FROM q
        UNION ALL SELECT doc_id, lang, question, 2, question FROM q WHERE lang <> 'es'
        UNION ALL SELECT doc_id, lang, question, 3, concat('So, ', question) FROM q WHERE lang <> 'es')
      SELECT concat(doc_id, '#', pos) AS item_id, question, CAST(doc_id AS VARCHAR) AS correct_chunk_id,
             question = original AS is_original, lang AS answer, lang <> 'es' AS variation_ok FROM a""",
    "lines": rf"""
      SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, s[i] AS line FROM (
        SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
          SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents))""",
    "judge_scores": f"""
      SELECT doc_id, judge_ok, CASE WHEN judge_ok THEN {_SCORE} END AS llm_judge_score,
             CASE WHEN judge_ok THEN c END AS llm_judge_correctness, CASE WHEN judge_ok THEN m END
             AS llm_judge_completeness, CASE WHEN judge_ok THEN r END AS llm_judge_relevance,
             CASE WHEN judge_ok THEN true END AS consistent FROM ({_JUDGED})""",
    "judge_means": f"""
      SELECT source, round(avg({_SCORE}) FILTER (WHERE judge_ok), 6) AS avg_llm_score,
             round(avg(c) FILTER (WHERE judge_ok), 6) AS avg_correctness,
             round(avg(m) FILTER (WHERE judge_ok), 6) AS avg_completeness,
             round(avg(r) FILTER (WHERE judge_ok), 6) AS avg_relevance, count(*) FILTER (WHERE judge_ok) AS judged
      FROM ({_JUDGED}) GROUP BY source""",
    "judged_projects": f"""
      SELECT project_path, total_questions, judged, {", ".join(f"round({c}, 6) AS {c}" for c in _ROLLED)}
      FROM ({_JUDGED_PROJECTS})""",
    "judged_rollup": f"""
      SELECT concat('projects/', split_part(project_path, '/', 2), '/', split_part(project_path, '/', 3)) AS level,
             {_rolled('total_questions')} FROM ({_JUDGED_PROJECTS}) GROUP BY 1
      UNION ALL SELECT split_part(project_path, '/', 2), {_rolled('judged')} FROM ({_JUDGED_PROJECTS}) GROUP BY 1""",
    "error_counts": f"SELECT count(*) AS rows, count(e) AS errors FROM (SELECT {_LABEL_ERROR} AS e FROM ({_LABELLED}))",
    "last_per_question": """
      SELECT max(doc_id) AS doc_id, concat('About ', source, ' in ', lang) AS question, arg_max(n_chars, doc_id) AS n_chars
      FROM documents GROUP BY source, lang""",
    "replay_join": """
      WITH stored AS (SELECT DISTINCT sha256(text) AS h, concat('answer ', md5(text)) AS response
                      FROM documents WHERE lang IN ('en', 'fr'))
      SELECT doc_id, lang, response, CASE WHEN response IS NULL THEN 'no response' END AS error,
             CASE WHEN response IS NULL THEN 0 ELSE 1 END AS attempts, 'replay' AS backend
      FROM documents LEFT JOIN stored ON h = sha256(text)""",
    "label_records": f"""
      SELECT doc_id, CASE WHEN e IS NULL THEN CAST(to_json({{'document_id': CAST(doc_id AS VARCHAR),
             'severity_level': lang, 'explanation': text, 'score': n_chars, 'notes': NULL}}) AS VARCHAR) END
             AS teacher_output, e AS error
      FROM (SELECT *, {_LABEL_ERROR} AS e FROM ({_LABELLED}))""",
    "label_field": f"""
      SELECT doc_id, CASE WHEN e IS NULL THEN {_TEXT_JSON} END AS teacher_output, e AS error
      FROM (SELECT *, {_LABEL_ERROR} AS e FROM ({_LABELLED}))""",
    "require_keys": f"SELECT doc_id FROM ({_TRAINING}) WHERE shape > 1",
    "drop_counts": f"""
      SELECT count(*) FILTER (WHERE shape > 1) AS kept, count(*) FILTER (WHERE shape = 0) AS not_objects,
             count(*) FILTER (WHERE shape = 1) AS missing_keys FROM ({_TRAINING})""",
    "sft_text": f"""
      SELECT doc_id, concat({_SFT_HEAD}, {_NL}, {_NL}, '### Instruction:', {_NL}, 'Rate the text.', {_NL}, {_NL},
             '### Input:', {_NL}, text, {_NL}, {_NL}, '### Response:', {_NL},
             to_json({{'quality': quality, 'toxic': toxic}}), '</s>') AS text
      FROM ({_TRAINING}) WHERE shape > 1 AND labelled""",
    "batch_score": f"""
      SELECT doc_id, 'Rate the text.' AS system_prompt,
             CASE WHEN doc_id % 3 = 2 THEN concat('seen ', {_SEEN}) ELSE concat('{{"seen":', {_SEEN}, '}}') END
             AS student_output, doc_id % 3 <> 2 AS is_json
      FROM ({_TRAINING}) WHERE shape > 1""",
    "tool_prompt": f"""
      SELECT event_id, concat('Read the event.', {_NL}, {_NL}, 'Write JSON of this shape:', {_NL},
             '{{"k": int}}', {_NL}, {_NL}, 'What is k?', {_NL}, {_NL}, '## type', {_NL}, {_NL}, event_type, {_NL},
             '## props', {_NL}, {_NL}, props) AS prompt FROM events""",
    "tool_chain": """
      SELECT event_id, replace(props, ': ', ':') AS reader,
             CASE WHEN event_id % 3 = 0 THEN '{"raw_output":"none"}' ELSE concat('{"n":', event_id, '}') END AS counter FROM events""",
    "answer_lanes": f"""
      WITH a AS (SELECT doc_id AS id, lang, n_chars AS n, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 5 THEN '$.doc_id: missing' ELSE 'not JSON' END AS error FROM documents)
      SELECT 'null' AS lane, id, CASE WHEN error IS NULL THEN lang END AS lang, CASE WHEN error IS NULL THEN n END AS n, error FROM a
      UNION ALL SELECT 'default', id, CASE WHEN error IS NULL THEN lang ELSE 'none' END, CASE WHEN error IS NULL THEN n ELSE 0 END, error FROM a
      UNION ALL SELECT 'drop', id, lang, n, error FROM a WHERE error IS NULL""",
    "model_prompts": _PROMPTS_SQL,
    "first_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 700",
    "tool_step": """
      SELECT event_id, raw AS raw_output, CASE event_id % 4 WHEN 0 THEN compact WHEN 1 THEN '{}' END AS json_output,
             CASE event_id % 4 WHEN 2 THEN 'not an object' WHEN 3 THEN 'not JSON' END AS error,
             CASE event_id % 4 WHEN 0 THEN compact ELSE CAST(to_json({'raw_output': raw}) AS VARCHAR) END AS reader
      FROM (SELECT event_id, replace(props, ': ', ':') AS compact,
                   CASE event_id % 4 WHEN 1 THEN '{}' WHEN 2 THEN concat('[', props, ']')
                        WHEN 3 THEN concat('k: ', props) ELSE props END AS raw FROM events)""",
}
