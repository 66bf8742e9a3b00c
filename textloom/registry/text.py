"""Cleaning, sentences, batches, chunks, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.prompts import Redaction, redaction_frame, redaction_prompt
from textloom.functions.redact import EMAIL, ID, PHONE, Gazetteers, redact, redaction_counts
from textloom.operators.chunking import chunk_pages, clean_pages
from textloom.operators.model_map import Replay, Rules, prompt_hash
from textloom.plans import anonymize as A
from textloom.plans.classify import clean_rows
from textloom.registry.base import documents, spread, sql_sentences, sql_text, sql_trim, table

CUSTOM_RULES = {"the": "<T$1>", "de la": "DE\\LA", "É": "[e]"}


def split_sentences(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("sent_idx", "sentence"))


def sentence_batches(spark, d):
    b = A.sentence_batches(documents(spark, d, "doc_id", "text")).filter(F.col("batch_id").isNotNull())
    return b.select(
        "doc_id", "batch_id", F.size("sentences").alias("sent_count"), F.array_join("sentences", "\n").alias("block")
    )


def clean_text(spark, d):
    s = documents(spark, d, "doc_id", "text").select("doc_id", X.clean_text(F.col("text")).alias("text"))
    return s.withColumn("length", F.length("text"))


def token_counts(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", X.token_count(F.col("text")).alias("num_tokens"), F.length("text").alias("length"))


def corpus_tokens(spark, d):
    s = documents(spark, d, "doc_id", "text", "lang")
    return s.groupBy("lang").agg(F.sum(X.token_count(F.col("text"))).alias("num_tokens"), F.count("*").alias("n"))


def row_text(spark, d):
    return documents(spark, d).select("doc_id", X.row_as_text("doc_id", "lang", "source", "n_chars").alias("row_text"))


def clean_rows_q(spark, d):
    return clean_rows(table(spark, d, "documents"))


def truncate_tokens(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", X.truncate_tokens(F.col("text"), 50).alias("tail"))


def custom_rules(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", X.collapse_ws(X.apply_custom_rules(F.col("text"), CUSTOM_RULES)).alias("text"))


def chunk_windows(spark, d):
    pages = spread(table(spark, d, "conversations"), "conv_id").select(
        F.col("conv_id").cast("string").alias("doc_name"), (F.col("turn") + 1).alias("page_number"), "text"
    )
    return chunk_pages(clean_pages(pages), size=2, max_tokens=150)


def redact_contacts(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", redact(F.col("text")).alias("text"))


def redact_counts(spark, d):
    s = documents(spark, d, "doc_id", "text")
    return s.select("doc_id", redaction_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


#: Ten thousand names by a rule: every word of two parts.
_HEADS = [a + b for a in "bcdfghklmnprstvw" for b in "aeiou"]
_TAILS = [a + b for a in "bcdfghklmnprstvwxyz" for b in ("a", "e", "i", "o", "u", "an", "en")]
NAMES = [h + t for h in _HEADS for t in _TAILS][:10_000]


def redact_names(spark, d):
    """Ten thousand names in three lists, over whole texts."""
    s = documents(spark, d, "doc_id", "text")
    lists = Gazetteers(persons=NAMES[::3] + ["the"], organizations=NAMES[1::3] + ["of the"], locations=NAMES[2::3])
    return s.select("doc_id", redact(F.col("text"), Redaction(hide=("person", "organization", "place")), lists).alias("text"))


def _stored(docs):
    """Responses of the rules backend, keyed by prompt digest: a response table."""
    batches = A.sentence_batches(docs).filter(F.col("sentences").isNotNull())
    prompt = redaction_prompt(F.col("sentences"), Redaction())
    return batches.select(prompt_hash(prompt).alias("prompt_hash"), A.rules_answer(F.col("sentences")).alias("response"))


def redact_roundtrip(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return A.anonymize(docs, Replay(_stored(docs)), Redaction())


def redact_refused(spark, d):
    """Answers that are good, short, doubled, no JSON, or in another order; refused batches null their document."""
    say = lambda s: F.concat(F.lit("> "), s)
    good = F.transform("sentences", lambda s, i: F.struct(i.cast("int").alias("original_index"), say(s).alias("text")))
    doubled = F.transform("sentences", lambda s: F.struct(F.lit(0).alias("original_index"), say(s).alias("text")))
    listed = lambda a: F.to_json(F.struct(a.alias("sentences")))
    shape = F.col("doc_id") % 5
    response = (
        F.when(shape == 1, listed(F.slice(good, 1, 1))).when(shape == 2, listed(doubled)).when(shape == 3, F.lit("I cannot."))
        .when(shape == 4, listed(F.reverse(good))).otherwise(listed(good))
    )
    return A.anonymize(documents(spark, d, "doc_id", "text"), Rules(response), Redaction(), on_error="null")


def batch_meta(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    answered = A.answer_batches(docs, Replay(_stored(docs)), Redaction())
    meta = A.batch_meta(answered, provider="replay")
    return meta.select("doc_id", "batch_id", "sent_count", "prompt_chars", "returned_count", "provider", "retries", "ok")


def dry_run_prompt(spark, d):
    return A.dry_run_prompt(documents(spark, d, "doc_id", "text"), 5)


QUERIES = {
    "split_sentences": split_sentences,
    "sentence_batches": sentence_batches,
    "clean_text": clean_text,
    "token_counts": token_counts,
    "corpus_tokens": corpus_tokens,
    "row_text": row_text,
    "clean_rows": clean_rows_q,
    "truncate_tokens": truncate_tokens,
    "custom_rules": custom_rules,
    "chunk_windows": chunk_windows,
    "redact_contacts": redact_contacts,
    "redact_counts": redact_counts,
    "redact_names": redact_names,
    "redact_roundtrip": redact_roundtrip,
    "redact_refused": redact_refused,
    "batch_meta": batch_meta,
    "dry_run_prompt": dry_run_prompt,
}

# Oracles ----------------------------------------------------------------------
_S = sql_sentences("text")
_GAPS = r"\s{2,}"
_LETTER, _LOWER = "A-Za-zÀ-ÖØ-öø-ÿ", "a-zà-öø-ÿ"


def _sub(c: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {sql_text(pattern)}, {sql_text(by)}, '{flags}')"


def sql_clean(c: str) -> str:
    for letters, tail in ((_LETTER, "- "), (_LOWER, "- "), (_LETTER, "-"), (_LOWER, "-")):
        c = _sub(c, f"- ([{letters}]){tail}", r"\1")
    c = _sub(c, "-+", " ")
    return sql_trim(_sub(f"replace({c}, chr(0), ' ')", r"\s+", " "))


def sql_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


def sql_redact(c: str) -> str:
    return _sub(_sub(_sub(c, EMAIL, "<EMAIL>"), ID, "<ID>"), PHONE, "<PHONE>")


_HEAD, _TAIL = redaction_frame()

_SENTENCES = f"""
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sentence
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_S} AS s FROM documents))
"""
_NUMBERED = "string_agg(concat(sent_idx % 8, chr(9), sentence), chr(10) ORDER BY sent_idx)"
_PROMPT = f"concat({sql_text(_HEAD)}, @BLOCK@, {sql_text(_TAIL)})"

ORACLE = {
    "split_sentences": _SENTENCES,
    "sentence_batches": f"""
      SELECT doc_id, CAST(sent_idx // 8 AS INTEGER) AS batch_id, CAST(count(*) AS INTEGER) AS sent_count,
             string_agg(sentence, chr(10) ORDER BY sent_idx) AS block
      FROM ({_SENTENCES}) GROUP BY 1, 2""",
    "clean_text": f"""
      SELECT doc_id, t AS text, CAST(length(t) AS INTEGER) AS length
      FROM (SELECT doc_id, {sql_clean('text')} AS t FROM documents)""",
    "token_counts": f"""
      SELECT doc_id, CAST(len({sql_tokens('text')}) AS INTEGER) AS num_tokens,
             CAST(length(text) AS INTEGER) AS length FROM documents""",
    "corpus_tokens": f"""
      SELECT lang, CAST(sum(len({sql_tokens('text')})) AS BIGINT) AS num_tokens, count(*) AS n
      FROM documents GROUP BY lang""",
    "row_text": """
      SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR)
             AS row_text FROM documents""",
    "clean_rows": f"""
      SELECT CAST(doc_id AS VARCHAR) AS doc_id, {sql_trim('text')} AS text FROM documents
      WHERE length({sql_trim('text')}) > 0""",
    "truncate_tokens": f"""
      SELECT doc_id, CASE WHEN len(t) <= 50 THEN text ELSE array_to_string(t[-50:], ' ') END AS tail
      FROM (SELECT doc_id, text, {sql_tokens('text')} AS t FROM documents)""",
    "custom_rules": "SELECT doc_id, "
    + sql_trim(
        _sub(
            _sub(_sub(_sub("text", "the", "<T$1>", "gi"), "de la", r"DE\\LA", "gi"), "É", "[e]", "gi"), r"\s{2,}", " "
        )
    )
    + " AS text FROM documents",
    "chunk_windows": f"""
      WITH p AS (
        SELECT CAST(conv_id AS VARCHAR) AS doc_name, turn + 1 AS page_number, text,
               len({sql_tokens('text')}) AS toks
        FROM (SELECT conv_id, turn, {sql_clean('text')} AS text FROM conversations)),
      w AS (
        SELECT *, lead(text) OVER d AS text2, lead(toks) OVER d AS toks2, lead(page_number) OVER d AS page2
        FROM p WINDOW d AS (PARTITION BY doc_name ORDER BY page_number)),
      c AS (
        SELECT *, page2 IS NOT NULL AND (toks + toks2 <= 150 OR toks = 0) AS two FROM w),
      t AS (
        SELECT doc_name, page_number AS start_page, CASE WHEN two THEN page2 ELSE page_number END AS end_page,
               CASE WHEN two THEN concat(page_number, ',', page2) ELSE CAST(page_number AS VARCHAR) END AS pages,
               {sql_trim("CASE WHEN two THEN concat(text, chr(10), chr(10), text2) ELSE text END")} AS text,
               CAST(CASE WHEN two THEN toks + toks2 ELSE toks END AS BIGINT) AS num_tokens
        FROM c)
      SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY start_page) AS chunk_id, start_page, end_page,
             pages, text, CAST(length(text) AS INTEGER) AS length, num_tokens
      FROM t WHERE text <> ''""",
    "redact_contacts": f"SELECT doc_id, {sql_redact('text')} AS text FROM documents",
    "redact_counts": f"""
      SELECT doc_id, CAST(len(regexp_extract_all(text, {sql_text(EMAIL)})) AS BIGINT) AS email,
             CAST(len(regexp_extract_all(t1, {sql_text(ID)})) AS BIGINT) AS id,
             CAST(len(regexp_extract_all(t2, {sql_text(PHONE)})) AS BIGINT) AS phone
      FROM (SELECT *, {_sub('t1', ID, '<ID>')} AS t2
            FROM (SELECT doc_id, text, {_sub('text', EMAIL, '<EMAIL>')} AS t1 FROM documents))""",
    # tokens and gaps as rows; "of the" takes three of them, any other name one
    "redact_names": f"""
      WITH names AS (
        SELECT heads[i] || tails[j] AS name, ['<PERSON>', '<ORGANIZATION>', '<LOCATION>'][((i - 1) * {len(_TAILS)} + j - 1) % 3 + 1] AS tag
        FROM (SELECT {_HEADS} AS heads, {_TAILS} AS tails), range(1, {len(_HEADS) + 1}) AS r(i), range(1, {len(_TAILS) + 1}) AS s(j)
        WHERE (i - 1) * {len(_TAILS)} + j - 1 < {len(NAMES)} UNION ALL SELECT 'the', '<PERSON>'),
      parts AS (
        SELECT doc_id, i, p[i] AS part, i > 2 AND lower(p[i - 2]) = 'of' AND p[i - 1] = ' ' AND lower(p[i]) = 'the' AS third,
               i > 1 AND lower(p[i - 1]) = 'of' AND p[i] = ' ' AND lower(p[i + 1]) = 'the' AS second,
               lower(p[i]) = 'of' AND p[i + 1] = ' ' AND lower(p[i + 2]) = 'the' AS first
        FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i))
      SELECT doc_id, coalesce(string_agg(CASE WHEN first THEN '<ORGANIZATION>' WHEN second OR third THEN '' ELSE coalesce(tag, part) END, '' ORDER BY i), '') AS text
      FROM documents LEFT JOIN parts USING (doc_id) LEFT JOIN names ON name = lower(part) GROUP BY doc_id""".replace("\\\\", "\\"),
    "redact_roundtrip": f"""
      SELECT doc_id, string_agg({sql_trim(_sub(sql_redact('sentence'), _GAPS, ' '))},
             ' ' ORDER BY sent_idx) AS text, true AS ok, CAST(max(sent_idx) // 8 + 1 AS BIGINT) AS batches
      FROM ({_SENTENCES}) GROUP BY doc_id""",
    "redact_refused": f"""
      WITH s AS (
        SELECT doc_id, sent_idx, sentence, doc_id % 5 AS shape, sent_idx % 8 AS place,
               count(*) OVER (PARTITION BY doc_id, sent_idx // 8) AS n FROM ({_SENTENCES})),
      t AS (
        SELECT *, shape = 3 OR shape = 2 AND n > 1 AS refused,
               CASE WHEN shape = 1 AND place > 0 THEN {sql_redact('sentence')} ELSE concat('> ', sentence) END AS said FROM s)
      SELECT doc_id, CASE WHEN NOT bool_or(refused) THEN string_agg({sql_trim(_sub('said', _GAPS, ' '))}, ' ' ORDER BY sent_idx) END AS text,
             NOT bool_or(refused) AS ok, CAST(max(sent_idx) // 8 + 1 AS BIGINT) AS batches
      FROM t GROUP BY doc_id""",
    "batch_meta": f"""
      SELECT doc_id, CAST(sent_idx // 8 AS INTEGER) AS batch_id, CAST(count(*) AS INTEGER) AS sent_count,
             CAST(length({_PROMPT.replace("@BLOCK@", _NUMBERED)}) AS INTEGER) AS prompt_chars,
             CAST(count(*) AS INTEGER) AS returned_count, 'replay' AS provider, 0 AS retries, true AS ok
      FROM ({_SENTENCES}) GROUP BY 1, 2""",
    "dry_run_prompt": f"""
      SELECT doc_id, {_PROMPT.replace("@BLOCK@", _NUMBERED)} AS prompt
      FROM ({_SENTENCES}) WHERE sent_idx < 5 GROUP BY doc_id""",
}
