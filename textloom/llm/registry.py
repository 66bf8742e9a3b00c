"""Queries of the subpackage, and the SQL that states the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import audit, crosspolytope, debruijn, decontaminate, jaccard, lines, merkle, packing, quality, rules, suffixes, tokencount, warc

#: Place of a public tokenizer file.
tokenizer_path = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit, names = decontaminate.hit_words("hit_spans"), F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.learn(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = debruijn.remove_repeats(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and a digest of what stays."""
    docs = _documents(spark, sf_dir).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"))
    out = lines.dedup_lines(docs)
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.octet_length("removed_lines") / 4, F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: unigram tokens under the pieces and scores of the public 32k model."""
    return tokencount.token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(rules.text_stats(_documents(spark, sf_dir)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive_roundtrip(pages).withColumnRenamed("id", "page_id")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_passages(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return audit.audit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf and proof, and the root that a tampered leaf gives where 7 divides the checksum of the id."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fields(F.col("n_chars") + 1))
    leaves = docs.select(
        F.col("doc_id").alias("key"), F.col("lang").alias("grp"), fields(F.col("n_chars")).alias("digest"), tampered.alias("tampered")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, changed, paths, roots = (batch[c].to_pylist() for c in ("digest", "tampered", "path", "root"))
            proof = [hashlib.sha256("".join(s.hex() for s in merkle.siblings(p)).encode()).hexdigest() for p in paths]
            folded = [merkle.fold(t or d, p) for d, t, p in zip(given, changed, paths)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["key"], "leaf": [d.hex() for d in given], "subroot": [r.hex() for r in batch["subroot"].to_pylist()],
                "root": [r.hex() for r in roots], "proof_sha256": proof, "folded_root": [f.hex() for f in folded],
                "verified": [f == r for f, r in zip(folded, roots)],
            }, schema=_PROOF)

    return merkle.proofs(merkle.manifest(leaves)).mapInArrow(digests, _PROOF_DDL)


_PROOF_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 50 == 0, k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_quality, op3_jaccard, op4_substrings, op5_lines, op6_packing, op7_token_count, op8_rules, op9_warc,
        op10_suffixes, op11_filter_audit, op12_merkle, op13_neighbours,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{s}'), lambda x: x <> '')"
_ASCII_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_GAP = r"[\x20\x09-\x0D]+"



def _repeats_sql(n: int) -> str:
    """Words in windows of n words that start in a document with a smaller id go."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '{_BLANK_GAP}'), lambda x: x <> ''), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {n - 2})) AS t(i)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
x AS (SELECT DISTINCT doc_id, p FROM g JOIN f USING (g), unnest(range(i, i + {n})) AS t(p) WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS p FROM x GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""


def _leaf_sql(n_chars: str) -> str:
    part = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return f"sha256({' || '.join(part.format(c=c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_TREE_SQL = """{t}(g, l, i, n, h) AS (SELECT {g}, 0, pos, n, h FROM {leaves}
  UNION ALL SELECT g, l + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY g, l, i // 2)"""
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT for k in range(8)]),
    lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""
#: The group of a null language sorts first; levels are numbered over both trees.
_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, {_leaf_sql("n_chars")} AS h,
  CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_TREE_SQL.format(t="a", g="g", leaves="e")},
r AS (SELECT g AS tree, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
{_TREE_SQL.format(t="b", g="''", leaves="r")},
x AS (SELECT e.*, r.pos AS above, r.h AS subroot FROM e JOIN r ON tree = g),
own AS (SELECT doc_id, 0 AS up, p.l, CASE WHEN s.h IS NULL THEN '-' WHEN s.i < p.i THEN '<' || s.h ELSE '>' || s.h END AS step
  FROM (SELECT doc_id, a.g, a.l, a.i FROM x JOIN a ON a.g = x.g AND a.n > 1 AND a.i = x.pos >> a.l) p
  LEFT JOIN a s ON s.g = p.g AND s.l = p.l AND s.i = xor(p.i, 1)
  UNION ALL SELECT doc_id, 1, p.l, CASE WHEN s.h IS NULL THEN '-' WHEN s.i < p.i THEN '<' || s.h ELSE '>' || s.h END
  FROM (SELECT doc_id, b.l, b.i FROM x JOIN b ON b.n > 1 AND b.i = x.above >> b.l) p
  LEFT JOIN b s ON s.l = p.l AND s.i = xor(p.i, 1)),
paths AS (SELECT doc_id, list(step ORDER BY up, l) AS path FROM own GROUP BY 1),
y AS (SELECT x.*, coalesce(path, []) AS path, (SELECT h FROM b WHERE n = 1) AS root FROM x LEFT JOIN paths USING (doc_id)),
z AS (SELECT *, list_reduce(list_prepend(coalesce(changed, h), path), lambda acc, s:
  CASE s[1] WHEN '<' THEN sha256(s[2:] || acc) WHEN '>' THEN sha256(acc || s[2:]) ELSE sha256(acc) END) AS folded_root FROM y)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM z"""

ORACLE = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(c="text", s=_ASCII_GAP)}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(c="text", s=_ASCII_GAP)} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op3_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(c="text", s=_BLANK_GAP)}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' ' || len(w) ELSE '' END AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, c FROM r JOIN both_ways ON v = a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, q.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) q ON q.v = d.doc_id""",
    "op4_substrings": _repeats_sql(13),
    "op10_suffixes": _repeats_sql(50),
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to FROM q""",
    "op11_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
f AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
  + 16 * coalesce(first < doc_id, false)::INT AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || l FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(l)
  WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS before
  FROM o, unnest(range(1, 6)) AS u(step) WHERE len(filter_order) = 5)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (m & (bit | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (m & bit > 0 AND m & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS toxic_lost,
  any_value(shapley)::BIGINT AS shapley
FROM c, s JOIN (SELECT part AS p, bit AS b, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS shapley
  FROM c, s GROUP BY 1, 2) ON b = bit WHERE p = part GROUP BY 1, 2, 3""",
    "op12_merkle": _MERKLE_SQL,
}
