"""Each operator against a brute-force version, on tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import debruijn, decontaminate, jaccard, lines, packing, quality, registry, rules, suffixes, tokencount, warc
from textloom.llm.components import components

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return BLANK.findall(text or "")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1 decontamination

def brute_hits(text, items, size=13):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    cut = lambda s: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(s))
    words, hit, found = cut(text), set(), []
    for item, item_text in items:
        w = cut(item_text)
        windows = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        n = min(size, len(w))
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in windows]
        if at:
            found.append(item)
            hit.update(p for i in at for p in range(i, i + n))
    return len(words), len(hit), found


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(spark, table, odd, block):
    items = [(3, "Which, is THE one?"), (20, " ".join(f"alpha{i}" for i in range(10, 30))), (7, None), (8, "?!"), (9, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.unionByName(table([(30, "say: which is the one-which is the one"), (31, "ONE Two, one two")]))
    out = decontaminate.find_contamination(docs, bench, block_bytes=block)
    got = out.withColumn("n_hit", decontaminate.hit_words("hit_spans")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["hit_items"] or []) == brute_hits(r["text"], items)
        for s in r["hit_spans"] or []:
            raw = r["text"].encode()[s["first_byte"] : s["end_byte"]].decode()
            assert len(brute_hits(raw, items)[2]) and brute_hits(raw, items)[0] == s["last_word"] - s["first_word"] + 1


def test_decontamination_of_little(spark, odd):
    """Empty tables, items without an id, and columns of inner names."""
    named = odd.withColumns({"_block_words": F.lit(1), "hit_spans": F.lit("x"), "n_words": F.lit(None).cast("int")})
    none = spark.createDataFrame([], "item_id long, text string")
    for bench in (none, spark.createDataFrame([(None, "one two")], "item_id long, text string")):
        out = decontaminate.find_contamination(named, bench)
        assert out.where("size(hit_items) = 0 and size(hit_spans) = 0").count() == odd.count() and "_block_words" in out.columns
    some = spark.createDataFrame([(1, "one two"), (2, "ONE")], "item_id long, text string")
    assert decontaminate.find_contamination(named.limit(0), some).count() == 0
    for block in (decontaminate.BLOCK_BYTES, 4):
        got = decontaminate.find_contamination(named, some, block_bytes=block).where("doc_id = 6").first()
        assert got["hit_items"] == [1, 2] and got["n_words"] == 2 and len(got["hit_spans"]) == 1


# 2 quality

def test_quality_on_held_out_rows(spark):
    got = registry.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    right, all_ = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.93 * all_
    assert got.where("quality = 1 and predicted = 0").count() <= 0.03 * all_


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (12, 0), (12, 0), (3, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    got = quality.score(odd, model).select("doc_id", "score").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    one = quality.learn(odd, labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in quality.score(odd, one).collect())
    none = quality.learn(odd.limit(0), labels)
    assert quality.score(odd, none).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert quality.score(odd.limit(0), one).count() == 0


# 3 Jaccard

def brute_components(docs, num=75, den=100):
    sets = []
    for doc, text in docs:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for d, s in sets), key=repr)


def check_components(df):
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert rows(jaccard.link_components(df), "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_jaccard_odd_rows(odd):
    check_components(odd)
    assert jaccard.link_components(odd.limit(0)).count() == 0


def test_jaccard_id_with_two_texts(table):
    """An id that is the first holder of neither of its texts ties them."""
    x, y = (" ".join(f"{k}{i}" for i in range(20)) for k in "xy")
    df = table([(3, y), (4, x), (5, x), (5, y), (6, x), (7, "other words only here today"), (8, None), (8, y)])
    check_components(df)
    assert {r["component_id"] for r in jaccard.link_components(df).where("doc_id between 3 and 6").collect()} == {3}


def near_copies(rng, n, words, edits):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_long_lists(table, monkeypatch):
    """Large groups of near copies go through stars, and with no star turns through blocks."""
    rng = random.Random(3)
    texts = near_copies(rng, 60, 60, 8) + near_copies(rng, 40, 100, 14) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rng.shuffle(texts)
    df = table(list(enumerate(texts))).repartition(4)
    check_components(df)
    monkeypatch.setattr(jaccard, "STAR_TURNS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 3)
    check_components(df)


def test_t_occurrence_with_long_lists():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(300)]
    sizes, index = np.array([len(s) for s in sets]), jaccard.build_index(sets)
    for q in sets[:40]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert sorted(jaccard.t_occurrence(q, index, sizes, 60, 100).tolist()) == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    assert rows(components(edges), "node", "component_id") == sorted([(i, 0) for i in range(41)] + [(80, 80), (90, 80)], key=repr)
    assert components(edges.limit(0)).count() == 0


# 4 and 10 repeats

def brute_cut(docs, size):
    first = {}
    for doc, text in docs:
        w = split(text)
        for i in range(len(w) - size + 1):
            if doc is not None:
                g = tuple(w[i : i + size])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in docs:
        w = split(text)
        gone = {p for i in range(len(w) - size + 1) if doc is not None and first[tuple(w[i : i + size])] < doc for p in range(i, i + size)}
        out.append((doc, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def shuffled_pieces(rng, n):
    """Texts that join, branch, repeat inside themselves and end inside shared passages."""
    pieces = [[f"p{k}w{i}" for i in range(rng.randrange(4, 70))] for k in range(12)]
    return [" ".join(w for k in rng.choices(range(12), k=rng.randrange(1, 5)) for w in pieces[k][rng.randrange(3) :]) for _ in range(n)]


@pytest.mark.parametrize("remove,size", [(debruijn.remove_repeats, 13), (suffixes.remove_passages, 50)])
def test_repeats(table, odd, remove, size):
    rng = random.Random(5)
    df = odd.unionByName(table([(100 + i, t) for i, t in enumerate(shuffled_pieces(rng, 60))])).repartition(5)
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert rows(remove(df), "doc_id", "n_words", "n_removed", "kept") == brute_cut(docs, size)
    assert remove(df.limit(0)).count() == 0


def test_paths_are_maximal_and_do_not_branch(table):
    """Two documents share 40 words, a third branches off after 20: three compacted paths."""
    w = [f"s{i}" for i in range(40)]
    df = table([(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[:20] + ["z"] * 3))])
    texts = debruijn.text_cells(df, "doc_id", "text")
    got = rows(debruijn.compact_paths(texts), "id", "start", "edges")
    assert got == [(1, 0, 8), (1, 8, 20), (2, 0, 8), (2, 8, 20), (3, 0, 8)]


# 5 lines

def all_pairs_lines(docs, min_words=lines.MIN_WORDS):
    """Every row with an id and a text, aligned with every text of every smaller id."""
    out = []
    for doc, text in docs:
        gone = set()
        if doc is not None and text:
            own = text.split("\n")
            for earlier in {t for d, t in docs if d is not None and t and d < doc}:
                gone.update(lines.common_blocks(earlier.split("\n"), own, [len(split(x)) for x in own], min_words))
            text = "\n".join(x for i, x in enumerate(own) if i not in gone)
        out.append((doc, text, len(gone)))
    return sorted(out, key=repr)


def test_lines(table, odd):
    """Odd rows, and ids with up to three texts."""
    rng = random.Random(9)
    pool = [" ".join(f"l{k}w{i}" for i in range(rng.randrange(1, 15))) for k in range(25)] + ["", "  "]
    extra = [(50 + i % 45, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)]
    extra += [(80, "x\n"), (81, "\n"), (82, "\n" + extra[0][1]), (83, extra[0][1] + "\n")]
    df = odd.unionByName(table(extra)).repartition(5)
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    out = lines.dedup_lines(df).withColumn("n", F.coalesce(F.octet_length("removed_lines") / 4, F.lit(0)).cast("int"))
    assert rows(out, "doc_id", "text", "n") == all_pairs_lines(docs)
    assert set(df.columns) < set(out.columns) and lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_an_id_with_two_texts(table):
    x, y = ("\n".join(" ".join(f"{k}{j}w{i}" for i in range(12)) for j in range(3)) for k in "xy")
    docs = [(2, x), (2, y), (5, "q\n" + x), (6, "q\n" + y)]
    check_all_pairs(table, docs)
    assert [n for _, _, n in all_pairs_lines(docs)] == [0, 0, 3, 3]


def test_lines_by_a_key_of_an_inner_name(spark):
    x = "\n".join(" ".join(f"{j}w{i}" for i in range(12)) for j in range(3))
    df = spark.createDataFrame([(1, x, "a", 0), (2, "own\n" + x, "b", 0)], "id long, text string, sig string, lines int")
    out = lines.dedup_lines(df, key="id", out="removed")
    assert [(r["id"], r["text"], r["sig"]) for r in out.orderBy("id").collect()] == [(1, x, "a"), (2, "own", "b")]


def check_all_pairs(table, docs):
    out = lines.dedup_lines(table(docs).repartition(5)).withColumn("n", F.coalesce(F.octet_length("removed_lines") / 4, F.lit(0)).cast("int"))
    assert rows(out, "doc_id", "text", "n") == all_pairs_lines(docs)


def test_blocks_of_short_lines(table):
    """A common block without a single line of ten words, and blocks that begin or end with blank and short lines."""
    verse = "\n".join(f"v{i} and four words" for i in range(30))
    long = " ".join(f"g{i}" for i in range(12))
    docs = [(1, "first\n" + verse), (2, verse + "\nlast"), (3, f"own\n{long}\nx"), (4, f"other\n\n{long}\nend y\n"), (5, f"five\n\n{long}\nend y\n")]
    check_all_pairs(table, docs)
    assert [n for _, _, n in all_pairs_lines(docs)] == [0, 30, 0, 1, 4]


def test_lines_of_all_pairs(table):
    """Later copies whose first holders have the lines in another order, or hold a frequent line beside other lines."""
    one, two, hot = (" ".join(f"{k}{i}" for i in range(12)) for k in "abh")
    docs = [(1, f"{two}\n{one}"), (2, f"{one}\n{two}"), (3, f"{one}\n{two}")]
    check_all_pairs(table, docs)
    assert all_pairs_lines(docs)[2][2] == 2
    docs = [(i, f"s{i}\n{hot}\nt{i}") for i in range(90)]
    docs += [(200, f"{hot}\nmine\n{hot}"), (201, f"x\n{hot}\ny {one}\nz"), (202, f"{hot}\nmine\n{hot}"), (203, f"y {one}\nz\n{hot}\nyours")]
    check_all_pairs(table, docs)
    rng = random.Random(12)
    pool = [" ".join(f"l{k}w{i}" for i in range(rng.randrange(1, 15))) for k in range(14)] + ["", "  "]
    check_all_pairs(table, [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(70)])


def test_patience():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([], [1]) == [] and lines.patience([5, 5], [5, 5, 5]) == [(0, 0), (1, 1)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in "ab")
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


# 6 packing

def test_word_ids_are_those_of_the_tokenizer():
    """Special tokens, case, apostrophes, marks that combine, odd blanks; also when words are forgotten."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(7)
    parts = ["a", "B", "don't", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "é", "e\u0301", "Σ", "ß", "12", "\u00a0", "\u2028", "\x1c", "☃", "İ", "É", "ÿ", "\u0301", "×", "ɏ", "ɐ", "ſ", "½", "—", "x<", "3.14", "!", "(", " ", " ", "\n", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(600)] + ["a<|endoftext|>b", "<|endoftext|>", None, "", "x<|endoftext|> <|EndOfText|>"]
    own = packing.WordIds(path)
    for memory in (packing._MEMORY, 100):
        packing_memory, packing._MEMORY = packing._MEMORY, memory
        for at in range(0, len(texts), 100):
            ids, cuts = own.of(pa.array(texts[at : at + 100]))
            got = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
            assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[at : at + 100]]
        packing._MEMORY = packing_memory
    assert own.of(pa.array(["a<|endoftext|>b"]))[0].tolist() == [320, 49407, 321]


def test_packing(odd):
    path = registry.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in odd.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((r["doc_id"], s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    out = packing.pack(packing.token_pieces(odd, path))
    assert rows(out, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)
    bins = {}
    for r in out.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    for pieces in bins.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at
            at += length
        assert at == total <= 4096
    assert packing.pack(packing.token_pieces(odd.limit(0), path)).count() == 0


def test_first_fit_is_first_fit():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    tree, plain = packing.FirstFit(100, len(lengths)), []
    for n in lengths:
        k = next((i for i, used in enumerate(plain) if used + n <= 100), len(plain))
        plain += [0] * (k == len(plain))
        assert tree.place(n) == (k, plain[k])
        plain[k] += n


# 7 token counts

def test_token_counts_match_the_public_unigram_tokenizer(spark, odd):
    from tokenizers import Tokenizer, models

    pieces, _ = tokencount.model_pieces(registry.tokenizer_path("piece_bpe_32k.model"))
    public = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    rng = random.Random(8)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    texts += ["".join(rng.choices("abe  nthé\n.1", k=rng.randrange(40))) for _ in range(200)]
    counts = tokencount.SegmentCounts(pieces, False)
    texts += ["".join(rng.choices("\u0e01\u0e02 a\U0001f600\U0001f601", k=rng.randrange(30))) for _ in range(100)] + ["ab\u0e01" * 60, "é" * 300]
    ids = [public.encode(tokencount.MARK + t.replace(" ", tokencount.MARK)).ids if t else [] for t in texts]
    assert any(0 in i for i in ids)
    assert counts.totals(texts) == [len(i) for i in ids] == [tokencount.count_text(counts, t) for t in texts]
    real = [("<unk>", 0.0), *[(p, s / 8) for p, s in pieces if s > -10_000][:3000]]  # eighths add up exactly, in 32 and in 64 bits
    other = Tokenizer(models.Unigram(real, 0, False))
    fine = tokencount.SegmentCounts(real[1:], False)
    want = [len(other.encode(tokencount.MARK + t.replace(" ", tokencount.MARK)).ids) if t else 0 for t in texts]
    assert fine.totals(texts) == want
    assert tokencount.token_counts(odd.limit(0), registry.tokenizer_path("piece_bpe_32k.model")).count() == 0
    out = tokencount.token_counts(odd, registry.tokenizer_path("piece_bpe_32k.model"))
    got = {(r["doc_id"], r["text"]): r["n_tokens"] for r in out.collect()}
    assert got[3, None] == got[4, ""] == 0 and got[1, odd.first()["text"]] > 80 and out.where("doc_id = 2").select("n_tokens").distinct().count() == 1


def test_token_count_ties_and_unknowns():
    pieces = [("▁a", -1.0), ("b", -1.0), ("▁ab", -2.0), ("▁", -3.0), ("a", -3.0), ("c", -1.5), ("bc", -2.5)]
    counts = tokencount.SegmentCounts(pieces, True)
    assert counts.count("▁ab") == 1  # -2 either way: the candidate that starts first
    assert counts.count("▁abc") == 2  # -3.5 either way: [▁a][bc] starts before [..][c]
    assert counts.count("▁aé") == 3 and tokencount.SegmentCounts(pieces, False).count("▁aé") == 2
    real = tokencount.SegmentCounts([(p, s / 3) for p, s in pieces], False)
    assert real.count("▁abab") == 3
    rng = random.Random(5)
    for byte_pieces in (True, False):
        for scale in (1, 3):
            own = tokencount.SegmentCounts([(p, s / scale) for p, s in pieces], byte_pieces)
            texts = ["▁" + "".join(rng.choices("abcé☃", k=rng.randrange(60))) for _ in range(200)]
            assert own.count_all(texts) == [own._viterbi_one(t) for t in texts]


def test_token_memory_keeps_two_generations(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMORY", 40)
    own = tokencount.SegmentCounts([("▁", -1.0), ("a", -1.0), ("aa", -1.5)], False)
    for n in range(30):
        assert own.totals(["a" * n + " a", None, ""]) == [(1 + (n + 1) // 2 if n else 1) + 2, 0, 0]
        assert sum(map(len, own.young)) + sum(map(len, own.old)) <= 80 + 2 * 33


# 8 rules

def brute_stats(text):
    w, doubles, seen = split(text), 0, set()
    for line in (text or "").split("\n"):
        if split(line):
            doubles += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), doubles, len(cover)


def test_rules(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    stats = rules.text_stats(docs.withColumn("copy", F.col("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = stats.collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(brute_stats(r["text"]) for r in docs.collect())
    assert all(tuple(r[n] for n in names) == brute_stats(r["copy"]) for r in got)
    out = rules.judge(stats.drop("copy"))
    assert out.count() == docs.count()
    assert out.where("base_failed and kept").count() == out.where("kept is null").count() == 0
    assert rules.judge(stats.limit(0)).count() == 0


def brute_posteriors(patterns, turns=200, right=8.0, wrong=2.0):
    """EM for {votes: count}, document class by document class, in plain arithmetic."""
    import math

    m = len(next(iter(patterns)))
    good, bad, share, post = [right / (right + wrong)] * m, [right / (right + wrong)] * m, 0.8, dict.fromkeys(patterns, 0.5)
    for _ in range(turns):
        new = {}
        for votes in patterns:
            a, b = share, 1 - share
            for k, v in enumerate(votes):
                a *= good[k] if v == rules.GOOD else 1 - good[k] if v == rules.BAD else 1
                b *= bad[k] if v == rules.BAD else 1 - bad[k] if v == rules.GOOD else 1
            new[votes] = a / (a + b)
        moved, post = max(abs(new[v] - post[v]) for v in patterns), new
        hold = lambda x: min(max(x, 0.55), 0.999)
        for k in range(m):
            said = lambda c: sum(n * post[v] for v, n in patterns.items() if v[k] == c)
            said_bad = lambda c: sum(n * (1 - post[v]) for v, n in patterns.items() if v[k] == c)
            good[k] = hold((said(rules.GOOD) + right) / (said(rules.GOOD) + right + said(rules.BAD) + wrong))
            bad[k] = hold((said_bad(rules.BAD) + right) / (said_bad(rules.BAD) + right + said_bad(rules.GOOD) + wrong))
        n = sum(patterns.values())
        share = min(max((sum(c * post[v] for v, c in patterns.items()) + right) / (n + right + wrong), 0.02), 0.98)
        if moved < 1e-9:
            break
    assert all(math.isfinite(p) for p in post.values())
    return post


def test_verdicts_against_brute_force(spark, odd):
    """Posterior and verdict of every row, with columns of inner and of result names."""
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    stats = rules.text_stats(docs).withColumns({"_vote_size": F.lit(9), "_vote0": F.lit(8), "p_good": F.lit(0.1)})
    named = rules.default_rules()
    voted = stats.withColumns({f"v{k}": v for k, v in enumerate(named.values())}).withColumn("failed", rules.base_failed())
    want, patterns = voted.collect(), {}
    for r in want:
        if not r["failed"]:
            key = tuple(r[f"v{k}"] for k in range(len(named)))
            patterns[key] = patterns.get(key, 0) + 1
    post = brute_posteriors(patterns)
    expected = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], not r["failed"] and post[tuple(r[f"v{k}"] for k in range(len(named)))] >= 0.5) for r in want)
    out = rules.judge(stats)
    assert {"_vote_size", "_vote0", "p_good"} < set(out.columns) and out.where("_vote_size = 9 and _vote0 = 8").count() == len(want)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["kept"]) for r in out.collect()) == expected
    near = {tuple(r[f"v{k}"] for k in range(len(named))): post.get(tuple(r[f"v{k}"] for k in range(len(named)))) for r in want}
    assert any(p is not None and 0.01 < p < 0.99 for p in near.values()) or len(patterns) > 3


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = registry.op8_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    assert out.where("quality = 1 and not base_failed and not kept").count() <= 0.02 * out.where("quality = 1").count()


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = rules.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, accuracy = rules.estimate(patterns, counts.astype(float))
    assert np.abs(accuracy - right).max() < 0.05
    per = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(per[tuple(v)] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.9


# 9 WARC

def test_warc(spark, tmp_path, monkeypatch):
    big = "é" * 2_000_000
    head = "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    pages = [(1, "u", big), (2, "u", big), (3, None, None), (4, "a\r\nb", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", head), (8, "u", head), (None, "u", "y" * 1500), (9, "u", "z" * 1000), (10, "u", "z" * 1000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, kind string")
    out = warc.archive_roundtrip(df, str(tmp_path / "w"))
    last = {2: 1, 8: 7, 10: 9}
    refers = {v: k for k, v in last.items()}
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if i in refers else "response", refers.get(i)))
    assert rows(out, "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK
    assert b"".join(r["data"] for r in chunks.where("id = 2 and kind <> 'revisit'").orderBy("chunk").collect()).decode() == big
    assert warc.archive_roundtrip(df.limit(0)).count() == 0
