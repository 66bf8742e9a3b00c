import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.redact import EMAIL, Gazetteers, redact, redact_all, redaction_counts
from textloom.functions.prompts import Redaction


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(3)
    return [r["o"] for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


RANDOM = random.Random(5)
ALPHABET = "aZ9 éÉ.!?;:\n\t \u0085 \x1c-"
FUZZ = ["".join(RANDOM.choices(ALPHABET, k=RANDOM.randrange(0, 40))) for _ in range(300)]


def test_white_space_is_pythons():
    assert set(X.WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_trim_and_tokens_follow_python(spark):
    assert column(spark, FUZZ, X.trim_ws) == [t.strip() for t in FUZZ]
    assert column(spark, FUZZ, X.token_count) == [len(t.split()) for t in FUZZ]
    assert column(spark, FUZZ, X.is_blank) == [not t.strip() for t in FUZZ]


def test_sentences_follow_the_break_rule(spark):
    brk = re.compile(r"(?<=[.!?;:])\s+(?=[A-ZÁÉÍÓÚÂÊÎÔÛÃÕÀÄËÏÖÜÇ0-9])")
    want = [[p for p in brk.split(t.strip()) if p] for t in FUZZ]
    assert column(spark, FUZZ, X.split_sentences) == want


def test_sentences_edge_cases(spark):
    texts = ["", "    ", "One. Two! 3 é. Éa; b", "Dr. Who: 5 no", "a.\nB", "a.b C", None]
    assert column(spark, texts, X.split_sentences) == [
        [], [], ["One.", "Two!", "3 é.", "Éa; b"], ["Dr.", "Who:", "5 no"], ["a.", "B"], ["a.b C"], [],
    ]
    assert column(spark, ["a| b || c"], lambda c: X.split_sentences(c, r"\|")) == [["a", "b", "c"]]


def test_clean_text(spark):
    texts = ["wo- r- d", "a - b", "x--y\x00z", " a \n  b ", "", None, "- a- - b- c", "ta- ç-ão", "no change"]
    assert column(spark, texts, X.clean_text) == ["word", "a b", "x y z", "a b", "", "", "abc", "tação", "no change"]


def test_custom_rules_are_literal_and_chained(spark):
    rules = {"a.c": "$1", "$1": "b\\", "É": "e", "x\\Ey": "ok"}
    assert column(spark, ["A.C abc", "é", "X\\EY"], lambda c: X.apply_custom_rules(c, rules)) == ["b\\ abc", "e", "ok"]
    assert column(spark, ["same"], lambda c: X.apply_custom_rules(c, None)) == ["same"]


def test_collapse_keeps_single_breaks(spark):
    assert column(spark, [" a\nb \t c\n\nd "], X.collapse_ws) == ["a\nb c d"]


def test_truncate_keeps_the_tail(spark):
    texts = ["a b  c", "a b", "", None]
    assert column(spark, texts, lambda c: X.truncate_tokens(c, 2)) == ["b c", "a b", "", None]
    with pytest.raises(ValueError):
        X.truncate_tokens(F.col("t"), 0)


def test_lines(spark):
    assert column(spark, [" a \n\n \nb\nc"], lambda c: X.line_list(c, 2)) == [["a", "b"]]


def test_redaction_is_idempotent_and_switchable(spark):
    texts = [
        "Mail a.b@x.example.org or +1 (555) 123-4567.", "card 4111111111111111, 123-45-6789", "Ana met ANA MARIA in Rio",
        "nothing here", None,
    ]
    names = Gazetteers(persons=["Ana", "Ana Maria"], locations=["Rio"], organizations=["Acme"])
    once = column(spark, texts, lambda c: redact(c, None, names))
    assert once == [
        "Mail <EMAIL> or <PHONE>.", "card <ID>, <ID>", "<PERSON> met <PERSON> in <LOCATION>", "nothing here", None,
    ]
    assert column(spark, once, lambda c: redact(c, None, names)) == once
    off = Redaction(hide=("place", "organization", "number"))
    assert column(spark, texts, lambda c: redact(c, off, names))[:3] == [texts[0], once[1], "Ana met ANA MARIA in <LOCATION>"]
    counts = column(spark, texts[:3], lambda c: redaction_counts(c, None, names))
    assert [tuple(c) for c in counts] == [(1, 0, 1, 0, 0, 0), (0, 2, 0, 0, 0, 0), (0, 0, 0, 2, 0, 1)]


def test_names_match_whole_words_only(spark):
    names = Gazetteers(persons=["Éva"])
    assert column(spark, ["éva, Évariste", "ÉVA"], lambda c: redact(c, None, names)) == ["<PERSON>, Évariste", "<PERSON>"]


def brute_names(text, lists):
    """Leftmost, then longest, then the first list; character by character."""
    out, at = "", 0
    while at < len(text):
        best = None
        if not (at and text[at - 1].isalnum()):
            for tag, names in lists:
                for name in names:
                    end = at + len(name)
                    if text[at:end].lower() == name.lower() and not text[end : end + 1].isalnum() and (best is None or end > best[0]):
                        best = end, tag
        out += best[1] if best else text[at]
        at = best[0] if best else at + 1
    return out


def test_names_against_brute_force(spark):
    rng = random.Random(6)
    made = ["".join(rng.choices("abé -.", k=rng.randrange(1, 6))).strip() or "b" for _ in range(60)]
    texts = ["".join(rng.choices("abÉB -.x1", k=rng.randrange(0, 60))) for _ in range(300)] + ["", None]
    names = Gazetteers(persons=made[:20], organizations=made[20:40], locations=made[40:])
    lists = [("<PERSON>", made[:20]), ("<ORGANIZATION>", made[20:40]), ("<LOCATION>", made[40:])]
    hide = Redaction(hide=("person", "organization", "place"))
    want = [t if t is None else brute_names(t, lists) for t in texts]
    assert column(spark, texts, lambda c: redact(c, hide, names)) == want
    listed = column(spark, texts, lambda c: redact_all(F.array(c, F.lit("é")), hide, names))
    assert [x[0] for x in listed] == want


def test_emails_of_any_length_go_whole(spark):
    long = "a" * 300 + "@" + "b" * 300 + ".org"
    texts = [f"x {long} y", "x@y.co1m@z.org", "a@b@c.de", "@x.org", "a@x.o", ".@-.zz", "q@w.ee,r@t.yy"]
    want = [re.sub(EMAIL, "<EMAIL>", t) for t in texts]
    assert want[0] == "x <EMAIL> y"
    assert column(spark, texts, lambda c: redact(c, Redaction(hide=["contact"]))) == want
    counts = column(spark, texts, lambda c: redaction_counts(c, Redaction(hide=["contact"])))
    assert [c["email"] for c in counts] == [len(re.findall(EMAIL, t)) for t in texts]


def test_redaction_is_linear_in_an_unbroken_run(spark):
    import time

    texts = ["a" * 1_000_000 + " x@y.org", "a" * 1_000_000 + "@" + "b" * 1_000_000]
    column(spark, ["warm@up.org"], redact)
    start = time.perf_counter()
    out = column(spark, texts, lambda c: redact(c, Redaction(hide=["contact"])))
    assert out == ["a" * 1_000_000 + " <EMAIL>", texts[1]] and time.perf_counter() - start < 5
