"""Prompt builders.  The row-dependent part is a column, the rest literals.

Wording is a parameter everywhere; the defaults are this library's own.  What
is fixed is the layout: numbered contexts, ``## key`` blocks, the three-part
training template, list lines.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import trim_ws

# Section layout of training and inference texts ---------------
SFT_PREAMBLE = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
)
SFT_INSTRUCTION = "### Instruction:\n"
SFT_INPUT = "\n\n### Input:\n"
SFT_RESPONSE = "\n\n### Response:\n"
CLASSES_MARK = "{CLASSES_DESCRIPTION}"
# ---------------------------------------------------------------------------


#: Kinds of personal detail, with the tags that stand in their place.
DETAIL_TAGS = {
    "person": ("<PERSON>",),
    "place": ("<LOCATION>",),
    "organization": ("<ORGANIZATION>",),
    "number": ("<ID>",),
    "contact": ("<EMAIL>", "<PHONE>"),
}
_WORDING = {
    "person": "people", "place": "places", "organization": "organizations", "number": "identity and account numbers",
    "contact": "e-mail addresses and phone numbers",
}
SOURCE_LANGUAGE = "source"


@dataclass(frozen=True)
class Redaction:
    """What to hide: kinds of detail, and words of the caller's own with what replaces each.

    ``language`` is ``source`` (each sentence keeps its own), the name of a language, or None for no demand.
    """

    hide: Collection[str] = tuple(DETAIL_TAGS)
    replace: Mapping[str, str] = field(default_factory=dict)
    language: str | None = SOURCE_LANGUAGE
    keep_layout: bool = True

    def __post_init__(self) -> None:
        unknown = sorted(set(self.hide) - set(DETAIL_TAGS))
        if unknown:
            raise ValueError(f"unknown kinds of detail: {', '.join(unknown)}")


REDACTION_TEMPLATE = """{task}

Reply with JSON in this form and nothing around it:
{{"sentences": [{{"original_index": 0, "text": "..."}}], "warnings": [], "errors": []}}

{sentences}
"""


def redaction_task(wanted: Redaction) -> str:
    """The demands of a prompt, a sentence each."""
    say = ["Every line below is a sentence; a number and a tab may stand before it. Give all of them back in their order."]
    tagged = [f"{' or '.join(tags)} for {_WORDING[kind]}" for kind, tags in DETAIL_TAGS.items() if kind in wanted.hide]
    if tagged:
        say.append(f"Write {'; '.join(tagged)}.")
    say += [f"Write {new!r} for {old!r}." for old, new in sorted((k.strip(), v.strip()) for k, v in wanted.replace.items())]
    say.append("Leave all other words as they are" + (", with their spacing and punctuation." if wanted.keep_layout else "."))
    if wanted.language == SOURCE_LANGUAGE:
        say.append("Stay in the language of each sentence.")
    elif wanted.language:
        say.append(f"Answer in {wanted.language}.")
    return "\n".join(say)


def redaction_frame(wanted: Redaction | None = None, template: str = REDACTION_TEMPLATE) -> list[str]:
    """The literal text around each place where the sentences go."""
    if "{sentences}" not in template:
        raise ValueError("the template must contain '{sentences}'")
    mark = "\x00sentences\x00"
    return template.format(sentences=mark, task=redaction_task(wanted or Redaction())).split(mark)


def redaction_prompt(
    sentences: Column, wanted: Redaction | None = None, template: str = REDACTION_TEMPLATE, numbered: bool = True
) -> Column:
    """Prompt for one batch, an ``array<string>`` of sentences.

    ``numbered=False`` sends the bare sentences, one per line.
    """
    if numbered:
        lines = F.transform(sentences, lambda s, i: F.concat(i.cast("string"), F.lit("\t"), trim_ws(s)))
    else:
        lines = F.transform(sentences, trim_ws)
    block = F.array_join(lines, "\n")
    first, *rest = redaction_frame(wanted, template)
    return F.concat(F.lit(first), *[part for text in rest for part in (block, F.lit(text))])


def class_lines(classes: Sequence[Mapping[str, str]]) -> str:
    """``- id: description`` lines of a class catalogue."""
    if not classes:
        raise ValueError("the class catalogue is empty")
    return "\n".join(f"- {c['id'].strip()}: {c['description'].strip()}" for c in classes)


def class_system_prompt(template: str, classes: Sequence[Mapping[str, str]]) -> str:
    """The class list in place of its mark, or appended when there is none."""
    listing = class_lines(classes)
    if CLASSES_MARK in template:
        return template.replace(CLASSES_MARK, listing)
    return f"{template}\n\nPredefined classes:\n{listing}"


def class_user_prompt(text: Column, classes: Sequence[Mapping[str, str]]) -> Column:
    head = (
        "Which of these classes clearly apply to the text? Several may; none is a fine answer.\n"
        "Use only the ids listed, each with a short justification.\n\n"
        f"Classes (id: description):\n{class_lines(classes)}\n\nText:\n\"\"\""
    )
    tail = '"""\n\nAnswer with {"relevant_classes": [{"class_id": "<id>", "justification": "<why>"}]}'
    return F.concat(F.lit(head), text, F.lit(tail))


def with_system(system: Column | str, user: Column) -> Column:
    """System and user part as one prompt text, the unit a backend sees."""
    head = F.lit(system) if isinstance(system, str) else system
    return F.concat(F.coalesce(head, F.lit("")), F.lit("\n\n"), user)


def document_labels_json(text: Column, labels_json: Column | str) -> Column:
    """``{"document": ..., "labels": [...]}`` around an already rendered list."""
    labels = F.lit(labels_json) if isinstance(labels_json, str) else labels_json
    document = F.regexp_extract(F.to_json(F.struct(text.alias("d"))), r'(?s)^\{"d":(.*)\}$', 1)
    return F.concat(F.lit('{"document":'), document, F.lit(',"labels":'), labels, F.lit("}"))


def faq_prompt(persona: Column, rules: str, text: Column, k: int) -> Column:
    """Persona, rules with their ``{k}`` filled in, the count, the base text."""
    return F.concat(
        persona,
        F.lit("\n\n" + rules.replace("{k}", str(k)) + f"\n\nReturn exactly k = {k} items.\n"),
        F.lit('\n\nBase text:\n"""'),
        text,
        F.lit('"""'),
    )


def numbered_contexts(contexts: Column) -> Column:
    """Context block of ``array<struct<source_text, question, answer>>``."""
    parts = F.transform(
        contexts,
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("]\nText: "), c["source_text"],
            F.lit(" \nQuestion: "), c["question"], F.lit("\nAnswer: "), c["answer"], F.lit("\n\n"),
        ),
    )
    return F.array_join(parts, "")


def rag_prompt(contexts: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), numbered_contexts(contexts), F.lit("\n\nUser question:\n"), question)


def judge_prompt(question: Column, generated: Column, reference: Column) -> Column:
    return F.concat(
        F.lit("A reader asked:\n"), question,
        F.lit("\n\nThe text to mark:\n"), generated,
        F.lit("\n\nWhat is known to be right:\n"), reference,
        F.lit(
            "\n\nMark the text by what is known to be right. Reply with one JSON object and nothing else. "
            "Give whole numbers under the keys correctness, completeness and relevance, a decimal number under "
            "overall_score, and a short reason under justification."
        ),
    )


def paraphrase_prompt(question: Column, n: int) -> Column:
    return F.concat(
        F.lit(f"Ask the same question in {n} other ways, one per line, without numbering.\n\nQuestion: \""),
        question,
        F.lit('"'),
    )


def tool_user_prompt(user_prompt: Column, inputs: Column) -> Column:
    """User prompt plus one ``## key`` block per entry of a map, in map order."""
    blocks = F.transform(
        F.map_entries(inputs), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n\n"), e["value"])
    )
    return F.concat(user_prompt, F.lit("\n\n"), F.array_join(blocks, "\n"))


def tool_system_prompt(system_prompt: Column, output_schema: Column) -> Column:
    return F.concat(system_prompt, F.lit("\n\nWrite JSON of this shape:\n"), output_schema)


def example_system_prompt(system_prompt: Column, example: Mapping[str, Any] | None) -> Column:
    """Base prompt (may be null) followed by the pretty-printed example."""
    if example is None:
        return F.when(system_prompt != "", system_prompt)
    shown = json.dumps(example, ensure_ascii=False, indent=2)
    appendix = (
        "\n\nAnswer only with a JSON object that has the keys and types of this example:\n" + shown
    )
    return F.concat(F.coalesce(system_prompt, F.lit("")), F.lit(appendix))


def sft_text(instruction: Column, inp: Column, output: Column, eos: str) -> Column:
    """Training text: preamble, three sections, end mark."""
    return F.concat(
        F.lit(SFT_PREAMBLE + SFT_INSTRUCTION), instruction,
        F.lit(SFT_INPUT), inp, F.lit(SFT_RESPONSE), output, F.lit(eos),
    )


def inference_prompt(instruction: Column, inp: Column, preamble: bool = False) -> Column:
    """The same sections with an open response; parts trimmed."""
    head = (SFT_PREAMBLE if preamble else "") + SFT_INSTRUCTION
    return F.concat(
        F.lit(head), trim_ws(instruction), F.lit(SFT_INPUT), trim_ws(inp), F.lit(SFT_RESPONSE)
    )
