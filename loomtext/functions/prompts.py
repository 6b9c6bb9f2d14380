"""Prompt templates by task, chosen by a hash of a row's key, so that a run repeats itself."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS: dict[str, tuple[str, ...]] = {
    "article_summary": (
        "Sum up this article:\n\n{content}", "In a few sentences, what does this article say?\n\n{content}", "Condense the article:\n\n{content}",
        "List the main points of this article:\n\n{content}", "Give the gist of the article:\n\n{content}", "Shorten this article:\n\n{content}", "What should a reader take from this article:\n\n{content}",
    ),
    "code_explanation": (
        "Explain this {lang} code:\n\n```\n{code}\n```", "What happens when this {lang} code runs?\n\n```\n{code}\n```", "Describe the {lang} code below:\n\n```\n{code}\n```",
        "Go through this {lang} code line by line:\n\n```\n{code}\n```", "What is this {lang} code for?\n\n```\n{code}\n```", "Tell a newcomer what this {lang} code does:\n\n```\n{code}\n```",
        "Comment on this {lang} code:\n\n```\n{code}\n```", "How does this {lang} code work?\n\n```\n{code}\n```",
    ),
    "concept_explanation": ("Explain {heading}.", "What is meant by {heading}?", "Describe {heading} in detail.", "Introduce {heading}.", "Tell me about {heading}.", "What should I know about {heading}?", "Write an explanation of {heading}."),
    "datasheet_specs": ("List the specifications:\n\n{content}", "Which parameters does this datasheet give?\n\n{content}", "Tabulate the electrical data:\n\n{content}", "Summarise the datasheet:\n\n{content}", "What are the ratings of this part?\n\n{content}"),
    "bom_generation": ("Write a bill of materials:\n\n{content}", "Which parts does this project use?\n\n{content}", "List the components:\n\n{content}", "What has to be ordered to build this?\n\n{content}", "Make a parts list:\n\n{content}"),
    "kicad_to_description": ("Describe this circuit:\n\n{content}", "What is this schematic for?\n\n{content}", "Explain the project:\n\n{content}", "Summarise this schematic:\n\n{content}"),
    "qa_stackexchange": ("{question}", "Question: {question}", "Please answer:\n\n{question}", "I would like to know:\n\n{question}", "Help with this:\n\n{question}"),
    "faq_qa": ("{question}", "Question: {question}", "Please answer: {question}"),
    "multi_turn_dialogue": ("{first_question}", "User: {first_question}", "Let's talk.\n\nUser: {first_question}"),
}


@dataclass(frozen=True)
class Prompts:
    """Templates with their seed; ``with_custom`` adds a file's to those of its tasks."""

    templates: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEFAULTS))
    seed: int = 42

    def with_custom(self, path: str) -> Prompts:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                more = json.load(f)
            else:
                import yaml

                more = yaml.safe_load(f)
        if not isinstance(more, dict):
            raise ValueError("a template file maps tasks to lists of texts")
        added = {task: tuple(t for t in texts if isinstance(t, str)) for task, texts in more.items() if isinstance(texts, list)}
        return Prompts({task: (*self.templates.get(task, ()), *added.get(task, ())) for task in {**self.templates, **added}}, self.seed)

    def variations(self, task: str) -> tuple[str, ...]:
        return self.templates.get(task, ())

    def pick(self, task: str, key: Column, **values: Column) -> Column:
        """The filled template; for an unknown task ``content``, or the first value that isn't empty."""
        texts = self.variations(task)
        if not texts:
            order = [values[k] for k in ("content", *values) if k in values]
            return F.coalesce(*[F.when(v != "", v) for v in order], F.lit(""))
        fit = [t for t in texts if all("{" + k + "}" not in t or k in values for k in ("content", "code", "lang", "heading", "question", "first_question"))] or list(texts)
        which = F.pmod(F.conv(F.substring(F.sha1(F.concat(F.lit(f"{self.seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(fit)))
        out = None
        for i, t in enumerate(fit):
            filled = self._fill(t, values)
            out = F.when(which == i, filled) if out is None else out.when(which == i, filled)
        return out

    @staticmethod
    def _fill(template: str, values: dict[str, Column]) -> Column:
        import re

        parts = [F.coalesce(values[p[1:-1]], F.lit("")) if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
        return F.concat(*parts)
