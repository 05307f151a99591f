"""Training samples from records: chats, masks, prompts and generated question families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat(system: str, user: Column, assistant: Column) -> Column:
    """The three messages of a sample."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(m("system", F.lit(system)), m("user", user), m("assistant", assistant))


def rendered(messages: Column, header: bool = True) -> Column:
    """Messages in a chat template with begin and end marks, and the header of the next answer."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")
    return F.concat(body, F.lit("\n<|im_start|>assistant\n")) if header else body


def masked_labels(ids: Column, prefix: Column, most: int) -> Column:
    """Labels of a truncated sample: -100 over the prompt's ids, the ids themselves after it."""
    cut = F.slice(ids, F.lit(1), F.least(F.size(ids), F.lit(most)))
    n = F.least(prefix, F.size(cut))
    return F.concat(F.array_repeat(F.lit(-100), n), F.slice(cut, n + 1, F.size(cut) - n))


def padded(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), size - F.size(ids)))


def families(df: DataFrame, key: str, templates: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One sample per row and template (category, instruction, output), formats of the row's columns by name.

    A template whose text would be null gives none."""
    def fill(t: str) -> Column:
        parts, rest = [], t
        while "{" in rest:
            a, _, b = rest.partition("{")
            name, _, rest = b.partition("}")
            parts += [F.lit(a), F.col(name).cast("string")]
        return F.concat(*parts, F.lit(rest))

    made = F.array(*[F.struct(F.lit(c).alias("category"), fill(i).alias("instruction"), fill(o).alias("output")) for c, i, o in templates])
    return df.select(F.col(key), F.explode(made).alias("s")).select(key, "s.*").where("instruction is not null and output is not null")


def prompt(question: Column, docs: Column, extras: Sequence[Column] = ()) -> Column:
    """Sections that are not null, the documents numbered, and the question."""
    listed = F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n")
    return F.concat_ws("\n\n", *extras, F.nullif(listed, F.lit("")), F.concat(F.lit("问题："), question))
