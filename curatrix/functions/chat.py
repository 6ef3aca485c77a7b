"""Chat prompts in the styles that models were trained on, from an array of turns (role, text) in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("single", "two", "mpt", "plain", "llama_2", "mistral", "llama_3")


def prompt(style: str, system: Column, turns: Column, sep: str, sep2: str = "") -> Column:
    """The prompt of one of STYLES. A turn without text opens an answer: its role alone, or nothing in the styles
    without roles. Signs of `sep` at the start of a llama_2 or mistral prompt are taken off."""
    one, two = F.lit(sep), F.lit(sep2)
    parts = F.transform(turns, lambda x, i: _turn(style, system, x["role"], F.coalesce(x["text"], F.lit("")), i, one, two))
    rest = F.array_join(parts, "")
    if style in ("llama_2", "mistral"):
        whole = F.concat(F.lit("<s>" if style == "mistral" else ""), rest)
        return F.ltrim(whole, one) if sep else whole
    return F.concat(system, rest) if style == "plain" else F.concat(system, one, rest)


def _turn(style: str, system: Column, role: Column, text: Column, i: Column, sep: Column, sep2: Column) -> Column:
    odd = i % 2 == 1
    alternate = F.when(odd, sep2).otherwise(sep)
    if style in ("single", "two"):
        full, empty = F.concat(role, F.lit(": "), text, sep if style == "single" else alternate), F.concat(role, F.lit(":"))
    elif style in ("mpt", "llama_3"):
        full, empty = F.concat(role, text, sep), role
    elif style == "plain":
        full, empty = F.concat(text, alternate), F.lit("")
    else:
        head = F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n")) if style == "llama_2" else F.when(system == "", "").otherwise(F.concat(system, F.lit("\n")))
        asked = F.concat(sep, F.lit("[INST] "), F.when(i == 0, head).otherwise(""), text, F.lit(" [/INST]"))
        said = F.concat(F.lit(" "), text, F.lit(" "), sep2) if style == "llama_2" else F.concat(text, sep2)
        full, empty = F.when(odd, said).otherwise(asked), F.lit("")
    return F.when(text == "", empty).otherwise(full)
