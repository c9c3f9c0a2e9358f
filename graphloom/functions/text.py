"""Scalar functions on text and on display values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() and split() see it, as one pattern and as all its characters.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Display colours of entity types.
TYPE_COLOURS = {
    "Person": "#42A5F5",
    "Organization": "#AB47BC",
    "Location": "#66BB6A",
    "Concept": "#FFA726",
    "Event": "#EF5350",
    "Product": "#26C6DA",
    "Technology": "#78909C",
    "Date": "#FF7043",
    "Award": "#FFD700",
}
DEFAULT_COLOUR = "#90A4AE"

#: What stands before and after the text of a prompt.
PROMPT_HEAD = "Extract all entities and relationships from the following text.\n\nText:\n"
PROMPT_TAIL = "\n\nReturn a complete knowledge graph with entities and their relationships."


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space at the ends removed, and inside turned into single spaces."""
    return F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")


def shorten_to_sentence(text: Column, most: int = 512) -> Column:
    """Collapsed text of at most ``most`` characters, cut after a full stop in its last three tenths if it has one."""
    whole = collapse(text)
    cut = F.left(whole, F.lit(most))
    back = F.instr(F.reverse(cut), ".")
    last = F.when(back == 0, F.lit(-1)).otherwise(F.length(cut) - back)
    shorter = F.when(last > most * 0.7, F.left(cut, last + 1)).otherwise(cut)
    return F.when(F.length(whole) > most, strip(shorter)).otherwise(whole)


def prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), text, F.lit(PROMPT_TAIL))


def chunk_scoped_id(chunk_id: Column, entity_id: Column) -> Column:
    return F.concat(F.lit("chunk"), chunk_id.cast("string"), F.lit("_"), entity_id)


def evidence(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, relation, obj)


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(14), F.least(F.lit(55), F.lit(12) + 4 * degree))


def truncated(label: Column, most: int = 28, mark: str = "…") -> Column:
    return F.when(F.length(label) > most, F.concat(F.left(label, F.lit(most)), F.lit(mark))).otherwise(label)


def type_colour(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_COLOURS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(DEFAULT_COLOUR))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(F.lit(0.0)).cast("bigint")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def node_tooltip(label: Column, kind: Column, degree: Column) -> Column:
    return F.concat(F.lit("<b>"), escaped(label), F.lit("</b><br>"), escaped(kind), F.lit("<br>"), degree.cast("string"), F.lit(" connections"))
