"""Lines of page text: joined to paragraphs, told from headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomkb.functions.text import bind

# How long a heading may be.
HEADING_CHARS, HEADING_WORDS, APPENDIX_CHARS = 100, 14, 80


def join_lines(lines: Column) -> Column:
    """Lines joined to paragraphs: a line goes on in the next one that begins in lower case, unless it ends a sentence; a hyphen at its end goes."""
    text = bind(F.array_join(lines, "\n"), lambda t: F.regexp_replace(t, r"(?<![.:;!?\n])(?<=[^\n])-\n(?=\p{Ll})", ""))
    joined = F.regexp_replace(text, r"(?<![.:;!?\n])\n(?=\p{Ll})", " ")
    return F.when(F.size(lines) > 0, F.split(joined, "\n")).otherwise(F.array().cast("array<string>"))


def heading(line: Column, following: Column) -> Column:
    """Struct (level, title) of a numbered short line or an appendix that no lower-case line follows; null for others."""
    number = F.regexp_extract(line, r"^\s*(\d+(?:\.\d+)*)\.?\s+\p{Lu}", 1)
    title = F.trim(line)
    short = (F.length(line) <= HEADING_CHARS) & (F.size(F.split(title, r"\s+")) <= HEADING_WORDS)
    open_end = F.regexp_like(F.rtrim(line), F.lit(r"[;,:.]$")) | F.regexp_like(F.coalesce(following, F.lit("")), F.lit(r"^\p{Ll}"))
    dated = F.regexp_like(line, F.lit(r"\d{2}\.\d{2}\.\d{4}"))
    appendix = F.regexp_like(line, F.lit(r"(?iu)^\s*(приложение|appendix|annex)(?![\p{L}\p{N}_])")) & (F.length(line) < APPENDIX_CHARS)
    level = F.when((number != "") & ~dated, F.size(F.split(number, r"\."))).when(appendix, F.lit(1))
    return F.when(short & ~open_end & level.isNotNull(), F.struct(level.alias("level"), title.alias("title")))
