"""Fill-in-middle documents by injected markers.

All column expressions, one pass, no shuffle:

1. a delimiter character is escaped in the text, so that it is free;
2. ``regexp_replace`` appends it after every unit (a line, by default), and
   counting it counts the units;
3. hashes of the document's id choose two cuts between units;
   ``substring_index`` takes the parts between the ranked delimiters;
4. the parts lose the delimiters, are unescaped, and are put together with the
   markers of the chosen order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.session import table

#: The injected delimiter and the character that escapes it and itself.
DELIMITER, ESCAPE = "\x1e", "\x1f"
#: A unit: a line with its end, or what is left without one.
LINES = r"[^\n]*\n|[^\n]+"
RESULTS = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Settings:
    """``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of those suffix first."""

    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7"
    rate: int = 100
    spm_rate: int = 50

    def __post_init__(self):
        for m in self.markers:
            # no marker can then begin in a part of a text and end in a marker beside it
            if len(m) < 3 or m[0] != "<" or m[-1] != ">" or set("<>") & set(m[1:-1]):
                raise ValueError(f"a marker has the form <name>: {m}")
        if len(set(self.markers)) < 3:
            raise ValueError("markers must differ")

    @property
    def markers(self) -> Sequence[str]:
        return self.prefix, self.suffix, self.middle


def escaped(text: Column) -> Column:
    """``text`` without any delimiter character."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(marked: Column) -> Column:
    """The raw text of an escaped one; injected delimiters go."""
    plain = F.translate(marked, DELIMITER, "")
    return F.replace(F.replace(plain, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def ranked(marked: Column, count: Column) -> Column:
    """The units up to the ``count``-th delimiter, or from the end for a negative count."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count.cast("int"))


def hash_parts(seed: str, key: Column) -> list[Column]:
    """The first four unsigned 32-bit integers of a SHA-256 of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix, middle, suffix (null where plain) and output.

    Null texts are empty; empty texts, texts that hold a marker, and those that
    the rate leaves out stay plain, their output is the text. A null id is
    hashed as an empty one; equal ids cut at the same share of their hashes.
    Texts are taken whole at any length, and any characters, the delimiter and
    the escape among them, come back unchanged. ``settings.unit`` must cover
    every text; it sees the two control characters as pairs of ESCAPE and a
    digit, and must not end between them. Every row is its own; an empty table
    stays empty. Input columns named like a result column are replaced.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    raw = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = hash_parts(settings.seed, F.col(id_col))
    marked = docs.select(
        *[F.col(c) for c in kept],
        raw.alias("__raw"),
        F.regexp_replace(escaped(raw), settings.unit, f"$0{DELIMITER}").alias("__marked"),
        F.array(h1, h2, h3, h4).alias("__h"),
    )
    n = F.length("__marked") - F.length(F.translate("__marked", DELIMITER, ""))
    h = [F.col("__h")[i] for i in range(4)]
    holds = F.lit(False)
    for m in settings.markers:
        holds = holds | F.contains("__raw", F.lit(m))
    plain = (F.col("__raw") == "") | holds | (h[2] % 100 >= settings.rate)
    form = F.when(plain, "plain").when(h[3] % 100 < settings.spm_rate, "spm").otherwise("psm")
    counted = marked.withColumns({"__n": n.cast("long"), "__form": form})
    cuts = [h[0] % (F.col("__n") + 1), h[1] % (F.col("__n") + 1)]
    cut = counted.withColumns({"__from": F.least(*cuts), "__to": F.greatest(*cuts)})
    chosen, left = F.col("__form") != "plain", F.col("__n") - F.col("__to") + 1
    parts = {
        "__prefix": ranked(F.col("__marked"), F.col("__from")),
        "__middle": ranked(ranked(F.col("__marked"), F.col("__to")), F.col("__from") - F.col("__to")),
        "__suffix": ranked(F.col("__marked"), -left),
    }
    cut = cut.withColumns({k: F.when(chosen, unescaped(v)) for k, v in parts.items()})
    p, s, m = (F.lit(x) for x in settings.markers)
    psm = F.concat(p, "__prefix", s, "__suffix", m, "__middle")
    spm = F.concat(s, "__suffix", p, "__prefix", m, "__middle")
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(F.col("__raw"))
    return cut.select(
        *kept,
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        *[F.col(f"__{c}").alias(c) for c in ("prefix", "middle", "suffix")],
        output.alias("output"),
    )


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that ``output`` was made of. Parts hold no marker, so each occurs once."""
    p, s, m = settings.markers
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def part(marker: str, other: str) -> Column:
        """What follows ``marker`` up to ``other`` or the end, in the part before the middle."""
        return F.substring_index(F.substring_index(head, marker, -1), other, 1)

    whole = F.concat(part(p, s), middle, part(s, p))
    return F.when(form == "plain", output).otherwise(whole)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS raw, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
    SELECT doc_id, raw, units, CAST(len(units) AS BIGINT) AS n,
           CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN raw = '' OR contains(raw, '<P>') OR contains(raw, '<S>') OR contains(raw, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
           coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN raw WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(raw) AS restored_sha256
FROM p
"""
