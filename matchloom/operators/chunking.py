"""Sectioning and chunking of study documents, as row-local column expressions.

Nothing here shuffles: a document goes in, an array of chunks comes out, and only
the final ``posexplode`` changes the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import WHITESPACE, _col, extract_between, single_spaced, strip
from matchloom.operators.quality import Split

DEFAULT_MAX_LENGTH = 4096

# Section markers and chunk labels of the document format.
TITLE_PREFIXES = ("Title: ", "Title:")
ELIGIBILITY = "Eligibility:"
INCLUSION = "Inclusion Criteria:"
EXCLUSION = "Exclusion Criteria:"
CONDITIONS = "Conditions:"
LOCATIONS = "Locations:"
INTERVENTIONS = "Interventions:"
OUTCOMES = "Outcomes:"
# Java's \\s knows the ASCII white space only, so the characters are listed.
_GAP = f"[{WHITESPACE}]*"
# Fixed value: an outcome item runs to the next marker or to the end of the text.
OUTCOME_PATTERN = (
    f"(?s)-{_GAP}(PRIMARY|SECONDARY):{_GAP}(.+?)(?={_GAP}-{_GAP}(?:PRIMARY|SECONDARY):|$)"
)
# Fixed value: with this much room or less behind the header, text is cut to it.
MIN_ROOM = 100


def split_empty_documents(df: DataFrame, text: str, *, strict: bool = False) -> Split:
    """Documents with text, and the empty ones. ``strict`` raises if there are any."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    split = Split(df.filter(~empty), df.filter(empty))
    if strict and not split.rejected.isEmpty():
        raise ValueError("document text cannot be empty")
    return split


def section_title(text: Column | str) -> Column:
    """First line without the title markers."""
    title = F.substring_index(_col(text), "\n", 1)
    for prefix in TITLE_PREFIXES:
        title = F.replace(title, F.lit(prefix), F.lit(""))
    return strip(title)


def split_outcomes(text: Column | str, kind: str) -> Column:
    """Outcome texts of one kind (``PRIMARY`` or ``SECONDARY``), blanks dropped."""
    src = _col(text)
    kinds = F.regexp_extract_all(src, F.lit(OUTCOME_PATTERN), F.lit(1))
    texts = F.regexp_extract_all(src, F.lit(OUTCOME_PATTERN), F.lit(2))
    pairs = F.zip_with(kinds, texts, lambda k, t: F.when(k == kind, strip(t)))
    return F.filter(pairs, lambda t: t.isNotNull() & (t != ""))


def with_sections(df: DataFrame, text: str = "document") -> DataFrame:
    """Adds the eight section columns (outcomes as arrays)."""
    return (
        df.withColumn("_eligibility", extract_between(text, ELIGIBILITY, CONDITIONS))
        .withColumn("_outcomes", extract_between(text, OUTCOMES))
        .withColumns(
            {
                "title": section_title(text),
                "inclusion": extract_between("_eligibility", INCLUSION, EXCLUSION),
                "exclusion": extract_between("_eligibility", EXCLUSION),
                "conditions": extract_between(text, CONDITIONS, LOCATIONS),
                "locations": extract_between(text, LOCATIONS, INTERVENTIONS),
                "interventions": extract_between(text, INTERVENTIONS, OUTCOMES),
                "primary_outcomes": split_outcomes("_outcomes", "PRIMARY"),
                "secondary_outcomes": split_outcomes("_outcomes", "SECONDARY"),
            }
        )
        .drop("_eligibility", "_outcomes")
    )


def group_starts(costs: Column, room: Column) -> Column:
    """Start positions (from 1) when items are packed greedily into ``room``.

    An item opens a new group when it does not fit and the group is not empty, so
    an item larger than ``room`` gets a group of its own. The fold carries only
    numbers; no text is copied until the groups are cut.
    """
    state = F.struct(
        F.lit(0).alias("used"),
        F.lit(1).alias("at"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, cost: Column) -> Column:
        opens = (acc["at"] == 1) | (acc["used"] + cost > room)
        return F.struct(
            F.when(opens, cost).otherwise(acc["used"] + cost).alias("used"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.array_append(acc["starts"], acc["at"]))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    return F.aggregate(costs, state, step, lambda acc: acc["starts"])


def _cut(items: Column, starts: Column, separator: str) -> Column:
    def group(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(items) + 1)
        return F.array_join(F.slice(items, start, end - start), separator)

    return F.transform(starts, group)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_words(content: Column | str, room: Column | int) -> Column:
    """Word groups of at most ``room`` characters, counting one blank per word.

    Greedy packing is what a greedy regular expression does: the longest run of at
    most ``room - 1`` characters that ends at a word's end, else one over-long word.
    """
    limit = F.lit(room) if isinstance(room, int) else room
    more = F.greatest(limit - 2, F.lit(0)).cast("string")
    pattern = F.concat(F.lit(r"\S.{0,"), more, F.lit(r"}(?= |\z)|\S+"))
    return F.regexp_extract_all(single_spaced(content), pattern, F.lit(0))


def _header(title: Column, label: str, tail: str) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit(f"\n{label}:{tail}"))


def split_long(title: Column, label: str, content: Column, max_length: int) -> Column:
    """Chunks of an over-long section, each with the header in front."""
    header = _header(title, label, " ")
    room = F.lit(max_length) - F.length(header)
    cut = F.array(F.concat(header, F.substring(content, 1, MIN_ROOM)))
    packed = F.transform(pack_words(content, room), lambda part: F.concat(header, part))
    return F.when(room <= MIN_ROOM, cut).otherwise(packed)


def _none() -> Column:
    return F.array().cast("array<string>")


def overview_chunks(max_length: int) -> Column:
    title, conditions = F.col("title"), F.col("conditions")
    whole = F.concat(_header(title, "Conditions", " "), conditions)
    parts = F.when(
        conditions != "", split_long(title, "Conditions", conditions, max_length)
    ).otherwise(_none())
    split = F.concat(F.array(F.concat(F.lit("Title: "), title)), parts)
    return F.when(F.length(whole) <= max_length, F.array(whole)).otherwise(split)


def section_chunks(section: str, label: str, max_length: int) -> Column:
    title, data = F.col("title"), F.col(section)
    whole = F.concat(_header(title, label, " "), data)
    return (
        F.when(data == "", _none())
        .when(F.length(whole) <= max_length, F.array(whole))
        .otherwise(split_long(title, label, data, max_length))
    )


def pack_outcomes(section: str, label: str, max_length: int) -> Column:
    """Outcome lists packed line by line under a repeated header."""
    header = _header(F.col("title"), label, "\n")
    room = F.lit(max_length) - F.length(header)
    lines = F.transform(F.col(section), lambda o: F.concat(F.lit("  - "), o, F.lit("\n")))

    def packed(ls: Column) -> Column:
        costs = F.transform(ls, lambda x: F.length(x))
        return _let(group_starts(costs, room), lambda starts: _cut(ls, starts, ""))

    return F.transform(_let(lines, packed), lambda part: F.concat(header, part))


def chunk_texts(max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """All chunks of a sectioned document, in the fixed section order."""
    return F.concat(
        overview_chunks(max_length),
        section_chunks("inclusion", "Inclusion Criteria", max_length),
        section_chunks("exclusion", "Exclusion Criteria", max_length),
        section_chunks("locations", "Locations", max_length),
        section_chunks("interventions", "Interventions", max_length),
        pack_outcomes("primary_outcomes", "Primary Outcomes", max_length),
        pack_outcomes("secondary_outcomes", "Secondary Outcomes", max_length),
    )


def chunk_documents(
    df: DataFrame,
    *,
    id_col: str = "nct_id",
    text: str = "document",
    keep: tuple[str, ...] = (),
    max_length: int = DEFAULT_MAX_LENGTH,
) -> DataFrame:
    """(chunk_id, nct_id, chunk_index, text, *keep), one row per chunk.

    ``keep`` columns are carried under their own names; they must not be named like
    a section. Empty documents give no chunk; see :func:`split_empty_documents`.
    """
    docs = split_empty_documents(df, text).good
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    source = docs.select(F.col(id_col).alias("nct_id"), F.col(text).alias("document"), *kept)
    chunks = with_sections(source).select(
        "nct_id",
        *[f"_keep_{c}" for c in keep],
        F.posexplode(chunk_texts(max_length)).alias("chunk_index", "text"),
    )
    return chunks.select(
        F.concat(F.col("nct_id"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"),
        "nct_id",
        "chunk_index",
        "text",
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def chunk_summary(chunks: DataFrame, documents: DataFrame, id_col: str = "nct_id") -> DataFrame:
    """(documents, chunks, chunks_per_document) of one chunking run."""
    n_docs = documents.agg(F.count(id_col).alias("documents"))
    return chunks.agg(F.count("*").alias("chunks")).select(
        n_docs.scalar().alias("documents"),
        "chunks",
        F.round(F.col("chunks") / F.nullif(n_docs.scalar(), F.lit(0)), 1).alias(
            "chunks_per_document"
        ),
    )
