"""Line deduplication with DataFrame functions only.

Every text is split at line feeds. Lines are exploded, normalised and hashed; the number of distinct documents of each
hash is counted; lines whose hash occurs in too many documents are dropped; what stays is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, ascii_lower, col, cut, fresh


def line_key(line: Column) -> Column:
    """A line with white space stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    n_lines_col: str = "n_lines",
    n_dropped_col: str = "n_dropped",
) -> DataFrame:
    """Drop lines found in many documents, except in the document with the largest id.

    A key is a line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars`` code points that
    occur in at least ``min_docs`` distinct documents lose all their lines except in the largest ``id_col`` that holds
    them. All columns of ``docs`` are returned, the text replaced, with the numbers of lines before dropping and of
    lines dropped (these two columns are replaced if ``docs`` has them).

    Null and empty texts are one empty line and come back as an empty text. A null id counts as one document, smaller
    than any other. Rows that repeat an id belong to one document: they share its decisions and all come back. An
    empty table gives an empty table.

    The only rows shuffled are 16-byte hashes with ids (a line's text never leaves its row) and, once, the documents
    for the final join. Counting is preceded by partial aggregation, so a line that a third of all documents share
    costs each task one row; the join back to the lines is one that adaptive execution can split by rows. The time of a
    text grows with its lines, however many of them go.
    """
    row, place, key, held, n_docs, last, drop, lines, mark = fresh(
        docs, "ld_row", "ld_place", "ld_key", "ld_doc", "ld_docs", "ld_last", "ld_drop", "ld_lines", "ld_mark"
    )
    ident, text = col(docs, id_col), col(docs, text_col)
    # The id and a hash of the text name a row: rows that repeat an id with another text keep their own positions.
    named = F.xxhash64(F.coalesce(ident.cast("string"), F.lit("null")), text, ident.isNull())
    # F.length counts code points; the raw line is tested first because only long lines can have long keys.
    hashed = (
        docs.select(ident.alias(held), named.alias(row), F.posexplode(lines_of(text)).alias(place, key))
        .where(F.length(key) >= min_chars)
        .withColumn(key, line_key(F.col(key)))
        .where(F.length(key) >= min_chars)
        .withColumn(key, F.unhex(F.md5(key)))
    )
    hashed = cut(hashed)
    spread = (
        hashed.select(key, held)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(n_docs), F.max(held).alias(last))
        .where(F.col(n_docs) >= min_docs)
        .select(key, last)
    )
    # Cut, so that both sides of the join are exchanged for it, and a line that very many documents share can be split.
    spread = cut(spread)
    gone = (
        hashed.join(spread.hint("merge"), key)
        .where(~F.col(held).eqNullSafe(F.col(last)))
        .groupBy(row, held)
        .agg(F.collect_set(place).alias(drop))
    )
    # The lines travel in place of the text: they are split once, and looked up by position after the join.
    left = docs.select(
        *[col(docs, c) for c in docs.columns if c != text_col], named.alias(mark), lines_of(text).alias(lines)
    )
    # Equal rows may repeat, so the join keys only have to be those of the row.
    joined = left.join(
        gone.select(F.col(row), F.col(held), F.col(drop)),
        (F.col(mark) == F.col(row)) & col(left, id_col).eqNullSafe(F.col(held)),
        "left",
    )
    dropped = F.coalesce(F.col(drop), F.array().cast("array<int>"))
    # Positions that stay are found by hashing, in time linear in the lines.
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.array_join(
        F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.transform(places, lambda i: F.get(F.col(lines), i))), "\n"
    )
    out = [
        kept.alias(c) if c == text_col else col(left, c)
        for c in docs.columns
        if c.lower() not in (n_lines_col.lower(), n_dropped_col.lower())
    ]
    return joined.select(
        *out,
        F.size(lines).cast("long").alias(n_lines_col),
        F.size(dropped).cast("long").alias(n_dropped_col),
    )
