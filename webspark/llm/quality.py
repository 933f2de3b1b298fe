"""Quality rules over lines that recur across the documents of a host.

Boilerplate is a line that many documents of one host share. Lines are normalised and hashed, the
distinct documents of each (host, line) are counted, lines above the limits are removed, and documents
of which too little is left are rejected. Beside it stand a few plain figures of every text. Everything
is built-in functions: figures stay in the row, and of the lines only hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A line is boilerplate when more documents of its host than both limits hold it. The share counts up to
# SHARE_DOCS documents only: a line in more is boilerplate, however many documents the host has.
MAX_DOCS = 20
MAX_SHARE = 0.005
SHARE_DOCS = MAX_DOCS
# A document is depleted when less than this part of its words is left.
LEAST_LEFT = 0.5
# Fixed values of the plain figures.
WINDOW_WORDS = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
NOT_SYMBOL = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Words of a text; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW_WORDS that occur twice or more, the first occurrence included.

    Windows are hashed; texts without a repeated window stop there. Else the windows are put in order
    of hash and place, so that equal ones are neighbours, and what their places cover is summed.
    Everything is linear in the text, or a sort of it.
    """
    last = F.size(words) - WINDOW_WORDS
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW_WORDS)])
    )

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def at(sorted_pairs: Column) -> Column:
            def again(p: Column, k: Column) -> Column:
                before, after = F.get(sorted_pairs, k - 1), F.get(sorted_pairs, k + 1)
                return F.coalesce(before["h"] == p["h"], F.lit(False)) | F.coalesce(
                    after["h"] == p["h"], F.lit(False)
                )

            starts = F.array_sort(F.transform(F.filter(sorted_pairs, again), lambda p: p["i"]))
            return _let(
                starts,
                lambda s: F.aggregate(
                    F.transform(
                        s, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW_WORDS)))
                    ),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return _let(pairs, at)

    return _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_figures(text: Column) -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; null has none."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    words = words_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(whole, NOT_SYMBOL, "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(words, repeated_words).cast("long"),
    }


def normalised(line: Column) -> Column:
    """A line as it is compared: lower case, digits all 0, no space around, one space within."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def _document_lines(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """``(ws_row, host, hash, line_no, words)`` of every line with a word."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.select(
        F.col(key).alias("ws_key"),
        F.col(host).alias("ws_host"),
        F.xxhash64(text).alias("ws_twin"),
        F.posexplode(split).alias("line_no", "line"),
    ).where(F.regexp_like("line", F.lit(WORD)))
    return rows.select(
        "ws_key", "ws_host", "ws_twin", "line_no",
        F.xxhash64(normalised(F.col("line"))).alias("hash"),
        F.size(words_of(F.col("line"))).alias("words"),
    )


def line_frequency(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    least_left: float = LEAST_LEFT,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = True,
    share_docs: int = SHARE_DOCS,
) -> DataFrame:
    """The documents with their figures and verdict, and their text without boilerplate lines.

    Added are the :func:`base_figures`, ``base_failed``, ``boilerplate_lines``, ``words_left``,
    ``clean_text`` (if ``with_text``) and ``kept``; columns of the input with these names are replaced.
    ``base_failed``: fewer than 10 words, or more than 20 % of them in repeated windows. A line goes
    when more than ``max_docs`` documents of its host, and more than ``max_share`` of them or more than
    ``share_docs``, hold it (:func:`normalised`); so a host's size protects no line above ``share_docs``. ``kept`` is false for failed documents and for those with less than
    ``least_left`` of their words left.

    A null host is a host; a null or empty text has no lines, no words, and fails. Documents are told
    apart by id and text: rows equal in both are one document to the counts, and are returned as often
    as given. A null id is an id like any other. An empty table gives an empty one.
    """
    lines = _document_lines(docs, id_column, host, text_column)
    document = ["ws_host", "ws_key", "ws_twin"]
    # Distinct documents of a line: equal lines of a document first, under a key that no host heats.
    held = lines.groupBy("hash", *document).agg(F.count("*").alias("ws_n"))
    counts = held.groupBy("hash", "ws_host").agg(F.count("*").alias("ws_docs"))
    sizes = (
        docs.select(F.col(host).alias("ws_host"), F.col(id_column).alias("ws_key"), F.xxhash64(text_column).alias("ws_twin"))
        .distinct()
        .groupBy("ws_host")
        .agg(F.count("*").alias("ws_total"))
    )
    same_host = F.col("c.ws_host").eqNullSafe(F.col("s.ws_host"))
    frequent = counts.where(F.col("ws_docs") > max_docs).alias("c")
    if share_docs > max_docs:
        share = F.col("ws_docs") > F.lit(max_share) * F.col("ws_total")
        frequent = frequent.join(sizes.alias("s"), same_host).where(share | (F.col("ws_docs") > share_docs))
    frequent = frequent.select("c.hash", F.col("c.ws_host").alias("ws_of"))
    # One line may be a third of a host's lines: a plain join on line and host, which Spark can split.
    met = lines.alias("l").join(
        frequent.withColumnRenamed("hash", "ws_hash"),
        (F.col("l.hash") == F.col("ws_hash")) & F.col("l.ws_host").eqNullSafe(F.col("ws_of")),
    )
    removed = met.groupBy(*[F.col(c).alias(f"{c}_r") for c in document]).agg(
        F.collect_set(F.struct("line_no", "words")).alias("ws_gone")
    )
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "boilerplate_lines", "words_left", "clean_text", "kept")
    names = [c for c in docs.columns if c.lower() not in made]
    based = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.xxhash64(text_column).alias("ws_twin"),
        *[c.alias(n) for n, c in base_figures(F.col(text_column)).items()],
    )
    meets = (
        F.col(id_column).eqNullSafe(F.col("ws_key_r"))
        & F.col(host).eqNullSafe(F.col("ws_host_r"))
        & (F.col("ws_twin") == F.col("ws_twin_r"))
    )
    gone = F.coalesce(F.col("ws_gone"), F.array().cast("array<struct<line_no:int,words:int>>"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.aggregate(gone, F.lit(0).cast("long"), lambda a, g: a + g["words"])
    all_lines = F.split(F.col(text_column), "\n")
    stay = F.array_except(
        F.sequence(F.lit(0), F.size(all_lines) - 1), F.transform(gone, lambda g: g["line_no"])
    )
    clean = F.when(F.col("ws_gone").isNull(), F.col(text_column)).otherwise(
        F.array_join(F.transform(stay, lambda k: F.get(all_lines, k)), "\n")
    )
    judged = based.join(removed, meets, "left").select(
        *[F.col(f"`{c}`") for c in names],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.size(gone).cast("long").alias("boilerplate_lines"),
        left.alias("words_left"),
        *([clean.alias("clean_text")] if with_text else []),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= least_left * F.col("n_words")))
