"""Line dedup by a log-template tree of fixed depth: token count, leading tokens, then templates with variable fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import HOT_KEYS, free_name, row_column, split_join, text_hash, whole_row, written

FIELD = "<*>"
#: A token with a digit is a variable field.
DIGITS = r"\S*[0-9]\S*"
#: Stretches into which the tokens behind the leading ones are cut; one of them may vary in a template.
STRETCHES = 5
#: Lines whose first three tokens have a letter each, so that all of their templates have three words.
WORDY = r"^\s*+(?:[^\s\p{L}]*+\p{L}\S*+(?:\s++|$)){3}"
#: Constant tokens with a letter that a template needs, and no fewer than the line has digit fields.
LEAST_WORDS = 3
#: Documents from which on a line recurs that is not shared by chance.
FEW_DOCS = 2
#: Words with a letter from which on an equal line is not shared by chance: no word makes up more than a tenth of a text, so two
#: unrelated lines of eight words are equal with a chance below 10**-8.
EXACT_WORDS = 8
EXACT = rf"^(?:[^\p{{L}}]*+\p{{L}}\S*+){{{EXACT_WORDS}}}"
#: Tokens from which on no template of a line is shared by chance, as four fifths of them are constant (less its digit fields).
LONG_LINE = 20


def _keys(line: Column, leading: int, long_from: int | None) -> Column:
    """Keys of the templates that a line belongs to; none for a blank line.

    Path in the tree: token count, then ``leading`` tokens with digit fields masked. In the leaf, each template has one of
    ``STRETCHES`` equal stretches of the other tokens as a variable field beside the masked ones, so lines that share one
    agree on four fifths of these tokens. Lines with fewer tokens behind the leading ones have one template, themselves.
    A template with fewer constant words than ``LEAST_WORDS`` or than the line has digit fields is replaced by the line as it
    is, so lines of numbers or separators share a key only when their tokens are equal.
    A line of ``EXACT_WORDS`` words or more has itself, as it is, as one more key.
    Keys that recur in ``FEW_DOCS`` documents already are odd, all others even, so that a key tells it without a column: those of
    whole lines of ``EXACT_WORDS`` words, and all keys of lines of ``long_from`` tokens, if it is given.
    """
    def tokens(of: Column) -> Column:
        return F.split(F.trim(of), r"\s+")

    def let(value: Column, function) -> Column:  # evaluates a shared part once
        return F.transform(F.array(value), function)[0]

    def of(t: Column, digits: bool) -> Column:
        n = F.size(t)
        rest = n - leading

        def end(i: int) -> Column:
            return F.expr("int(0)") if i == 0 else F.floor(rest * i / STRETCHES).cast("int")

        parts = F.array(F.xxhash64(n, F.slice(t, 1, leading)), *[
            F.xxhash64(F.slice(t, leading + 1 + end(i), end(i + 1) - end(i))) for i in range(STRETCHES)])
        varied = let(parts, lambda p: F.array(*[
            F.xxhash64(F.lit(i), *[p[j] for j in range(STRETCHES + 1) if j != i + 1]) for i in range(STRETCHES)]))
        keys = F.when(rest >= STRETCHES, varied).otherwise(F.array(F.xxhash64(n, t)))

        def words(of: Column) -> Column:
            return F.size(F.filter(of, lambda x: x.rlike(r"\p{L}")))

        def cut(i: Column) -> Column:  # words in the stretch that varies
            begin, stop = (F.floor(rest * x / STRETCHES).cast("int") for x in (i, i + 1))
            return F.when(rest >= STRETCHES, words(F.slice(t, leading + 1 + begin, stop - begin))).otherwise(0)

        counts = F.array(words(t), F.greatest(F.lit(LEAST_WORDS), F.size(F.filter(t, lambda x: x == FIELD))))
        whole = F.xxhash64(F.lit("line"), tokens(line))
        told = let(counts, lambda c: F.transform(keys, lambda key, i: F.when(c[0] - cut(i) >= c[1], key).otherwise(whole)))
        if digits:
            keys = told
        else:  # a short line without digits has one key, itself, in any case
            safe = line.rlike(WORDY) if leading >= LEAST_WORDS else F.lit(False)
            keys = F.when((rest >= STRETCHES) & ~safe, told).otherwise(keys)
        few = F.lit(False) if long_from is None else n >= long_from
        keys = F.transform(keys, lambda key: F.when(few, key.bitwiseOR(F.lit(1))).otherwise(key.bitwiseAND(F.lit(-2))))
        itself = F.array(F.xxhash64(F.lit("exact"), F.trim(line)).bitwiseOR(F.lit(1)))
        return F.when((n >= EXACT_WORDS) & line.rlike(EXACT), F.concat(keys, itself)).otherwise(keys)

    return F.when(F.length(F.trim(line)) == 0, F.array().cast("array<bigint>")).when(
        line.rlike("[0-9]"), let(tokens(F.regexp_replace(line, DIGITS, FIELD)), lambda t: of(t, True))).otherwise(
        let(tokens(line), lambda t: of(t, False)))


def keyed(documents: DataFrame, leading: int = 3, long_from: int | None = None) -> DataFrame:
    """``doc_id``, ``row_hash`` and ``keys``: the template keys of each line, in order; written, so that a line is keyed once."""
    return written(documents.where(F.col("text").isNotNull()).select(
        "doc_id", text_hash().alias("row_hash"),
        F.transform(F.split("text", "\n"), lambda x: _keys(x, leading, long_from)).alias("keys")), "line-keys")[0]


def recurring(keys: DataFrame, min_docs: int = 3) -> DataFrame:
    """Templates that lines of ``min_docs`` documents or more share (``FEW_DOCS`` for odd keys): ``key``, ``n_docs``, and the first
    document that has it, ``first_id``, or, if none of them has an id, ``first_hash``.

    First is the smallest doc_id; rows without one come last, the smallest text hash first. A row has each template once, and
    these are summed before the shuffle, so a line that most documents have is one row per task.
    """
    once = keys.select("doc_id", "row_hash", F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
    least = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.least(F.lit(FEW_DOCS), F.lit(min_docs))).otherwise(F.lit(min_docs))
    return once.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"),
        F.min(F.when(F.col("doc_id").isNull(), F.col("row_hash"))).alias("first_hash")).where(F.col("n_docs") >= least)


def repeated_lines(documents: DataFrame, min_docs: int = 3, leading: int = 3, long_from: int | None = None,
                   hot: int = HOT_KEYS) -> DataFrame:
    """``doc_id``, ``row_hash``, ``dropped`` (line numbers from 0): lines of recurring templates outside their first document.

    Templates with one in ``hot`` of the rows to be found are broadcast, so that no key is hot in the join of the others.
    """
    keys = keyed(documents, leading, long_from)
    found, _ = written(recurring(keys, min_docs), "templates")
    lines = keys.select("doc_id", "row_hash", F.posexplode("keys").alias("at", "of"))
    rows = lines.select("doc_id", "row_hash", "at", F.explode("of").alias("key"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("first_id")).otherwise(
        F.col("first_id").isNull() & (F.col("row_hash") == F.col("first_hash")))
    return split_join(rows, found, "key", "n_docs", hot).where(~own).groupBy("doc_id", "row_hash").agg(
        F.collect_set("at").alias("dropped"))


def deduplicated(documents: DataFrame, min_docs: int = 3, leading: int = 3, long_from: int | None = None,
                 counts: bool = True) -> DataFrame:
    """All rows of ``documents`` with the columns they had, ``text`` without repeated lines, and with ``counts`` ``n_lines`` and ``n_dropped``.

    A line goes if one of its templates recurs in ``min_docs`` documents or more (two for whole lines of ``EXACT_WORDS`` words, and
    for all templates of lines of ``long_from`` tokens, if given) and another document is the first to have it, so that no text
    vanishes from the corpus. Rows of one doc_id are one document; repeated rows count each and share their lines' fate. Null texts
    stay null (0 lines), blank lines stay; an empty table gives an empty result. A text may become empty. If ``documents`` has a
    column ``n_chars``, it is set to the new length where a line went. Other columns stay as they are, whatever their names; a
    count whose name is taken gets an underscore.
    """
    gone = repeated_lines(documents, min_docs, leading, long_from)
    rows = documents.select(whole_row(documents).alias("row"), F.col("doc_id").alias("row_id"), text_hash().alias("row_text"))
    both = rows.join(gone, rows["row_id"].eqNullSafe(gone["doc_id"]) & (rows["row_text"] == gone["row_hash"]), "left")
    lines = F.split(row_column("text"), "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("dropped", i)), "\n")
    counted = both.select(
        "row", "dropped", F.when(F.col("dropped").isNull(), row_column("text")).otherwise(kept).alias("new"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"))
    values = {"text": F.col("new")}
    if "n_chars" in documents.columns:
        values["n_chars"] = F.when(F.col("dropped").isNull(), row_column("n_chars")).otherwise(F.length("new")).cast(
            documents.schema["n_chars"].dataType)
    told = []
    if counts:
        taken = list(documents.columns)
        for name, value in (("n_lines", F.col("lines")), ("n_dropped", F.coalesce(F.size("dropped"), F.lit(0)).cast("long"))):
            taken.append(free_name(name, taken))
            told.append(value.alias(taken[-1]))
    return counted.select(*[values.get(c, row_column(c)).alias(c) for c in documents.columns], *told)
