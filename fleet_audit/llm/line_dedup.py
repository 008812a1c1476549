"""Removal of multi-line chunks that repeat anywhere in the corpus, with shift-resistant boundaries.

A text is cut into lines: at line breaks, and after a full stop and blank, since prose often has
whole paragraphs on one line. A line of over ``LONG_BYTES`` is cut further, after each word whose own
hash says so (one in ``WORDS_PER_CUT``), so a passage on one line is cut alike wherever it stands.

A chunk starts at a line that is not blank and takes lines until it has two that are not blank and
``MIN_WORDS`` words, ``MAX_LINES`` lines at most. A rolling hash over its lines' hashes is its key and
decides whether there is a boundary where it starts (31 of 32 have one). Both its start and its end hang
on lines inside it only, so lines before and behind a passage change none of its chunks. Chunks
overlap: a longer passage goes as the union of its chunks.

Chunks that occur elsewhere, in another text or further up in the same, are removed everywhere but at
their first place (the smallest document, then the topmost line); so the first place of every line
stays. Equal hashes are only candidates: the texts of all chunks of a hash are compared, and where they
differ each text is judged by itself. White space at the ends of lines does not count in the comparison.
Words are counted by blanks and tabs; where most letters have three bytes, as in scripts without blanks,
four letters count as a word at least.

A null text stays null and an empty one stays empty; neither has lines. A null id sorts behind all
others; rows of equal id are told apart by their text, and rows equal in both count as one text and
are treated alike. Texts are otherwise unchanged, byte for byte. A line with the control character
U+0001 is not cut further. Empty tables give no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.shared import kept, unused

MAX_LINES = 16
MIN_WORDS = 8
#: One in so many chunks has no boundary at its start.
BOUNDARIES = 32
#: Some 50 words.
LONG_BYTES = 250
WORDS_PER_CUT = 6
_MARK = "\x01"
#: Letters of scripts that put no blanks between words.
_LETTERS = r"\u0E00-\u0EFF\u3040-\u30FF\u3400-\u9FFF"


def split_lines(text: Column) -> Column:
    """The lines of a text, each with what ends it; put together they are the text again."""
    marked = F.replace(F.replace(text, F.lit("\n"), F.lit("\n" + _MARK)), F.lit(". "), F.lit(". " + _MARK))
    slow = F.split(text, r"(?<=\n)|(?<=\. )")
    lines = F.when(F.contains(text, F.lit(_MARK)), slow).otherwise(F.split(marked, _MARK))
    # Bound to a variable, so that the split is made once.
    whole = F.transform(F.array(lines), lambda found: F.when(
        F.exists(found, _is_long), F.flatten(F.transform(found, lambda line: F.when(_is_long(line), _parts(line)).otherwise(F.array(line))))
    ).otherwise(found))
    return F.filter(whole[0], lambda line: line != "")


def _is_long(line: Column) -> Column:
    return (F.octet_length(line) > LONG_BYTES) & ~F.contains(line, F.lit(_MARK))


def _parts(line: Column) -> Column:
    """A long line cut after the words that their hashes choose."""
    words = F.split(line, rf"(?<=\s)(?=\S)|(?<=[{_LETTERS}])")
    cut = lambda word: F.pmod(F.xxhash64(_bare(word)), F.lit(WORDS_PER_CUT)) == 0
    return F.split(F.array_join(F.transform(words, lambda w: F.when(cut(w), F.concat(w, F.lit(_MARK))).otherwise(w)), ""), _MARK)


def _bare(line: Column) -> Column:
    return F.rtrim(F.rtrim(line, F.lit(" \n\r\t")))


def _line_hash(bare: Column) -> Column:
    return F.xxhash64(bare)


def _words(bare: Column) -> Column:
    """Words of a bare line, by its blanks and tabs; one for four letters at least where letters have mostly three bytes."""
    spaced = F.trim(bare)
    without = F.replace(F.replace(spaced, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))
    by_blanks = F.length(spaced) - F.length(without) + 1
    wide = F.octet_length(bare) > 2 * F.length(bare)
    return F.when(bare == "", 0).when(wide, F.greatest(by_blanks, F.floor(F.length(bare) / 4).cast("int"))).otherwise(by_blanks)


def chunks_of(texts: DataFrame) -> DataFrame:
    """``hash, id, digest, start, lines`` of every chunk of ``texts`` (``id, digest, text``)."""
    lines = texts.select("id", "digest", F.transform(split_lines(F.col("text")), _bare).alias("bare"))
    hashed = lines.select("id", "digest", F.transform("bare", _line_hash).alias("h"), F.transform("bare", _words).alias("words"))

    def length(i: Column) -> Column:
        words = [F.get("words", i + k) for k in range(MAX_LINES)]
        enough = [(words[n - 1] > 0) & (reduce(Column.__add__, words[:n]) >= MIN_WORDS) for n in range(2, MAX_LINES + 1)]
        chain = reduce(lambda c, n: c.when(enough[n - 2], n), range(3, MAX_LINES + 1), F.when(enough[0], 2))
        return F.when(words[0] > 0, chain)

    placed = F.transform("h", lambda _, i: F.struct(i.alias("start"), length(i).alias("lines")))
    hashes = F.transform(F.filter(placed, lambda p: p["lines"].isNotNull()), lambda p: F.struct(
        F.xxhash64(F.slice("h", p["start"] + 1, p["lines"])).alias("hash"), p["start"].alias("start"), p["lines"].alias("lines")))
    found = hashed.select("id", "digest", F.explode(hashes).alias("c")).select("c.hash", "id", "digest", "c.start", "c.lines")
    return found.filter(F.pmod("hash", F.lit(BOUNDARIES)) != 0)


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """``id, digest, start, lines``: the chunks of ``texts`` (``id, digest, text``) that stand elsewhere before."""
    found = kept(chunks_of(texts), "chunks")
    often = kept(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "often")
    candidates = kept(found.join(often, "hash"), "candidates")
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "digest", "start")

    of_text = candidates.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "lines", "hash")).alias("chunks"))
    with_text = of_text.join(texts, _same_text(of_text, texts)).select(
        of_text["id"], of_text["digest"], "chunks", F.transform(split_lines(F.col("text")), _bare).alias("text_lines"))
    chunk = F.transform("chunks", lambda c: F.struct(
        c["hash"].alias("hash"), c["start"].alias("start"), c["lines"].alias("lines"), F.array_join(F.slice("text_lines", c["start"] + 1, c["lines"]), "\n").alias("chunk")))
    written = with_text.select("id", "digest", F.explode(chunk).alias("c")).select("id", "digest", "c.*").withColumn("place", place)

    compared = kept(written.groupBy("hash").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), (F.min("chunk") == F.max("chunk")).alias("alike")
    ).filter("first != last").drop("last"), "compared")
    later = candidates.withColumn("place", place).join(compared.filter("alike"), "hash").filter("place != first").select("id", "digest", "start", "lines")
    unlike = compared.filter("not alike").select("hash")
    if unlike.isEmpty():
        return later
    apart = kept(written.join(unlike, "hash", "left_semi"), "apart")
    first = apart.groupBy("hash", "chunk").agg(F.min("place").alias("first"))
    return later.unionByName(apart.join(first, ["hash", "chunk"]).filter("place != first").select("id", "digest", "start", "lines"))


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return (a["digest"] == b["digest"]) & a["id"].eqNullSafe(b["id"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_lines") -> DataFrame:
    """``docs`` with the repeated chunks cut out of its texts, and the number of lines cut.

    A column of ``docs`` named ``removed_col`` is replaced.
    """
    digest = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text"))
    chosen, of_text, marks, gone = (unused(docs, stem) for stem in ("cut_id", "cut_digest", "cut_chunks", "cut_lines"))
    cut = repeated_chunks(texts).groupBy("id", "digest").agg(F.collect_set(F.struct("start", "lines")).alias(marks))
    cut = kept(cut, "cuts").withColumnsRenamed({"id": chosen, "digest": of_text})
    joined = docs.join(cut, (digest == F.col(of_text)) & F.col(id_col).eqNullSafe(F.col(chosen)), "left")
    numbers = F.flatten(F.transform(marks, lambda c: F.sequence(c["start"], c["start"] + c["lines"] - 1)))
    joined = joined.withColumn(gone, F.array_distinct(numbers))
    left = F.array_join(F.filter(split_lines(F.col(text_col)), lambda line, i: ~F.array_contains(gone, i)), "")
    return joined.select(
        *(F.when(F.col(marks).isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns if c != removed_col),
        F.coalesce(F.size(gone), F.lit(0)).alias(removed_col))
