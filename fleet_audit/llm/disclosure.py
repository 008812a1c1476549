"""Personal data in texts, and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone numbers. Each value
found is an entity to protect. Every term of a text that holds an entity, wherever it stands, is then
weighed by what the whole corpus knows: with the shares of documents that hold the entity, the term,
and both, the pointwise mutual information of the two against the information of the entity says how
much of it the term reveals. A term above the threshold gets a span of its own wherever it stands in
the texts with that entity; the entity may stand in one text only. A term that stands in a single
text has no use that the corpus knows, so nothing can be said about it, and it gets no span. Terms
that reveal the whole entity are removed from the sanitised text, the others are generalised to a
placeholder.

A null text counts as empty and has no spans. Rows equal in id and text are treated alike; copies of
one text count as documents but as one piece of evidence. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleet_audit.llm.shared import kept

#: Share of the information of an entity that a term may reveal.
THRESHOLD = 0.8
KINDS = ("email", "ip", "card", "phone", "term")

# The contract's patterns. Quantifiers that never need to give back are possessive, and a run of
# characters is tried from its start (or the end of the match before) only; the matches are the same.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_TERM = r"\p{L}[\p{L}\p{N}'-]{2,}"

_SPAN = "struct<start:int,end:int,kind:int,value:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _spans(text: Column, pattern: str, kind: int, holds, value) -> Column:
    """Spans of the matches of ``pattern`` that hold, in code points; the pieces between matches give the positions."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)), matches)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value(x["1"]).alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(holds(x["1"]), span).otherwise(_none())).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start, then kind."""
    def number(low: int, high: int):
        return lambda m: F.length(_digits(m)).between(low, high)

    email = F.when(F.contains(text, F.lit("@")), _spans(text, _EMAIL, 0, lambda m: F.lit(True), F.lower))
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, _IP, 1, lambda m: m.rlike(_IP_PARTS), lambda m: m))
    card = F.when(text.rlike("[0-9]"), _spans(text, _CARD, 2, lambda m: number(14, 19)(m) & F.call_function("luhn_check", _digits(m)), _digits))
    phone = F.when(F.contains(text, F.lit("+")), _spans(text, _PHONE, 3, number(10, 15), _digits))
    return F.array_sort(F.concat(*(F.coalesce(k, _none()) for k in (email, ip, card, phone))), _by_start)


def _by_start(a: Column, b: Column) -> Column:
    def sign(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.when(a["start"] != b["start"], sign(a["start"], b["start"])).otherwise(sign(a["kind"], b["kind"]))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda t: F.lower(t))


def term_counts(docs: DataFrame) -> DataFrame:
    """``term_hash, n_term``: documents with each term that stands in several different texts."""
    hashes = F.array_distinct(F.transform(_terms(F.col("text")), lambda t: F.xxhash64(t)))
    exploded = docs.select("digest", F.explode(hashes).alias("term_hash"))
    counted = exploded.groupBy("term_hash").agg(F.count(F.lit(1)).alias("n_term"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return counted.filter("low != high").select("term_hash", "n_term")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of its base spans, so that all positions stay."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        whole = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.repeat(F.lit(" "), s["end"] - s["start"]))).alias("out"))
        rest = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.repeat(F.lit(" "), s["end"] - acc["at"]))).alias("out"))
        return F.when(s["start"] >= acc["at"], whole).when(s["end"] > acc["at"], rest).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def held_entities(found: DataFrame) -> DataFrame:
    """``digest, size, copies, held, n_entity`` per text and set of entities in it that stand in the same texts.

    Entities of the same texts are revealed alike by every term, so ``held`` stands for all of them; the
    entities that only one text holds are one row of it.
    """
    entity = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))
    each = found.select("digest", "size", "copies", F.explode(F.array_distinct(entity)).alias("entity"))
    mark = F.xxhash64(F.lit("held"), "digest", "size")
    of_entity = each.groupBy("entity").agg(
        F.sum("copies").alias("n_entity"), F.struct(F.count(F.lit(1)).alias("texts"), F.bit_xor("digest").alias("x"), F.bit_xor(mark).alias("y")).alias("held"))
    return each.join(of_entity, "entity").select("digest", "size", "copies", "held", "n_entity").distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``digest, size, term, revealed``: the terms of each text that reveal ``THRESHOLD`` or more of an entity in it."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    near = found.select("digest", "size", F.explode(F.array_distinct(_terms(F.col("rest")))).alias("term"))
    known = near.withColumn("term_hash", F.xxhash64("term")).join(term_counts(docs), "term_hash").select("digest", "size", "term", "n_term")
    information = F.log(n / F.col("n_entity"))
    # A term is seen with an entity in no more documents than hold the entity; what is too common to reveal enough even then is left out early.
    met = known.join(held_entities(found), ["digest", "size"]).filter((information > 0) & (F.log(n / F.col("n_term")) >= THRESHOLD * information - 1e-9))
    both = met.groupBy("held", "term").agg(F.sum("copies").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    mutual = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    revealing = both.withColumn("revealed", mutual / information).filter(F.col("revealed") >= THRESHOLD).select("held", "term", "revealed")
    return met.join(revealing, ["held", "term"]).groupBy("digest", "size", "term").agg(F.max("revealed").alias("revealed"))


def term_spans(found: DataFrame, given: DataFrame) -> DataFrame:
    """``digest, size, start, end, term, revealed`` wherever a term of ``given`` stands in its text."""
    shown = found.join(given.select("digest", "size").distinct(), ["digest", "size"], "left_semi")
    matches = F.regexp_extract_all(F.col("rest"), F.lit(_TERM), F.lit(0))
    words = F.arrays_zip(F.split("rest", _TERM, -1), matches)
    placed = shown.select("digest", "size", F.posexplode(words).alias("k", "w")).filter(F.col("w.1").isNotNull())
    placed = placed.select("digest", "size", "k", F.lower("w.1").alias("term"), F.length("w.1").alias("long"), (F.length("w.0") + F.length("w.1")).alias("step"))
    placed = placed.withColumn("end", F.sum("step").over(W.partitionBy("digest", "size").orderBy("k")).cast("int"))
    return placed.join(given, ["digest", "size", "term"]).select("digest", "size", (F.col("end") - F.col("long")).alias("start"), "end", "term", "revealed")


def find_disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, spans`` for every row: base spans and those of disclosing terms, ordered by start, then kind.

    ``digest`` is the hash of the text; a span has ``start, end, kind`` (the index in ``KINDS``), ``value``
    and, for terms, ``revealed`` (the largest share over its entities).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    spanned = docs.select("id", "digest", F.length("text").alias("size"), "text", base_spans(F.col("text")).alias("spans"))
    rest = F.when(F.size("spans") > 0, without_spans(F.col("text"), F.col("spans")))
    rows = kept(spanned.select("id", "digest", "size", "spans", rest.alias("rest")), "base")
    found = rows.filter(F.size("spans") > 0).groupBy("digest", "size").agg(F.first("spans").alias("spans"), F.first("rest").alias("rest"), F.count(F.lit(1)).alias("copies"))
    found = kept(found, "found")
    given = kept(disclosing_terms(docs, found), "terms")
    terms = term_spans(found, given).groupBy("digest", "size").agg(F.collect_list(F.struct("start", "end", "term", "revealed")).alias("terms"))
    joined = rows.drop("rest").join(terms, ["digest", "size"], "left")
    base = F.transform("spans", lambda s: _span(s["start"], s["end"], s["kind"], s["value"], F.lit(None)))
    added = F.transform("terms", lambda t: _span(t["start"], t["end"], F.lit(KINDS.index("term")), t["term"], t["revealed"]))
    every = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast("array<struct<start:int,end:int,kind:int,value:string,revealed:double>>"))), _by_start)
    return joined.select("id", "digest", every.alias("spans"))


def _span(start: Column, end: Column, kind: Column, value: Column, revealed: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), value.alias("value"), revealed.cast("double").alias("revealed"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", output_col: str = "sanitised") -> DataFrame:
    """``docs`` with base spans replaced by their kind, disclosing terms by ``[term]``, and wholly revealing terms taken out."""
    found = find_disclosures(docs, id_col, text_col).filter(F.size("spans") > 0).groupBy("id", "digest").agg(F.first("spans").alias("_spans"))
    found = found.withColumnsRenamed({"id": "_id", "digest": "_digest"})
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.join(found, docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_digest")), "left")
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["revealed"] >= 1, "").otherwise(F.element_at(names, s["kind"] + 1))
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, put).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    whole = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return joined.select(*(docs[c] for c in docs.columns), F.when(F.col("_spans").isNull(), docs[text_col]).otherwise(whole).alias(output_col))
