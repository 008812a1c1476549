"""Configuration files to ``config_entries``, all files of all clusters at once.

Every parser takes ``config_files``, keeps the files of its kind and explodes them
to one row per setting, with the line it stands on. No parser shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = ("cluster", "role", "node", "file")
_JOINT = "\u0001"  # stands for a continued line end while lines are split

PROPERTIES_FILES = r"(?i)\.properties$"
JVM_FILES = r"(?i)(^|/)jvm\.config$"
XML_FILES = r"(?i)\.xml$"
JSON_FILES = r"(?i)\.json$"


def _of_kind(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("file").rlike(pattern))


def _entries(df: DataFrame, line: Column, key: Column, raw: Column) -> DataFrame:
    return df.select(
        *_KEYS, line.cast("int").alias("line"), key.alias("key"), raw.alias("raw")
    ).where("key <> ''")


def _line_of(content: Column, needle: Column) -> Column:
    """Line of the first occurrence of ``needle``, counted from 1; NULL when absent."""
    at = F.instr(content, needle)
    head = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1)


def _lines(text: Column) -> Column:
    """Lines of a text; one plain character splits without a pattern."""
    return F.when(F.contains(text, F.lit("\r")), F.split(text, r"\r?\n")).otherwise(F.split(text, "\n"))


def properties_entries(files: DataFrame) -> DataFrame:
    """``key=value``, ``key = value`` and ``key: value`` lines; comments are skipped.

    A line that ends in an odd number of backslashes goes on in the next one and keeps the
    number of its first line. A comment line never goes on.
    """
    comments = F.regexp_replace("content", r"(?m)^([ \t]*[#!][^\r\n]*?)\\+(\r?)$", "$1$2")
    joined = F.regexp_replace(comments, r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t]*", "$1" + _JOINT)
    # Both patterns need a backslash, which few files have.
    text = F.when(F.contains("content", F.lit("\\")), joined).otherwise(F.col("content"))
    lines = _of_kind(files, PROPERTIES_FILES).withColumn("_text", text).select(
        *_KEYS, "_text", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line")
    )
    before = F.when(F.col("_pos") > 0, F.expr("substring_index(_text, '\\n', _pos)")).otherwise("")
    joints = F.when(
        F.instr("_text", _JOINT) > 0,
        F.length(before) - F.length(F.replace(before, F.lit(_JOINT))),
    ).otherwise(0)
    plain = F.replace(F.col("_line"), F.lit(_JOINT))
    pattern = r"^\s*([^#!\s=:][^\s=:]*)\s*[=:\s]\s*(.*?)\s*$"
    return _entries(
        lines, F.col("_pos") + 1 + joints,
        F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2),
    )


def jvm_entries(files: DataFrame) -> DataFrame:
    """Flags of ``jvm.config``: ``-Xmx``/``-Xms``/``-Xss`` with size, ``-XX`` and ``-D``."""
    lines = _of_kind(files, JVM_FILES).select(
        *_KEYS, F.posexplode(_lines(F.col("content"))).alias("_pos", "_line")
    )
    line = F.trim("_line")
    sized, named = r"^(-X(?:mx|ms|ss|mn))(\d+[kKmMgGtT]?)$", r"^-(?:D|XX:)([^=\s]+)=(.*)$"
    switch = r"^-XX:([+-])(\S+)$"
    key = (
        F.when(line.rlike(sized), F.regexp_extract(line, sized, 1))
        .when(line.rlike(switch), F.regexp_extract(line, switch, 2))
        .when(line.rlike(named), F.regexp_extract(line, named, 1))
        .when(line.startswith("-"), line)
        .otherwise("")
    )
    raw = (
        F.when(line.rlike(sized), F.regexp_extract(line, sized, 2))
        .when(line.rlike(switch), F.when(F.regexp_extract(line, switch, 1) == "+", "true").otherwise("false"))
        .when(line.rlike(named), F.regexp_extract(line, named, 2))
        .otherwise("")
    )
    return _entries(lines, F.col("_pos") + 1, key, raw)


def hive_site_entries(files: DataFrame) -> DataFrame:
    """``<property>`` elements of XML files such as ``hive-site.xml``; a repeated name has the line of each occurrence."""
    schema = "property array<struct<name: string, value: string>>"
    rows = (
        _of_kind(files, XML_FILES)
        .select(*_KEYS, "content", F.from_xml("content", schema).alias("_xml"))
        .select(*_KEYS, "content", "_xml", F.posexplode("_xml.property").alias("_i", "_p"))
        .withColumn("_nth", F.size(F.filter(F.slice("_xml.property", 1, F.col("_i") + 1), lambda p: p["name"] == F.col("_p.name"))))
    )
    name = F.trim("_p.name")
    tag = F.concat(F.lit("<name>"), F.col("_p.name"), F.lit("</name>"))
    head = F.call_function("substring_index", F.col("content"), tag, F.col("_nth"))
    line = F.when(F.instr(F.col("content"), tag) > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).otherwise(_line_of(F.col("content"), name))
    return _entries(rows, line, name, F.trim(F.coalesce("_p.value", F.lit(""))))


def ranger_entries(files: DataFrame) -> DataFrame:
    """Access policies: one entry per field of each policy, key ``policy.<id>.<field>``."""
    policies = (
        _of_kind(files, JSON_FILES)
        .select(*_KEYS, "content", F.try_parse_json("content").alias("_doc"))
        .select(
            *_KEYS, "content",
            F.explode(F.try_variant_get("_doc", "$.policies", "array<variant>")).alias("_policy"),
        )
        .select(
            *_KEYS, "content",
            F.try_variant_get("_policy", "$.id", "string").alias("_id"),
            F.explode(F.try_variant_get("_policy", "$", "map<string, variant>")).alias("_field", "_value"),
        )
    )
    at = F.regexp_instr("content", F.concat(F.lit(r'"id"\s*:\s*"?\Q'), F.col("_id"), F.lit(r"\E(?![A-Za-z0-9_.-])")))
    head = F.substring(F.col("content"), F.lit(1), at - 1)
    line = F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1)
    text = F.coalesce(F.try_variant_get("_value", "$", "string"), F.to_json("_value"))
    return _entries(policies, line, F.concat_ws(".", F.lit("policy"), "_id", "_field"), text)


def assignment_entries(files: DataFrame) -> DataFrame:
    """Any ``key = "value"`` or ``"key": "value"`` anywhere in any file, whatever its kind.

    The redaction check reads files this way too, so that a secret nested in JSON or
    inlined in free text is seen as well as one in a properties file.
    """
    lines = files.select(*_KEYS, F.posexplode(_lines(F.col("content"))).alias("_pos", "_line")).where(
        F.col("_line").contains('"')
    )
    pair = r'([A-Za-z_][A-Za-z0-9_.-]*)"?\s*[=:]\s*"([^"]*)"'
    pairs = lines.select(*_KEYS, "_pos", F.explode(F.regexp_extract_all("_line", F.lit(pair), F.lit(0))).alias("_pair"))
    return _entries(
        pairs, F.col("_pos") + 1, F.regexp_extract("_pair", pair, 1), F.regexp_extract("_pair", pair, 2)
    )


def parse_all(files: DataFrame) -> DataFrame:
    """Entries of every known kind of file."""
    parsers = (properties_entries, jvm_entries, hive_site_entries, ranger_entries)
    return reduce(DataFrame.unionByName, [parse(files) for parse in parsers])
