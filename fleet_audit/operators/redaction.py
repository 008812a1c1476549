"""Verify on read that secrets were redacted; refuse the files in which they were not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit import fixed_values
from fleet_audit.findings import to_findings
from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.functions.text import glob_regex, whole_match_regex
from fleet_audit.sources.parsers import (
    JSON_FILES,
    JVM_FILES,
    PROPERTIES_FILES,
    XML_FILES,
    assignment_entries,
    parse_all,
)

MASK = "********"
_FILE = ["cluster", "role", "node", "file"]


def shown_value(key: str = "key", raw: str = "raw") -> Column:
    """The raw value as it may appear in results: a secret that is no placeholder is masked."""
    return F.when(is_exposed(key, raw), MASK).otherwise(F.col(raw))


def is_exposed(key: str = "key", raw: str = "raw") -> Column:
    """True for a secret that is no placeholder."""
    secret = F.col(key).rlike(glob_regex(fixed_values.SENSITIVE_KEYS))
    return secret & ~F.col(raw).rlike(whole_match_regex(fixed_values.PLACEHOLDERS))


def sensitive_keys(entries: DataFrame, patterns=fixed_values.SENSITIVE_KEYS) -> DataFrame:
    """Entries whose key matches one of the globs, in any case."""
    return entries.where(F.col("key").rlike(glob_regex(patterns)))


def verify_redaction(
    entries: DataFrame, patterns=fixed_values.SENSITIVE_KEYS, placeholders=fixed_values.PLACEHOLDERS
) -> DataFrame:
    """Violations: ``cluster, role, node, file, line, key``. The value is not carried on."""
    exposed = ~F.col("raw").rlike(whole_match_regex(placeholders))
    return sensitive_keys(entries, patterns).where(exposed).select(*_FILE, "line", "key")


def file_violations(
    files: DataFrame, patterns=fixed_values.SENSITIVE_KEYS, placeholders=fixed_values.PLACEHOLDERS, parsed: DataFrame | None = None
) -> DataFrame:
    """Violations in whole files: settings of known formats, and assignments anywhere.

    ``parsed`` are the violations among the settings, where files were parsed already.
    """
    if parsed is None:
        parsed = verify_redaction(parse_all(files), patterns, placeholders)
    anywhere = verify_redaction(assignment_entries(files).unionByName(json_scalars(files)), patterns, placeholders)
    return parsed.unionByName(anywhere).distinct()


def json_scalars(files: DataFrame) -> DataFrame:
    """Every ``"key": scalar`` of JSON files, at any depth, with numbers and with the value on a later line."""
    pair = r'"((?:[^"\\]|\\.)*+)"\s*:\s*("(?:[^"\\]|\\.)*+"|[^\s,"{}\[\]]+)'
    content = F.col("content")
    found = files.where(F.col("file").rlike(JSON_FILES)).select(
        *_FILE, "content", F.explode(F.regexp_extract_all("content", F.lit(pair), F.lit(0))).alias("_pair"))
    head = F.substring(content, F.lit(1), F.instr(content, F.col("_pair")) - 1)
    return found.select(
        *_FILE, (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("int").alias("line"),
        F.regexp_extract("_pair", pair, 1).alias("key"), F.regexp_replace(F.regexp_extract("_pair", pair, 2), '^"|"$', "").alias("raw"))


def is_verifiable(free_text: str | None = None) -> Column:
    """True for files that can be checked: of a known kind and well-formed.

    ``free_text`` is a pattern of names that are known to be free text, where only assignments are looked for.
    """
    name = F.col("file")
    known = name.rlike(f"{PROPERTIES_FILES}|{JVM_FILES}|{XML_FILES}|{JSON_FILES}" + (f"|{free_text}" if free_text else ""))
    xml = F.from_xml("content", "_broken string, property array<struct<name: string>>", {"columnNameOfCorruptRecord": "_broken"})
    broken_xml = name.rlike(XML_FILES) & (xml.isNull() | xml["_broken"].isNotNull())
    broken_json = name.rlike(JSON_FILES) & F.try_parse_json("content").isNull()
    return F.coalesce(known & ~broken_json & ~broken_xml & F.col("content").isNotNull(), F.lit(False))


def unverifiable(files: DataFrame, free_text: str | None = None) -> DataFrame:
    """Files that cannot be checked: of no known format, or malformed."""
    return files.where(~is_verifiable(free_text)).select(*_FILE)


def refusal_findings(refused: DataFrame) -> DataFrame:
    """One high-severity finding per file that cannot be checked and is therefore not returned."""
    return to_findings(
        refused,
        cluster=F.col("cluster"), rule_id="redaction", severity="high", property=F.col("file"),
        actual="unknown or malformed", expected="a well-formed file of a known kind",
        rationale="A file that cannot be parsed may hold secrets that the check does not see.",
        file=F.concat_ws("/", "role", "file"), cause="unverifiable_file",
    )


def redaction_findings(violations: DataFrame) -> DataFrame:
    """One high-severity finding per exposed key; the secret itself never appears."""
    return to_findings(
        violations,
        cluster=F.col("cluster"), rule_id="redaction", severity="high", property=F.col("key"),
        actual=MASK, expected="a placeholder",
        rationale="A key that holds a secret has a value that was not redacted in the backup.",
        file=F.concat_ws("/", "role", "file"), line=F.col("line"), cause="unredacted_value",
    )


def config_detail(
    files: DataFrame,
    violations: DataFrame,
    cluster: str | None = None,
    role: str | None = None,
    file: str | None = None,
    free_text: str | None = None,
) -> DataFrame:
    """Content of files that passed verification; one with a violation, or that cannot be checked, is absent.

    Files with violations are few and are broadcast after a count, which spares the
    contents a shuffle; should they be many, they are joined by key.
    """
    wanted = files
    for name, value in (("cluster", cluster), ("role", role), ("file", file)):
        if value is not None:
            wanted = wanted.where(F.col(name) == value)
    refused = broadcast_if_small(violations.select(*_FILE).distinct())
    checked = wanted.withColumn("redaction_verified", is_verifiable(free_text)).where("redaction_verified")
    return checked.join(refused, _FILE, "left_anti").select(*_FILE, "content", "redaction_verified")
