"""Values fixed by the audit's definition, kept together as plain text."""

# Directories of a configuration backup, one per role.
BACKUP_ROLES = ("coordinator", "worker", "hms", "ranger")

# Key patterns whose value must be a placeholder.
SENSITIVE_KEYS = ("*password*", "*secret*", "*keytab*", "*credential*")

# Intent signal -> scopes.
SCOPE_SIGNALS = (
    (r"spilling|OOM|memory", ("memory", "jvm", "spill")),
    (r"hive\b.*\bcatalog\b.*\bslow|slow\b.*\bhive\b.*\bcatalog", ("hive_catalog", "hms", "s3")),
    (r"(?:cannot|can't|can not)\s+access\b.*\btable", ("ranger", "hms", "auth")),
    (r"general|validate", ("all",)),
)

# Detector names in the order they are listed in a report.
DETECTORS = (
    "no_partition_pruning",
    "exploding_join",
    "bad_broadcast",
    "missing_stats",
    "skew",
    "small_files",
    "spilling",
    "not_the_querys_fault",
    "ineffective_dynamic_filter",
)

# Fixed value: a stage is skewed when its slowest task exceeds this multiple of the median.
SKEW_RATIO = 5.0

# Our own choice, but for the tasks of skewed stages: what to look up after what fired, or after a predicate that cannot prune.
FOLLOW_UPS = {
    "tasks": ("skew",),
    "column_stats": ("exploding_join", "bad_broadcast", "spilling", "skew"),
    "table_files": ("small_files", "spilling", "ineffective_dynamic_filter", "wrapped_predicate", "no_predicate"),
}

# Defaults of our own where the definition leaves the number open; all are rows of the
# ``thresholds`` table and can be changed per fleet.
DEFAULT_THRESHOLDS = (
    ("no_partition_pruning", "scanned_ratio", 0.9),
    ("exploding_join", "output_ratio", 10.0),
    ("bad_broadcast", "build_bytes", 100.0 * 1024 * 1024),
    ("skew", "max_over_median", SKEW_RATIO),
    ("skew", "least_wall_ms", 1000.0),
    ("small_files", "average_bytes", 16.0 * 1024 * 1024),
    ("spilling", "spilled_bytes", 0.0),
    ("not_the_querys_fault", "queued_ratio", 0.5),
    ("ineffective_dynamic_filter", "reduction", 0.1),
    ("stats_stale", "relative_difference", 0.1),
    ("estimate_scan", "scan_bytes", 1024.0**4),
)

# Our own choice: texts that count as a redacted value (matched whole, any case).
PLACEHOLDERS = (
    r"",
    r"\*+",
    r"x{3,}",
    r"<[^<>]*>",
    r"\$\{[^}]*\}",
    r"\{\{[^}]*\}\}",
    r"(?:redacted|masked|removed|hidden|placeholder)",
    r"\[(?:redacted|masked|removed|hidden)\]",
)

# Our own choice: configuration keys that state the engine version.
VERSION_KEYS = ("engine.version", "node.version")
