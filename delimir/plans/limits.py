"""Limits that are checked before any job starts."""

# Limits that users of the engine rely on.
MAX_COLUMN = 2024
MAX_PROJECTION = 2024
MAX_LEAVES = 2024
MAX_PROGRAM = 4096
MAX_REGEX_LEAVES = 32
MAX_REGEX_BYTES = 4096
MAX_FIXED_COLUMNS = 2**32 - 1
MAX_CHUNK = 64 * 1024 * 1024
MAX_NESTING = 128
ZIP_OUTPUT_BYTES = 64 * 1024**3
ZIP_RATIO = 1000
PROBE_BYTES = 64 * 1024
PROBE_ROWS = 128
DEFAULT_CHUNK = 1024 * 1024
