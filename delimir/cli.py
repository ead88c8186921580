"""``python -m delimir count|lines <path> [options]``: exit status 0, 1 for input errors, 2 for usage errors."""

from __future__ import annotations

import argparse
import re
import sys

from .functions.filters import all_, check, column, parse_json
from .functions.regex import regex
from .plans.errors import DelimitedError
from .plans.limits import DEFAULT_CHUNK, MAX_CHUNK
from .plans.options import Options, options
from .sources.codecs import FORMATS, Zip
from .sources.grammar import ENCODINGS, delimiter_of


class Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        if m := re.match(r"unrecognized arguments: (\S+)", message):
            raise Usage(f"Unknown option '{m[1].split('=')[0]}'" if m[1].startswith("-") else f"unexpected argument: {m[1]}")
        raise Usage(message)


def _parser(command: str) -> _Parser:
    about = {"count": "Count every record, including the header row.", "lines": "Write matching records as normalized UTF-8 text or JSON lines."}[command]
    p = _Parser(prog=f"delimir {command}", description=about, allow_abbrev=False)
    p.add_argument("path", nargs="*")
    text = {
        "delimiter": "one safe ASCII character or auto (default: ,)",
        "encoding": "utf8, latin1, iso88591 or iso-8859-1 (default: utf8)",
        "chunk-size": f"bytes read at once, 1 through {MAX_CHUNK}",
        "compression": "auto, gzip, deflate, deflate-raw, brotli, zstd or zip",
        "zip-entry": "entry used with --compression zip",
        "max-compression-ratio": "ZIP expansion limit",
        "max-decompressed-bytes": "ZIP output limit",
        "fixed-columns": "required field count, with --strict",
        "columns": "zero-based columns, with commas",
        "selected-columns": "the same as --columns",
        "min-data-rows": "least number of data rows, with --strict",
        "where": "filter as JSON",
    }
    for name, help_ in text.items():
        p.add_argument(f"--{name}", help=help_)
    for name in ("where-eq", "where-in", "where-neq", "where-noin", "where-prefix", "where-regex", "expected-header"):
        p.add_argument(f"--{name}", action="append", default=[], help="may be repeated")
    for name in ("strict", "require-header"):
        p.add_argument(f"--{name}", action="store_true")
    if command == "lines":
        p.add_argument("--json", action="store_true", help="JSON arrays instead of delimited text")
        p.add_argument("--output-delimiter", help="one safe ASCII character (default: ,)")
        p.add_argument("--limit", help="stop after this many records")
    return p


def _int(text: str, label: str, low: int, high: int | None = None) -> int:
    if not re.fullmatch(r"\d+", text) or not low <= int(text) <= (high if high is not None else int(text)):
        raise Usage(f"{label} must be an integer " + (f"from {low} through {high}" if high is not None else f"greater than or equal to {low}"))
    return int(text)


def _columns(text: str) -> tuple[int, ...]:
    got = []
    for part in text.split(","):
        if not re.fullmatch(r"\s*\d+\s*", part):
            raise Usage("columns must be comma-separated integers")
        got.append(int(part))
    return tuple(got)


def _clause(option: str, text: str) -> tuple[int, str]:
    left, eq, value = text.partition("=")
    if not eq:
        import json

        raise Usage(f"{option} must use <column>=<value>: {json.dumps(text)}")
    if not re.fullmatch(r"\d+", left):
        raise Usage(f"{option} column must be an integer greater than or equal to 0")
    return int(left), value


def filters(a) -> object | None:
    """All filter flags together: repeated --where-in and --where-noin of a column are one list."""
    out = []
    for flag, make in (("eq", "equals"), ("neq", "does_not_equal"), ("prefix", "starts_with")):
        for text in getattr(a, f"where_{flag}"):
            c, v = _clause(f"--where-{flag}", text)
            out.append(getattr(column(c), make)(v))
    for flag, make in (("in", "is_one_of"), ("noin", "is_none_of")):
        lists: dict[int, list[str]] = {}
        for text in getattr(a, f"where_{flag}"):
            c, v = _clause(f"--where-{flag}", text)
            lists.setdefault(c, []).append(v)
        out += [getattr(column(c), make)(v) for c, v in lists.items()]
    for text in a.where_regex:
        c, v = _clause("--where-regex", text)
        m = re.fullmatch(r"(?s)/(.+)/([a-z]*)", v)
        if not m:
            import json

            raise Usage(f"--where-regex must use <column>=/<pattern>/<flags>: {json.dumps(text)}")
        out.append(column(c).has_match(regex(m[1], m[2])))
    if a.where is not None:
        out.append(parse_json(a.where))
    if not out:
        return None
    return check(out[0] if len(out) == 1 else all_(*out))


def settings(a, command: str) -> Options:
    """Options from flags, with every conflict checked."""
    if a.encoding is not None and a.encoding.lower() not in ENCODINGS:
        raise Usage(f"unsupported encoding: {a.encoding}")
    chunk = _int(a.chunk_size, "chunk size", 1, MAX_CHUNK) if a.chunk_size is not None else DEFAULT_CHUNK
    compression = a.compression
    zipped = {"--zip-entry": a.zip_entry, "--max-compression-ratio": a.max_compression_ratio, "--max-decompressed-bytes": a.max_decompressed_bytes}
    if compression == "zip":
        if not a.zip_entry:
            raise Usage("--compression zip requires --zip-entry <path>")
        more = {}
        if a.max_compression_ratio is not None:
            more["max_compression_ratio"] = _int(a.max_compression_ratio, "maximum compression ratio", 1, 2**32 - 1)
        if a.max_decompressed_bytes is not None:
            more["max_decompressed_bytes"] = _int(a.max_decompressed_bytes, "maximum decompressed bytes", 1)
        compression = Zip(a.zip_entry, **more)
    else:
        if compression is not None and compression not in FORMATS:
            raise Usage(f"unsupported compression format: {compression}")
        if used := next((k for k, v in zipped.items() if v is not None), None):
            raise Usage(f"{used} requires --compression zip")
    if a.columns is not None and a.selected_columns is not None:
        raise Usage("--columns and --selected-columns cannot be used together")
    columns = a.columns if a.columns is not None else a.selected_columns
    fixed = _int(a.fixed_columns, "fixed columns", 1) if a.fixed_columns is not None else None
    least = _int(a.min_data_rows, "minimum data rows", 0) if a.min_data_rows is not None else None
    where = filters(a)
    if not a.strict:
        for flag, given in (("--fixed-columns", fixed is not None), ("--expected-header", a.expected_header), ("--require-header", a.require_header), ("--min-data-rows", least is not None)):
            if given:
                raise Usage(f"{flag} requires --strict")
    elif where is not None:
        raise Usage("--strict cannot be used with filter options")
    if command == "lines":
        if a.json and a.output_delimiter is not None:
            raise Usage("--json cannot be combined with --output-delimiter")
        if a.limit is not None:
            if least is not None:
                raise Usage("--limit cannot be combined with --min-data-rows")
            if a.strict:
                if compression is not None:
                    raise Usage("--strict with --limit cannot use --compression")
                if a.delimiter == "auto":
                    raise Usage("--strict with --limit requires a fixed delimiter")
                if a.chunk_size is not None and chunk != 1:
                    raise Usage("--strict with --limit uses --chunk-size 1")
    return options(
        delimiter=a.delimiter if a.delimiter is not None else ",", encoding=a.encoding or "utf8", chunk_size=chunk, compression=compression, columns=_columns(columns) if columns is not None else None,
        where=where, strict=a.strict, fixed_columns=fixed, expected_headers=tuple(a.expected_header) or None, require_header=a.require_header, min_data_rows=least,
    )


def run(a, o: Options, command: str, out, limit: int | None, delimiter: str) -> None:
    """The command on one local file is a plain loop; folders, globs and stores go through Spark."""
    from .operators.sinks import serialize, to_json_line
    from .plans.api import evaluate
    from .sources import grammar
    from .sources.codecs import open_chunks
    from .sources.datasource import resolve_delimiter
    from .sources.storage import local_path

    import os

    path = a.path[0]
    local = local_path(path)
    if local is None or os.path.isdir(local):
        return _by_spark(path, o, command, out, limit, delimiter, a.json if command == "lines" else False)
    d = resolve_delimiter(path, o.delimiter, o.compression)
    chunks = open_chunks(path, o.compression, o.chunk_size)
    if o.strict:
        c = grammar.HeaderCheck(list(o.expected_headers) if o.expected_headers else None, o.require_header, o.min_data_rows)
        rows = (c.row(r) for r in grammar.strict_records(chunks, d, o.encoding, o.fixed_columns))
    else:
        c, rows = None, grammar.records(chunks, d, o.encoding)
    n = 0
    for r in rows:
        if o.where is not None and evaluate(o.where, r) is not True:
            continue
        n += 1
        if command == "lines":
            if o.columns is not None:
                r = [r[k] if k < len(r) else "" for k in o.columns]
            out.write((to_json_line(r) if a.json else serialize(r, delimiter)) + "\n")
            if n == limit:
                return None
    if c:
        c.finish()
    if command == "count":
        out.write(f"{n}\n")
    return None


def _by_spark(path: str, o: Options, command: str, out, limit: int | None, delimiter: str, as_json: bool) -> None:
    from pyspark.sql import SparkSession

    from .operators.scan import scan
    from .operators.sinks import serialize, to_json_line
    from .plans.api import count, first_rows

    spark = SparkSession.builder.getOrCreate()
    if command == "count":
        out.write(f"{count(spark, path, o)}\n")
        return
    df = first_rows(spark, path, limit, o) if limit else scan(spark, path, o).orderBy("_file", "_shard", "_pos")
    for r in df.select("fields").toLocalIterator():
        out.write((to_json_line(r[0]) if as_json else serialize(r[0], delimiter)) + "\n")


HELP = """Usage: delimir <command> <path> [options]

Commands:
  count   Count records
  lines   Write matching records

Run 'delimir <command> --help' for command options.
"""


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    command = argv[0] if argv else ""
    if command in ("--help", "-h", "help"):
        sys.stdout.write(HELP)
        return 0
    help_command = f"delimir {command} --help" if command in ("count", "lines") else "delimir --help"
    try:
        if not command:
            raise Usage("a command is required")
        if command not in ("count", "lines"):
            raise Usage(f"unknown command: {command}")
        a = _parser(command).parse_args(argv[1:])
        if len(a.path) != 1:
            raise Usage("exactly one input path is required")
        o = settings(a, command)
        limit = _int(a.limit, "limit", 1) if command == "lines" and a.limit is not None else None
        delimiter = delimiter_of(a.output_delimiter) if command == "lines" and a.output_delimiter is not None else ","
    except SystemExit as e:
        return int(e.code or 0)
    except (Usage, DelimitedError) as e:
        sys.stderr.write(f"csv: {e}\nRun '{help_command}' for usage.\n")
        return 2
    try:
        sys.stdout.reconfigure(encoding="utf-8", newline="")
        run(a, o, command, sys.stdout, limit, delimiter)
        sys.stdout.flush()
        return 0
    except BrokenPipeError:
        import os

        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except (DelimitedError, OSError) as e:
        sys.stdout.flush()
        sys.stderr.write(f"csv: {e}\n")
        return 1
