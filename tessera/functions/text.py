"""Column functions of line and text analytics. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a line, as in a browser's trim().
WS = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Terminal colour and title sequences, and the mark that folding leaves.
ANSI = "\\x1b\\[[0-?]*[ -/]*[@-~]|\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)"
FOLD_MARK = "^\\[… [0-9]+ similar lines …\\]$"
#: Lines with a diagnostic are never folded.
DIAGNOSTIC = "(?i)error|warn|fail|fatal|panic|exception|traceback"
SIMILARITY, MIN_RUN = 0.7, 6


#: The same characters one by one.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{WS}]")


def without_ansi(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\x1b")), F.regexp_replace(c, ANSI, "")).otherwise(c)


def settled(line: Column) -> Column:
    """The last state of a line that carriage returns rewrite."""
    parts = F.filter(F.split(line, "\r", -1), lambda p: p != "")
    return F.when(F.instr(line, "\r") == 0, line).otherwise(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")))


def settled_lines(text: Column) -> Column:
    return F.transform(F.split(without_ansi(text), "\n", -1), settled)


def shape(line: Column) -> Column:
    """Words of a line with numbers and long hexadecimal runs abstracted."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9a-f]{6,}", "<h>"), "[0-9]+", "#")
    return F.filter(F.split(plain, "[^a-z#<>]+", -1), lambda w: w != "")


def similar(a: Column, b: Column) -> Column:
    """Whether two shapes agree in place by the similarity share of the longer one."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (same / F.greatest(F.size(a), F.size(b)) >= SIMILARITY)


def outline_shape(line: Column) -> Column:
    """A coarser shape: words w, numbers #, hexadecimal runs h."""
    hexed = F.regexp_replace(trimmed(line), "(?<![0-9A-Za-z_])[0-9a-fA-F]{4,}(?![0-9A-Za-z_])", "h")
    marked = F.regexp_replace(F.regexp_replace(hexed, "[A-Za-z]+", "w"), "[0-9]+", "#")
    return F.regexp_replace(marked, "w(?:[ _-]w)+", "w+")


def is_protected(line: Column) -> Column:
    return line.rlike(DIAGNOSTIC)


def is_fold_mark(line: Column) -> Column:
    return line.rlike(FOLD_MARK)


def looks_binary(text: Column) -> Column:
    return F.instr(text, "\0") > 0


def looks_secret(text: Column) -> Column:
    return text.rlike("(?i)(token|secret|password|api[_-]?key) ?[=:]|-----BEGIN [A-Z ]*PRIVATE KEY-----")


LISTING = "^(?:ls|tree|du|find|fd|rg|grep|egrep|fgrep|git\\s+(?:grep|ls-files|status|log))(?![0-9A-Za-z_])"
READING = "^(?:cat|head|tail|less|more|nl|sed|curl|wget)(?![0-9A-Za-z_])"


def output_class(command: Column, output: Column) -> Column:
    """search, document or log."""
    return F.when(trimmed(command).rlike(LISTING), "search").when(trimmed(command).rlike(READING) | output.rlike("^\\s*[\\[{]"), "document").otherwise("log")


def command_label(tool: Column, *details: Column) -> Column:
    """The tool and its first detail, cut to 200."""
    return F.concat_ws(" ", tool, F.substring(F.coalesce(*details), 1, 200))


def duration(seconds: Column) -> Column:
    return F.when(seconds < 120, F.concat(F.round(seconds).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(F.round(seconds / 60).cast("long").cast("string"), F.lit("min")))


def thousands(tokens: Column) -> Column:
    return F.concat(F.round(tokens / 1000).cast("long").cast("string"), F.lit("k"))


def archive_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def fold_footer(folded: Column, path: Column) -> Column:
    lines = F.concat(F.lit("\n["), folded.cast("string"), F.lit(" lines folded; "))
    return F.concat(lines, F.when(path.isNotNull(), F.concat(F.lit("whole output: "), path)).otherwise(F.lit("output not saved")), F.lit("]"))


#: The deterministic scorer's words.
SCORED = "(?i)error|warn|fail|BUNDLE|ROLLBACK|completed|sha256|digest|rollback|release"


def simulated_score(text: Column) -> Column:
    """0.99 or 0.01; the offline stand-in for a scorer model."""
    return F.when(text.rlike(SCORED), 0.99).otherwise(0.01)


def shortened_input(fields: Column) -> Column:
    """A map of input fields with the long ones cut to their head and a note."""
    note = lambda v: F.concat(F.substring(v, 1, 300), F.lit("[… "), (F.length(v) - 300).cast("string"), F.lit(" more characters left out]"))
    return F.transform_values(fields, lambda _, v: F.when(F.length(v) > 600, note(v)).otherwise(v))


def kept_lines(original: Column, lines: Column, head_chars: int) -> Column:
    """An output cut to its first line, a note, and the kept lines that aren't in the head."""
    head = F.substring(F.get(F.split(original, "\n", -1), F.lit(0)), 1, head_chars)
    note = F.concat(F.lit("["), (F.length(original) - F.length(head)).cast("string"), F.lit(" characters left out; lines that stood out follow]"))
    return F.array_join(F.concat(F.array(head, note), F.filter(lines, lambda x: ~F.contains(head, x))), "\n")


#: Headings that part a report's summary from its details, in two languages.
SUMMARY_HEAD = "(?im)^#{1,3}[ \\t]*(?:summary|요약)[ \\t]*:?[ \\t]*$"
DETAILS_HEAD = "(?im)^#{1,3}[ \\t]*(?:details?|상세|세부)[ \\t]*:?[ \\t]*$"


def summary_of(report: Column) -> Column:
    """The text between a report's summary and details headings; null unless both stand, in this order."""
    start, stop = F.regexp_instr(report, F.lit(SUMMARY_HEAD)), F.regexp_instr(report, F.lit(DETAILS_HEAD))
    head = F.length(F.regexp_extract(report, SUMMARY_HEAD, 0))
    return F.when((start > 0) & (stop > start), trimmed(F.substring(report, start + head, stop - start - head)))


def tokens_of(text: Column) -> Column:
    """Specific tokens: identifiers of 6 and more, hexadecimal runs of 7 to 40, numbers of 3 and more, Hangul of 3 and more."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{5,}|[0-9a-f]{7,40}|[0-9]{3,}|[\\uac00-\\ud7a3]{3,}"), F.lit(0))


#: Numbered items and bullets of a brief.
NUMBERED = "^\\s*(?:[0-9]{1,2}[.)]|\\([0-9]{1,2}\\)|[①-⑩])\\s+(.{10,240})$"
BULLET = "^\\s*[-*•]\\s+(.{10,240})$"


def items_of(brief: Column) -> Column:
    """Numbered items of 10 to 240 characters if there are 2 to 8 (none if more), else 2 to 8 bullets, else none."""
    lines = F.split(brief, "\n", -1)
    pick = lambda p: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, p, 1)), lambda x: x != "")
    numbered, bullets, none = pick(NUMBERED), pick(BULLET), F.array().cast("array<string>")
    return F.when(F.size(numbered) >= 2, F.when(F.size(numbered) <= 8, numbered).otherwise(none)).when(F.size(bullets).between(2, 8), bullets).otherwise(none)
