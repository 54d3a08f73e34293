"""Column functions on texts, paths and hashes; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of each file ending, and the languages that count as code.
LANGUAGE_OF = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".hh": "cpp", ".cxx": "cpp",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".md": "markdown",
    ".sql": "sql",
    ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
}
CODE = ("python", "javascript", "typescript", "java", "go", "rust", "ruby", "php", "c", "cpp")
#: Python's white space, as a character class of Java.
BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def suffix(path: Column) -> Column:
    """The last ending of the file name with its dot; a leading dot begins no ending."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(pairs, F.lower(suffix(path)))


def is_code(lang: Column) -> Column:
    return F.coalesce(lang.isin(*CODE), F.lit(False))


def decoded(content: Column) -> Column:
    """Bytes as text, undecodable bytes left out, line ends as \\n."""
    text = F.replace(content.cast("string"), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a final line end adds none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def sha256(content: Column) -> Column:
    """Hex digest, "" where the content can't be read."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def content_hash16(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def strip(text: Column) -> Column:
    """Without the white space around, as Python knows it (trim() only knows the space)."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "")).cast("long")


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def hedging_count(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\b(" + "|".join(words) + r")\b")).cast("long")


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def display_time(at: Column) -> Column:
    """A time as its first 19 characters in ISO form."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def one_place(x: Column) -> Column:
    return F.format_string("%.1f", x.cast("double"))
