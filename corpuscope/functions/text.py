"""Column functions over paths and text, all JVM-side."""

import unicodedata

from pyspark.sql import Column, functions as F

# File extension -> language.
LANGUAGES = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "py": "python", "js": "javascript",
    "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "sh": "bash",
}

# The characters that separate tokens for the hashed embedding.
EMBED_DELIMITERS = " \t\n\r,.!?;:()[]{}<>/=+-*\"'`#@"
_EMBED_SPLIT = r"""[ \t\n\r,.!?;:()\[\]{}<>/=+\-*"'`#@]+"""

# Texts that mark a failed run.
ERROR_MARKERS = ("error:", "Error:", "ERROR:", "Traceback")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Inside a lambda an outer expression would be evaluated again on every call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extension(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def is_source_file(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def is_hidden(relative_path: Column) -> Column:
    """A leading dot in any part of a path given relative to the scan root."""
    return F.startswith(relative_path, F.lit(".")) | F.contains(relative_path, F.lit("/."))


def language(path: Column) -> Column:
    by_extension = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(by_extension, extension(path)), F.lit("unknown"))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def leading_int(text: Column) -> Column:
    """The integer a text begins with, else 0; never raises under ANSI mode."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def embed_tokens(text: Column) -> Column:
    return F.filter(F.split(text, _EMBED_SPLIT), lambda t: t != "")


def _folding_table():
    """Letters that are one ASCII letter plus one combining mark, by rule from Unicode."""
    plain, accented = [], []
    for block in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for cp in range(*block):
            parts = unicodedata.normalize("NFD", chr(cp).lower())
            if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
                accented.append(chr(cp).lower())
                plain.append(parts[0])
    marks = [chr(cp) for cp in range(0x300, 0x332)]  # combining marks vanish
    return "".join(accented + marks), "".join(plain)


_FOLD_FROM, _FOLD_TO = _folding_table()


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics; `translate` runs only on non-ASCII text."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(
        F.translate(low, _FOLD_FROM, _FOLD_TO))


def search_tokens(text: Column) -> Column:
    """Full-text tokens: folded runs of letters and digits."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_words(query: Column) -> Column:
    """The words of a plain full-text query, or NULL where it is not plain.

    Plain means bare words between blanks: every other character, and the operator
    words, belong to the full-text query language, whose clauses `operators.search`
    offers as functions."""
    words = F.filter(F.split(query, r"[ \t\n\r]+"), lambda w: w != "")
    plain = F.forall(words, lambda w: w.rlike(r"^[A-Za-z0-9_\x{80}-\x{10FFFF}]+$") & ~w.isin("AND", "OR", "NOT"))
    return F.when(plain, words)


def unwrapped_base64(data: Column) -> Column:
    """Base64 on one line; Spark's own breaks lines at 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def epoch_text(seconds: Column) -> Column:
    return F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss")
