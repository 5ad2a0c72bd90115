"""Text identity and predicates: normalisation, tags, lines, smart case, languages. Built-in expressions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())

#: Extensions of the files that are indexed.
EXTENSIONS = (
    "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "metal", "py", "ts", "mts", "cts", "tsx", "js",
    "jsx", "mjs", "cjs", "pyi", "md", "yaml", "yml", "toml", "json", "txt", "sh", "bash", "sql", "proto", "graphql",
    "css", "scss", "html", "xml", "cfg", "ini", "conf",
)
#: Directories that a scan does not enter, besides the engine's own.
SKIPPED = (
    ".git", "target", "node_modules", "site-packages", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
)
OWN_DIRECTORY = ".sparkloom"
IGNORE_FILES = (".sparkloomignore", ".gitignore")
VIRTUALENV_MARKER = "pyvenv.cfg"
MAX_BYTES = 2 * 1024 * 1024
#: Extensions by language.
LANGUAGES = {
    "rust": ("rs",), "cpp": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "metal"), "python": ("py", "pyi"), "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "markdown": ("md", "markdown"),
}
#: Needles counted in the first 4096 bytes to tell the language of a file without a known extension.
NEEDLES = {
    "rust": ("fn ", "let ", "impl ", "pub ", "::", "-> "),
    "python": ("def ", "import ", "self", "elif ", "None"),
    "cpp": ("#include", "void ", "template<", "std::", "uint"),
}
HEAD_BYTES = 4096


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z alone; lower() would fold all of Unicode."""
    return F.translate(x, UPPER, UPPER.lower())


def normalize_lf(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def strip_bom(x: Column) -> Column:
    """Without one leading U+FEFF."""
    return F.when(x.startswith("\ufeff"), F.substr(x, F.lit(2))).otherwise(x)


def split_lines(x: Column) -> Column:
    """Lines of an LF-normalised text; a final line break opens no further line."""
    parts = F.split(normalize_lf(x), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files without text, a row a line: line from 1, text."""
    others = [F.col(f"`{c}`") for c in files.columns if c != text]
    return files.select(*others, F.posexplode(split_lines(F.col(text))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def tag(x: Column) -> Column:
    """64 hex digits of a text's lines without blanks at their ends: texts that differ only there share a tag.

    SHA-256 stands for BLAKE3, which Spark lacks; tags are opaque.
    """
    trimmed = F.transform(F.split(x, "\n", -1), lambda line: F.rtrim(line, F.lit(" \t\r")))
    return F.sha2(F.array_join(trimmed, "\n"), 256)


def display_tag(full: Column) -> Column:
    return F.substr(full, F.lit(1), F.lit(7))


def tag_matches(full: Column, cited: Column) -> Column:
    """A citation matches by case-insensitive prefix of four digits or more."""
    return (F.length(cited) >= 4) & ascii_lower(full).startswith(ascii_lower(cited))


def valid_tag(cited: Column) -> Column:
    return cited.rlike("^[0-9a-fA-F]{4,64}$")


def is_sensitive(pattern: Column) -> Column:
    """Smart case: a needle with an upper-case letter is searched as it is."""
    return pattern.rlike("\\p{Lu}")


def is_upper(pattern: str) -> bool:
    """is_sensitive of a literal."""
    return any(unicodedata.category(c) == "Lu" for c in pattern)


def smart_contains(x: Column, pattern: Column) -> Column:
    return F.when(is_sensitive(pattern), F.contains(x, pattern)).otherwise(F.contains(ascii_lower(x), ascii_lower(pattern)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, "\\.([^./]+)$", 1)


def is_indexable(path: Column) -> Column:
    return extension(path).isin(list(EXTENSIONS))


def under_any(path: Column, prefixes: Sequence[str]) -> Column:
    """Path-prefix OR-list; an empty list admits every path."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lit(True) if not extensions else extension(path).isin(list(extensions))


def language_of_path(path: Column) -> Column:
    out = F
    for lang, extensions in LANGUAGES.items():
        out = out.when(extension(basename(path)).isin(list(extensions)), F.lit(lang))
    return out.otherwise(F.lit(None))


def language_scores(text: Column) -> dict[str, Column]:
    """Needles found in the first 4096 bytes; the needles are ASCII, so a character that the cut parts makes no difference."""
    head = F.substring(F.encode(text, "UTF-8"), 1, HEAD_BYTES)
    return {lang: sum((F.contains(head, F.lit(n.encode())).cast("int") for n in needles), F.lit(0)) for lang, needles in NEEDLES.items()}


def language_of_content(text: Column) -> Column:
    """By shebang (python or nothing), else the language with the most needles, three at least; ties go rust, python, cpp."""
    s = language_scores(text)
    best = F.greatest(*s.values())
    first = F.element_at(F.split(text, "\n", 2), 1)
    return (
        F.when(first.startswith("#!"), F.when(F.contains(first, F.lit("python")), F.lit("python")))
        .when(best < 3, F.lit(None))
        .when(s["rust"] == best, F.lit("rust"))
        .when(s["python"] == best, F.lit("python"))
        .otherwise(F.lit("cpp"))
    )


def query_terms(query: Column) -> Column:
    """Terms of a query: split outside [letters digits _ : .], trimmed of : and ., of three bytes or more, first eight distinct."""
    words = F.transform(F.split(query, "[^\\p{L}\\p{N}_:.]+"), lambda w: F.trim(w, F.lit(":.")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 3)), 1, 8)


def balance(text: Column, pair: str) -> Column:
    """How many more of the first character than of the second."""
    return (F.length(F.replace(text, F.lit(pair[1]), F.lit(""))) - F.length(F.replace(text, F.lit(pair[0]), F.lit("")))).cast("long")


def last_segments(qualified: Column, n: int = 2) -> Column:
    """The last n `::` segments."""
    parts = F.split(qualified, "::", -1)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "::")


def strip_generics(t: Column) -> Column:
    """Type text without references, lifetimes, mut and what follows the first <."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^(?:\\s|&|'\\w+\\s|mut\\s)+", ""), "<.*$", ""))


def dyn_trait(t: Column) -> Column:
    """The trait of dyn X or impl X in a type text, null if there is none."""
    found = F.regexp_extract(t, "\\b(?:dyn|impl)\\s+((?:\\w+::)*\\w+)", 1)
    return F.when(found != "", F.element_at(F.split(found, "::", -1), -1))


def symbol_id(file: Column, qualified: Column, kind: Column) -> Column:
    """An opaque id of 16 hex digits; equal for overloads that share file, qualified name and kind."""
    return F.lpad(F.lower(F.hex(F.xxhash64(F.concat_ws("|", file, qualified, kind)))), 16, "0")


def elide(xs: Column, head: int = 12, tail: int = 40) -> Column:
    """An array's head and tail around a marker, if it is longer than both."""
    gap = F.concat(F.lit("... "), (F.size(xs) - head - tail).cast("string"), F.lit(" lines ..."))
    return F.when(F.size(xs) <= head + tail, xs).otherwise(F.concat(F.slice(xs, 1, head), F.array(gap), F.slice(xs, -tail, tail)))


def stays_inside(path: Column) -> Column:
    """A relative path none of whose prefixes leaves the root; .. inside the tree is allowed."""
    parts = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return ~path.startswith("/") & (F.aggregate(parts, start, step)["least"] >= 0)


def plain_path(path: Column) -> Column:
    """The stricter test of history: relative, and no segment is . or .. ."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/", -1), lambda p: p.isin(".", ".."))


def opaque_name(key: str, x: Column) -> Column:
    """A name that tells nothing of x without the key: a hash of it under the key's hash."""
    return F.sha2(F.concat(F.sha2(F.lit(key), 256), x), 256)


def sealed(x: Column, key: bytes) -> Column:
    """x, encrypted and authenticated under a key of 16, 24 or 32 bytes; every call gives other bytes."""
    return F.aes_encrypt(x, F.lit(key), F.lit("GCM"))


def opened(x: Column, key: bytes) -> Column:
    """What sealed() was given; null if the key is another or the bytes were changed."""
    return F.try_aes_decrypt(x, F.lit(key), F.lit("GCM")).cast("string")
