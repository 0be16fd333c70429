"""Text as column expressions: normalising, counting, chunking, escaping, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK_WORDS, CHUNK_OVERLAP = 180, 30
# The line ends of Unicode text, besides \r\n.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def normalize(x: Column) -> Column:
    """Lower case, everything but 0-9 and a-z a single blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^0-9a-z]+", " "))


def count_tokens(x: Column) -> Column:
    """Runs of word characters and runs of other signs, in Unicode's sense."""
    return F.size(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0)))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def chunk_windows(x: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of word windows; a short text is one chunk as it is (trimmed), an empty one has none."""

    def windows(own: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(own) - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(own, i + 1, size), " "))
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(F.size(own) <= size, F.array(F.array_join(own, " "))).otherwise(F.filter(many, lambda c: c != ""))

    # bound by a lambda, so that the text is split once and not for every window
    return F.get(F.transform(F.array(words(x)), windows), F.lit(0))


def chunks(records: DataFrame, text: str = "abstract", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """records with (chunk_index, document) for each chunk of the text column."""
    return records.select("*", F.posexplode(chunk_windows(F.col(text), size, overlap)).alias("chunk_index", "document"))


def chunk_rows(records: DataFrame) -> DataFrame:
    """(entity, label, kind, pmid, title, abstract) -> chunks with id entity:pmid:index and their metadata."""
    own = chunks(records)
    return own.select(F.concat_ws(":", "entity", "pmid", F.col("chunk_index").cast("string")).alias("id"), "entity", "label", "kind", "pmid", "title", "chunk_index", "document")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def file_name(term: Column) -> Column:
    """A term as the stem of a file name."""
    return F.regexp_replace(term, "[^A-Za-z0-9_.-]", "_")


def fingerprint(x: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(x, 256), 1, digits)


def markdown_cell(x: Column, most: int = 80) -> Column:
    """A text as a cell of a Markdown table: bars escaped, line ends blanks, cut to ``most`` characters."""
    return F.substring(F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), 1, most)


def model_family(x: Column) -> Column:
    """A model's name without the date of its snapshot."""
    return F.regexp_replace(x, "-[0-9]{8}$", "")


def escape(x: Column) -> Column:
    """As the inside of a Turtle string."""
    for sign, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(sign), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    """Inverse of escape: a backslash and its sign are read together."""


    def plain(part: Column) -> Column:
        for code, sign in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            part = F.replace(part, F.lit(code), F.lit(sign))
        return part

    return F.array_join(F.transform(F.split(x, r"\\\\"), plain), "\\")


def contains_run(haystack: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens are a contiguous run of the haystack's; an empty phrase is in nothing."""
    own = normalize(phrase)
    return (F.length(own) > 0) & F.contains(F.concat(F.lit(" "), normalize(haystack), F.lit(" ")), F.concat(F.lit(" "), own, F.lit(" ")))
