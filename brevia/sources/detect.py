"""What a source is: addresses, freshness keys and kinds, from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.sources import charsets

#: Kinds by file extension (fixed values).
EXTENSIONS = {
    ".html": "html", ".htm": "html", ".xhtml": "html", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".pptx": "pptx", ".json": "json", ".jsonl": "json",
    ".ndjson": "json", ".geojson": "json", ".diff": "diff", ".patch": "diff", ".log": "logfile", ".zip": "zip",
}
MOST_BYTES = 50 << 20
#: What a cut leaves of the last character of a text in UTF-8, bytes as signs of ISO-8859-1.
_CUT_OFF = r"(?:[\xC2-\xF4]|\xE0[\xA0-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]|\xED[\x80-\x9F]|\xF0[\x90-\xBF][\x80-\xBF]?|[\xF1-\xF3][\x80-\xBF]{1,2}|\xF4[\x80-\x8F][\x80-\xBF]?)\z"


def address_kind(address: Column) -> Column:
    """url, file, local (a host without scheme on this machine), host (a bare host name), path or empty."""
    a = F.trim(address)
    return (
        F.when(a == "", "empty").when(a.rlike("^https?://"), "url").when(a.startswith("file:"), "file").when(a.rlike(r"^(localhost|127\.0\.0\.1|\[::1\])(:\d+)?(/|\z)"), "local")
        .when(a.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(:\d+)?(/|\z)"), "host").otherwise("path")
    )


def diff_address(url: Column) -> Column:
    """The address of the diff of a pull request or commit page; other addresses stay."""
    bare = F.regexp_replace(url, r"/\z", "")
    return F.when(bare.rlike(r"^https://github\.com/[\w.-]+/[\w.-]+/(?:pull/\d+|commit/[0-9a-fA-F]{7,40})\z"), F.concat(bare, F.lit(".diff"))).otherwise(url)


def freshness_key(path: Column, modified: Column, length: Column) -> Column:
    """Changes when a file does."""
    return F.concat_ws(":", path, F.unix_micros(modified.cast("timestamp")).cast("string"), length.cast("string"))


def decoded(content: Column, content_type: Column | None = None) -> Column:
    """The text of bytes, which never fails; a byte order mark goes.

    UTF-16 by its mark, else valid UTF-8, else the single-byte charset that the content type or a page's head names, else
    windows-1252. What the named charset has no sign for, and all but ASCII of a charset without a table, is U+FFFD.
    """
    mark, raw = F.hex(F.substring(content, 1, 2)), content.cast("string")
    legacy = charsets.single_byte(content, charsets.declared(content, F.lit("") if content_type is None else content_type))
    big, little = F.decode(F.substring(content, 3, 2**31 - 1), "UTF-16BE"), F.decode(F.substring(content, 3, 2**31 - 1), "UTF-16LE")
    even = F.octet_length(content) % 2 == 0
    text = F.when(F.is_valid_utf8(raw), raw).when((mark == "FEFF") & even, big).when((mark == "FFFE") & even, little).otherwise(legacy)
    return F.regexp_replace(text, "^\ufeff", "")


def is_text(content: Column) -> Column:
    """Whether the first 8192 bytes can be a text: no NUL (but in UTF-16 behind its mark), and UTF-8, or else no control signs.

    A character that the last of those bytes cut counts as whole; bytes that begin no character don't.
    """
    sample = F.substring(content, 1, 8192)
    signs = F.decode(sample, "ISO-8859-1")
    begun = F.length(F.regexp_extract(F.right(signs, F.lit(3)), _CUT_OFF, 0))
    valid = F.is_valid_utf8(F.substr(sample, F.lit(1), F.octet_length(sample) - begun).cast("string"))
    free = ~signs.rlike("[\\x01-\\x08\\x0E\\x0F]")
    return F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE") | ((F.instr(signs, "\u0000") == 0) & (valid | free))


def kind(text: Column, path: Column, content_type: Column) -> Column:
    """pdf, html, json, diff, ... or text: magic bytes, then header, extension and the first 2048 characters."""
    media = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    name = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./]*)\z", 1))
    by_name = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[name]
    head = F.lower(F.regexp_replace(F.substring(text, 1, 2048), r"^[ \t\r\n]+", ""))
    opens = lambda h: F.when(h.startswith("<!doctype html") | h.startswith("<html") | h.contains("<head") | h.contains("<body"), "html").when(h.startswith("diff --git ") | (h.contains("--- a/") & h.contains("+++ b/")), "diff")
    begun = F.transform(F.array(head), opens)[0]
    begins = F.ltrim(text, F.lit(" \t\r\n"))  # most texts fail at their first sign
    whole = F.trim(text, F.lit(" \t\r\n"))  # where a pattern would look at every blank
    alone = F.size(F.from_json(F.concat(F.lit("["), whole, F.lit("]")), "array<string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})) == 1  # one value, nothing behind it
    json = (begins.startswith("[") | begins.startswith("{")) & (whole.endswith("]") | whole.endswith("}")) & F.coalesce(alone, F.lit(False))
    return (
        F.when(text.startswith("%PDF-"), "pdf").when(media.isin("text/html", "application/xhtml+xml"), "html")
        .when(media.isin("application/json", "application/x-ndjson") | media.endswith("+json"), "json").when(media == "application/pdf", "pdf").when(by_name.isNotNull(), by_name)
        .when(begun == "html", "html").when(json, "json").when(begun == "diff", "diff").when(F.instr(text, "\u0000") > 0, "unknown").otherwise("text")
    )


def files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, modificationTime, length, content, text, kind, freshness and error of every file below a path.

    Files over ``most`` bytes come as an error row; their content is never read, as the filter on length reaches the scan.
    Bytes of any kind are read: what is no text has a null text and the kind of its name, or unknown.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = scan.where(F.col("length") <= most).withColumn("error", F.lit(None).cast("string"))
    large = scan.where(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit(f"larger than the {most >> 20} MB limit").alias("error"))
    every = small.unionByName(large)
    fresh = freshness_key(F.col("path"), F.col("modificationTime"), F.col("length"))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))]
    of_bytes = F.when(F.hex(F.substring("content", 1, 5)) == "255044462D", "pdf").otherwise(F.coalesce(known, F.lit("unknown")))
    texts = every.withColumn("text", F.when(is_text(F.col("content")), decoded(F.col("content"))))
    found = F.when(F.col("text").isNull(), of_bytes).otherwise(kind(F.col("text"), F.col("path"), F.lit(None).cast("string")))
    return texts.withColumn("kind", found).withColumn("freshness", fresh)
