"""Texts of single-byte charsets, by tables that column expressions translate with."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of charsets and what reads them (fixed values).
NAMES = {
    "windows-1252": "cp1252", "cp1252": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "windows-1250": "cp1250", "cp1250": "cp1250", "windows-1251": "cp1251",
    "cp1251": "cp1251", "windows-1253": "cp1253", "windows-1254": "cp1254", "iso-8859-9": "cp1254", "latin5": "cp1254", "windows-1255": "cp1255", "windows-1256": "cp1256", "windows-1257": "cp1257", "windows-1258": "cp1258", "iso-8859-2": "iso8859_2",
    "latin2": "iso8859_2", "iso-8859-5": "iso8859_5", "iso-8859-7": "iso8859_7", "greek": "iso8859_7", "iso-8859-15": "iso8859_15", "latin-9": "iso8859_15", "koi8-r": "koi8_r", "koi8-u": "koi8_u", "ibm866": "cp866", "cp866": "cp866", "macintosh": "mac_roman",
}
UNICODE = ["utf-8", "utf8", "unicode-1-1-utf-8"]
HIGH = "".join(map(chr, range(128, 256)))


@cache
def table(codec: str) -> str:
    """What the bytes from 0x80 stand for: themselves as control signs where windows-1252 has none, U+FFFD where others have none."""
    signs = [bytes([b]).decode(codec, "replace") for b in range(128, 256)]
    return "".join(chr(b) if s == "�" and codec == "cp1252" and b < 0xA0 else s for b, s in zip(range(128, 256), signs, strict=True))


def declared(content: Column, content_type: Column) -> Column:
    """The charset, in lower case, that a header names, or else the first 1024 bytes of a page; null if none does."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    of_header = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i)charset\s*=\s*["']?([\w.:-]+)""", 1)
    of_page = F.regexp_extract(head, r"""(?i)<meta\s[^>]*?charset\s*=\s*["']?\s*([\w.:-]+)""", 1)
    named = F.lower(F.when(of_header != "", of_header).otherwise(of_page))
    return F.when(named != "", named)


def single_byte(content: Column, charset: Column) -> Column:
    """Bytes as text of a charset: windows-1252 where it is null; where no table knows it, only ASCII, and U+FFFD for the rest."""
    plain = F.decode(content, "ISO-8859-1")
    out = F.when(charset.isNull(), F.translate(plain, HIGH, table("cp1252")))
    for codec in dict.fromkeys(NAMES.values()):
        out = out.when(charset.isin(*[n for n, c in NAMES.items() if c == codec]), F.translate(plain, HIGH, table(codec)))
    return out.when(charset.isin(*UNICODE), F.make_valid_utf8(content.cast("string"))).otherwise(F.translate(plain, HIGH, "�" * 128))
