"""Text formats as column expressions: escaping, quoting, paths, sizes, times and record lines.

Paths are bytes. ``as_chars`` turns them into a string of one character a byte, on which all
functions here are exact, and ``as_bytes`` turns that back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_chars(path: Column) -> Column:
    return F.decode(path, "ISO-8859-1")


def as_bytes(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1")


def escape(s: Column) -> Column:
    """Backslash, line feed and carriage return as two characters each."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape(s: Column) -> Column:
    """The inverse of ``escape``; null for a raw NUL, LF or CR and for any other use of a backslash."""
    rest = F.regexp_replace(s, r"\\[\\nr]", "")
    valid = ~rest.contains("\\") & ~s.rlike(r"[\x00\n\r]")
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1))
    one = lambda t: F.when(t == "\\\\", "\\").when(t == "\\n", "\n").when(t == "\\r", "\r").otherwise(t)
    return F.when(valid, F.array_join(F.transform(pieces, one), ""))


def shell_quote(s: Column) -> Column:
    """One word of a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def pattern_quote(s: Column) -> Column:
    """An anchored filter pattern of a directory that matches only this name."""
    return F.concat(F.lit("/"), F.regexp_replace(s, r"([*?\[\\])", r"\\$1"), F.lit("/"))


def clean_path(s: Column, cwd: str = "/") -> Column:
    """The absolute path without empty, ``.`` and ``..`` components, by words alone; ``/..`` is ``/``."""
    full = F.when(s.startswith("/"), s).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), s))
    none = F.array().cast("array<string>")
    step = lambda kept, part: (
        F.when((part == "") | (part == "."), kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part)))
    )
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), none, step), "/"))


def join_path(parent: Column, child: Column) -> Column:
    """Exactly one slash between the two."""
    return F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), child)


def decimal(s: Column, signed: bool = False) -> Column:
    """A 64-bit integer of digits alone, with one leading minus if ``signed``; else null."""
    return F.when(s.rlike("^-?[0-9]+$" if signed else "^[0-9]+$"), s.try_cast("bigint"))


def parse_size(s: Column) -> Column:
    """Bytes of digits and at most one of K, M, G, T (powers of 1024); null if malformed or beyond 64 bits."""
    unit = F.lower(F.regexp_extract(s, "^[0-9]+([kmgtKMGT]?)$", 1))
    power = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1).cast("bigint")
    return F.when(s.rlike("^[0-9]+[kmgtKMGT]?$"), F.try_multiply(F.regexp_extract(s, "^([0-9]+)", 1).try_cast("bigint"), power))


_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]


def human_bytes(v: Column) -> Column:
    """One decimal, cut off and not rounded; whole bytes have none."""
    out = F.concat(v.cast("string"), F.lit(" B"))
    for u in range(1, len(_UNITS)):
        whole = F.floor(F.shiftright(v, 10 * u))
        tenth = F.floor((F.shiftright(v, 10 * (u - 1)) % 1024) * 10 / 1024)
        out = F.when(v >= 1 << (10 * u), F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"), F.lit(f" {_UNITS[u]}"))).otherwise(out)
    return out


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def time_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def time_from_stamp(stamp: Column) -> Column:
    """dd/mm/yyyy HH:MM of twelve digits; null for anything else at the start."""
    return F.when(stamp.rlike("^[0-9]{12}"), F.regexp_replace(F.substring(stamp, 1, 12), "^(....)(..)(..)(..)(..)$", "$3/$2/$1 $4:$5"))


def archive_name(started: Column) -> Column:
    """The name of an archived run: its start, so that names sort; ``scan-unknown`` without twelve digits."""
    digits = F.substring(F.regexp_replace(started, "[^0-9]", ""), 1, 12)
    return F.when(F.length(digits) == 12, F.concat(F.lit("scan-"), F.regexp_replace(digits, "^(..)(..)(....)(....)$", "$3$2$1$4"))).otherwise("scan-unknown")


def header_value(line: Column, key: str) -> Column:
    """The value of a ``# key: value`` line; null for other lines."""
    return F.when(line.startswith(f"# {key}: "), F.substr(line, F.lit(len(key) + 5)))


RECORD = "struct<type:string,num:bigint,mtime:bigint,hash:string,path:string>"


def parse_record(line: Column, hashes: bool) -> Column:
    """The fields of a tree or hash line (type, num, mtime, hash, path); null if it is malformed.

    Three fields end at a space each and the rest is the escaped path, which may hold spaces.
    """
    a, b, c, rest = (F.regexp_extract(line, r"(?s)^([^ ]*) ([^ ]*) ([^ ]*) (.+)$", i) for i in range(1, 5))
    path = unescape(rest)
    split = line.rlike(r"(?s)^[^ ]* [^ ]* [^ ]* .+$")
    error = (a == "E") & (c == "-")
    num_error, none = decimal(b), F.lit(None).cast("bigint")
    no_hash = F.lit(None).cast("string")
    bad = F.struct(a.alias("type"), num_error.alias("num"), none.alias("mtime"), no_hash.alias("hash"), path.alias("path"))
    if hashes:
        size = decimal(c)
        good = F.struct(a.alias("type"), size.alias("num"), none.alias("mtime"), b.alias("hash"), path.alias("path"))
        fits = a.isin("F", "S", "L") & b.rlike("^[0-9a-f]{32}$") & size.isNotNull()
    else:
        size, mtime = decimal(b), decimal(c, signed=True)
        good = F.struct(a.alias("type"), size.alias("num"), mtime.alias("mtime"), no_hash.alias("hash"), path.alias("path"))
        fits = a.isin("F", "L") & size.isNotNull() & mtime.isNotNull()
    return F.when(split & path.isNotNull(), F.when(error & num_error.isNotNull(), bad).when(fits, good))
