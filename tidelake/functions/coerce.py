"""Coercion of textual cells to lake types, as column expressions.

Every function takes a string column and gives null for what has no valid reading, unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bool_token(x: Column) -> Column:
    """Boolean of a token: a raw 0/1 byte, one hex byte, bit literals and words; anything else is null, never false."""
    s = F.trim(x, F.lit(" \t\n\r\x0b\x0c"))
    low = F.lower(s)
    byte = F.regexp_extract(s, r"^(?:\\[xX]|0[xX])([0-9A-Fa-f]{2})$", 1)
    quoted = F.regexp_extract(s, r"^[xX]'([0-9A-Fa-f]{2})'$", 1)
    hexed = F.when(byte != "", byte).when(quoted != "", quoted)
    return F.when(s == "\x00", False).when(s == "\x01", True).when(hexed.isNotNull(), hexed != "00").when(low.isin("b'1'", 'b"1"', "1", "t", "true", "yes"), True).when(low.isin("b'0'", 'b"0"', "0", "f", "false", "no"), False)


def bool_number(x: Column) -> Column:
    return x != 0


def numeric_text(x: Column) -> Column:
    """The number in a display form such as "-1 (4294967295)": what stands in parentheses, else the leading number,
    else the text unchanged."""
    inner = F.regexp_extract(x, r"^[^(]*\(([-.0-9]+)\)", 1)
    lead = F.regexp_extract(x, r"^\s*([-+]?[0-9.eE+-]+)", 1)
    return F.when(inner != "", inner).when(lead != "", F.trim(lead)).otherwise(x)


def int32_overflow(x: Column) -> Column:
    """Whether a value doesn't fit 32 bits."""
    return F.coalesce((x < -(2**31)) | (x > 2**31 - 1), F.lit(False))


def bytes_hex(x: Column) -> Column:
    """Hex text of a binary cell: _binary'..' and X'..' literals, runs of \\xHH, bare hex of even length, or raw text.
    No pattern repeats a group, so cells may have any length."""
    size = F.length(x)
    binary = x.startswith("_binary") & x.endswith("'")
    behind = F.ltrim(F.substr(x, F.lit(8), size))
    s = F.when(binary & behind.startswith("'") & (F.length(behind) > 2), F.substr(behind, F.lit(2), F.length(behind) - 2)).otherwise(x)
    is_hex = lambda t: (F.length(t) > 0) & (F.length(t) % 2 == 0) & t.rlike("^[0-9A-Fa-f]+$")
    inner = F.when(F.lower(F.substring(s, 1, 2)) == "x'", F.when(s.endswith("'"), F.substr(s, F.lit(3), F.length(s) - 3)))
    runs = F.replace(s, F.lit("\\x"), F.lit(""))
    # as many marks as pairs: each pair has its own
    whole = s.startswith("\\x") & (F.length(s) == 2 * F.length(runs)) & is_hex(runs) & (F.length(F.regexp_replace(s, r"\\x[0-9A-Fa-f]{2}", "")) == 0)
    single = F.when(s.startswith("\\x"), F.substr(s, F.lit(3), F.length(s)))
    return F.lower(F.when(is_hex(inner), inner).when(whole, runs).when(is_hex(single), single).when(is_hex(s), s).otherwise(F.hex(F.encode(s, "UTF-8"))))


def utf8_text(x: Column) -> Column:
    """Text of bytes without NUL, with ? for each sequence that isn't UTF-8."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(x.cast("string")), "\x00", ""), "�", "?")


def single_byte_text(x: Column) -> Column:
    """Text of bytes: UTF-8 if valid, else Windows-1252; without NUL."""
    raw = x.cast("string")
    high = [(chr(b), bytes([b]).decode("windows-1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    single = F.translate(F.decode(x, "iso-8859-1"), "".join(a for a, _ in high), "".join(b for _, b in high))
    return F.regexp_replace(F.when(F.is_valid_utf8(raw), raw).otherwise(single), "\x00", "")


def date_text(x: Column) -> Column:
    """A date as YYYY-MM-DD from the front of the text, colons allowed; year 0000, month or day 00 is null."""
    s = F.regexp_replace(F.trim(x), r"^([0-9]{4}):([0-9]{2}):([0-9]{2})", "$1-$2-$3")
    d = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    bad = (d == "") | d.startswith("0000") | (F.substring(d, 6, 2) == "00") | (F.substring(d, 9, 2) == "00")
    return F.when(~bad & F.try_to_date(d, "yyyy-MM-dd").isNotNull(), d)


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def timestamp_text(x: Column) -> Column:
    """A timestamp as `YYYY-MM-DD hh:mm:ss[.frac]` from ISO text, or from `Mon d yyyy hh:mm:ss[:frac]AM`."""
    s = F.trim(x)
    named = r"^([A-Za-z]{3})\s+([0-9]{1,2})\s+([0-9]{4})\s+([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?::([0-9]+))?\s*([AaPp][Mm])$"
    part = lambda i: F.regexp_extract(s, named, i)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(1)))
    clock = part(4).try_cast("int") % 12 + F.when(F.lower(part(8)) == "pm", 12).otherwise(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    long = F.concat(part(3), F.lit("-"), two(month), F.lit("-"), two(part(2)), F.lit(" "), two(clock), F.lit(":"), part(5), F.lit(":"), part(6), F.when(part(7) != "", F.concat(F.lit("."), part(7))).otherwise(""))
    iso = F.regexp_replace(F.regexp_replace(s, r"^([0-9]{4}):([0-9]{2}):([0-9]{2})", "$1-$2-$3"), r"^([0-9-]{10})T", "$1 ")
    whole = F.when(date_text(iso).isNotNull() & iso.rlike(r"^[0-9-]{10}( [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?)?$"), F.when(F.length(iso) == 10, F.concat(iso, F.lit(" 00:00:00"))).otherwise(iso))
    return F.when(s.rlike(named), F.when(month > 0, long)).otherwise(whole)


def time_text(x: Column) -> Column:
    """A time h:m:s with an optional fraction; a fourth part after a colon is milliseconds."""
    s = F.trim(x)
    four = F.regexp_replace(s, r"^([0-9]+:[0-9]+:[0-9]+):(.*)$", "$1.$2")
    ok = F.regexp_replace(four, ",", ".")
    return F.when(ok.rlike(r"^[0-9]+:[0-9]+:[0-9]+(\.[0-9]*)?$"), F.substring(four, 1, 15))


def epoch_seconds_text(x: Column) -> Column:
    """Seconds since 1970 as `YYYY-MM-DD hh:mm:ss`, in UTC whatever the session's zone."""
    return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def epoch_millis_text(x: Column) -> Column:
    """Milliseconds since 1970 as `YYYY-MM-DD hh:mm:ss.mmm`; earlier times round down."""
    secs = F.floor(x / 1000)
    return F.concat(epoch_seconds_text(secs), F.lit("."), F.lpad(F.pmod(x, F.lit(1000)).cast("string"), 3, "0"))


def not_null_default(x: Column, kind: str, key: Column) -> Column:
    """A cell of a NOT NULL column: its text, or its type's default; identifiers without one get a hash of the row's key."""
    base = kind.upper()
    fixed = {"TIMESTAMPTZ": "1970-01-01 00:00:00", "DATE": "1970-01-01", "TIME": "00:00:00", "BOOLEAN": "f", "JSONB": "{}"}
    if base in fixed:
        default = F.lit(fixed[base])
    elif base in ("SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE", "NUMERIC"):
        default = F.lit("0")
    else:
        default = F.concat(F.lit("__missing__"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))
    return F.coalesce(x, default)


def copy_cell(x: Column, kind: str, is_key: bool = False) -> tuple[Column, Column]:
    """(cell, reject) of a bulk load: temporal and boolean cells without a reading are null; a row goes if a key cell is."""
    base = kind.upper()
    cell = {"BOOLEAN": lambda: bool_token(x).cast("string"), "DATE": lambda: date_text(x), "TIMESTAMPTZ": lambda: timestamp_text(x), "TIME": lambda: time_text(x), "BYTEA": lambda: bytes_hex(x)}.get(base, lambda: numeric_text(x) if base in ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "REAL", "DOUBLE") else x)()
    return cell, (x.isNull() | (x == "")) if is_key else F.lit(False)


def json_cell(x: Column, kind: str) -> Column:
    """A cell at apply: whole numbers for a timestamp are seconds since 1970; else as in a bulk load."""
    if kind.upper() == "TIMESTAMPTZ":
        return F.when(x.rlike(r"^-?[0-9]+$"), epoch_seconds_text(x.try_cast("long"))).otherwise(timestamp_text(x))
    return copy_cell(x, kind)[0]


def row_sample(entries: Column, keys: int = 4, width: int = 48) -> Column:
    """The first entries of an array of (key, value) structs as short JSON-like text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.slice(entries, 1, keys), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), F.substring(F.coalesce(e["value"], F.lit("")), 1, width), F.lit('"'))), ","), F.lit("}"))
