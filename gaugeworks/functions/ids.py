"""Identifiers, digests, paths, frames and validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of recording ids and safe names.
VIDEO_ID = r"^Person_\d+_session_\d+_[A-Za-z0-9_]+\z"
KITCHEN_VIDEO_ID = r"^P\d{2}_\d{2,3}\z"
SAFE_NAME = r"^[A-Za-z0-9_-]+\z"
RETRYABLE_NAMES = r"(?i)timeout|connection|apierror|ratelimit"


def canonical_digest(value: Column) -> Column:
    """sha256 of a JSON text's canonical form: sorted keys, ``, `` and ``: `` between, characters as they are.

    The text is parsed as a VARIANT, which orders keys, and written again.  A VARIANT has no place for the difference of
    1 and 1.0, so numbers other than plain integers pass it as marked texts, in the shortest form that reads back as the
    same double.  Null for text that is not JSON or repeats a key.  Keys go by UTF-16 units; floats that are too
    small for full precision are written as the JVM writes them.
    """
    return F.sha2(canonical_json(value if isinstance(value, Column) else F.col(value)), 256)


#: Stand for an escaped backslash and quote while texts are cut into tokens; control characters are no part of JSON.
_SLASH, _QUOTE = "\x01", "\x02"
_TOKENS = r'("[^"]*+"|[-+0-9.eE]++|[^-+0-9.eE"]++|")'
_NUMBER = r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?\z"
_LONE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def canonical_json(value: Column) -> Column:
    """The canonical form that ``canonical_digest`` hashes."""
    hidden = lambda c: F.replace(F.replace(c, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    shown = lambda c: F.replace(F.replace(c, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))
    plain = lambda t: ~t.rlike("[.eE]") & (F.length(t) <= 38) & (t != "-0")
    mark = lambda t: F.concat(F.lit('"\\u0001n'), _number(t), F.lit('"'))
    into = lambda t: F.when(t.startswith('"\\u0001'), F.concat(F.lit('"\\u0001s'), F.substr(t, F.lit(8)))).when(t.rlike(_NUMBER) & ~plain(t), mark(t)).otherwise(t)
    back = lambda t: (
        F.when(t.startswith('"\\u0001n'), F.substr(t, F.lit(9), F.length(t) - 9)).when(t.startswith('"\\u0001s'), F.concat(F.lit('"\\u0001'), F.substr(t, F.lit(9))))
        .when(t.startswith('"'), t).otherwise(F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")))
    )
    pass_ = lambda c, change: F.array_join(F.transform(F.regexp_extract_all(hidden(c), F.lit(_TOKENS), 1), change), "")
    odd = value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | F.replace(value, F.lit("\\\\"), F.lit("")).rlike(_LONE)
    text = shown(pass_(F.when(~odd, value), into))
    # The parser passes over what follows a value, so the text must be one inside an array and inside an object.
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    parsed = F.to_json(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))))
    out = pass_(F.when(alone, F.substr(parsed, F.lit(6), F.length(parsed) - 6)), back)
    for digit in "ABCDEF":  # control characters have small hex digits
        out = F.regexp_replace(out, rf"\\u00([01]){digit}", rf"\\u00$1{digit.lower()}")
    return shown(out)


def _number(token: Column) -> Column:
    """A JSON number as Python writes what it reads: an integer, or the shortest text of the double."""
    value = token.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(token, "[eE].*$", ""), "[-.]", "")
    exact = F.length(F.regexp_replace(digits, "^0+|0+$", "")) <= 15
    whole = F.when(token == "-0", "0").when(~token.rlike("[.eE]"), F.when(F.length(token) <= 4300, token).otherwise("?\""))
    sign = F.when(token.startswith("-"), "-").otherwise("")
    double = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit('?"')).when(value == 0, F.concat(sign, F.lit("0.0")))  # a quote makes the text no JSON
    text = _bound(F.when(exact & (F.abs(value) > 1e-290), token).otherwise(F.abs(value).cast("string")), lambda t: _shortest(F.when(exact, t).otherwise(_bound(t, _shorter))))
    return F.coalesce(whole, double, F.concat(sign, text))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _shorter(token: Column) -> Column:
    """A positive double's text, with a digit less if that reads back alike, as Java before 19 may write one too many."""
    head, power = F.regexp_replace(token, "E.*$", ""), F.coalesce(F.regexp_extract(token, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.replace(head, F.lit("."), F.lit("")), "^0+", "")
    power = power - F.length(F.regexp_extract(head, "[.]([0-9]*)$", 1)) + 1
    less = F.floor(digits.try_cast("decimal(20,0)") / 10).cast("decimal(20,0)")
    told = lambda d: F.concat(d.cast("string"), F.lit("e"), power.cast("string"))
    alike = lambda d: F.coalesce(told(d).try_cast("double") == token.try_cast("double"), F.lit(False))
    down, up = less, (less + 1).cast("decimal(20,0)")
    return F.when(alike(up) & (digits.substr(-1, 1).isin(*"56789") | ~alike(down)), told(up)).when(alike(down), told(down)).otherwise(token)


def _shortest(token: Column) -> Column:
    """The digits of a decimal text, without sign, in the notation Python chooses by their exponent."""
    head = F.regexp_replace(F.regexp_replace(token, "[eE].*$", ""), "^-", "")
    power = F.coalesce(F.regexp_extract(token, "[eE]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.replace(head, F.lit("."), F.lit(""))
    cut = F.regexp_replace(digits, "^0+", "")
    at = F.length(F.substring_index(head, ".", 1)) + power - (F.length(digits) - F.length(cut)) - 1  # the exponent of the first digit
    own = F.regexp_replace(cut, "0+$", "")
    n = F.length(own)
    fixed = (
        F.when(at < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at - 1), own))
        .when(n <= at + 1, F.concat(F.rpad(own, at + 1, F.lit("0")), F.lit(".0")))
        .otherwise(F.concat(F.substr(own, F.lit(1), at + 1), F.lit("."), F.substr(own, at + 2)))
    )
    short = F.concat(F.left(own, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(own, F.lit(2)))).otherwise(""), F.when(at < 0, "e-").otherwise("e+"), F.lpad(F.abs(at).cast("string"), F.greatest(F.lit(2), F.length(F.abs(at).cast("string"))), F.lit("0")))
    return F.when((at >= -4) & (at < 16), fixed).otherwise(short)


def valid_video_id(c: Column) -> Column:
    return F.coalesce(c.rlike(VIDEO_ID), F.lit(False))


def is_extension_video(c: Column) -> Column:
    parts = F.split(c, "_")
    number = F.try_element_at(parts, F.lit(2))
    return F.coalesce((F.size(parts) == 2) & number.rlike(r"^\d+\z") & (number.try_cast("long") >= 100), F.lit(False))


def valid_name(c: Column) -> Column:
    """Run ids, model ids and tags: ASCII letters, digits, _ and - only."""
    return F.coalesce(c.rlike(SAFE_NAME), F.lit(False))


def valid_hex(c: Column, digits: int) -> Column:
    """A checksum of so many hex digits of either case; a missing one passes."""
    return F.coalesce(c.rlike(rf"^[a-fA-F0-9]{{{digits}}}\z"), F.lit(True))


def video_urls(c: Column, base: str, extension_base: str) -> Column:
    """Where a kitchen recording may be, likeliest first: extension recordings in one place, others under train or test."""
    person, file = F.substring_index(c, "_", 1), F.concat(c, F.lit(".MP4"))
    split = lambda name: F.concat(F.lit(f"{base}/videos/{name}/"), person, F.lit("/"), file)
    return F.when(is_extension_video(c), F.array(F.concat(F.lit(f"{extension_base}/"), person, F.lit("/videos/"), file))).otherwise(F.array(split("train"), split("test")))


def video_path(c: Column) -> Column:
    """Path of a recording in its collection, by person; null for an id of another shape."""
    return F.when(valid_video_id(c), F.concat(F.lit("data/video/"), F.substring_index(c, "_", 2), F.lit("/"), c, F.lit(".mp4")))


def seconds(c: Column) -> Column:
    """A time in seconds: finite and not negative, else null."""
    v = c.try_cast("double")
    return F.when((v >= 0) & (v < float("inf")), v)


def valid_window(start: Column, end: Column) -> Column:
    return F.coalesce(seconds(end) > seconds(start), F.lit(False))


def scaled(width: Column, height: Column, longest: int, even: bool = False) -> Column:
    """Width and height at most ``longest``, rounded down, to even numbers if asked."""
    ratio = F.least(F.lit(1.0), longest / F.greatest(width, height))
    size = lambda x: (F.floor(x * ratio / 2) * 2 if even else F.floor(x * ratio)).cast("int")
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def utc_stamp(c: Column) -> Column:
    """ISO time with milliseconds and Z; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def run_id(system: Column, mode: Column, stamp: Column) -> Column:
    return F.concat_ws("__", F.regexp_replace(system, r"[^\p{L}\p{N}\-_.]", "_"), mode, stamp)


def retryable(status: Column, name: Column) -> Column:
    """Worth another try: status 429 or 5xx, or without a status a name that says so."""
    return F.coalesce(F.when(status.isNotNull(), (status == 429) | ((status >= 500) & (status < 600))).otherwise(name.rlike(RETRYABLE_NAMES)), F.lit(False))


def session_number(question: Column) -> Column:
    return F.regexp_extract(question, r"(?i)session\s+(\d+)\s+of", 1).try_cast("int")


def question_object(question: Column) -> Column:
    """What a where-was-it question asks for, as bare upper-case letters; '' when it asks otherwise."""
    phrase = F.regexp_extract(question, r"(?i)where was the\s+(.+?)\s*\?", 1)
    return F.regexp_replace(F.upper(F.regexp_replace(phrase, r"(?i)\s*in the most recent session$", "")), "[^A-Z]", "")
