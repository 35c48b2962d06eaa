"""Text functions as Column expressions: numbers, choice letters, diagnostics and rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reply patterns that name a choice letter.
LETTER_PATTERNS = [
    r"(?i)^\s*\(?([A-E])\)?\s*[.):,-]?\s*$",
    r"(?i)\b(?:answer|option|choice)\s*(?:is\s*)?:?\s*\(?([A-E])\)?\b",
    r"(?i)^\s*\(?([A-E])\)?[.):]\s+\S",
]
#: Inline markup, negations and abstentions of replies.
MARKUP = r"</?[a-zA-Z][a-zA-Z0-9]{0,19}\s*/?>|\*+|`+|~~"
NEGATION = r"(?i)\b(?:not|isn'?t|no longer|never|nowhere|none)\b"
ABSTENTION = (
    r"(?i)\b(?:information is not available|not available based on"
    r"|cannot (?:be )?(?:determine|determined|tell|say|answer|know)"
    r"|can(?:'|no)?t (?:determine|tell|say|answer|know)"
    r"|(?:no|insufficient|not enough) (?:information|evidence|context)"
    r"|impossible to (?:tell|determine|say)|unable to (?:determine|tell|say|answer))\b"
)
UNANSWERABLE_TEXT = "The information is not available based on the given context"
#: Phrases of a refusal.
REFUSALS = [
    "don't have access", "do not have access", "don't have the video", "cannot access", "can't access",
    "can't provide information", "cannot view", "can't see", "cannot see", "don't have any visual",
    "don't have information", "can't watch", "cannot watch",
    "无法查看", "无法访问", "看不到视频", "没有视频", "未提供视频", "没有提供视频",
]
#: Verbs and suffixes of placements, what is never a place, and fixed places.
PLACEMENT_HEADS = "put place insert store leave return throw move".split()
DEST_SUFFIXES = "in on into onto down to inside under back".split()
COMPOUND_SUFFIXES = "in on into onto inside under".split()
NOT_A_PLACE = (
    "it them this that there here half top bottom side middle place position hand hands left right front back again "
    "order pieces piece bits bit water oil salt pepper soup sauce milk sugar"
).split()
FIXED_PLACES = (
    "drawer cupboard cupboards fridge refrigerator freezer sink shelf shelves table counter countertop worktop hob stove oven "
    "microwave dishwasher bin rack cabinet pantry drainer floor surface sideboard desk cooker washer machine holder stand door tap "
    "cupboard:top drainer:dish rack:drying"
).split()
DESTINATION = (
    r"(?i)\b(?:in|into|on|onto|inside|in\s+to|onto\s+of|under|behind|to)\s+(?:the\s+|a\s+|my\s+|his\s+|her\s+|its\s+)?"
    r"([a-z][a-z\s\-']{1,28}?)(?=\s*$|\s+(?:and|then|to|with|for|from|so|because|after|before)\b|[,.])"
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def parse_number(c: Column) -> Column:
    """The number a reply gives: the whole text, or else the first number in it; null if none or not finite.

    ASCII digits only; case of exponents and signs as in decimal literals, single underscores between digits.
    """
    text = F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))
    digits = r"[0-9](?:_?[0-9])*"
    plain = text.rlike(rf"^[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?\z")
    named = text.rlike(r"(?i)^[+-]?(?:inf|infinity|nan)\z")
    first = F.regexp_extract(text, r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0)
    value = F.when(plain, F.replace(text, F.lit("_"), F.lit(""))).when(named, F.lit(None)).otherwise(F.nullif(first, F.lit("")))
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def strip_markup(c: Column) -> Column:
    return strip(F.regexp_replace(c, MARKUP, ""))


def option_array(options: Column) -> Column:
    """A map of options as an array of (letter, text) by letter."""
    return F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text"))))


def choice_letter(reply: Column, options: Column) -> Column:
    """The letter a free-form reply chooses, or null.

    ``options`` is an ordered array of (letter, text), or null for A to E.  Tried in turn: the first
    token; three phrasings; an option's whole text; the longest option text contained, unless
    another one is outside it or a negation stands around it; the abstention option.
    Letters are compared in lower case, so foldings that change length are not followed.
    """
    text = strip_markup(strip(reply.cast("string")))
    letters = F.coalesce(F.transform(options, lambda o: o["letter"]), F.array(*map(F.lit, "ABCDE")))
    allowed = lambda x: F.array_contains(letters, F.upper(x))
    token = strip(F.regexp_replace(F.substring_index(text, " ", 1), r"\.+\z", ""))
    steps = [F.when((F.length(token) == 1) & allowed(token), F.upper(token))]
    for pattern in LETTER_PATTERNS:
        found = F.regexp_extract(text, pattern, 1)
        steps.append(F.when((found != "") & allowed(found), F.upper(found)))
    low = F.lower(text)
    folded = F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), F.lower(strip(o["text"])).alias("text")))
    equal = F.filter(folded, lambda o: o["text"] == low)
    steps.append(F.when(F.size(equal) == 1, F.upper(F.try_element_at(equal, F.lit(1))["letter"])))
    inside = F.filter(folded, lambda o: (o["text"] != "") & low.contains(o["text"]))
    longest = F.aggregate(inside, F.struct(F.lit(None).cast("string").alias("letter"), F.lit("").alias("text")), lambda a, o: F.when(F.length(o["text"]) > F.length(a["text"]), o).otherwise(a))
    nested = F.forall(inside, lambda o: longest["text"].contains(o["text"]))
    named = (F.size(inside) > 0) & nested
    denied = F.replace(low, longest["text"], F.lit(" ")).rlike(NEGATION)
    abstains = F.exists(options, lambda o: (o["letter"] == "E") & (o["text"] == UNANSWERABLE_TEXT)) & text.rlike(ABSTENTION)
    rest = F.when(named & denied, F.lit(None)).when(named, F.upper(longest["letter"])).when(abstains, "E")
    return F.when(text != "", F.coalesce(*steps, rest))


def first_token(c: Column) -> Column:
    """The word before the first blank without its closing full stops."""
    return strip(F.regexp_replace(F.substring_index(strip(c), " ", 1), r"\.+\z", ""))


def exact_match(a: Column, b: Column) -> Column:
    return F.when(F.lower(strip(a)) == F.lower(strip(b)), 1.0).otherwise(0.0)


def diagnostic_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(r"[a-z0-9]+(?:'[a-z]+)?|[\x{4e00}-\x{9fff}]"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """64-bit hashes of the windows of n tokens, which tell the n-grams of one text apart."""
    last = F.size(tokens) - n
    window = lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(n)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))


def refuses(c: Column) -> Column:
    low = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("’"), F.lit("'"))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in REFUSALS])


def lexical_words(c: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, ""), F.lit("[a-z0-9]+"), F.lit(0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of words: both empty 1, one empty 0.

    One pass over both bags sorted together: of equal words those of ``a`` come first and wait to be matched by those of ``b``.
    """
    side = lambda words, k: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))

    def step(acc: Column, x: Column) -> Column:
        known = acc["w"] == x["w"]
        match = known & (x["k"] == 1) & (acc["left"] > 0)
        left = F.when(x["k"] == 0, F.when(known, acc["left"]).otherwise(0) + 1).when(match, acc["left"] - 1).otherwise(F.when(known, acc["left"]).otherwise(0))
        return F.struct(x["w"].alias("w"), left.alias("left"), F.when(match, acc["same"] + 1).otherwise(acc["same"]).alias("same"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("same"))
    same = F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step)["same"]
    f1 = 2.0 * same / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(f1)


def is_placement(verb: Column) -> Column:
    parts = F.split(F.lower(verb), "-")
    suffix = F.try_element_at(parts, F.lit(2))
    return F.element_at(parts, 1).isin(PLACEMENT_HEADS) & (suffix.isNull() | suffix.isin(DEST_SUFFIXES))


def head_noun(phrase: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(phrase), r"[^a-z\s\-]", " "), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def destination(narration: Column, verb: Column, places: list[str] | None = None) -> Column:
    """(head, surface) of the place a narration names, or null."""
    allowed = places if places is not None else FIXED_PLACES
    good = lambda h: (h != "") & ~h.isin(NOT_A_PLACE) & h.isin(allowed)
    surfaces = F.transform(F.regexp_extract_all(narration, F.lit(DESTINATION), F.lit(1)), lambda s: strip(F.regexp_replace(s, r"\s+", " ")))
    pair = lambda h, s: F.struct(h.alias("head"), s.alias("surface"))
    named = F.try_element_at(F.filter(F.transform(surfaces, lambda s: pair(head_noun(s), s)), lambda p: good(p["head"])), F.lit(1))
    tail = head_noun(narration)
    compound = F.try_element_at(F.split(F.lower(F.coalesce(verb, F.lit(""))), "-"), F.lit(2)).isin(COMPOUND_SUFFIXES)
    return F.coalesce(named, F.when(compound & good(tail), pair(tail, tail)))


def render_prompt(question: Column, answer_format: Column, options: Column, unit: Column) -> Column:
    lines = F.array_join(F.transform(F.array_sort(options), lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), "\n")
    gap = F.lit("\n\n")
    choice = F.concat(question, gap, F.coalesce(lines, F.lit("")), gap, F.lit("Answer with the single letter of the best option and nothing else."))
    number = F.concat(question, gap, F.lit("Answer with a single number in "), F.coalesce(F.nullif(unit, F.lit("")), F.lit("units")), F.lit(", with no words and no unit symbol."))
    return F.when(answer_format.isin("mcq", "mcq5"), choice).when(answer_format == "numeric", number).otherwise(F.concat(question, gap, F.lit("Answer in one or two sentences.")))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_")


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def hash_choice(c: Column, n: Column) -> Column:
    """First byte of the text's sha256, modulo n."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("long") % n
