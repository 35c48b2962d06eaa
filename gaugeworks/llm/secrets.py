"""Secret scan: candidate strings, then a random forest that removes false positives, in SQL expressions.

Candidates are runs of 16 or more credential characters, or of 8 or more that are assigned to a credential's name,
with both letters and digits.  Features are
their length, character classes and transitions, how natural their letter pairs are, how much of
them dictionary words cover, the path or source, and the neighbouring words on both sides.  The forest is trained
on labelled findings (``findings``), with features computed by the same expressions,
and becomes one CASE expression; nothing but SQL functions touches the corpus.

Defined results: each occurrence of a value in a text is scored by its own context; null and empty texts have no
candidates and stay as they are; repeated rows give equal results; a null path is an unknown path;
extra columns are kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names after which shorter values are candidates too.
ASSIGNED = r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
RUN = "[A-Za-z0-9_+/-]"
CANDIDATE = rf"(?<!{RUN})(?:{RUN}{{16,}}|(?<=[=:][\"' ]{{0,3}})(?<=(?i:{ASSIGNED})[\"']? {{0,2}}[=:] {{0,2}}[\"']?){RUN}{{8,}})={{0,2}}"
MASK = "[SECRET]"
#: Frequent letter pairs of English words.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
#: Words of identifiers and placeholders.
WORDS = (
    "example sample test dummy placeholder your changeme version release build config default user name file path http https www com org image page index table "
    "column value data time date code item order list public private license token secret password key access account service system session request response "
    "error update delete create module package import export class method object string number array buffer stream socket server client network address domain "
    "folder source target input output result report status event message queue worker thread process memory cache store record field entry group member owner "
    "admin guest profile setting option feature product price payment invoice customer supplier shipment country region city street phone email contact window "
    "button label title header footer border color width height style theme script document article comment review rating search filter sort view click model"
).split()
#: Names that stand before credentials, and before harmless strings.
CREDENTIAL = r"(?:tokens?|secrets?|passw(?:or)?ds?|pwd|passphrase|api[_ -]?key|access[_ -]?key|auth|credentials?|private[_ -]?key|bearer)"
HARMLESS = r"(?:sha\d*|commit|md5|uuid|guid|checksum|digest|hash|etag|version|revision|build|isbn|order|example|sample)"
#: Beginnings of issued keys, and the letters and number of letters after them.
ISSUED = [("AKIA", "upper", 16), ("ghp_", "both", 36), ("sk_live_", "both", 24), ("AIza", "both", 35), ("xoxb-", "both", 40), ("glpat-", "both", 20)]
#: Fixed value: words after a value that tell what it is.
AFTER = r"(?i)^[\"')\]]{0,2}\s*\(?(?:was merged|is the (?:checksum|digest|hash|commit|version)|commit|on branch|matches the|is a page|revision)"
KNOWN = r"(?:^|[/+_-])(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abpr]-|sk_live_|sk-|AIza|eyJ|glpat-)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Each feature as SQL over x.value, x.before (40 characters), x.after (24 characters) and x.path.
FEATURES = {
    "size": "CAST(length(x.value) AS DOUBLE)",
    "digits": "regexp_count(x.value, '[0-9]') / length(x.value)",
    "capitals": "regexp_count(x.value, '[A-Z]') / length(x.value)",
    "marks": "regexp_count(x.value, '[^A-Za-z0-9]') / length(x.value)",
    "letter_digit": "regexp_count(x.value, '[A-Za-z](?=[0-9])') / (length(x.value) - 1)",
    "digit_letter": "regexp_count(x.value, '[0-9](?=[A-Za-z])') / (length(x.value) - 1)",
    "lower_upper": "regexp_count(x.value, '[a-z](?=[A-Z])') / (length(x.value) - 1)",
    "upper_lower": "regexp_count(x.value, '[A-Z](?=[a-z])') / (length(x.value) - 1)",
    "natural": f"regexp_count(lower(x.value), '(?={'|'.join(PAIRS)})') / (length(x.value) - 1)",
    "covered": f"1 - length(regexp_replace(lower(x.value), '{'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))}', '')) / length(x.value)",
    "longest": "array_max(transform(split(x.value, '[^A-Za-z]+'), s -> length(s))) / length(x.value)",
    "variety": "size(array_distinct(split(x.value, ''))) / least(length(x.value), 64)",
    "hex": r"CAST(x.value RLIKE '^[0-9a-fA-F]+$' AS DOUBLE)",
    "uuid": r"CAST(x.value RLIKE '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' AS DOUBLE)",
    "known": f"CAST(x.value RLIKE {_sql(KNOWN)} AS DOUBLE)",
    "named": f"CAST(x.before RLIKE {_sql('(?i)' + CREDENTIAL + r'[^A-Za-z]{0,12}$')} AS DOUBLE)",
    "harmless": f"CAST(x.before RLIKE {_sql('(?i)' + HARMLESS + r'[^A-Za-z]{0,12}$')} AS DOUBLE)",
    "assigned": r"""CAST(x.before RLIKE '[=:]\\s*["\']?$' AS DOUBLE)""",
    "explained": f"CAST(x.after RLIKE {_sql(AFTER)} AS DOUBLE)",
    "path": r"CAST(coalesce(x.path, '') RLIKE '(?i)(test|example|fixture|sample|doc)' AS DOUBLE)",
}


def findings(n: int = 3600, seed: int = 31) -> list[tuple[str, str, str, int, str]]:
    """Labelled findings (value, before, path, label, after).

    The label is what the value was made as; where it stands is drawn apart from that, so that names, neighbours
    and paths are only more or less likely with either label.
    """
    rng = random.Random(seed)
    some = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    prose = ["the value of", "and then set", "see also", "was found in", "please use", "according to", "est une", "und der", "para los", ""]
    names = ["token", "secret", "api_key", "apikey", "access_key", "password", "auth_token", "client_secret", "TOKEN", "private_key", "PRIVATE_KEY", "passwd", "credential"]
    other = ["commit", "sha256", "md5", "uuid", "checksum", "digest", "version", "build", "order", "example", "etag", "revision"]
    neutral = ["value", "ref", "field", "id", "name", "x", "data"]
    paths, demo = ["src/app", "config/prod", "src0", "web/main", "lib/core", None], ["tests/unit", "docs/example", "fixtures/a"]
    rest = ["", " and more", ".", ", then", '"', "'", ";", " end"]
    told = [" was merged", " is the checksum", " (commit)", " on branch main", " matches the digest", " is a page"]
    word = lambda: rng.choice(WORDS)
    words = lambda lo, hi: [word() + rng.choice(["", "", str(rng.randrange(100))]) for _ in range(rng.randint(lo, hi))]

    def issued() -> str:
        head, letters, size = rng.choice(ISSUED)
        return head + some(upper if letters == "upper" else alnum, size, size)

    def among(parts: list[str]) -> str:
        parts.insert(rng.randrange(len(parts)), issued())
        return rng.choice("/-_+").join(parts)

    def cased(value: str) -> str:
        return value.upper() if rng.random() < 0.15 else value

    def before(credential: float, harmless: float, plain: float) -> str:
        """Text before a value, with such odds that the name is a credential's, a harmless or a neutral one, and else prose."""
        u, sign = rng.random(), f"{rng.choice([' = ', '=', ': ', ':'])}{rng.choice(['', chr(34), chr(39)])}"
        if u < credential:
            return f"{rng.choice(prose)} {cased(rng.choice(names))}{sign}"
        if u < credential + harmless:
            return f"{rng.choice(prose)} {cased(rng.choice(other))}{rng.choice([sign, ' '])}"
        return f"{rng.choice(prose)} {rng.choice(neutral)}{sign}" if u < credential + harmless + plain else f"{rng.choice(prose)} "

    base64 = lambda: some(alnum * 8 + "+/", 520, 3000)
    kinds = [
        (lambda: cased(some(hexes, 16, 64)), 1, 3, (0.96, 0.0, 0.03)),
        (lambda: some(alnum, 16, 64), 1, 3, (0.9, 0.0, 0.05)),
        (lambda: some(alnum * 8 + "+/", 20, 60) + rng.choice(["", "=", "=="]), 1, 1, (0.9, 0.0, 0.05)),
        (lambda: cased(some(alnum, 8, 15)), 1, 2, (1.0, 0.0, 0.0)),
        (issued, 1, 2, (0.4, 0.02, 0.08)),
        (base64, 1, 1, (0.95, 0.0, 0.02)),
        (lambda: among(words(60, 200)), 1, 1, (0.1, 0.0, 0.1)),
        (lambda: cased(some(hexes, 32, 64)), 0, 3, (0.01, 0.69, 0.1)),
        (lambda: "-".join(some(hexes, k, k) for k in (8, 4, 4, 4, 12)), 0, 2, (0.03, 0.4, 0.4)),
        (lambda: rng.choice("_-/").join(words(2, 6)) + str(rng.randrange(100)), 0, 3, (0.05, 0.15, 0.2)),
        (lambda: rng.choice(["your-token-here-", "example-secret-key-", "changeme-password-", "test-api-key-sample-"]) + str(rng.randrange(10, 999)), 0, 2, (0.85, 0.05, 0.05)),
        (lambda: some(string.ascii_lowercase, 14, 30) + str(rng.randrange(1000)), 0, 2, (0.0, 0.1, 0.1)),
        (lambda: rng.choice("/-_+").join(words(90, 300)) + "1", 0, 1, (0.02, 0.1, 0.1)),
        (base64, 0, 1, (0.0, 0.2, 0.1)),
        (lambda: some(upper, 16, 24), 0, 1, (0.0, 0.6, 0.1)),
    ]
    drawn = [k for k in kinds for _ in range(k[2])]
    out = []
    for i in range(n):
        make, label, _, odds = drawn[i % len(drawn)]
        value = make()
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            path = rng.choice(demo if rng.random() < (0.04 if label else 0.3) else paths)
            head = before(*odds)
            if not label and "+" in value and len(value) > 500 and rng.random() < 0.5:
                head = rng.choice(["data:image/png;base64,", "data:font/woff2;base64,"])
            out.append((value, head, path, label, rng.choice(told if rng.random() < (0.02 if label else 0.3) else rest)))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int = 8):
    """A tree by Gini over a random third or so of the features: a probability, or (feature, cut, low, high)."""
    if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in rng.choice(x.shape[1], 7, replace=False):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)))
        for cut in cuts:
            low = x[:, f] <= cut
            n = low.sum()
            if leaf <= n <= len(y) - leaf:
                p, q = y[low].mean(), y[~low].mean()
                gini = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or gini < best[0]:
                    best = (gini, int(f), float(cut), low)
    if best is None:
        return float(y.mean())
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], rng, depth - 1, leaf), grow(x[~low], y[~low], rng, depth - 1, leaf)


def tree_sql(node) -> str:
    if isinstance(node, float):
        return f"{node!r}D"
    f, cut, low, high = node
    return f"IF(x.{list(FEATURES)[f]} <= {cut!r}D, {tree_sql(low)}, {tree_sql(high)})"


def featured(candidates: str) -> str:
    """SQL for an array of structs with the features beside value, start and the rest of each candidate."""
    return f"transform({candidates}, x -> named_struct('value', x.value, 'start', x.start, {', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in FEATURES.items())}))"


@lru_cache(maxsize=4)
def forest(trees: int = 24, depth: int = 7, seed: int = 41) -> tuple:
    """The trees trained on the labelled findings, whose features Spark works out by the same SQL."""
    spark = SparkSession.getActiveSession()
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(findings())], "i int, value string, before string, path string, label int, after string")
    made = labelled.withColumn("x", F.expr("named_struct('value', value, 'before', right(before, 40), 'after', left(after, 24), 'path', path)"))
    got = made.select("i", "label", *(F.expr(v).alias(k) for k, v in FEATURES.items())).orderBy("i").collect()
    x, y = np.array([r[2:] for r in got], float), np.array([r[1] for r in got], float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        of = rng.integers(0, len(y), len(y))
        grown.append(grow(x[of], y[of], rng, depth))
    return tuple(grown)


def forest_sql() -> str:
    """The forest's probability as SQL over a featured x."""
    grown = forest()
    return "(" + " + ".join(map(tree_sql, grown)) + f") / {len(grown)}"


def scored(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with found: array of (value, start, score), each occurrence of a candidate in the text; and all runs and the texts between them.

    Nothing is looked up by its place in the text, which would walk it from its start for each candidate: contexts come from the
    neighbouring runs and texts between, whose ends alone are joined, and places are sums of lengths.
    """
    text, path, pattern = f"`{text_col}`", f"CAST(`{path_col}` AS STRING)", _sql(CANDIDATE)
    some = lambda made: F.expr(f"IF(size(__raw) > 0, {made}, array())")
    # Columns that a lambda reads stand outside it and are read twice at least, or they would be worked out for each element.
    out = docs.withColumn("__raw", F.expr(f"regexp_extract_all({text}, {pattern}, 0)")).withColumn("__between", some(f"split({text}, {pattern}, -1)"))
    # Where each run ends: sums inside blocks of about sqrt(n) lengths, then sums of the blocks, as appending copies an array.
    width = "CAST(ceil(sqrt(size(__lengths))) AS INT)"
    out = out.withColumn("__lengths", some("zip_with(__between, __raw, (b, v) -> length(b) + coalesce(length(v), 0))"))
    out = out.withColumn("__sums", some(f"transform(sequence(0, CAST((size(__lengths) - 1) / {width} AS INT)), i -> aggregate(slice(__lengths, i * {width} + 1, {width}), array(0), (a, n) -> array_append(a, element_at(a, -1) + n)))"))
    out = out.withColumn("__before_blocks", some("aggregate(__sums, array(0), (a, s) -> array_append(a, element_at(a, -1) + element_at(s, -1)))"))
    out = out.withColumn("__ends", some("flatten(zip_with(__sums, slice(__before_blocks, 1, size(__sums)), (s, o) -> transform(slice(s, 2, size(s)), e -> e + o)))"))
    # A run has eight characters at least, so five runs back and three ahead hold all of a context.
    out = out.withColumn("__behind", some("zip_with(__between, __raw, (b, v) -> right(concat(right(b, 40), right(coalesce(v, ''), 40)), 40))"))
    out = out.withColumn("__ahead", some("zip_with(__between, __raw, (b, v) -> left(concat(left(b, 24), left(coalesce(v, ''), 24)), 24))"))
    back = [f"concat(array_repeat('', least({k}, size(__raw))), slice(__behind, 1, greatest(size(__raw) - {k}, 0)))" for k in range(5, 0, -1)]
    near = "slice(transform(__between, b -> right(b, 40)), 1, size(__raw))"
    joined = ", ".join(f"z.`{i}`" for i in range(6))
    out = out.withColumn("__before", some(f"transform(arrays_zip({', '.join([*back, near])}), z -> right(concat({joined}), 40))"))
    ahead = [f"slice(__ahead, {k + 1}, size(__raw))" for k in range(1, 4)]
    joined = ", ".join(f"coalesce(z.`{i}`, '')" for i in range(3))
    out = out.withColumn("__after", some(f"transform(arrays_zip({', '.join(ahead)}), z -> left(concat({joined}), 24))"))
    placed = f"transform(arrays_zip(__raw, __ends, __before, __after), z -> named_struct('value', z.__raw, 'start', z.__ends - length(z.__raw) + 1, 'path', {path}, 'before', z.__before, 'after', z.__after))"
    out = out.withColumn("__placed", some(f"filter(slice({placed}, 1, size(__raw)), p -> p.value RLIKE '[0-9]' AND p.value RLIKE '[A-Za-z]')"))
    out = out.withColumn("__made", F.expr(featured("__placed")))
    out = out.withColumn("found", F.expr(f"transform(__made, x -> named_struct('value', x.value, 'start', x.start, 'score', {forest_sql()}))"))
    return out.drop("__lengths", "__sums", "__before_blocks", "__ends", "__behind", "__ahead", "__before", "__after", "__placed", "__made")


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value_sha256, score, is_secret), one row for each occurrence of a candidate; values are not shown."""
    rows = scored(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source"))
    # Outer, as a filter on found before the explosion would work out all of it once more.
    rows = rows.select("doc_id", F.explode_outer("found").alias("f")).where("f is not null")
    return rows.select("doc_id", F.col("f.start").alias("start"), F.length("f.value").alias("length"), F.sha2("f.value", 256).alias("value_sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with the secrets replaced by ``MASK`` wherever they occur; all rows and columns stay.

    A value is a secret of its text if any of its occurrences is.  The text is put together again from its runs and what
    is between them: a run that is a secret becomes the mask as a whole, and inside any other run secrets are replaced, longer ones first.
    Which other runs may hold one is told by the eight characters that a secret begins with, looked up among theirs a thousand runs at a time.
    """
    values = f"array_distinct(transform(filter(found, x -> x.score >= {threshold}D), x -> x.value))"
    longest = f"array_sort({values}, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)"
    some = lambda made: F.expr(f"IF(size(__secrets) > 0, {made}, array())")
    out = scored(docs, text_col, path_col).withColumn("__secrets", F.expr(f"IF(size(found) > 0, {longest}, array())"))
    out = out.withColumn("__others", some("array_except(__raw, __secrets)")).withColumn("__keys", some("transform(__secrets, v -> left(v, 8))"))
    grams = "flatten(transform(slice(__others, g * 1000 + 1, 1000), r -> regexp_extract_all(r, '(?=(.{8}))', 1)))"
    out = out.withColumn("__hits", some(f"array_distinct(flatten(transform(sequence(0, CAST(size(__others) / 1000 AS INT)), g -> IF(size(__keys) > 0, array_intersect({grams}, __keys), array()))))"))
    out = out.withColumn("__touched", some("IF(size(__hits) > 0, filter(__others, r -> exists(__hits, h -> contains(r, h))), array())"))
    # Secrets by hash in about sqrt(n) buckets, so that a run is compared with few of them.
    out = out.withColumn("__hashed", some("transform(__secrets, v -> CAST(pmod(xxhash64(v), CAST(ceil(sqrt(size(__secrets))) AS INT)) AS INT))"))
    out = out.withColumn("__buckets", some("transform(sequence(0, CAST(ceil(sqrt(size(__secrets))) AS INT) - 1), b -> filter(__secrets, (v, i) -> size(__hashed) > 0 AND get(__hashed, i) = b))"))
    held = "array_contains(get(__buckets, CAST(pmod(xxhash64(r), size(__buckets)) AS INT)), r)"
    inside = f"aggregate(__secrets, r, (t, v) -> replace(t, v, '{MASK}'))"
    hidden = f"CASE WHEN r IS NULL THEN '' WHEN {held} THEN '{MASK}' WHEN size(__touched) > 0 AND array_contains(__touched, r) THEN {inside} ELSE r END"
    whole = f"array_join(flatten(zip_with(__between, __raw, (b, r) -> array(b, {hidden}))), '')"
    masked = F.expr(f"IF(size(__secrets) > 0, {whole}, `{text_col}`)")
    return out.withColumn(text_col, masked).select(docs.columns)
