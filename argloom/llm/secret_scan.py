"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

Patterns give spans of the kinds ``assign``, ``access`` and ``hex``.  Beside them,
every long token is tested within the alphabet of its inferred encoding (hex in either case, base32, base64 letters):

* chi-squared uniformity of its symbols,
* runs of symbols of one class (small letters, capitals, digits, others),
* serial correlation of neighbouring symbols.

The hypothesis to reject is "an ordinary token": symbols drawn with the letter frequencies of
ordinary tokens, and few changes of class, as in words, names, paths and numbered identifiers.  A p-value is the chance that an ordinary
token of that encoding and length looks at least as random: as even in its symbols (moments of the sum of squared counts),
with as many runs (deviance of the changes' share), as little correlated.  Each is a normal deviate, and their sum
is tested, so that a token which is plainly ordinary by one test is not called random for another.  The letter
frequencies come from the corpus' own long tokens without digits, smoothed by a fixed table.

A rejection is a secret, and becomes a span of kind ``random``.  The false discovery rate, the share of ordinary
tokens among the reported ones, is controlled over all tokens of the corpus (Benjamini-Hochberg), where p-values are
divided by weights of mean one that grow with the token's length: a longer token carries more evidence and gets more of the budget.

Only DataFrame functions are used.  Texts are read once and not shuffled; what is found in them is written to the
checkpoint folder.  The rejection threshold comes from counts of tokens by rounded log p-value, a table of bounded size.

Defined results: a null or empty text has no spans; offsets are code points, ends
are exclusive; repeated rows are scanned each for itself; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import cut, let

# The patterns of the base rules.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
# Alphabets in the order of their encodings, and the letters' frequencies in English prose, in thousandths.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LETTERS = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
    "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}
#: Letters that the fixed table counts for.
_PRIOR_LETTERS = 1000
#: Of an ordinary token: the share of digits, of capitals among letters (by encoding), and the chance that the class changes from one symbol to the next.
ORDINARY = {"hex": (0.3, 0.0, 0.1), "HEX": (0.3, 1.0, 0.1), "base32": (0.05, 1.0, 0.05), "base64": (0.1, 0.1, 0.2)}
FDR = 0.01
#: Length beyond which a token's weight grows no more, so that one endless token does not take the budget of all others.
_WEIGHED = 64
#: Parts of a natural-log unit in which p-values are counted.
_STEP = 20
_DEEPEST = 40 * _STEP


def _spans(text: Column, pattern: str, kind: str, fits=None) -> Column:
    """``start, rank, end`` of all matches of ``pattern`` (for which ``fits`` holds): the k-th starts after the first k pieces between matches and the k-1 matches before."""

    def walk(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,token:string>>").alias("s"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            own = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), x["m"].alias("token"))
            return F.struct(end.alias("at"), F.concat(acc["s"], F.array(own)).alias("s"))

        both = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("m")))
        spans = F.aggregate(both, zero, step, lambda acc: acc["s"])
        return spans if fits is None else F.filter(spans, lambda x: fits(x["token"]))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,token:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, walk(m)).otherwise(none))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind of the base rules, an array of ``start, rank, end``."""
    found = {
        "assign": _spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS),
        "access": _spans(text, ACCESS, "access"),
        "hex": _spans(text, HEX, "hex"),
    }
    return {kind: F.transform(spans, lambda s: s.dropFields("token")) for kind, spans in found.items()}


def _upper_tail(z: Column) -> Column:
    """log P(Z > z) of a standard normal, by a logistic form for small z and the asymptotic bound beyond 3."""
    middle = -F.log1p(F.exp(F.least(F.lit(50.0), 1.5976 * z + 0.070565992 * z * z * z)))
    far = -z * z / 2 - F.log(F.greatest(z, F.lit(1.0)) * math.sqrt(2 * math.pi))
    return F.when(z > 3, far).otherwise(middle)


def _plain(token: Column) -> Column:
    return F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")


def encoding(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "HEX").when(token.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def letter_shares(tokens: DataFrame) -> dict[str, float]:
    """The letters' frequencies in the ``token``s without digits, smoothed by the fixed table; upper case counts as lower."""
    plain = tokens.filter(F.col("token").rlike("^[A-Za-z]+$")).select(F.explode(F.split(F.lower("token"), "")).alias("letter"))
    seen = {r["letter"]: r["n"] for r in plain.groupBy("letter").agg(F.count("*").alias("n")).collect()}
    whole = sum(LETTERS.values())
    counts = {x: seen.get(x, 0) + _PRIOR_LETTERS * n / whole for x, n in LETTERS.items()}
    return {x: n / sum(counts.values()) for x, n in counts.items()}


def ordinary_symbols(letters: dict[str, float], name: str) -> list[float]:
    """The probability of each symbol of an encoding in an ordinary token."""
    digits, capitals, _ = ORDINARY[name]
    alphabet = ALPHABETS[name]
    own = [capitals * letters[x.lower()] if x.isupper() else (1 - capitals) * letters[x] if x.islower() else 0.0 for x in alphabet]
    own = [x / sum(own) for x in own]
    others = sum(not x.isalpha() for x in alphabet)
    return [(1 - digits) * p if x.isalpha() else digits / others for x, p in zip(alphabet, own, strict=True)]


def _at_least_as_random(code: Column, classes: Column, q: list[float], turning: float) -> Column:
    """The natural logarithm of the battery's combined p-value under "an ordinary token" with the symbol probabilities ``q``."""
    size, middle = len(q), (len(q) - 1) / 2
    s2, s3 = sum(p**2 for p in q), sum(p**3 for p in q)
    uniform = (size * size - 1) / 12
    mean, square = (sum(p * (i - middle) ** k for i, p in enumerate(q)) for k in (1, 2))
    n = F.size(code).cast("double")
    squares = F.aggregate(
        F.sort_array(code),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, v: F.struct(v.alias("last"), F.when(v == a["last"], a["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"), (a["sum"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1).cast("bigint"))).alias("sum")),
        lambda a: a["sum"],
    )
    expected = n + n * (n - 1) * s2
    spread = F.sqrt(4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2)
    even = (expected - squares) / spread

    def neighbours(x: Column) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    share = F.size(F.filter(neighbours(classes), lambda y: y["a"] != y["b"])) / (n - 1)
    # The signed root of the deviance of the changes' share from the ordinary one.
    term = lambda x, y: F.when(x > 0, x * F.log(F.when(x > 0, x).otherwise(F.lit(1.0)) / y)).otherwise(F.lit(0.0))
    runs = let(share, lambda t: F.signum(t - turning) * F.sqrt(2 * (n - 1) * F.greatest(F.lit(0.0), term(t, turning) + term(1 - t, 1 - turning))))
    product = F.aggregate(neighbours(code), F.lit(0.0), lambda acc, y: acc + (y["a"] - middle) * (y["b"] - middle))
    serial = (mean * mean / uniform - product / ((n - 1) * uniform)) * F.sqrt(n - 1) / (square / uniform)
    return F.least(F.lit(0.0), _upper_tail((even + runs + serial) / math.sqrt(3)))


def log_p(token: Column, letters: dict[str, float]) -> Column:
    """The natural logarithm of the chance that an ordinary token of this encoding and length looks at least as random."""
    plain = _plain(token)
    classes = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "")

    def under(own: str) -> Column:
        code = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ALPHABETS[own]), c) - 1)
        q = ordinary_symbols(letters, own)
        return let(F.struct(code.alias("code"), classes.alias("classes")), lambda x: _at_least_as_random(x["code"], x["classes"], q, ORDINARY[own][2]))

    name = encoding(token)
    return F.when(name == "hex", under("hex")).when(name == "HEX", under("HEX")).when(name == "base32", under("base32")).otherwise(under("base64"))


def candidates(text: Column) -> Column:
    """Array of ``start, rank, end, token`` of the long tokens that have a letter."""
    return _spans(text, TOKEN, "random", lambda t: t.rlike("[A-Za-z]") & (F.length(F.rtrim(t, F.lit("="))) >= 16))


def _weighted_bin(log_p: Column, chars: Column, mean_chars: Column) -> Column:
    """The bin of a token's weighted p-value; a higher bin is a smaller p-value.  Rounding is towards larger p-values."""
    return F.least(F.lit(_DEEPEST), F.greatest(F.lit(0), F.floor(-(log_p - F.log(F.least(chars, F.lit(_WEIGHED)) / mean_chars)) * _STEP))).cast("int")


def rejection_bin(tokens: DataFrame, fdr: float = FDR) -> tuple[float, int]:
    """From ``chars, log_p``: the mean length (of tokens up to ``_WEIGHED`` symbols), and the least bin at which tokens are rejected (above all bins if none is)."""
    mean = tokens.agg(F.avg(F.least("chars", F.lit(_WEIGHED)))).first()[0] or 1.0
    bins = tokens.groupBy(_weighted_bin(F.col("log_p"), F.col("chars"), F.lit(mean)).alias("bin")).agg(F.count("*").alias("n")).collect()
    total, above, least = sum(r["n"] for r in bins), 0, _DEEPEST + 1
    for row in sorted(bins, key=lambda r: -r["bin"]):
        above += row["n"]
        if math.exp(-row["bin"] / _STEP) <= above * fdr / total:
            least = row["bin"]
    return mean, least


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(names[s["rank"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    found = base_spans(F.col("_text"))
    rows = cut(given.select("doc_id", *(found[k].alias(f"_{k}") for k in ("assign", "access", "hex")), candidates(F.col("_text")).alias("_tokens")))
    letters = letter_shares(rows.select(F.explode("_tokens.token").alias("token")))
    judged = lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), log_p(t["token"], letters).alias("log_p"))
    rows = cut(rows.withColumn("_tokens", F.transform("_tokens", judged)))
    mean, least = rejection_bin(rows.select(F.explode("_tokens").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("chars"), "t.log_p"), fdr)

    secret = F.filter("_tokens", lambda t: _weighted_bin(t["log_p"], t["end"] - t["start"], F.lit(mean)) >= least)
    random = F.transform(secret, lambda t: t.dropFields("log_p"))
    base = F.concat("_assign", "_access", "_hex")
    return rows.select(
        "doc_id",
        *(F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.size(random).cast("bigint").alias("n_random"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, random)).alias("spans"),
    )
