"""Quality rules per document and per host.

Base rules look at one text.  Host rules then count the base failures of each
host (the ``source`` column, or the domain of a ``url`` by :func:`domain`).  A beta prior is fitted to the hosts' failure rates, each weighted by
its documents up to ``MAX_PRIOR``: its mean is the median rate, its spread comes from the quartiles, so that a few bad hosts do not
hide themselves, and it counts for at most ``MAX_PRIOR`` documents.  A host's posterior shrinks its rate towards the prior.  The host is rejected,
with all its documents, if the lower end of the posterior's one-sided 95 % interval is above what the
prior allows (its mean and three deviations) and above ``MIN_HOST_RATE``: the worst of good hosts stay.

Only DataFrame functions are used.  Texts are not shuffled: the counts of a text
are array expressions in its row.  The host table has one row per host; it is
aggregated map-side first, so a host with a third of all rows is no hot spot.

Defined results: a null or empty text has no words and fails the rule on short
texts; a null host gets no host verdict; repeated rows count as often as they
occur; with one host the prior has that host's rate; an
empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import broadcast_if_small, cut, let

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
MIN_HOST_RATE = 0.25
#: Documents that the prior counts for at most.
MAX_PRIOR = 20.0
#: Parts of the unit interval in which rates are counted, so that a table of bounded size has their distribution.
_RATES = 200
_ONE_SIDED = 1.645
_DEVIATIONS = 3.0


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _covered(starts: Column) -> Column:
    """Words in windows that start at the ascending positions ``starts``."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, s: F.struct((acc["n"] + s + WINDOW - F.greatest(acc["end"], s)).alias("n"), (s + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def _repeated_words(words: Column) -> Column:
    """Words in windows of five that occur at least twice among ``words``.

    Window hashes are sorted first as plain numbers; positions are sorted along
    only where some hash repeats, which is rare.
    """
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def starts(h: Column) -> Column:
        def again(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, j: ((j > 0) & (p[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < last) & (p[F.least(j + 1, last)]["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    def count(h: Column) -> Column:
        some = let(F.sort_array(h), lambda s: F.size(F.filter(s, lambda x, j: (j > 0) & (s[F.greatest(j - 1, F.lit(0))] == x))) > 0)
        return F.when(some, _covered(starts(h))).otherwise(F.lit(0).cast("bigint"))

    return let(hashes, count)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_argloom_q``: a struct of the counts of each text and ``base_failed``."""

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(
            _words(t),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                _repeated_words(w).alias("n_repeat_words"),
            ),
        )

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])
        return q.withField("base_failed", failed)

    # Bound once, the counts are not worked out again for each place where a filter names them.
    return docs.withColumn("_argloom_q", let(let(_text(text_col), counts), judged))


def domain(url: Column) -> Column:
    """The host name of a web address, lower-cased; null if there is none."""
    name = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name)


def fit_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the hosts' rates (``n_docs, n_failed``): the weighted median, and the quartiles' distance."""
    rate = F.least(F.lit(_RATES - 1), F.expr(f"{_RATES} * n_failed div n_docs")).cast("int")
    bins = sorted((r["rate"], r["n"]) for r in hosts.groupBy(rate.alias("rate")).agg(F.sum(F.least(F.lit(int(MAX_PRIOR)), "n_docs")).alias("n")).collect())
    total = sum(n for _, n in bins)

    def quantile(part: int) -> float:
        seen = 0
        for rate, n in bins:
            seen += n
            if 4 * seen >= part * total:
                return (rate + 0.5) / _RATES
        return 0.5 / _RATES

    return quantile(2), (quantile(3) - quantile(1)) / 1.349 + 1 / _RATES


def host_verdicts(rows: DataFrame, min_host_rate: float = MIN_HOST_RATE) -> DataFrame:
    """From ``host, base_failed`` per document: ``host, n_docs, n_failed, shrunk_rate, rejected`` per host."""
    hosts = cut(rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed")))
    mean, spread = fit_prior(hosts)
    weight = min(MAX_PRIOR, max(1.0, mean * (1 - mean) / spread**2 - 1))
    shrunk, n = F.col("shrunk_rate"), F.col("n_docs") + F.lit(weight)
    hosts = hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(weight * mean)) / n)
    lower = shrunk - F.lit(_ONE_SIDED) * F.sqrt(shrunk * (1 - shrunk) / (n + 1))
    return hosts.withColumn("rejected", lower > F.lit(max(min_host_rate, mean + _DEVIATIONS * spread)))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_host_rate: float = MIN_HOST_RATE) -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``host_rate`` (the shrunken one), ``host_rejected`` and ``kept``."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_argloom_text"), F.col(host_col).alias("host"))
    rows = cut(text_counts(given, "_argloom_text").select("doc_id", "host", "_argloom_q.*"))
    hosts = broadcast_if_small(host_verdicts(rows, min_host_rate).select("host", "shrunk_rate", "rejected"))
    rejected = F.coalesce("rejected", F.lit(False))
    return rows.join(hosts, "host", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.round("shrunk_rate", 6).alias("host_rate"),
        rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_host_rate: float = MIN_HOST_RATE) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay as they are.

    The texts are read twice, once for the hosts and once for the verdict, so that they need not be shuffled.
    """
    counted = text_counts(docs, text_col)
    hosts = host_verdicts(counted.select(F.col(host_col).alias("host"), F.col("_argloom_q.base_failed").alias("base_failed")), min_host_rate)
    bad = broadcast_if_small(hosts.filter("rejected").select(F.col("host").alias("_argloom_host")))
    good = counted.filter(~F.col("_argloom_q.base_failed")).drop("_argloom_q")
    return good.join(bad, good[host_col] == bad["_argloom_host"], "left_anti")
