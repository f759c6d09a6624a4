"""Text expressions: parsing of labels, chunk and sentence splits, ids, fingerprints, hash embeddings.  Null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_name(raw: Column) -> Column:
    """The trimmed part after the last colon, camel case as snake case, lower case, blanks and hyphens as underscores."""
    tail = F.element_at(F.split(F.trim(raw), ":"), -1)
    snake = F.regexp_replace(F.regexp_replace(tail, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(snake, "[ -]+", "_"))


# Aliases of node types and statuses, by their names without separators.
NODE_ALIASES = {
    "observationunit": "evidence",
    "empiricalstatement": "claim",
    "theoreticalhypothesis": "hypothesis",
    "coreexpansion": "hypothesis",
    "auxiliary": "hypothesis",
    "coreaxiom": "axiom",
    "coretheory": "axiom",
    "foundation": "axiom",
    "premise": "claim",
    "domain": "paradigm",
    "intendedapplication": "paradigm",
}
RELATION_ALIASES = {
    "rebuts": "attacks",
    "undercuts": "attacks",
    "refutes": "attacks",
    "contradicts": "attacks",
    "entails": "supports",
    "deduces": "supports",
}


def parse_label(raw: Column, known: list[str], aliases: dict[str, str], default: str) -> Column:
    """A known name, else the alias of its letters, else ``default`` (also for null)."""
    name = local_name(raw)
    bare = F.regexp_replace(name, "[-_ ]", "")
    found = F.when(name.isin(*known), name)
    for alias, target in aliases.items():
        found = found.when(bare == alias, target)
    return F.coalesce(found.otherwise(default), F.lit(default))


def default_polarity(relation: Column) -> Column:
    """-1 for attacks, 0 for structural relations, +1 for the rest."""
    structural = relation.isin("specializes", "constrains", "reduces_to") | relation.startswith("has_")
    return F.when(relation == "attacks", -1).when(structural, 0).otherwise(1)


def resolved_polarity(explicit: Column, relation: Column) -> Column:
    """The sign of an explicit non-zero polarity, else the relation's default, else +1."""
    own = F.when(explicit > 0, 1).when(explicit < 0, -1)
    default = default_polarity(relation)
    return F.coalesce(own, F.when(default != 0, default), F.lit(1))


def warrant(relation: Column) -> Column:
    """Warrant strength by the first keyword group that occurs in the relation's name."""
    has = lambda *words: F.lower(relation).rlike("|".join(words))
    return (
        F.when(has("entail", "deduce", "imply", "contradict", "refute", "rebut"), 1.0)
        .when(has("support", "cohere", "attack", "undermine"), 0.75)
        .when(has("undercut", "criticize"), 0.6)
        .when(has("analogy", "exemplif"), 0.4)
        .otherwise(0.75)
    )


def normal_formula(text: Column) -> Column:
    """``\\cdot`` as ``*``, without braces, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\\cdot"), F.lit("*")), "[{}]", ""), "\\s+", " ")))


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def set_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column) -> Column:
    """Sentences: cut at white space after a full stop, exclamation or question mark."""
    return F.split(text, "(?<=[.!?])\\s+")


def paragraphs(text: Column) -> Column:
    return F.split(text, "\\n{2,}")


def sections(text: Column) -> Column:
    """Sections ``title, body`` at headers of level 1 or 2; what stands before the first is the preamble."""
    header = "(?m)^#{1,2}[ \\t]+(.+)$"
    titles = F.concat(F.array(F.lit("Preamble")), F.regexp_extract_all(text, F.lit(header), F.lit(1)))
    bodies = F.split(text, header)
    return F.filter(F.zip_with(titles, bodies, lambda t, b: F.struct(F.trim(t).alias("title"), F.trim(b).alias("body"))), lambda s: (s["title"] != "Preamble") | (F.length(s["body"]) > 0))


def headings_of_html(html: Column) -> Column:
    """HTML with heading tags as Markdown headers and without comments, scripts and tags."""
    text = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<h1[^>]*>", "\n# "), "(?s)<h2[^>]*>", "\n## ")
    text = F.regexp_replace(F.regexp_replace(text, "</h[12]>", "\n"), "<[^>]*>", " ")
    return F.regexp_replace(text, " *\\n *", "\n")


def markdown(text: Column) -> Column:
    """Without comments, with at most one blank line in a row, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", ""), "\\n{3,}", "\n\n"))


def latex(text: Column) -> Column:
    """Without residual commands: an argument in braces stays, bare commands go, blanks are single."""
    text = F.regexp_replace(text, "\\\\[a-zA-Z]+\\*?\\{([^}]*)\\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\\\[a-zA-Z]+\\*?", ""), "[ \\t]+", " "))


def token_estimate(text: Column) -> Column:
    """1.35 tokens a word, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(F.split(F.trim(text), "\\s+")) * 1.35)).cast("bigint")


def typography(text: Column) -> Column:
    """Plain quotes, hyphens for dashes, three dots for an ellipsis, single blanks."""
    plain = F.translate(text, "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), "\\s+", " "))


def stable_id(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.encode(F.concat_ws("::", *parts), "UTF-8"), 256), 1, size)


def name_overlap(a: Column, b: Column) -> Column:
    """1.0 if the shorter name has four letters or more and is part of the longer; else 0.0."""
    x, y = F.lower(a), F.lower(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return F.when((F.length(short) >= 4) & long.contains(short), 1.0).otherwise(0.0)


def hash_embedding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse unit vectors ``id, slot, x``: each token adds a sign to one of 128 slots, both taken from the last byte of its MD5."""
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("token"))
    byte = F.conv(F.right(F.md5(F.encode("token", "UTF-8")), F.lit(2)), 16, 10).cast("int")
    slots = tokens.withColumn("byte", byte).groupBy("id", (F.col("byte") % 128).alias("slot")).agg(F.sum(F.when(F.col("byte") >= 128, 1).otherwise(-1)).alias("x")).filter("x <> 0")
    norm = slots.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return slots.join(norm, "id").select("id", "slot", (F.col("x") / F.col("norm")).alias("x"))


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, slots, counts`` of ``id, tokens``: the signs of a text's tokens, summed by slot.  A token is hashed once a batch."""
    for batch in batches:
        lists = batch.column(1)
        coded = lists.flatten().dictionary_encode()
        byte = np.fromiter((md5(t.encode()).digest()[-1] for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(lists)), np.fromiter((n or 0 for n in lists.value_lengths().to_pylist()), np.int64, len(lists)))
        sums = np.bincount(text * 128 + byte % 128, np.where(byte >= 128, 1, -1), len(lists) * 128).astype(np.int64)
        held = np.flatnonzero(sums)
        offsets = pa.array(np.searchsorted(held, np.arange(len(lists) + 1) * 128), pa.int32())
        some = pa.array(np.diff(offsets.to_numpy()) > 0)
        of = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), of(held % 128, pa.int32()), of(sums[held], pa.int64())], names=["id", "slots", "counts"]).filter(some)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, slots, xs``: the counts of rows that follow each other with one id, summed and scaled to unit length."""
    key, total, kind, ids, slots, xs = None, None, None, [], [], []

    def close() -> None:
        at = np.flatnonzero(total)
        if len(at):
            ids.append(key)
            slots.append(at)
            xs.append(total[at] / np.sqrt((total * total).sum()))

    def out() -> pa.RecordBatch:
        made = [pa.array(ids, kind), pa.array(slots, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))]
        for held in (ids, slots, xs):
            held.clear()
        return pa.RecordBatch.from_arrays(made, names=["id", "slots", "xs"])

    for batch in batches:
        kind = batch.schema.field(0).type
        offsets, at, n = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
        for i, x in enumerate(batch.column(0).to_pylist()):
            if total is None or x != key:
                if total is not None:
                    close()
                key, total = x, np.zeros(128, np.int64)
            part = slice(offsets[i], offsets[i + 1])
            total[at[part]] += n[part]
        if ids:
            yield out()
    if total is not None:
        close()
        if ids:
            yield out()


def sparse_embedding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The vectors of :func:`hash_embedding` as rows ``id, slots, xs``; a text without an id or tokens, or whose signs cancel out, has none.

    Signs are summed where the text is read, so one short row per text is shuffled; texts of one id are one text.
    """
    tokens = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)).alias("tokens"))
    kind = tokens.schema["id"].dataType.simpleString()
    counts = tokens.mapInArrow(_slot_counts, f"id {kind}, slots array<int>, counts array<bigint>")
    return counts.repartition("id").sortWithinPartitions("id").mapInArrow(_unit_rows, f"id {kind}, slots array<int>, xs array<double>")


def dense(sparse: DataFrame, dim: int = 128) -> DataFrame:
    """``id, v`` of sparse rows."""
    at = F.map_from_arrays("slots", "xs")
    return sparse.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("v"))


def redact(props: Column, pattern: str) -> Column:
    """A string map with the values of matching keys hidden."""
    return F.transform_values(props, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit("***")).otherwise(v))


# Names of an epistemic status, without separators.
STATUS_NAMES = {
    "hardcore": "hard_core", "core": "hard_core", "actualmodel": "hard_core",
    "protectivebelt": "protective_belt", "belt": "protective_belt", "auxiliary": "protective_belt",
    "anomaly": "anomalous", "anomalous": "anomalous",
}
# Words that a scope's text holds, in the order in which they count.
SCOPE_WORDS = [
    ("essentieller_allsatz", "ESSENTIELL", "ALLSATZ"), ("lokalisierter_allsatz", "LOKALISIERT", "ALLSATZ"), ("lokalisierter_existenzsatz", "LOKALISIERT", "EXISTENZSATZ"),
    ("statistischer_allsatz", "STATISTISCH", ""), ("statistischer_allsatz", "PROBABILISTISCH", ""), ("existenzsatz", "EXISTENZSATZ", ""),
]


def epistemic_status(raw: Column) -> Column:
    """The status that a name after the last colon stands for, whatever its case and separators; ``neutral`` by default."""
    bare = F.lower(F.regexp_replace(F.element_at(F.split(F.trim(raw), ":"), -1), "[-_ ]", ""))
    out = F.lit("neutral")
    for name, status in STATUS_NAMES.items():
        out = F.when(bare == name, status).otherwise(out)
    return out


def scope_type(raw: Column) -> Column:
    """The scope that a text names; null if it names none."""
    text = F.upper(raw)
    out = None
    for scope, one, two in SCOPE_WORDS:
        holds = text.contains(one) & text.contains(two)
        out = F.when(holds, scope) if out is None else out.when(holds, scope)
    return out
