"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, kept string, bucket int, row string, n long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages, odd characters and one very long text; extra columns clash with names used inside."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = prose(60), prose(120).split()
    texts = [None, "", " \t\n", "One", "one", "a b c", "A  b\tc", "x\x0by", "  　 word", prose(3000), passage, f"{prose(40)} {passage} {prose(30)}", f"{prose(9)} {passage}"]
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        texts.append(" ".join(copy))
    texts += [prose(rng.randrange(1, 150)) for _ in range(60)]
    texts += [texts[20].replace(" ", "\n"), texts[20] + "  ", texts[40], "line one\nline two\nline one\n\n\nline one", "a b c d e " * 30, "#$ | <b> *x* & %"]
    texts += ["token = abcdefghijkl1234 secret:token:zzzzzzzzzzzzzz Api_Key='Ab+/_.=-xyz0123' AKIAABCDEFGHIJKLMN0 AKIASHORT 0123456789abcdef0 é PASSWD=short", "k " + "".join(rng.choice("0123456789abcdef") for _ in range(48))]
    out = [(i, t, f"src{i % 3}" if i % 7 else None, "x", 1, "y", 2) for i, t in enumerate(texts)]
    return out + [out[30], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def brute_components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for k, a in enumerate(ids):
        for b in ids[:k]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, links


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, rows, k, percent):
    from argloom.llm.jaccard_join import jaccard_classes

    unique = {r[0]: r[1] for r in rows}
    grams = {}
    for i, t in unique.items():
        w = words((t or "").translate(LOWER))
        grams[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    component, links = brute_components(grams, percent)
    got = jaccard_classes(docs.dropDuplicates(["doc_id"]), k, percent).collect()
    assert len(got) == len(unique)
    for r in got:
        assert (r.n_shingles, r.component_id, r.n_links) == (len(grams[r.doc_id]), component[r.doc_id], links[r.doc_id]), r


def test_jaccard_join_repeats_and_empty(docs, rows, empty):
    from argloom.llm.jaccard_join import jaccard_classes, keep_one_of_each

    assert jaccard_classes(docs).count() == len(rows)
    assert jaccard_classes(empty).collect() == []
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and 13 in {r.doc_id for r in kept.select("doc_id").collect()}


def test_jaccard_join_repeated_ids(spark):
    """Rows that repeat an id with another text are linked by their texts."""
    from argloom.llm.jaccard_join import jaccard_classes

    rng = random.Random(8)
    word = lambda p: [f"{p}{rng.randrange(500)}" for _ in range(200)]
    one, two = word("a"), word("b")
    near = lambda t: " ".join([*t[:150], "new", *t[151:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (3, near(two)), (None, " ".join(one)), (4, "alone")]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2), (4, 4, 0)]


@pytest.mark.parametrize("members", [300, 5000])
def test_jaccard_join_in_many_blocks(docs, rows, monkeypatch, members):
    from argloom.llm import jaccard_join

    want = sorted(map(tuple, jaccard_join.jaccard_classes(docs, 3, 70).collect()))
    monkeypatch.setattr(jaccard_join, "_BLOCK", members)
    monkeypatch.setattr(jaccard_join, "_FLUSH", 500)
    monkeypatch.setattr(jaccard_join, "_OFTEN", 2)
    monkeypatch.setattr(jaccard_join, "_HEAVY_FROM", 3)
    assert sorted(map(tuple, jaccard_join.jaccard_classes(docs, 3, 70).collect())) == want


def test_runs_of_most_sets_do_not_pair_blocks(spark, monkeypatch):
    """Eight runs are in all sets, one fewer than linked sets of this size have in common, so only the two sets with nine more in common meet."""
    from argloom.llm import jaccard_join

    cuts, write = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: cuts.append(write(df)) or cuts[-1])
    monkeypatch.setattr(jaccard_join, "_BLOCK", 100)
    own = lambda i: [1000 * i + j for j in range(23)]
    sets = [(i, i, 7 * i, 100, [*range(8), *own(i)]) for i in range(1, 41)]
    sets[1] = (2, 2, 14, 100, [*range(8), *own(1)[:9], *own(2)[9:]])
    placed = jaccard_join._placed(spark.createDataFrame(sets, "node long, d1 long, home long, n long, runs array<long>"), 80).collect()
    assert len(placed) == 40
    block = {r["node"]: r["block"] for r in placed}
    assert block[1] != block[2]
    assert {r["node"]: r["others"] for r in placed if r["others"]} == {1: [block[2]], 2: [block[1]]}
    assert cuts[-1].count() <= 18


def test_runs_over_batches():
    """A run of one member may be cut anywhere by the batches."""
    import pyarrow as pa

    from argloom.llm.jaccard_join import _runs

    rng = np.random.default_rng(4)
    size = {d: int(rng.integers(1, 40)) for d in range(9)}
    rows = sorted((int(m), size[d], d) for m, d in zip(rng.integers(0, 12, 90), rng.integers(0, 9, 90).tolist(), strict=True))
    runs = []
    for m, n, d in sorted(set(rows)):
        if runs and runs[-1][-1][0] == m and 85 * n <= 100 * runs[-1][-1][1]:
            runs[-1].append((m, n, d))
        else:
            runs.append([(m, n, d)])
    want = sorted((r[2], run[0][2]) for run in runs if len(run) > 1 for r in run)
    for step in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + step]], pa.int64()) for k in (0, 1, 2)], names=["member", "n", "d1"]) for i in range(0, 90, step)]
        got = [tuple(r.values()) for b in _runs(iter(batches), 85) for r in b.to_pylist()]
        assert sorted((d, rep) for d, _, rep in got) == want and len({run for _, run, _ in got}) == sum(len(run) > 1 for run in runs)


def test_jaccard_blocks_give_the_same_links(monkeypatch):
    from argloom.llm import jaccard_join
    from argloom.llm.jaccard_join import BlockJoin

    rng = np.random.default_rng(1)
    monkeypatch.setattr(jaccard_join, "_EACH", 3)
    base = np.unique(rng.integers(0, 900, 60))
    near = [np.unique(np.concatenate([np.delete(base, rng.integers(0, len(base), 2)), rng.integers(0, 900, 2)])) for _ in range(25)]
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(25)] + near
    sets = [sets[i] for i in rng.permutation(50)]
    want = {(a, b) for a in range(50) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    one = {(max(x, y), min(x, y)) for x, ys in BlockJoin(sets, None, 60).links() for y in ys.tolist()}
    two = {(max(x, y), min(x, y)) for x, ys in BlockJoin(sets[:20], sets[20:], 60).links() for y in ys.tolist()}
    assert one == want
    assert two == {(a, b) for a, b in want if b < 20 <= a}


def test_components(spark):
    from argloom.llm.components import connected_components

    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7), (300, 100), (500, 501)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100, 500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_in_small_forests(spark, monkeypatch):
    from argloom.llm import components

    monkeypatch.setattr(components, "_HELD", 3)
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000, i) for i in range(0, 300, 40)]
    root = {i: i for p in pairs for i in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    assert got == {i: find(i) for i in {i for a, b in pairs if a != b for i in (a, b)}}


def test_secret_scan(docs, rows, empty):
    from argloom.llm.secret_scan import KINDS, scan

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = {r[0]: r[1] or "" for r in rows}
    got = scan(docs).collect()
    assert len(got) == len(rows) and scan(empty).collect() == []
    for r in got:
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == sha(listed)
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in listed.split(",") if s]
    assert max(r.n_assign for r in got) == 2


def planted_tokens(rng):
    """Random keys of four encodings, and ordinary tokens: paths, names, numbered identifiers, dates, run-together words."""
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [(low + up + digits, 32), ("0123456789abcdef", 40), ("0123456789ABCDEF", 40), (up + "234567", 32), (low + up + digits + "+/", 44)]
    secret = [draw(letters, n) for letters, n in kinds for _ in range(30)]
    part = lambda: rng.choice("page user profile settings main java example invoice report module handler config service backup quarterly summary northern".split())
    plain = []
    for i in range(300):
        plain.append([f"path/to/the/{part()}{1000 + i}", f"{part()}_{part()}_{part()}_{i}x", f"src/main/java/{part().title()}{part().title()}{i}", f"{part()}-{part()}-2024-01-{i % 28 + 1:02}", f"{part()}{part()}{part()}{part()}", f"{part()}{part().title()}{part().title()}{i}"][i % 6])
    return secret, [x for x in plain if len(x) >= 16]


def test_secrets_are_found_and_ordinary_tokens_are_not(spark):
    from argloom.llm.secret_scan import scan

    secret, plain = planted_tokens(random.Random(2))
    plain += ["a" * 50_000 + "1", "https/example/com/path/to/the/page1234"]
    df = spark.createDataFrame([(i, f"é see {t} now") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    found = [i for i in got if got[i].n_random]
    right = [i for i in found if i < len(secret)]
    assert len(found) - len(right) <= 0.03 * len(found)
    base32 = [i for i in right if 90 <= i < 120]  # 32 symbols of base32 alone are little evidence
    assert len(right) - len(base32) >= 0.97 * 120 and len(base32) >= 12, (len(right), len(base32), len(found))
    assert f"random:6:{6 + len(secret[0])}" in got[0].spans.split(",")


def test_secret_battery(spark):
    """The three tests and their combination against plain Python."""
    from argloom.llm.secret_scan import ALPHABETS, ORDINARY, encoding, letter_shares, log_p, ordinary_symbols

    secret, plain = planted_tokens(random.Random(4))
    tokens = [*secret[::15], *plain[::20], "abcdefghijklmnop", "ABCDEFGHIJKLMNOP", "0f" * 10, "Zm9vYmFyYmF6cXV1eA=="]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    letters = letter_shares(df)
    assert abs(sum(letters.values()) - 1) < 1e-9
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for r in df.select("token", encoding(F.col("token")).alias("e"), log_p(F.col("token"), letters).alias("p")).collect():
        q, turning, alphabet = ordinary_symbols(letters, r.e), ORDINARY[r.e][2], ALPHABETS[r.e]
        assert abs(sum(q) - 1) < 1e-9
        plain = r.token.rstrip("=").replace("-", "+").replace("_", "/")
        x, n, size = [alphabet.index(c) for c in plain], len(plain), len(alphabet)
        s2, s3 = sum(p * p for p in q), sum(p**3 for p in q)
        sd = math.sqrt(4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2)
        even = (n + n * (n - 1) * s2 - sum(v * v for v in Counter(x).values())) / sd
        kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else c for c in plain]
        t = sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / (n - 1)
        deviance = (t * math.log(t / turning) if t else 0) + ((1 - t) * math.log((1 - t) / (1 - turning)) if t < 1 else 0)
        runs = math.copysign(math.sqrt(2 * (n - 1) * deviance), t - turning)
        mid, var = (size - 1) / 2, (size * size - 1) / 12
        m1, m2 = (sum(p * (i - mid) ** k for i, p in enumerate(q)) for k in (1, 2))
        serial = (m1 * m1 / var - sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False)) / ((n - 1) * var)) * math.sqrt(n - 1) / (m2 / var)
        want = math.log(tail((even + runs + serial) / math.sqrt(3)) or 1e-300)
        assert abs(r.p - want) < 0.05 + 0.03 * abs(want), r


def test_rejection_bin_controls_the_false_discovery_rate(spark):
    """Against the procedure on the tokens themselves."""
    from argloom.llm.secret_scan import _STEP, _weighted_bin, rejection_bin

    rng = random.Random(1)
    rows = [(rng.randrange(16, 60), math.log(rng.random() ** rng.choice([1, 1, 12]))) for _ in range(400)]
    df = spark.createDataFrame(rows, "chars int, log_p double")
    mean, least = rejection_bin(df, 0.05)
    binned = sorted(math.exp(-math.floor(-(p - math.log(n / mean)) * _STEP) / _STEP) if p < math.log(n / mean) else 1.0 for n, p in rows)
    k = max(i for i, p in enumerate(binned, 1) if p <= 0.05 * i / len(rows))
    assert df.filter(_weighted_bin(F.col("log_p"), F.col("chars"), F.lit(mean)) >= least).count() == k
    assert rejection_bin(df.limit(0), 0.05)[0] == 1.0


def test_pfair_mixing(docs, rows, empty, spark):
    from argloom.llm.pfair_mixing import mix, mix_order

    shares = spark.createDataFrame([("src0", 5), ("src1", 3), ("src2", 1), (None, 1)], "source string, shares long")
    order = sorted(mix_order(docs, shares, block_rows=1).collect(), key=lambda r: (r["round"], r.slot))
    assert len(order) == len(rows) and mix_order(empty).collect() == []
    assert len({(r["round"], r.slot) for r in order}) == len(order)
    assert all(r.release <= r.slot < r.deadline for r in order)
    # As long as every source has blocks, each is within less than one block of its target after every slot.
    left = Counter(r.source for r in order)
    seen, target = Counter(), {"src0": 0.5, "src1": 0.3, "src2": 0.1, None: 0.1}
    for t, r in enumerate(order, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - w * t) < 1 for s, w in target.items())
        if seen[r.source] == left[r.source]:
            break
    mixed = mix(docs, shares, block_rows=1)
    assert mixed.columns == docs.columns
    by_id = {}
    for r in order:
        by_id.setdefault(r.doc_id, (r["round"], r.slot))
    places = [min(p for i, p in by_id.items() if i == r.doc_id) for r in mixed.collect()]
    assert len(places) == len(rows) and sorted(places) == places and len(set(places)) > 1


def brute_windows(texts, n):
    first, gone = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        gone[i] = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), (i, p)) != (i, p):
                gone[i][p : p + n] = [True] * n
    return gone


@pytest.mark.parametrize("n", [20, 6])
def test_rlz_dedup(docs, rows, empty, n):
    from argloom.llm.rlz_dedup import parse_against_earlier

    texts = {r[0]: r[1] for r in rows}
    gone = brute_windows(texts, n)
    got = parse_against_earlier(docs, n).collect()
    assert len(got) == len(rows) and parse_against_earlier(empty, n).collect() == []
    for r in got:
        w, cut = words(texts[r.doc_id]), gone[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(w), sum(cut)), r.doc_id
        assert r.kept_text == " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_rlz_small_flushes(docs, rows, monkeypatch):
    from argloom.llm import rlz_dedup

    dealer = rlz_dedup._Dealer(2, False)
    dealer.add(5, 50, np.arange(3), np.array([1, 2, 1], np.uint64))
    dealer.add(4, 40, np.arange(2), np.array([2, 9], np.uint64))
    out = [r for b in dealer.flush() for r in b.to_pylist()]
    local = {(int(np.frombuffer(r["rows"], np.int64)[0]), tuple(rlz_dedup._unsmall(r["pos"]))) for r in out if r["local"]}
    assert local == {(50, (1, 2))}


def test_quality_rules(docs, rows, empty):
    from argloom.llm.quality_rules import keep_good, quality_report

    texts = {r[0]: r[1] or "" for r in rows}
    got = quality_report(docs).collect()
    assert len(got) == len(rows) and quality_report(empty).collect() == []
    for r in got:
        t = texts[r.doc_id]
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_host_verdicts(spark):
    from argloom.llm.quality_rules import keep_good, quality_report

    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad" if i % 20 else good, "spam") for i in range(60)] + [(100 + i, good if i % 10 else "bad", f"h{i % 4}") for i in range(80)] + [(999, "bad", "tiny"), (998, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_report(df).collect()}
    assert not got[20].base_failed and got[20].host_rejected and not got[20].kept
    assert got[101].kept and got[998].kept
    assert {r.doc_id for r in keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def brute_rebalance(now, sizes, shards):
    """Each shard keeps its largest slots up to an equal share; the others go, largest first, to the least loaded shard."""
    share, load, free, out = sum(sizes.values()) / shards, [0] * shards, [], {}
    for s in set(now.values()):
        upto = 0
        for v in sorted((v for v in now if now[v] == s), key=lambda v: (-sizes[v], v)):
            upto += sizes[v]
            if s < shards and upto <= share:
                out[v] = s
                load[s] += sizes[v]
            else:
                free.append(v)
    for v in sorted(free, key=lambda v: (-sizes[v], -v)):
        out[v] = load.index(min(load))
        load[out[v]] += sizes[v]
    return out


def test_virtual_slots(spark, docs, rows, empty):
    from argloom.llm.virtual_slots import rebalance_stored, shard_by_bytes, slot_sizes, stored_map

    placed, path = shard_by_bytes(docs, shards=4, slots=64)
    got = placed.collect()
    assert len(got) == len(rows) and shard_by_bytes(empty, 4, 64)[0].collect() == []
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert (r.size, r.text_crc32, r.map_version) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), 2)
    for s in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    sizes = {v: sum(r.size for r in got if r.vslot == v) for v in range(64)}
    maps = {v: {r.vslot: r.shard for r in stored_map(spark, path, v).collect()} for v in (1, 2)}
    assert maps[1] == {v: v % 4 for v in range(64)} and maps[2] == brute_rebalance(maps[1], sizes, 4)
    assert all(r.shard == maps[2][r.vslot] and r.map_shard == maps[1][r.vslot] for r in got)
    # Shards grow and shrink by further versions of the stored map; the versions before stay as they were.
    measured = slot_sizes(spark, placed, 64)
    for version, shards in ((3, 6), (4, 3)):
        maps[version] = {r.vslot: r.shard for r in rebalance_stored(spark, path, measured, shards).collect()}
        assert maps[version] == brute_rebalance(maps[version - 1], sizes, shards)
    assert {r.vslot: r.shard for r in stored_map(spark, path, 2).collect()} == maps[2]


def test_a_version_of_the_slot_map_has_one_writer(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from argloom.llm.virtual_slots import first_map, save_map, stored_map

    path = str(tmp_path / "map")
    save_map(first_map(spark, 3, 16), path)
    with pytest.raises(AnalysisException):
        save_map(first_map(spark, 5, 16), path)
    assert stored_map(spark, path).filter("shard >= 3").count() == 0
    first_map(spark, 3, 16).drop("version").write.mode("append").parquet(f"{path}/version={stored_map(spark, path).first().version}")
    with pytest.raises(ValueError):
        stored_map(spark, path)


def test_equal_texts_spread_over_the_shards(spark):
    from argloom.llm.virtual_slots import shard_by_bytes

    copies = spark.range(600).selectExpr("id AS doc_id", "'the same text' AS text")
    shards = shard_by_bytes(copies, 4, 64)[0].groupBy("shard").count().collect()
    assert len(shards) == 4 and max(r["count"] for r in shards) < 300


def test_virtual_slots_are_near_equal(spark):
    from argloom.llm.virtual_slots import shard_by_bytes

    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(90))).cast("int")).alias("text"))
    load = [r.b for r in shard_by_bytes(df)[0].groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 24 and max(load) - min(load) < 0.02 * sum(load) / 24


def test_chat_format(spark):
    from argloom.llm.chat_format import conversation_digests, escape, expand, unescape

    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "<|end|><|turn|>", "[\\INST]", "", None, "a\nb", "é😀 <|text|>", "<<|end|>", "<\\|end|>"]
    back = spark.createDataFrame([(t or "",) for t in nasty], "t string").select("t", unescape(escape(F.col("t"))).alias("u"), escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u and "<|end|>" not in r.e and "</s>" not in r.e and "[INST]" not in r.e for r in back)
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "system", "s"), (2, 1, "user", "u"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in conversation_digests(expand(df)).collect()}
    for c in (1, 2, 3, 4):
        own = [(t[2] or "", t[3] or "") for t in turns if t[0] == c]
        loss = "".join(t for role, t in own if role == "assistant")
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in own))
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), sha(loss))
    examples = [r for r in expand(df).collect() if r.conv_id == 1]
    assert len(examples) == 5 and all(r.formatted.startswith(examples[0].formatted[:20]) for r in examples)
    assert expand(df.limit(0)).collect() == []


def test_exact_dedup(docs, rows, empty):
    from argloom.llm.cuckoo_dedup import drop_exact_copies, exact_groups

    unique = {r[0]: r[1] or "" for r in rows}
    groups = {}
    for i, t in unique.items():
        groups.setdefault("".join(words(t)), []).append(i)
    count = Counter("".join(words(r[1])) for r in rows)
    got = exact_groups(docs).collect()
    assert len(got) == len(rows) and exact_groups(empty).collect() == []
    for r in got:
        key = "".join(words(unique[r.doc_id]))
        keep = min(groups[key], key=lambda i: (-len(unique[i]), i))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, count[key], keep == r.doc_id, sha(key)), r
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.keep_id for r in got}


def test_cuckoo_index(spark):
    from argloom.llm.cuckoo_dedup import CuckooIndex, build_index, digests, update_index

    index = CuckooIndex(16)
    rng = random.Random(3)
    raw = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    keys = lambda ids: np.array([raw[i] for i in ids], "S32")
    live = {}
    for step in range(60):  # against a dictionary
        ids = [rng.randrange(5000) for _ in range(rng.randrange(1, 700))]
        if step % 4 == 3:
            assert index.delete(keys(ids)) == len(set(ids) & set(live))
            for i in ids:
                live.pop(i, None)
            continue
        rows = [(1, rng.randrange(3), rng.randrange(50), rng.randrange(4)) for _ in ids]
        fresh = len(set(ids) - set(live))
        assert int(index.insert(keys(ids), np.array(rows, np.int64)).sum()) == fresh
        for i, r in zip(ids, rows, strict=True):
            live.setdefault(i, []).append(r)
    want = sorted((raw[i].rstrip(b"\0"), len(rs), *min(((c, d, h) for _, c, d, h in rs), key=lambda x: (-x[0], x[1], x[2]))) for i, rs in live.items())
    assert [(k, *v) for k, v in zip(index.keys.tolist(), index.values.tolist(), strict=True)] == want
    assert index.resizes > 0 and index.might_hold(index.keys).all() and np.count_nonzero(index.table) == len(live)
    gone = keys([i for i in range(5000) if i not in live])
    assert np.count_nonzero(index.might_hold(gone)) < 0.01 * len(gone) + 5  # so the content is hardly looked at for what is new
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    live = build_index(digests(df), 2)
    retired = live.filter("group_size = 2").select("digest")
    after = update_index(live, None, retired, 2).collect()
    assert [r.keep_id for r in after] == [3]
    back = update_index(live, build_index(digests(df.filter("doc_id = 1")), 2), retired, 2).collect()
    assert sorted((r.keep_id, r.group_size) for r in back) == [(1, 1), (3, 1)]


def test_exact_dedup_repeated_ids(spark):
    """Of rows that repeat an id with equal texts, one stays; a row of another text with the same id is not touched."""
    from argloom.llm.cuckoo_dedup import drop_exact_copies, exact_groups

    df = spark.createDataFrame([(1, "a b"), (1, "ab "), (1, "other"), (2, "a  b"), (2, "a  b"), (None, "ab")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in exact_groups(df).collect() if r.kept) == [(1, 1, 1), (2, 2, 5), (2, 2, 5)]
    assert sorted(map(tuple, drop_exact_copies(df).collect())) == [(1, "other"), (2, "a  b"), (2, "a  b")]


def test_gru_lm(docs, rows, empty):
    from argloom.llm import gru_lm

    got = gru_lm.score(docs, rounds=3).collect()
    assert len(got) == len(rows) and gru_lm.score(empty).collect() == []
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r[0], [*words((r[1] or "").translate(LOWER)), "\n"]) for r in rows]
    c = Counter(t for i, ts in tokens if not out(i) for t in ts)
    n, v = sum(c.values()), len(c)
    by_id = dict(tokens)
    for r in got:
        ts = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r.base_score - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) < 1e-6
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gru_learns_from_every_document(spark):
    from argloom.llm import gru_lm

    start = gru_lm.new_model([(int(gru_lm.END), 4), (11, 3), (12, 2)], 40)
    docs = [(i, "some words of one document") for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:8]
    for row in docs:
        learned = gru_lm.train(spark.createDataFrame([row], "doc_id bigint, text string"), start)
        assert not np.array_equal(learned.flat(), start.flat()), row


def test_gru_defaults_beat_the_base_on_held_out_documents(spark):
    from argloom.llm import gru_lm

    got = gru_lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_gru_probabilities_and_lanes():
    from argloom.llm import gru_lm

    m = gru_lm.new_model([(int(gru_lm.END), 40), *((100 + i, 50 - i) for i in range(30))], 2000)
    rng = np.random.default_rng(0)
    state = rng.standard_normal((1, gru_lm.UNITS)).astype(np.float32)
    size = len(m.words)
    assert abs(np.exp(gru_lm.log_probs(m, np.repeat(state, size, 0), np.arange(size))).sum() - 1) < 1e-4
    lens = [700, 1, 3, 90, 33, 32, 31]
    ids = rng.integers(0, 30, sum(lens)).astype(np.int32)
    at = np.append(0, np.cumsum(lens))
    whole = gru_lm.score_documents(m, ids, at)
    for d in range(len(lens)):  # one document alone, step by step
        h, total, last = np.zeros((gru_lm.UNITS, 1), np.float32), 0.0, m.end
        for t in ids[at[d] : at[d + 1]]:
            h = gru_lm._step(m, m.gates[[last]].T, h)[0]
            total += gru_lm.log_probs(m, h.T, np.array([t]))[0]
            last = t
        assert abs(whole[d] - total) < 1e-2 + 1e-4 * abs(total)


def test_gru_gradients(monkeypatch):
    """Each parameter's step is the slope of the loss, against differences; the carried state is held fixed."""
    from argloom.llm import gru_lm

    monkeypatch.setattr(gru_lm, "TRAIN_LANES", 3)
    m = gru_lm.new_model([(int(gru_lm.END), 40), *((100 + i, 50 - i) for i in range(60))], 2000)
    rng = np.random.default_rng(3)
    ids, at = rng.integers(0, 60, gru_lm.TRAIN_WINDOW * 3).astype(np.int32), np.arange(4) * gru_lm.TRAIN_WINDOW
    ids[at[1:] - 1] = m.end
    slopes = {}

    class Seen(gru_lm.Trainer):
        def _apply(self, name, grad, at=slice(None)):
            whole = np.zeros_like(getattr(self.m, name))
            whole[at] += grad
            slopes[name] = whole

    Seen(m).fit(ids, at)
    for name in gru_lm.Model.NAMES:
        x = getattr(m, name)
        for _ in range(4):
            i = np.unravel_index(np.argmax(np.abs(slopes[name] * rng.random(x.shape))), x.shape)
            kept, losses = x[i], []
            for step in (0.02, -0.02):
                x[i] = kept + step
                losses.append(-gru_lm.score_documents(m, ids, at).sum() / 3)
            x[i] = kept
            assert abs((losses[0] - losses[1]) / 0.04 - slopes[name][i]) < 2e-3 + 0.02 * abs(slopes[name][i]), name


def test_gru_does_not_depend_on_partitions(spark, docs):
    from argloom.llm import gru_lm

    one = {r.doc_id: r.score for r in gru_lm.score(docs.repartition(7)).collect()}
    two = {r.doc_id: r.score for r in gru_lm.score(docs.repartition(2)).collect()}
    assert all(abs(one[i] - two[i]) < 1e-3 + 1e-5 * abs(one[i]) for i in one)


def test_gru_without_training_documents(spark):
    from argloom.llm import gru_lm

    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = gru_lm.score(spark.createDataFrame([(out, "some words")], "doc_id bigint, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    from argloom.llm.bpe import codec, decode, encode, token_digests

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = codec(path, public_tokenizers.PATTERN)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = token_digests(docs, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows) and token_digests(empty, path, public_tokenizers.PATTERN).collect() == []
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = np.array(real.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(texts[r.doc_id]))
    apart = decode(encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert apart.columns == [*docs.columns, "ids", "decoded"] and all(bytes(r.decoded).decode() == texts[r.doc_id] for r in apart.collect())


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1000 + "b" * 700, "\x1c\x85  x", "it's 12345 they'LL", "\U0001f600️ é", "x" * 513, " " * 2000])
def test_byte_bpe_odd_pieces(text):
    import tiktoken

    from argloom.llm.bpe import codec

    own = codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    packed = own.encode_texts([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == real.encode_ordinary(text) and own.decode(packed) == text.encode()


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "sf")
    docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "source").write.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in rows}

    def good(t):
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    left = {i: t for i, t in texts.items() if good(t)}
    groups = {}
    for i, t in left.items():
        groups.setdefault("".join(words(t)), []).append(i)
    left = {k: left[k] for k in (min(g, key=lambda i: (-len(left[i]), i)) for g in groups.values())}
    grams = {i: {tuple(words(t.translate(LOWER))[j : j + 5]) for j in range(len(words(t)) - 4)} for i, t in left.items()}
    component, _ = brute_components(grams, 80)
    want = {i for i, c in component.items() if c == i}
    made = corpus_pipeline.run(spark, path)
    # Each stage was written once; what is left to do does not go back to the documents.
    assert "parquet" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = made.collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) for r in got)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_an_empty_table_and_nulls(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, None), (2, None, "a"), (None, text + " more", "a"), (3, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()} == {1, None}
