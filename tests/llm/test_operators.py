"""The ten operators against brute force, and on the cases that every table may hold."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsift.llm import attribution, bpe, components, dedup, licenses, linededup, packing, secrets, simhash, toxicity, vafile

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "ab " * 30_000 + "password = abcdefghijkl cc by " + "x" * 5_000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "The quick brown fox jumps over it"), (5, "The quick brown fox jumps over it"), (6, LONG), (7, LONG),
    (8, "tOKEN: 'abcdefghijkl' AKIAABCDEFGHIJKLMN 0123456789abcdef"), (8, "tOKEN: 'abcdefghijkl' AKIAABCDEFGHIJKLMN 0123456789abcdef"), (None, "no id here at all"),
    (9, "CC by all rights Reserved general\npublic license"), (10, "é<|endoftext|>İ ǅ 中文 '!!'s don't x1y2 ½"), (11, None), (12, "line one of five words\nline two of five words 7"), (13, "line two of five words 8"),
]
SCHEMA = "doc_id long, text string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "k", 0, "n") for i, t in ODD]
    return spark.createDataFrame(rows, f"{SCHEMA}, name string, at int, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        simhash.near_components(empty), linededup.drop_recurring(empty), secrets.secrets(empty), attribution.section_tokens(empty, BYTE, public_tokenizers.PATTERN), toxicity.toxicity(empty, labels),
        licenses.licenses(empty), bpe.token_digests(empty, WORD), packing.packed(empty, WORD), dedup.exact_duplicates(empty), vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.collect() == []


# 1 SimHash


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if near(a, b):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {n: top(n) for n in nodes}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 1023), min_size=1, max_size=80), st.integers(0, 4), st.integers(1, 64))
def test_forest_is_all_links(found, radius, size):
    prints = sorted(x | x << 40 for x in found)
    near = lambda a, b: (a ^ b).bit_count() <= radius
    links = simhash.forest(prints, radius, size)
    assert all(near(prints[i], prints[j]) for i, j in links)
    linked = {frozenset((prints[i], prints[j])) for i, j in links}
    assert brute_components(prints, near) == brute_components(prints, lambda a, b: frozenset((a, b)) in linked)
    assert len(links) == len(prints) - len(set(brute_components(prints, near).values()))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    digests = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(d >> bit & 1 for d in digests) > len(digests))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbB zÉé\x1c\x85\xa0\t\n\x0b中", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_and_components(odd):
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint("\x0b") == 0 == simhash.fingerprint(None)
    got = simhash.near_components(odd).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{brute_fingerprint(t):016x}") for i, t in ODD)
    least = {}
    for i, t in ODD:
        f = brute_fingerprint(t)
        least[f] = min(least.get(f, 10**9), i if i is not None else 10**9)
    root = brute_components(list(least), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(list)
    for f, r in root.items():
        groups[r].append(least[f])
    for r in got:
        want = min(groups[root[int(r.fingerprint, 16)]])
        assert r.component_id == (None if want == 10**9 else want)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(rows_of(components.connected(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# 2 line deduplication


def brute_lines(docs):
    def masked(line):
        return ["<*>" if re.search("[0-9@]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r"))]

    def bands(t):
        return [tuple(t[len(t) * k // 8 : len(t) * (k + 1) // 8]) for k in range(8)]

    def place(i, t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return -(2**63) if i is None else i, h - (h >> 63 << 64)

    where = defaultdict(set)  # documents of a masked line
    for i, t in docs:
        for line in (t or "").split("\n"):
            m = tuple(masked(line))
            if set("".join(m).replace("<*>", "")) and (len(m) >= 5 or len(" ".join(m)) >= 32 or any(c.isalpha() for c in "".join(m))):
                where[m].add(place(i, t))
    first = defaultdict(list)
    for m, at in where.items():
        if len(at) >= (2 if len(m) >= 5 or len(" ".join(m)) >= 32 else 10):
            first[m].append(min(at))
    leaves = defaultdict(list)  # the tree: token count, leading token
    for m in where:
        if len(m) >= 8:
            leaves[len(m), m[0]].append(m)
    for leaf in leaves.values():
        for a, c in combinations(range(1, 8), 2):
            alike = defaultdict(list)
            for m in leaf:
                b = bands(m)
                if len(m) - len(b[a]) - len(b[c]) - " ".join(m).count("<*>") >= 5:
                    alike[tuple(x for k, x in enumerate(b) if k not in (a, c))].append(m)
            for group in alike.values():
                at = set().union(*(where[m] for m in group))
                if len(group) >= 3 and len(at) > 1:
                    for m in group:
                        first[m].append(min(at))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (f := first.get(tuple(masked(x)))) or place(i, t) <= min(f)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def test_line_dedup(spark, odd):
    assert rows_of(linededup.drop_recurring(odd)) == brute_lines(ODD)
    docs = [(i, "\n".join(f"user {i * k} of host a@b.c logged  in\tnow" if k % 3 else f"unique words {'abcdefgh'[i]} in this line {'xyz'[k % 3]}" for k in range(6))) for i in range(8)]
    assert rows_of(linededup.drop_recurring(spark.createDataFrame(docs, SCHEMA))) == brute_lines(docs)


def test_words_that_vary_are_generalised(spark):
    who, host = ["alice", "bob", "carol", "dave"], ["mars", "venus", "pluto", "saturn"]
    docs = [(i, f"user {w} logged in from host {h} today\nsome {w} own words of number {h} and {w} only") for i, (w, h) in enumerate(zip(who, host))]
    got = linededup.drop_recurring(spark.createDataFrame(docs, SCHEMA)).sort("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1, 1] and got[3].text == "some dave own words of number saturn and dave only"
    assert rows_of(linededup.drop_recurring(spark.createDataFrame(docs, SCHEMA))) == brute_lines(docs)


def test_lines_by_the_tree(spark):
    rng = np.random.default_rng(11)
    said = ["the job", "started on", "node", "alpha", "beta", "gamma", "with status", "ok", "failed", "after", "12 tries", "x@y", "Zeile", "中文", "}"]
    docs = [(int(i), "\n".join(" ".join(["the job", "started on", "node", str(rng.choice(said)), "with status", str(rng.choice(said)), *rng.choice(said, int(rng.integers(0, 4)))]) for _ in range(6))) for i in range(12)]
    docs += [(i, "All rights reserved.\n}\nLes.") for i in range(100, 109)] + [(109, "Les.\n}"), (None, "one null id and this line here"), (None, "another\none null id and this line here"), (7, "All rights reserved."), (7, "x\none null id and this line here")]
    docs += [(200 + i, "这是一行没有空格的文字而且它在几个文件里出现所以应当被去掉只留下第一次") for i in range(2)] + [(300, docs[0][1])] * 2
    got = rows_of(linededup.drop_recurring(spark.createDataFrame(docs, SCHEMA).repartition(4)))
    assert got == brute_lines(docs) and sum(r[3] for r in got) > 20


def test_lines_are_masked_in_linear_time(spark):
    text = "a" + " " * 400_000 + "b\n" + "a1" * 200_000 + "\n" + "\t \r" * 200_000 + "x"
    began = time.time()
    got = linededup.drop_recurring(spark.createDataFrame([(1, text), (2, text)], SCHEMA)).sort("doc_id").collect()
    assert got[0].text == text and [r.n_lines for r in got] == [3, 3] and time.time() - began < 60


# 3 secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "apikey", "PASSWD", "ſecret", "api_Key", ":", "=", " ", '"', "'", "abcdef", "0123456789", "AKIA", "ABCDEFGHIJKL", "é", "ghp_" + "a" * 36]), max_size=14).map("".join))
def test_base_spans(text):
    base = [f"{k}:{s}:{e}" for s, e, k in secrets.find(text, (1,))]
    assert base == brute_base(text)
    assert [x for x in (f"{k}:{s}:{e}" for s, e, k in secrets.find(text)) if x.split(":")[0] in secrets.BASE] == base


def test_secrets_and_ledger(spark, odd):
    got = secrets.secrets(odd).collect()
    want = Counter((i, hashlib.sha256(",".join(brute_base(t or "")).encode()).hexdigest()) for i, t in ODD)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    kinds = lambda t: Counter(x.split(":")[0] for x in brute_base(t or ""))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got) == Counter((i, *(kinds(t)[k] for k in ("assign", "access", "hex"))) for i, t in ODD)
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh-_"
    said = spark.createDataFrame([(1, f"é token={jwt} {jwt}\nghp_{'a' * 36}"), (2, None)], SCHEMA)
    assert {r.doc_id: r.spans for r in secrets.secrets(said).collect()} == {1: f"assign:2:{8 + len(jwt)},jwt:8:{8 + len(jwt)},jwt:{9 + len(jwt)}:{9 + 2 * len(jwt)},forge:{10 + 2 * len(jwt)}:{50 + 2 * len(jwt)},hex:{14 + 2 * len(jwt)}:{50 + 2 * len(jwt)}", 2: ""}
    texts = {t or "" for _, t in ODD}
    assert sorted(r.text for r in secrets.pending(odd).collect()) == sorted(texts)  # each text is scanned once
    ledger = secrets.update_ledger(odd)
    assert ledger.count() == len(texts) * len(secrets.RULES) == ledger.select("blob", "version").distinct().count()
    assert secrets.update_ledger(odd, ledger).count() == 0
    more = spark.createDataFrame([(1, "new token=abcdefghijkl"), (2, ""), (None, "n"), (None, "n")], SCHEMA)
    assert secrets.pending(more, ledger).count() == 2
    found, whole = secrets.scan(more, ledger)
    assert rows_of(found) == rows_of(secrets.scan(more)[0]) and secrets.pending(odd.select("doc_id", "text").union(more), whole).count() == 0
    assert rows_of(secrets.secrets(more, ledger)) == rows_of(secrets.secrets(more))
    old = ledger.where("version = 1")  # a new rule version is scanned alone
    assert {r.version for r in secrets.update_ledger(odd, old).collect()} == {2}


def test_copies_without_an_id_are_one_blob(spark):
    df = spark.createDataFrame([(None, "token=abcdefghijkl")] * 50, SCHEMA).repartition(5)
    assert secrets.pending(df).count() == 1 and [r.n_assign for r in secrets.secrets(df).collect()] == [1] * 50


PLANTED = [
    ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh-_", 0), ("forge", "ghp_" + "aB1" * 12, 0), ("forge", "glpat-" + "x-" * 10, 0), ("chat", "xoxb-12345-abcDE", 0), ("access", "AKIA" + "Z" * 14, 0),
    ("assign", "password: 'abcdefghijkl", 0), ("hex", "0123456789abcdef", 0), (None, "eyJhbG.eyJ.x", 0), (None, "ghp_short", 0), (None, "a word", 0), (None, "xeyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh", 0),
]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PLANTED), max_size=8))
def test_spans_of_all_kinds(parts):
    text, want = "é", []
    for kind, said, _ in parts:
        text += " "
        if kind:
            want.append((len(text), len(text) + len(said), kind))
        text += said
    assert secrets.find(text) == want  # no two start at one place


@pytest.mark.parametrize("text", ["eyJ" * 400_000, "eyJaaaaaaaa." * 80_000, "-----BEGIN " * 90_000, "-----BEGIN " + "A" * 1_000_000, "token" * 200_000 + " " * 100_000, "ghp_" * 200_000, "xoxb-" * 200_000, "AKIA" * 250_000])
def test_scans_are_linear(text):
    began = time.process_time()
    secrets.find(text)
    assert time.process_time() - began < 3


def test_redact(spark, odd):
    rows = odd.select("*", F.lit("b").alias("blob"), F.lit("s").alias("Spans"), F.lit(1).alias("__spans"), F.lit(2).alias("__blob"))
    out = secrets.redact(rows)
    assert out.columns == rows.columns and out.count() == len(ODD) and out.where("blob = 'b' and spans = 's' and __spans = 1 and __blob = 2").count() == len(ODD)
    texts = [r.text for r in out.collect()]
    assert None in texts and "[SECRET]' [SECRET] [SECRET]" in texts and not any(brute_base(t or "") for t in texts)


def test_whole_private_keys():
    for kind, head in (("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n"), ("PGP PRIVATE KEY BLOCK", "Version: a-b\n\n"), ("PRIVATE KEY", "")):
        key = f"-----BEGIN {kind}-----\n{head}MIIabc/+=\nxyz--\n-----END {kind}-----"
        spans = [(s, e) for s, e, k in secrets.find(f"before\n{key}\nafter - all\n{key}") if k == "pem"]
        assert spans == [(7, 7 + len(key)), (7 + len(key) + 13, 7 + 2 * len(key) + 13)]
    cut = "-----BEGIN RSA PRIVATE KEY-----\nDEK-Info: x-y\nabc\n"
    assert [x[:2] for x in secrets.find(cut + "-----BEGIN RSA PRIVATE KEY-----\nabc")] == [(0, len(cut)), (len(cut), len(cut) + 35)]


# 4 exact top-k


@pytest.mark.parametrize("big", [0, 3, 1000, 1 << 40, (1 << 63) - 1])
def test_bounds_hold(big):
    rng = np.random.default_rng(big % 1000)
    for _ in range(20):
        n, d = rng.integers(1, 300), rng.integers(1, 8)
        v, q = (rng.integers(-big, big, (m, d), endpoint=True) for m in (n, 5))
        cells, low, width = vafile.approximate(v)
        assert all(int(low[j]) + int(c) * int(width[j]) <= int(v[i, j]) < int(low[j]) + (int(c) + 1) * int(width[j]) for (i, j), c in np.ndenumerate(cells))
        upper, gap = vafile.bounds(q, cells, low, width)
        for i in range(5):
            for p in range(n):
                said = sum(int(a) * int(b) for a, b in zip(q[i], v[p]))
                assert upper[i, p] - gap[i] <= said <= upper[i, p]
                assert vafile.scores(q[i : i + 1], v[p : p + 1]).tolist() == [min(2**63 - 1, max(-(2**63), said))]


def brute_top(vectors, k=10):
    cut = lambda x: min(2**63 - 1, max(-(2**63), x))
    ints = [(i, [cut(int(np.floor(1024 * x))) for x in v]) for i, v in vectors]
    want = []
    for q in sorted({i for i, _ in ints if i % 100 == 0}):
        asked = {tuple(v) for i, v in ints if i == q}
        ranked = sorted((-cut(sum(a * b for a, b in zip(s, v))), i) for s in asked for i, v in ints if i != q)[:k]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(ranked, 1)]
    return sorted(want, key=repr)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(250)] + [(300, [0.1] * 6), (301, [0.1] * 6)]
    bad = [(400, None), (500, [1.0, None] + [0.0] * 4), (600, [float("nan")] * 6), (700, [float("inf")] * 6), (None, [1.0] * 6)]
    schema = "vec_id long, embedding array<double>, score int, row int, v string"
    df = spark.createDataFrame([(*v, 1, 2, "v") for v in vectors + bad], schema)
    assert rows_of(vafile.top_k(df)) == brute_top(vectors)
    for name, n in (("BLOCK_VECTORS", 40), ("BLOCK_QUERIES", 2), ("FIRST", 1)):
        monkeypatch.setattr(vafile, name, n)
    # a very common vector, rows repeated under one id, equal and unlike queries of one id, and components beyond a long
    hot = [(i, [3.0, 1.0, 0.0, 0.0, 0.0, 0.5]) for i in range(400, 700)] + [(5000, [3.0] * 6)] * 30 + [(5001, [3.0] * 6)] * 2 + [(100, [1.0] * 6), (100, [1.0] * 6), (100, [-1.0] * 6)]
    huge = [(800, [1e17] * 6), (801, [1e17] * 6), (802, [-1e17] * 6), (803, [1e15, 0.0, 0.0, 0.0, 0.0, -1e15]), (900, [1e15] * 6), (901, [1e300] * 6), (1000, [-1e17] * 5 + [3.0])]
    for more in (hot, huge, hot + huge):
        df = spark.createDataFrame([(*v, 1, 2, "v") for v in vectors + more], schema).repartition(5)
        assert rows_of(vafile.top_k(df)) == brute_top(vectors + more)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert rows_of(vafile.top_k(few)) == [(0, 1, 1, 1024 * 2048)]
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0]), (2, []), (3, [0.0, 1.0, 5.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vafile.top_k(uneven).sort("rank").collect()] == [(1, 1024 * 2048), (3, 2048 * 1024), (2, 0)]
    assert vafile.top_k(few.where("vec_id = 1")).collect() == []


# 5 token counts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.é中", max_size=80))
def test_attribution(text):
    b = attribution.vocabulary(BYTE, public_tokenizers.PATTERN)
    raw = text.encode()
    starts = attribution.lines(raw)
    tokens, crossing = attribution.attribute(b.spans(text), starts, len(raw))
    counts, over, at = Counter(), Counter(), 0
    for t in b.encoding.encode_ordinary(text):
        size = len(b.encoding.decode_single_token_bytes(t))
        section = raw[:at].count(b"\n")
        counts[section] += 1
        over[section] += b"\n" in raw[at : at + size - 1]
        at += size
    assert at == len(raw) and list(tokens) == [counts[i] for i in range(len(starts))] and list(crossing) == [over[i] for i in range(len(starts))]


def brute_sections(i, text):
    b = attribution.vocabulary(BYTE, public_tokenizers.PATTERN).encoding
    starts, at, raw = Counter(), 0, (text or "").encode()
    crossing, lines = Counter(), [x for x in re.split(rb"(?<=\n)", raw) if x] or [b""]
    ends = np.cumsum([len(x) for x in lines]).tolist()
    for t in b.encode_ordinary(text or ""):
        k = next(k for k, e in enumerate(ends) if at < e)
        starts[k] += 1
        at += len(b.decode_single_token_bytes(t))
        crossing[k] += at > ends[k]
    return [(i, k, e - len(x), len(x), starts[k], crossing[k]) for k, (x, e) in enumerate(zip(lines, ends))]


def test_section_rows(odd):
    rows = rows_of(attribution.section_tokens(odd, BYTE, public_tokenizers.PATTERN))
    assert rows == sorted((r for i, t in ODD for r in brute_sections(i, t)), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a1. \n\t\r\x1c\x85\xa0\u2003\u3000é", max_size=40))
def test_runs_apart_are_the_librarys(text):
    b = attribution.vocabulary(BYTE, public_tokenizers.PATTERN)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(attribution, "LONG_RUN", 0)
        m.setattr(attribution, "_RUN", re.compile(f"[{attribution._SPACES}]{{2,}}+"))
        assert b.ids(text) == b.encoding.encode_ordinary(text)


def test_megabytes_of_white_space(spark):
    texts = [" " * 1_200_000, "a" + " \t" * 600_000 + "b\n", "x" + "\n " * 600_000 + " y", "a" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r for r in attribution.section_tokens(df, BYTE, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")).collect()}
    assert [got[i].n for i in range(4)] == list(map(len, texts)) and [got[i].rows for i in range(4)] == [1, 1, 600_001, 1] and all(r.tokens for r in got.values())


# 6 toxicity


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(3)
    common, rude = [f"{a}{b}{c}" for a in ("ba", "to", "mi", "su") for b in ("ren", "lat", "vo") for c in ("a", "er", "ing")], ["grolk", "snarfle", "blitzug"]
    docs, labels = [], []
    for i in range(900):
        said = list(rng.choice(common, size=int(rng.integers(20, 120))))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(3, len(said) // 20)):
                said.insert(int(rng.integers(0, len(said))), str(rng.choice(rude)))
        docs.append((i, " ".join(said)))
        if i < 800:
            labels.append((i, toxic))
    docs += [(1000, None), (1001, ""), (1002, "!!! 123"), (1003, "ba" * 3000), (0, docs[0][1])]
    d, l = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(d, l).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert not any(r.predicted for r in rows if r.doc_id in (1000, 1001, 1002))
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id long, toxic int")
    again = {(r.doc_id, r.score) for r in toxicity.toxicity(d, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}  # held-out labels are never read


def test_sequences_agree(spark):
    found = [b"caf\xc3\xa9", b"a", b"abcdefghijkl", b"x" * 64, b"ab" * 32 + b"c", "é中".encode() * 500, b"q" * 70]
    parts = [(x, i + 1) for i, w in enumerate(found) for x in toxicity.stretches(w)]
    assert max(len(x) for x, _ in parts) <= toxicity.STRETCH + toxicity.ORDER
    df = spark.createDataFrame([(0, x, n) for x, n in parts], "kind int, word string, n long")
    want = Counter()
    for i, w in enumerate(found):
        for s in toxicity.sequences(w):
            want[s] += i + 1
    assert {r.s: r.n for r in toxicity.sequence_rows(df).collect()} == want


class BruteModel:
    """Kneser-Ney by its definition, from all texts and from (text, label) pairs."""

    def __init__(self, texts, pairs, order):
        self.order, self.counts = order, [Counter(), Counter()]
        grams = {g for t in texts for g in self.grams(t)}
        closed = {g[i:] for g in grams for i in range(len(g))}
        self.before = Counter(g[1:] for g in closed if len(g) > 1)  # how many letters each sequence follows
        for t, label in pairs:
            self.counts[label].update(self.grams(t))

    def grams(self, text):
        out = []
        for w in re.findall("[a-zA-Z\x80-\U0010ffff]+", text or ""):
            s = f"^{w.lower()}$"
            out += [s[max(0, i + 1 - self.order) : i + 1] for i in range(1, len(s))]
        return out

    def shared(self, s):
        if not s:
            return 1 / 256
        like = [n for g, n in self.before.items() if len(g) == len(s) and g[:-1] == s[:-1]]
        return (max(self.before[s] - 0.75, 0) + 0.75 * len(like) * self.shared(s[1:])) / sum(like)

    def ratio(self, s):
        said = []
        for c in self.counts:
            like = [n for g, n in c.items() if g[:-1] == s[:-1]]
            back = 5.0 + 0.75 * len(like)
            # a letter that neither class has seen there: the back-off itself cancels out
            p = self.shared(s[1:]) if self.counts[0][s] + self.counts[1][s] else 1.0
            said.append((max(c[s] - 0.75, 0) + back * p) / (5.0 + sum(like)))
        return np.log(said[1] / said[0])

    def features(self, text):
        found = re.findall("[a-zA-Z\x80-\U0010ffff]+", text or "")
        v = [sum(self.ratio(g) for g in self.grams(w)) for w in found]
        excess = sum(max(x - 2.0, 0) for x in v)
        return [excess / len(v), excess / len(v) ** 0.5, sum(v) / len(v), np.log(1 + len(v))] if v else [0.0] * 4


def test_scores_are_kneser_neys(spark):
    rng = np.random.default_rng(21)
    said = ["the", "cat", "cats", "sat", "rude", "rudest", "mat", "été", "on"]
    docs = [(i, " ".join(rng.choice(said[:4] + said[6:] if i % 3 else said, 6)) + ("!" if i % 2 else " rude.")) for i in range(40)] + [(50, None), (51, ""), (52, "unseen rudeness"), (7, "another row of an id"), (53, "z" * 200 + " rude")]
    labels = [(i, int(i % 3 == 0)) for i in range(30)]
    sample = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    unsigned = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    texts = {i: min((t for j, t in docs if j == i), key=unsigned) for i in sample}
    every = [t for _, t in docs]
    halves = [BruteModel(every, [(texts[i], y) for i, y in sample.items() if toxicity._half(i) == h], 3) for h in (0, 1)]
    whole = BruteModel(every, [(texts[i], y) for i, y in sample.items()], 3)
    d, l = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, after = toxicity.learn(d, toxicity.sample_texts(d, l), 3)[2]
    grams = {g for c in whole.counts for g in c}
    want = {int(toxicity.hashes([g])[0]): whole.ratio(g) for g in grams}
    got = dict(zip(seen["key"].to_pylist(), seen["r"].to_pylist()))
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    x = np.array([halves[1 - toxicity._half(i)].features(texts[i]) for i in sorted(sample)])
    mean, scale, w = toxicity.fit(x, np.array([sample[i] for i in sorted(sample)], float))
    rows = {(r.doc_id, r.text): r.score for r in toxicity.with_scores(d, l, order=3).collect()}
    for i, t in docs:
        z = np.append((np.array(whole.features(t)) - mean) / scale, 1) @ w
        assert abs(rows[i, t] - 1 / (1 + np.exp(-z))) < 1e-6


def test_words_are_looked_up_letter_by_letter():
    rng = np.random.default_rng(2)
    said = ["".join(rng.choice(list("abcé中"), int(n))).encode() for n in rng.integers(1, 90, 60)]
    grams = sorted({g for w in said[::2] for g in toxicity.sequences(w)})
    tables = []
    for names in (grams, sorted({g[:-1] for g in grams})):
        key, r = toxicity.hashes(names), rng.normal(size=len(names))
        order = np.argsort(key)
        assert len(set(key.tolist())) == len(names)
        tables.append((toxicity.pa.table({"key": key[order], "r": r[order]}), dict(zip(names, r))))
    (seen, s), (after, a) = tables
    for together in (7, 1 << 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "TOGETHER", max(together, toxicity.STRETCH))
            model = toxicity.Model(seen, after)
            model.know([said])
            if together == 7:
                m.setattr(toxicity, "TOGETHER", 7)
            want = [sum(s.get(g, a.get(g[:-1], 0.0)) for g in toxicity.sequences(w)) for w in said]
            assert np.allclose(model.ratios(said), want) and np.allclose([model._long(w) for w in said], want)


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(2, f"text {'ab' * i}") for i in range(50)] + [(3, "other")], SCHEMA)
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.sample_texts(docs, labels).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (2, 3))
    assert len(toxicity.toxicity(docs, labels).collect()) == 51


def test_shared_model_is_a_distribution(spark):
    seen = {s for w in (b"abab", b"abc", b"bca", b"c") for s in toxicity.sequences(w, 3)}
    model = {r.s: r.p for r in toxicity.shared_model(spark.createDataFrame([(s,) for s in seen], "s string"), 3).collect()}
    singles = {s: p for s, p in model.items() if len(s) == 1}
    rest = (toxicity.ALPHABET - len(singles)) * toxicity.DISCOUNT * len(singles) / toxicity.ALPHABET / sum(len({x for x in seen if len(x) == 2 and x[1] == s} | {x[1:] for x in seen if len(x) == 3 and x[2] == s}) for s in singles)
    assert abs(sum(singles.values()) + rest - 1) < 1e-9


def test_wholly_toxic_texts(spark):
    rng = np.random.default_rng(4)
    common, rude = [f"{a}{b}{c}" for a in ("ba", "to", "mi", "su") for b in ("ren", "lat", "vo") for c in ("a", "er", "ing")], ["grolk", "snarfle", "blitzug"]
    docs = []
    for i in range(500):
        said = list(rng.choice(common, size=int(rng.integers(20, 120))))
        docs.append((i, " ".join(said + list(rng.choice(rude, size=max(3, len(said) // 20))) if i % 5 == 0 else said)))
    toxic = ["grolk", "Snarfle!", "blitzug " * 40, "grolk snarfle blitzug grolk snarfle", "grolk snarfle grolk mirena"]
    clean = ["barena", "torener " * 40, "mivoing sulata", ""]
    docs += [(1000 + i, t) for i, t in enumerate(toxic + clean)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    rows = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), labels).collect()}
    assert [rows[1000 + i] for i in range(len(toxic + clean))] == [1] * len(toxic) + [0] * len(clean)


def test_models_keep_every_sequence(spark):
    """More than 200,000 distinct sequences, all seen once: none is dropped."""
    rng = np.random.default_rng(8)
    said = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), 60)) for _ in range(6000)]
    ids = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, " ".join(said[k :: len(ids)])) for k, i in enumerate(ids)], SCHEMA)
    sample = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as label", "text")
    want = {s for w in said for s in toxicity.sequences(w.encode())}
    seen, after = toxicity.learn(docs, sample)[2]
    assert len(want) > 200_000 and seen["key"].to_pylist() == sorted(toxicity.hashes(list(want)).tolist()) and len(set(seen["key"].to_pylist())) == len(want)
    assert after["key"].to_pylist() == sorted(toxicity.hashes(list({s[:-1] for s in want})).tolist())


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(4, 1), (5, 1)]])
def test_toxicity_with_few_labels(spark, odd, labels):
    rows = toxicity.toxicity(odd, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


# 7 licences

def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_FOLD))


def brute_license(text):
    w = license_words(text)
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def brute_spans(w, wording):
    """By diagonal voting over all pairs of places, chains tried one by one."""
    t = license_words(wording)
    votes = defaultdict(set)
    for i in range(len(w) - 2):
        for j in range(len(t) - 2):
            if w[i : i + 3] == t[j : j + 3]:
                votes[i - j].add(j)
    chains = []
    for d in sorted(votes, key=lambda d: (d + min(votes[d]), d)):
        near = [c for c in chains if abs(c[-1] - d) <= 3 and min(votes[d]) > max(votes[c[-1]])]
        covered = lambda c: len({j + i for x in c for j in votes[x] for i in range(3)})
        if near:
            max(near, key=lambda c: (covered(c), -abs(c[-1] - d), -min(x + min(votes[x]) for x in c))).append(d)
        else:
            chains.append([d])
    return [covered(c) / len(t) for c in chains if covered(c) >= max(0.6 * len(t), min(5, len(t)))] if chains else []


def brute_labels(text):
    w = license_words(text)
    *_, base = brute_license(text)
    found = [(label, x) for label, ps in licenses.TEMPLATES.items() for p in ps for x in brute_spans(w, p)]
    labels = {label for label, _ in found} | set(base.split(",")) - {""}
    return ",".join(sorted(labels)), round(max([x for _, x in found] + [1.0 if base else 0.0]), 9)


def test_words_put_in_and_left_out():
    for label, ps in licenses.TEMPLATES.items():
        for p in ps:
            t = license_words(p)
            if len(t) < licenses.LEAST_WORDS + licenses.GRAM:
                continue
            for i in range(len(t) + 1):
                for said in (t[:i] + ["truly"] + t[i:], t[:i] + t[i + 1 :], t[:i] + t[i + 2 :] if len(t) > 11 else t):
                    w = ["before"] * 4 + said + ["after"]
                    votes = defaultdict(list)
                    for k in range(len(w) - 2):
                        for j in range(len(t) - 2):
                            if w[k : k + 3] == t[j : j + 3]:
                                votes[k - j].append(j)
                    spans = licenses.merged(list(votes.items()), len(t))
                    assert spans and all(0.6 <= x[2] <= 1 for x in spans), (label, i, len(t))
                    assert max(x[2] for x in spans) >= (len(t) - 5) / len(t) and min(x[0] for x in spans) <= 8


def test_licenses(spark, odd):
    mit = licenses.TEMPLATES["mit"][2]
    more = [(20, "cc by by cc by cc"), (21, "İcc by \u212a cc by"), (22, "Permission is hereby granted, free of all charge, to any person obtaining a copy"), (23, "general public licenses"), (24, "!cc  BY!"), (25, "License under")]
    more += [(26, "Permission is hereby granted to any person obtaining a copy"), (27, "Permission is hereby truly granted free of charge to any person obtaining a copy"), (28, "Permission is hereby granted of charge to any person obtaining a copy")]
    more += [(30 + i, f"word here {p} and there. {p}") for i, p in enumerate(p for ps in licenses.TEMPLATES.values() for p in ps)]
    more += [(70, mit.replace("without limitation", "").replace("merge", "merge and fold").upper()), (71, mit[: len(mit) // 2]), (72, mit[: len(mit) * 2 // 3] + " in the software " * 50), (73, "the software of the software in the software " * 300)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA))
    rows = licenses.licenses(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter((i, *brute_license(t)) for i, t in ODD + more)
    assert Counter((r.doc_id, r.labels, round(r.score, 9)) for r in rows) == Counter((i, *brute_labels(t)) for i, t in ODD + more)
    assert all(r.labels == "mit" and 0.6 <= r.score <= 1 for r in rows if r.doc_id in (22, 26, 28, 70)) and all(r.score == 1 for r in rows if 30 <= (r.doc_id or 0) < 70)
    assert next(r.labels for r in rows if r.doc_id == 73) == "" and next((r.labels, r.score) for r in rows if r.doc_id == 27) == ("mit", 1.0)


# 8 BPE


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeéèñ ßÀIΣσςİK12!'stvermld<|x́\x1c\x85\xa0µª²½÷ÿ\xad\x80中🎈", max_size=60))
def test_encoding_is_the_librarys(text):
    b = bpe.vocabulary(WORD)
    for t in (text, text + "<|endoftext|>" + text):
        want = b.library.encode(t, add_special_tokens=False).ids
        ids = next(b.encode([t]))
        assert np.frombuffer(ids, "<u4").tolist() == want == np.frombuffer(b.long(t), "<u4").tolist()
        assert b.decode(ids).decode() == b.library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "a", "b", "er", "tion", "q", "é", "aaa"]), min_size=1, max_size=300).map("".join), st.integers(1, 20))
def test_tree_of_a_long_stretch(text, leaf):
    b = bpe.vocabulary(WORD)
    symbols = [s for _, x in b.stretches(text) for s in x]
    assert [b.vocab[t] for t in b.tree(symbols, leaf)] == b.library.encode(text, add_special_tokens=False).ids


def brute_digest(text):
    b = bpe.vocabulary(WORD)
    ids = b.library.encode(text or "", add_special_tokens=False).ids
    said = b.library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_token_digests(odd):
    want = sorted(((i, *brute_digest(t)) for i, t in ODD), key=repr)
    assert rows_of(bpe.token_digests(odd, WORD)) == want
    assert rows_of(bpe.token_digests(odd, WORD, spread=4000, leaf=64)) == want  # leaves dealt to tasks


# 9 packing


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([10, 17, 24]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_loses_nothing(case):
    capacity, items = case
    fixed, left = packing.reduce_counts(dict(Counter(items)), capacity)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(items, capacity)
    held = Counter()
    for n, parts in packing.plan(dict(Counter(items)), capacity):
        assert sum(w * k for w, k in parts) <= capacity
        for w, k in parts:
            held[w] += n * k
    assert held == Counter(items)


def test_packed(odd):
    b = bpe.vocabulary(WORD)
    rows = packing.packed(odd, WORD).collect()
    want = Counter()
    for i, t in ODD:
        ids = [*b.library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


# 10 exact duplicates


def test_exact_duplicates(spark, odd, monkeypatch):
    def check(df, docs):
        groups = defaultdict(list)
        for i, t in docs:
            groups[t or ""].append(i)
        rows = df.collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == Counter(
            (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs
        )
        kept = Counter(r.text_sha256 for r in rows if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)

    check(dedup.exact_duplicates(odd), ODD)
    monkeypatch.setattr(dedup, "BLOCK_CHARS", 2)
    docs = [(i, ("ab" * (i % 5) + "c" * (i % 3) + "é🎈" * (i % 4)) * (1 + i % 2)) for i in range(120)] + [(200 + i, "abababab") for i in range(60)] + [(300, "abab"), (300, "abab")]
    check(dedup.exact_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)), docs)
    monkeypatch.setattr(dedup, "_hash", lambda *c: F.xxhash64(*[F.length(F.col(x).cast("string")) for x in c]))  # very many blocks share a hash
    check(dedup.exact_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)), docs)
