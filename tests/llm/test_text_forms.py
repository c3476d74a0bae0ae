"""Fill-in-middle, SimHash and spelling variants against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

DOC = "doc_id bigint, text string, rule string, n double, form string, print string, word string"
LONG = "alpha beta gamma delta " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, LONG), (5, "same text here"), (5, "same text here"), (None, "no id"), (6, "Ünï çödé 日本語 🙂 text"), (7, "has <P> in it"), (8, "<<P <S <M"), (9, "x"), (10, "\x00a\U0010ffff")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, "f", "p", "w") for i, t in rows], DOC)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle

def cut(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) token by token."""
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(w), "plain", None, None, text
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(w), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_bit_sets_and_ranks():
    from gridstone.llm.fill_in_middle import bit_sets, ranked

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices(["a", "Zq", " ", "é", "日", "🙂", "\n", "<", "9"], k=rng.randint(0, 40)))
        data = text.encode()
        starts, _ = bit_sets(data)
        places = [len(text[:m.start()].encode()) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        assert starts.bit_count() == len(places)
        assert [ranked(starts, len(data), k) for k in range(len(places) + 1)] == [*places, len(data)]


def test_fill_in_middle_brute_force(spark):
    from gridstone.llm.fill_in_middle import fill_in_middle, restored

    rng = random.Random(2)
    rows = ODD + [(100 + i, "".join(rng.choices(["<", "<S", "<P", "S>", "M", "word", " ", "é", "🙂", "<M>"] if i % 3 == 0 else ["<", "<S", "word", " ", "é", "🙂", "M>"], k=rng.randint(0, 9)))) for i in range(400)]
    out = fill_in_middle(docs(spark, rows))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.withColumn("back", restored(out.output, out.form)).collect()]
    assert sorted(got, key=repr) == sorted([(i, *cut(i, t), t or "") for i, t in rows], key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs(spark, [])).count() == 0


def test_fill_in_middle_long_text_is_linear():
    from gridstone.llm.fill_in_middle import transformed

    def took(n):
        data = ("ab é" * n).encode()
        began = time.perf_counter()
        form = transformed(data, [n, 2 * n, 0, 50], 10, 20, (b"<P>", b"<S>", b"<M>"))
        assert form[:2] == (3 * n, "psm")
        return time.perf_counter() - began

    took(1000)
    assert took(2_000_000) < 5


def test_fill_in_middle_marks(spark):
    import pytest

    from gridstone.llm.fill_in_middle import fill_in_middle

    with pytest.raises(ValueError):
        fill_in_middle(docs(spark, ODD), marks=("aa", "b", "c"))


# SimHash

def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [] if not w else [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, within=3):
    """The smallest place that each place reaches."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            low = min(root[j] for j, y in enumerate(prints) if (x ^ y).bit_count() <= within)
            changed |= low < root[i]
            root[i] = min(low, root[i])
    return root


def test_xxh64_of_spans():
    from gridstone.llm.simhash import xxh64

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 3000)
    ends = starts + rng.integers(0, 80, 3000)
    assert xxh64(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]


def test_simhash_brute_force(spark):
    from gridstone.llm.simhash import simhash_dedup

    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(60)] for _ in range(12)]
    rows = list(ODD)
    for i in range(240):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 9)}"
        rows.append((1000 - i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    got = {}
    for r in simhash_dedup(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.print & (1 << 64) - 1, r.component_id))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint(t) for _, t in order]
    root = reach(prints)
    assert sum(map(len, got.values())) == len(rows)
    for (i, _), p, k in zip(order, prints, root):
        assert (p, order[k][0]) in got[i]
    assert got[1] == got[2] == got[3] == [(0, 1)] and len(set(root)) < 200
    assert simhash_dedup(docs(spark, [])).count() == 0


def test_near_links_of_crowded_values(spark, monkeypatch):
    """Fingerprints that share a half meet in tasks of several blocks; components stay exact, links stay few."""
    from gridstone.llm import simhash
    from gridstone.llm.components import components

    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for centre in (0, 0xFFFFFFFF00000000, rng.getrandbits(64)):
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(32), rng.randint(2, 7))) for _ in range(100)}
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for within, segments in ((3, 2), (2, 1), (3, 4)):
        links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), within, segments)
        assert links.where(f"bit_count(a ^ b) > {within}").count() == 0
        found = {r.node: r.root for r in components(links).collect()}
        root = reach(prints, within)
        assert [found.get(p, p) for p in signed] == [signed[k] for k in root]


def test_walk_of_a_dense_group():
    from gridstone.llm.simhash import walked

    rng = np.random.default_rng(6)
    prints = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(4000)], np.uint64))
    assert len(walked(prints, 3)) == len(prints) - 1


# Spelling variants

def variants(rows, slip=97, least_n=3):
    """The contract, word by word and pair by pair."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near_of = {w: [v for s in (-1, 0, 1) for v in by.get(len(w) + s, []) if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near_of[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near_of[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    out = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    assert len(got) == len(out)
    return got


def test_spelling_brute_force(spark):
    from gridstone.llm.spelling import spelling_variants

    rng = random.Random(7)
    stems = ["anagram", "nagaram", "straße", "letter", "aaaaa", "élève", "window", "listen", "silent"]
    rows = list(ODD)
    for i in range(300):
        words = []
        for _ in range(30):
            w = list(rng.choices(stems, weights=[90, 9, 30, 60, 20, 30, 9, 40, 4])[0])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "t"])
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "9", "\n"]).join(words)))
    for slip in (97, 5, 0):
        want = variants(rows, slip)
        assert rows_of(spelling_variants(docs(spark, rows), slip=slip)) == want
        assert any(form for form, *_ in want.values())
    assert spelling_variants(docs(spark, [])).count() == 0
    assert spelling_variants(docs(spark, [(1, None), (2, "")])).count() == 0


def test_spelling_chains_and_ties(spark):
    from gridstone.llm.spelling import spelling_groups

    chain = [("a" * (5 + k), 1 << k) for k in range(40)]
    got = rows_of(spelling_groups(spark.createDataFrame([*chain, ("zzzzzb", 6), ("zzzzza", 6), ("zzzzz", 3), (None, 9)], "word string, n long")))
    assert all(got[w][1] == chain[-1][0] for w, _ in chain) and got[chain[0][0]] == ("aaaaaa", chain[-1][0], 1, 1, 2)
    assert got["zzzzz"] == ("zzzzza", "zzzzza", 3, 2, 6) and got["zzzzza"] == (None, "zzzzza", 6, 2, None)


def test_long_words_have_keys(spark):
    from gridstone.llm.spelling import near_pairs

    long = "ÿ" * 100_000
    pairs = near_pairs(spark.createDataFrame([(long,), (long + "a",), ("a" + long,), (long[1:] + "b",)], "word string")).collect()
    assert len(pairs) == 3


def test_queries_on_given_tables(spark):
    from gridstone.llm import queries

    d = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(d["doc_id"], d["text"]))
    fim = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    for i, t in rows:
        n, form, prefix, middle, out = cut(i, t)
        assert tuple(fim[i]) == (i, n, form, prefix, middle, sha(out), sha(t or ""))
    rows.sort()
    prints = [fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, reach(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, "/root/testdata/sf0.001").collect()} == want
    assert rows_of(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == variants(rows)
