"""Source audit, n-gram join and prefix trie against brute force, with odd rows in every table."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from voxframe.llm import ngram_join, prefix_trie, source_audit

rng = random.Random(4)
WORDS = ["".join(rng.choice(["the", "er", "on", "Ti", "ña", "é", "王"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]


def words(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- source audit


def audit_rows():
    rows = [(k, words(rng.randint(0, 60)) + "! a1b", rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}", 1) for k in range(120)]
    rows += [(200, None, "en", "s0", 1), (201, "", "en", "empty source", 1), (202, words(20), None, None, 1), (203, "x " * 30000, "en", "s1", 1), rows[0], rows[0], (None, words(30), "fr", "s9", 1), (204, "\x00\ta\x7fb", "fr", "é", 1)]
    return rows


def brute_audit(rows, min_docs, top):
    rows = [(t or "", la or "", so or "") for _, t, la, so, _ in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), la, so) for t, la, so in rows]
    out = []
    for lang in {r[1] for r in found}:
        own = [r for r in found if r[1] == lang]
        df = Counter(x for w, _, _ in own for x in set(w))
        kept = [x for x, n in df.items() if n >= min_docs]
        sources = sorted({r[2] for r in own})
        count = {s: Counter(x for w, _, so in own if so == s for x in w) for s in sources}
        count[None] = Counter(x for w, _, _ in own for x in w)
        p = {s: {x: 1 + 10**9 * (c[x] + 2) // (sum(c[y] for y in kept) + 2 * len(kept)) for x in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][x], p[o][x]) for x in kept)) for o in sources if o != s]
            terms = [(x, f(p[s][x], p[None][x])) for x in kept if count[s][x] and p[s][x] > p[None][x]]
            for part, got, most in (("pair", pairs, None), ("term", terms, top)):
                got.sort(key=lambda g: (-g[1], g[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(got[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("entries", "cells"), [(1 << 18, 1 << 20), (50, 60)])
def test_audit(spark, monkeypatch, entries, cells):
    monkeypatch.setattr(source_audit, "MOST_ENTRIES", entries)
    monkeypatch.setattr(source_audit, "MOST_CELLS", cells)
    monkeypatch.setattr(source_audit, "BUCKET_CELLS", cells)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).withColumn("term", F.lit(1)).withColumn("grp", F.lit("x"))
    got = source_audit.audit(docs, min_docs=5, top=4)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 5, 4)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit(docs).collect() == []
    few = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(few).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_of_large_counts():
    import numpy as np

    count, total = np.array([0, 7, 10**13, 3 * 10**14]), 5 * 10**14
    assert source_audit.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in count]


# --- n-gram join


def changed(text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def join_texts():
    base = [words(rng.choice([12, 25, 40, 90, 150, 400])) for _ in range(40)]
    out = list(base)
    for b in base[:25]:
        n = len(b.split())
        out += [changed(b, rng.randint(0, max(1, n // 40))) for _ in range(rng.randint(1, 6))]
    out += [b + " " + words(max(1, len(b.split()) // 30)) for b in base[25:]]
    group = words(300)
    out += [changed(group, rng.randint(1, 7)) for _ in range(60)]  # many that are similar to the first, not to each other
    out += ["", None, "a", "A", "a b", "a  B", "b a", " \t ", "x " * 20000, "x " * 300, base[0].upper(), base[1]]
    line = words(12)
    out += [line + " " + words(30) + " " + line for _ in range(20)]
    return out


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set()


def brute_components(rows):
    low = {}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    sets = [(d, grams(t)) for d, t in rows if d is not None]
    for d, _ in sets:
        low[d] = d
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if n and 100 * n >= 90 * (len(x) + len(y) - n):
                a_, b_ = find(a), find(b)
                low[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in low}


@pytest.mark.parametrize(("part", "block"), [(256, 512), (3, 2)])
def test_ngram_join(spark, monkeypatch, part, block):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = list(enumerate(join_texts()))
    rng.shuffle(rows)
    rows = [(1000 - d if d % 2 else d, t) for d, t in rows]  # the smallest id isn't always the original
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n", F.lit("n")).withColumn("bucket", F.lit(1))
    got = [tuple(r) for r in ngram_join.classes(docs).collect()]
    want = brute_components(rows)
    assert len(set(want.values())) < len(want) - 60
    assert Counter(got) == Counter((d, len(grams(t)), want.get(d)) for d, t in rows)


def test_ngram_join_of_repeated_ids(spark):
    a, b, c = words(50), words(60), words(70)
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (9, c), (9, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.classes(docs).collect()) == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 9), (9, 9)]
    assert ngram_join.classes(docs.where("doc_id > 10")).collect() == []


def test_no_similar_pair_fails_to_meet():
    """Pairs just above the similarity share a meeting place, at all sizes."""
    import numpy as np

    from voxframe.llm._np import mix

    r = np.random.default_rng(3)
    for _ in range(300):
        union = int(r.integers(5, 700))
        lost = int(union * 0.1)
        h = np.unique(mix(r.integers(0, 1 << 62, union).astype(np.uint64)))
        side = r.integers(0, 2, lost)
        gone = r.choice(len(h), lost, replace=False)
        x, y = np.delete(h, gone[side == 0]), np.delete(h, gone[side == 1])
        where, names = ngram_join.meeting_places(np.repeat([0, 1], [len(x), len(y)]), np.append(x, y), 2, 90)
        assert set(names[where == 0]) & set(names[where == 1]) or len(x) == len(y) == len(h)


def test_sketches_never_differ_more_than_their_sets():
    import numpy as np

    from voxframe.llm._np import mix

    r = np.random.default_rng(5)
    for _ in range(200):
        h = np.unique(mix(r.integers(0, 1 << 62, int(r.integers(1, 900))).astype(np.uint64)))
        x, y = (np.sort(r.choice(h, max(1, int(len(h) * r.uniform(0.5, 1))), replace=False)) for _ in range(2))
        one, two = (np.frombuffer(ngram_join.sketches(np.zeros(len(z), np.int64), z, np.array([len(z)]), 90)[0], np.uint64)[None, :] for z in (x, y))
        width = min(one.shape[1], two.shape[1])
        differ = int(np.bitwise_count(ngram_join._folded(one, width) ^ ngram_join._folded(two, width)).sum())
        assert differ <= len(np.setxor1d(x, y))


# --- prefix trie


def conversation_rows():
    lines = ["hello", "", "yes", "no", "é 王", None]
    rows = []
    for c in [*range(0, 130), 205, 399, -5, -100, 1000, 1001]:
        for k in range(rng.randint(1, 9)):
            rows.append((c, k, rng.choice(["user", "assistant", None]), lines[min(rng.randint(0, 9), 5)]))
    rows += [(c, k, "user", "same") for c in range(500, 560) for k in range(3)]  # equal ones
    rows += [(600, k, "user", "long") for k in range(300)] + [(700, k, "user", "long") for k in range(310)]
    rows += [(800, None, "user", "before all"), (800, 2, "user", "b"), (800, 2, "user", "a"), (800, 2, "user", "a"), (None, 1, "user", "nobody's"), (801, 0, None, None)]
    rows += [(902, k, "u", "t" * 100000) for k in range(2)]
    return rows


def brute_trie(rows):
    from hashlib import md5

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize(("turns", "piece"), [(1 << 18, 1 << 16), (40, 7)])
def test_trie(spark, monkeypatch, turns, piece):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("key", F.lit(1)).withColumn("first", F.lit(1))
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.said(table))).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.said(table))).collect() == []


# --- long runs without blanks, and mark-up that never ends


def test_surrogates_of_long_runs(spark):
    """Half a million characters of each form, in time that is far below a quadratic scan's."""
    import time

    from voxframe.llm import pii

    runs = ["x", "1", ".", "a.", "@", "a@", "a@b.", "PASSWORD=", "Mr ", "Mr X", "王", "ab:", "0" * 32, "sk-", "+1 ", "a1", "DE44 ", "''", "token=\""]
    texts = [run * (500_000 // len(run)) + " password=abcdef1 " for run in runs]
    began = time.time()
    got = pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "k").collect()
    assert len(got) == len(runs) and all("abcdef1" not in r.text for r in got)
    assert time.time() - began < 240


def test_pages_that_never_end():
    import time

    from voxframe.llm import html_extract

    model = html_extract.train(pages=60, rounds=2)
    for form in ["<a ", '<a "', "<a '\"", "<!--", "<", "<! ", "</", "<div>", "<span>", "</x>", "<p><object><span>", "<svg>", "<li>", "<b><p></p>", "&", 'id="']:
        began = time.time()
        assert isinstance(model.main_text("<article><p>" + form * (1_000_000 // len(form))), str)
        assert time.time() - began < 60, form
