"""The parts of the text operators that run inside tasks, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from voxframe.llm import html_extract, near_dup, packing, quality_cnn, quality_rules, recompression, token_counts
from voxframe.llm._np import span_hash

random.seed(11)
ODD = "abcdefgh'sS tTrReEvVmMlLdD  \n\t éÉßİΣσς123½٣中文字 !?.,<|>endoftext'’́"
TEXTS = ["", " ", "\n", "a", "'s't're've'm'll'd''s !'s x's's", "a  's", "\n\n a", " 'll x", "x\n's", "<|endoftext|>a <|startoftext|>b<|endoftext|>", "e" * 3000, "中" * 700, " " * 900]
TEXTS += ["".join(random.choice(ODD) for _ in range(random.randint(0, 80))) for _ in range(400)]
TEXTS += ["".join(random.choice("thenandingouerst") for _ in range(4000))]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_counts_are_the_librarys(libraries, monkeypatch):
    want = [len(x.ids) for x in libraries["word_bpe_49k.json"].encode_batch(TEXTS, add_special_tokens=False)]
    machine = token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.count_block(machine, TEXTS).tolist() == want
    monkeypatch.setattr(token_counts, "MOST_STATES", 10)  # forgets and compiles anew
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 7)  # maps of short chunks, many of them without a border
    assert token_counts.count_block(machine, TEXTS).tolist() == want


def test_ids_are_the_librarys(libraries):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for part in (TEXTS, [t for t in TEXTS if "<|" not in t]):
        ids, at = encoder.encode(*packed(part))
        for k, x in enumerate(libraries["byte_bpe_50k.json"].encode_batch(part, add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == x.ids, part[k]


class Counted:
    """A library that notes the texts it encodes."""

    def __init__(self, library):
        self.library, self.seen = library, Counter()

    def encode_batch_fast(self, texts, **more):
        self.seen.update(texts)
        return self.library.encode_batch_fast(texts, **more)

    def encode(self, text, **more):
        self.seen[text] += 1
        return self.library.encode(text, **more)


def encodes_as(encoder, library, texts):
    ids, at = encoder.encode(*packed(texts))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_common_pieces_are_encoded_once(libraries, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIECES", 60)
    library = libraries["byte_bpe_50k.json"]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.library = Counted(library)
    for k in range(40):
        rare = "".join(f" r{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(9))
        assert encodes_as(encoder, library, [" some common words" + rare, "", rare])
    assert {encoder.library.seen[w] for w in (" some", " common", " words")} == {1}


def test_known_pieces_are_bounded_and_shared_by_tasks(libraries, monkeypatch):
    monkeypatch.setattr(packing, "MOST_KEPT_IDS", 500)
    library, path = libraries["byte_bpe_50k.json"], public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.worker_encoder(path)
    assert packing.worker_encoder(path) is encoder
    for k in range(40):
        assert encodes_as(encoder, library, ["中文"[k % 2] * (200 + k), " a common word", ""]) and len(encoder.ids) <= 500
    assert encodes_as(encoder, library, ["中" * 700]) and encodes_as(encoder, library, ["", ""]) and len(encoder.ids) <= 500


def test_pieces_of_one_name_are_told_apart(libraries, monkeypatch):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "span_hash", lambda d, a, b, salt=0: span_hash(d, a, b, salt) if salt else np.full(len(a), 7, np.uint64))
    for text in ("one", "two", "one", "three"):
        assert encodes_as(encoder, libraries["byte_bpe_50k.json"], [text])


def test_packer_loses_nothing():
    packer = packing.Packer(64, 3, 0)
    docs = {d: np.arange(random.choice([0, 1, 30, 64, 65, 300]), dtype=np.uint32) for d in range(200)}
    for d, ids in docs.items():
        packer.add(d, 0, ids, len(ids))
    packer.close()
    seen = defaultdict(dict)
    fill = defaultdict(int)
    for d, start, ids, total, sequence, offset in sorted(packer.done, key=lambda r: (r[4], r[5])):
        assert offset == fill[sequence] and total == len(docs[d])
        fill[sequence] += len(ids)
        seen[d] |= {start + k: i for k, i in enumerate(ids)}
    assert all(sorted(seen[d]) == list(range(len(ids))) for d, ids in docs.items())
    assert max(fill.values()) <= 64 and sum(f < 64 for f in fill.values()) <= 3


def _rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_rule_statistics():
    texts = TEXTS + ["a\na\n a", "x y z x y z", "".join(random.choice("ab \n\té#|") for _ in range(500))]
    s = quality_rules.statistics(*packed(texts))
    for k, t in enumerate(texts):
        assert tuple(int(s[c][k]) for c in quality_rules.COUNTS) == _rules(t), t


def test_forests_reject_what_no_good_row_has():
    rng = np.random.default_rng(1)
    good, bad = rng.random((600, len(quality_rules.FEATURES))) * 0.3, rng.random((40, len(quality_rules.FEATURES))) * 0.3
    bad[:, 2] = 0.9
    f = quality_rules.grow(good[::2], bad[::2], 0.01, 30)
    assert (f.excess(good[1::2]) <= 0).mean() > 0.97 and (f.excess(bad[1::2]) > 0).all()


def test_path_lengths_are_those_of_a_walk():
    """Scores against a row-by-row walk down each tree."""
    rng = np.random.default_rng(3)
    rows = rng.random((300, len(quality_rules.FEATURES)))
    f = quality_rules.IsolationForest([1, 4], trees=7, part=64).fit(rows[:200], rows.min(axis=0), rows.max(axis=0))
    for row, score in zip(rows[200:], f.score(rows[200:])):
        total = 0.0
        for feature, split, child, length in f.grown:
            node = 0
            while feature[node] >= 0:
                node = child[node][1 if row[feature[node]] >= split[node] else 0]
            total += length[node]
        assert abs(score - 2 ** (-total / 7 / f.deepest)) < 1e-12
    for feature, split, child, length in f.grown:  # each part of the sample ends in a leaf of its own size
        assert set(feature[feature >= 0]) <= {1, 4} and (length[feature >= 0] == 0).all()


def test_network_learns_and_reads_whole_texts():
    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choice(["the", "on", "and", "er", "ti"]) for _ in range(n))
    texts, labels = [], []
    for k in range(240):
        t = plain(rng.randint(150, 700))
        if k % 3 == 0:
            cut = rng.randrange(len(t))
            t = t[:cut] + " %%%### $$$ &&& %%% " + t[cut:]
        texts.append(t.encode())
        labels.append(float(k % 3 != 0))
    n = quality_cnn.Network().fit(texts[:180], np.array(labels[:180], np.float32), 12)
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    p = n.score(np.frombuffer(b"".join(texts), np.uint8), at)
    assert ((p[180:] >= 0.5) == (np.array(labels[180:]) == 1)).mean() > 0.9
    assert 0 <= n.score(np.zeros(0, np.uint8), np.array([0, 0]))[0] <= 1


def test_scores_are_those_of_whole_texts():
    """Chunk by chunk, against all windows of a text at once."""
    n, texts = quality_cnn.Network(), [bytes(random.choice(b"abc def") for _ in range(k)) for k in (0, 5, 511, 512, 513, 70_000, 1024)]
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    got = n.score(np.frombuffer(b"".join(texts), np.uint8), at)
    for t, p in zip(texts, got):
        pieces = [t[k : k + quality_cnn.CHUNK + quality_cnn.WIDTH] for k in range(0, max(len(t), 1), quality_cnn.CHUNK)]
        rows = np.array([[*x, *[quality_cnn.PAD] * (quality_cnn.CHUNK + quality_cnn.WIDTH - len(x))] for x in pieces], np.int16)
        best = n.answers(rows)[0]
        z = n.joined(best.max(axis=0)[None], best.mean(axis=0)[None], np.array([len(t)])) @ n.dense + n.level
        assert abs(1 / (1 + np.exp(-float(z[0]))) - p) < 1e-5


def test_network_slopes_are_those_of_the_loss():
    n = quality_cnn.Network()
    n.training = True
    n.shift += 0.05  # away from the bend of the largest answers at 0
    texts = [bytes(random.choice(b"abcdef") for _ in range(k)) for k in (700, 3, 1200)]
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    label, size = np.array([1.0, 0.0, 1.0]), np.diff(at)
    row, begin, place = quality_cnn.places(at)
    cut = quality_cnn.chunks(np.frombuffer(b"".join(texts), np.uint8), begin, at[row + 1])

    def loss():
        z = n.pooled(n.answers(cut)[0], place, size) @ n.dense + n.level
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - label) * z))

    for p, g in zip(n.parts(), n.slopes(cut, place, size, label)):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[k], 1e-3
        p[k] = old + h
        up = loss()
        p[k] = old - h
        down = loss()
        p[k] = old
        assert abs((up - down) / (2 * h) - g[k]) < 0.1 * abs(g[k]) + 2e-3


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    names = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    a, b = np.arange(0, 300), np.arange(60, 360)
    wa, wb = rng.integers(1, 4, 400), rng.integers(1, 4, 400)
    for weights in (np.ones(400), None):
        x, y = (np.ones(300), np.ones(300)) if weights is not None else (wa[a].astype(float), wb[b].astype(float))
        full = np.zeros((2, 400))
        full[0, a], full[1, b] = x, y
        want = full.min(axis=0).sum() / full.max(axis=0).sum()
        s = near_dup.dart_signatures(np.repeat([0, 1], 300), names[np.append(a, b)], np.append(x, y), 2, 2000)
        assert (s > 0).all() and abs((s[0] == s[1]).mean() - want) < 0.05


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(1, 1 << 62, 12).astype(np.uint64)
    words = vocabulary[rng.integers(0, 12, 4000)]
    words[100:160] = words[1000]
    words[2000:2200] = words[500:700]
    at = np.array([0, 0, 5, 1500, 1900, 4000])
    first, got = recompression.standing(words, at, 13)
    seen = {}
    for f, s in zip(first, got):
        assert seen.setdefault(words[f : f + 13].tobytes(), s) == s
    assert len(first) == sum(max(0, n - 12) for n in np.diff(at))
    assert recompression.standing(words[:0], np.array([0, 0]), 13)[0].size == 0


def test_sum_product_is_exact():
    page = html_extract.Page("<div><p>a</p><p>b <b>c</b></p><ul><li>d<li>e</ul></div><footer>f</footer>")
    model = html_extract.TreeModel()
    rng = random.Random(5)
    model.weights = [rng.uniform(-1, 1) for _ in range(html_extract.SLOTS)]
    model.edges = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(2)]
    slots = html_extract.features(page)
    got, _ = model.messages(page, slots)
    n = len(slots)
    total, ones = 0.0, [0.0] * n
    for case in range(2**n):
        y = [case >> k & 1 for k in range(n)]
        w = np.exp(sum(sum(model.weights[s] for s in slots[k]) * y[k] for k in range(n)) + sum(model.edges[page.tag[k] in html_extract.LEAVES][2 * y[page.parent[k]] + y[k]] for k in range(1, n)))
        total += w
        for k in range(n):
            ones[k] += w * y[k]
    assert np.allclose(got, [o / total for o in ones])


def test_pages():
    model = html_extract.train()
    lost = extra = blocks = 0
    for source, marks in html_extract.labelled_pages(60, seed=77):
        kept = model.main_text(source).split("\n")
        blocks += len(marks)
        lost += len(marks - {w for line in kept for w in line.split()})
        extra += sum(1 for line in kept if line and not marks & set(line.split()))
    assert lost <= 0.03 * blocks and extra <= 0.03 * blocks
    assert model.main_text("") == ""
    page = "<nav><a href=/>x</a></nav><article><h1>T &amp; U</h1><p>One  two\n three &eacute;.<p>Four</article><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    assert model.main_text(page) == "T & U\nOne two three é.\nFour"
    for odd in ("plain", "<", "<p", "</p></div>", "<!-- open", "<script>never closed", "<p>" * 300):
        assert isinstance(model.main_text(odd), str)


#: Pages of other layouts, written by hand, without an article element: source and the main text's blocks.
LAYOUTS = [
    ("<html><body><div id='top'><a href='/'>Home</a> <a href='/n'>News</a></div><table><tr><td width=120><ul><li><a href='/a'>First</a><li><a href='/b'>Second</a></ul><td class='content'><h1>The old mill</h1><p>The mill by the river has stood for three hundred years, and it still turns.<p>Visitors may see it on Sundays from ten to four.</table><div class='footer'>Copyright 2020 by the town.</div></body></html>", ["The old mill", "The mill by the river has stood for three hundred years, and it still turns.", "Visitors may see it on Sundays from ten to four."]),
    ("<body><header><h1>Daily</h1><nav><a href=1>One</a><a href=2>Two</a></nav></header><main><h2>How bread rises</h2><p>Yeast eats sugar and gives off gas, which the dough holds.</p><p>Warm rooms make it faster, cold ones slower, and both have their use.</p><aside class='related'><p>More about <a href=3>flour</a></p></aside></main><section id='comments'><h3>Comments</h3><p>I tried it and it worked well for me.</p></section><footer><p>All rights reserved.</p></footer>", ["How bread rises", "Yeast eats sugar and gives off gas, which the dough holds.", "Warm rooms make it faster, cold ones slower, and both have their use."]),
    ("<div class='wrapper'><div class='cookie-notice'><p>We use cookies to make this site better.</p><button>Accept</button></div><div class='post'><h1>Counting birds</h1><div class='entry-content'><p>Every winter some thousand people count the birds in their gardens.</p><blockquote><p>It takes one hour, and a cup of tea.</p></blockquote><p>The results show which kinds grow rare.</p></div></div><div class='sidebar'><ul><li><a href='/1'>Archive</a></li><li><a href='/2'>About</a></li></ul></div></div>", ["Counting birds", "Every winter some thousand people count the birds in their gardens.", "It takes one hour, and a cup of tea.", "The results show which kinds grow rare."]),
]


def test_pages_of_other_layouts():
    model = html_extract.train()
    for source, blocks in LAYOUTS:
        assert model.main_text(source).split("\n") == blocks


def test_articles_mark_their_text():
    page = html_extract.Page("<p>a<article><h1>b</h1><p>c<aside><p>d</aside></article><p>e")
    inside = html_extract.in_article(page)
    assert [text for node, text in page.runs if inside[node]] == ["b", "c"]


@pytest.mark.parametrize(
    ("source", "seen"),
    [
        ("<p>a<p><object><p>fallback</p></object>b<p>c", ["a", "b", "c"]),
        ("<ul><li>a<audio src=x><li>b</ul><p>c", ["a", "b", "c"]),
        ("<table><tr><td>a<canvas><td>b</table><p>c", ["a", "b", "c"]),
        ("<p>a<object data=x><p>b<p>c", ["a", "b", "c"]),
        ("<ul><li><svg>x<li>one two</ul><p>A long paragraph", ["one two", "A long paragraph"]),
        ("<select><option>x<option>y<p>a<p>b", ["a", "b"]),
        ("<div><svg><g>x<div>a</div><p>b", ["a", "b"]),
        ("<div><svg><g>x<p>y</svg><p>b", ["b"]),
        ("<p><object><p>x</p></object><p><svg><p>b<p>c", ["b", "c"]),
        ("<head><title>t</title><body><article><p>a</article>", ["a"]),
        ("<head><title>t</title><meta charset=x><style>p{}</style><p>a<p>b", ["a", "b"]),
        ("<head><template><p>no</p></template><title>t</title><b>a</b> b", ["a b"]),
        ("<head><title>t</title>\n a <p>b", ["a", "b"]),
        ("<head><template><body><p>a", ["a"]),
        ("<head><title>t</title></head><body><p>a<script>x</script></body>", ["a"]),
    ],
)
def test_hidden_elements_end(source, seen):
    assert [text for _, text in html_extract.Page(source).runs] == seen


def _swapped(a, b, n):
    """Two sequences that differ in the order of a and b alone, by a pattern in which sums over powers agree."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


def test_hashes_tell_patterns_apart():
    from voxframe.llm._np import span_hash, window_hashes

    x, y = ("".join(t) for t in _swapped("a", "b", 1024))
    data, at = packed([x, y])
    for salt in (0, 1):
        one, two = span_hash(data, at[:-1], at[1:], salt)
        assert one != two
    p, q = (np.array(t, np.uint64) for t in _swapped(3, 5, 1024))
    for size in (2, 5, 13, 1024):
        h, first = window_hashes(np.concatenate([p, q]), np.array([0, 1024, 2048]), size)
        seen = {}
        for k, f in zip(h.tolist(), first):
            assert seen.setdefault(k, np.concatenate([p, q])[f : f + size].tobytes()) == np.concatenate([p, q])[f : f + size].tobytes()
    texts = ["", "a", "aa", "a\x00", "\x00", "abcdefgh", "abcdefghi", "x" * 100] + ["".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(500)]
    data, at = packed(texts)
    assert len(set(span_hash(data, at[:-1], at[1:]).tolist())) == len(set(texts))


def test_patterned_words_and_lines(libraries):
    x, y = ("".join(t) for t in _swapped("a", "b", 1024))
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = encoder.encode(*packed([x, y]))
    for k, e in enumerate(libraries["byte_bpe_50k.json"].encode_batch([x, y], add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids
    assert quality_rules.statistics(*packed([x + "\n" + y]))["n_dup_lines"][0] == 0
