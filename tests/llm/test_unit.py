"""The parts of the operators without Spark, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from factloom.llm import encoder as encoder_module
from factloom.llm import common, decontam, langid, repetition, simhash, sstable, templates, warc
from factloom.llm.encoder import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = ["a", "b", "cé", "d e", "ſ", "x|y", "日本"]


def texts(seed, n, most=60):
    r = random.Random(seed)
    out = ["", " ", "\n\n", "a", "a\na\n a", "x " * 40, "é\t" * 9]
    return out + ["".join(r.choice(LOREM) + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_words_and_hashes():
    for t in texts(1, 60):
        raw = np.frombuffer(t.encode(), np.uint8)
        starts, ends = common.word_bounds(raw)
        words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
        assert words == WORD.findall(t)
        h = common.word_hashes(raw, starts, ends)
        assert (len(set(h.tolist()))) == len(set(words))
        w = common.window_hashes(h, 3)
        assert len(set(w.tolist())) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})


def brute_repetition(t):
    w = WORD.findall(t)
    n = len(w)
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    rep = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), sum(len(w[i]) for i in rep), longest


def test_repetition_profile():
    ts = texts(2, 120, 90)
    got = repetition.profile([t.encode() for t in ts])
    for i, t in enumerate(ts):
        assert tuple(int(got[c][i]) for c in repetition.COLUMNS) == brute_repetition(t), t


def brute_fingerprint(t, k=3):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for t in [*texts(3, 40), "ÀB Cd", "one two"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_every_close_pair_meets_at_a_home_anchor(threshold):
    r = np.random.default_rng(4)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, threshold, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    who, anchor, home = simhash.anchors(x, threshold)
    assert home.sum() == len(x)
    mine = {(int(a), int(b)) for a, b, h in zip(who, anchor, home) if h}
    who, anchor, _ = simhash.anchors(y, threshold)
    assert len({i for i, a in zip(who.tolist(), anchor.tolist()) if (i, a) in mine}) == len(x)


@pytest.mark.parametrize("size", [30, 400])
def test_group_links_give_the_components_of_all_pairs(size):
    r = np.random.default_rng(size)
    fps = np.unique(np.uint64(12345) ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 6))) for _ in range(size)], dtype=np.uint64))
    n = len(fps)
    a, b = simhash._links(np.zeros(n, np.int64), fps, np.ones(n, bool), 2)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert np.array_equal(simhash.components(a, b, n), simhash.components(i, j, n))


def test_large_groups_in_parts_and_split_anchors(monkeypatch):
    r = np.random.default_rng(9)
    fps = np.unique(np.uint64(77) ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for _ in range(300)], dtype=np.uint64))
    n = len(fps)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    want = simhash.components(i, j, n)
    monkeypatch.setattr(simhash, "_VARIANTS", 3000)
    a, b = simhash._large(fps, np.ones(n, bool), 2)
    assert np.array_equal(simhash.components(a, b, n), want)
    # every pair that an anchor joins is joined under one of its three keys
    anchor, own, home = simhash._split(np.full(n, 5), fps, np.ones(n, bool), np.array([2, 5, 9]))
    assert (anchor < 0).all() and len(anchor) == 3 * n
    order = np.argsort(anchor, kind="stable")
    a, b = simhash._links(anchor[order], own[order], home[order], 2)
    index = np.searchsorted(fps, own[order])
    assert np.array_equal(simhash.components(index[a], index[b], n), want)
    assert simhash._split(np.array([1]), fps[:1], np.ones(1, bool), np.array([2, 5]))[0].tolist() == [1]


def brute_code_length(counts, text, order):
    bits = 0.0
    for i, s in enumerate(text):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if s in seen:
                bits += np.log2((total + kinds) / seen[s])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_ppm_code_lengths():
    train = {"a": [b"abracadabra", b"abba", b""], "b": ["größe süß".encode(), b"xyz"]}
    order, counts, models = 3, {}, {}
    for lang, ts in train.items():
        gram, k, n = langid._counted(ts, order)
        counts[lang] = {}
        for kk in range(order + 1):
            values, inverse = np.unique(gram[k == kk], return_inverse=True)
            counts[lang][kk] = (values, np.bincount(inverse, weights=n[k == kk]).astype(np.int64))
        models[lang] = {}
        for t in ts:
            for i, s in enumerate(t):
                for c in range(min(order, i) + 1):
                    own = models[lang].setdefault(t[i - c : i], {})
                    own[s] = own.get(s, 0) + 1
    model = langid.Model(counts, order)
    for t in (b"abra", b"", b"zzz", "süße größe \U0001f600".encode(), b"abracadabra" * 30):
        want = [brute_code_length(models[lang], t, order) for lang in model.languages]
        assert np.allclose(model.lengths([b"q", t])[1], want, rtol=1e-5)
    assert model.predict([b"12 3", b"", b"abra"])[0] == ["und", "und", "a"]


def test_ppm_table_is_bounded():
    grams = np.arange(1000)
    with pytest.raises(ValueError, match="lower the order"):
        langid.Model({"a": {0: (grams[:256], np.ones(256, np.int64)), 1: (grams << 8, np.ones(1000, np.int64))}}, 1, most_bytes=1000)


def test_ppm_without_labels():
    lang, score, _ = langid.Model({}, 3).predict([b"abc", b""])
    assert lang == ["und", "und"] and score.tolist() == [0, 0]


def test_decontamination_spans():
    items = [(1, b"The quick BROWN fox jumps over the lazy dog again and again"), (2, b"short item"), (3, b"!!"), (4, b"short item")]
    block = decontam.Block(items, 10).open()
    text = "x The-quick, brown fox jumps over the lazy dog again y short item café short".encode()
    n, runs, found = decontam._hits(text, [block])
    assert n == 16 and runs == [(1, 11), (12, 14)] and found == {1, 2, 4}
    (a, b), (c, d) = decontam.spans(text, runs)
    assert text.decode()[a:b].startswith("The-quick") and text.decode()[a:b].endswith("again") and text.decode()[c:d] == "short item"
    assert decontam._hits(b"", [block]) == (0, [], set()) and decontam._hits(b"shorts item", [block])[1] == []
    assert decontam.Block([], 10).open().scan([b"x"]) == []


@pytest.mark.parametrize("window", [1, 2, 9, 10])
def test_decontamination_against_all_windows(window):
    r = random.Random(window)
    words = [b"a", b"b", b"c", "d\u00e9".encode()]
    items = [(i, b" ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(12)] + [(90, b"a b c a b"), (91, b"a b c a b")]
    block = decontam.Block(items, window).open()
    for _ in range(60):
        text = [r.choice([*words, b"other"]) for _ in range(r.randint(0, 60))] + items[r.randrange(12)][1].split()[: r.randint(0, 30)]
        want = set()
        for i, t in items:
            own = t.split()
            size = min(window, len(own))
            wins = {tuple(own[p : p + size]) for p in range(len(own) - size + 1)} if size else set()
            want |= {(p, p + size, i) for p in range(len(text) - size + 1) if tuple(text[p : p + size]) in wins}
        assert set(block.scan(text)) == want


def test_a_block_needs_little_memory_a_word():
    import pickle

    r = random.Random(3)
    text = b" ".join(b"%d" % r.randrange(20_000) for _ in range(20_000))
    assert len(pickle.dumps(decontam.Block([(1, text)], 10))) < 60 * 20_000


def test_encoder_equals_the_library():
    encoder = Encoder(sstable.path_of(), most=20)
    odd = ["", " ", "  a  b", "a \n b\n\nc", " a ", "\n\na\n", "don't we'll 's x.", "a <|endoftext|> b", "naïve  café x", "a\x85b \x1c c", "漢字 😀.", "A.B c, d! e: ǅ. ɐz", "1 22 3a", "x\r\ny"]
    r = random.Random(6)
    signs = ["a", "Z", "é", "×", " ", "\n", "\t", "\r", "\xa0", "\u3000", "'", "s", "1", "²", "漢", "😀", ".", "ſ", "ǅ", "ɐ", "\x85", "\x1c"]
    mixed = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    every = [t.encode() for t in [*odd, *texts(5, 60), *mixed, *odd]]
    for ts in (every, [], [b""], [b" "], every[:1]):
        ids, bounds = encoder.encode_all(ts)
        assert len(bounds) == len(ts) + 1
        for i, t in enumerate(ts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.whole(t).tolist(), t


def test_long_texts_are_cut_between_words(monkeypatch):
    encoder = Encoder(sstable.path_of())
    text = ("l'été, 12 words  and\n more <|endoftext|> x" * 40).encode()
    want = encoder.whole(text).tolist()
    monkeypatch.setattr(encoder_module, "SLICE", 100)
    assert encoder.encode_all([b"a b", text, b""])[0].tolist() == encoder.whole(b"a b").tolist() + want
    long = text.replace(b"<|endoftext|>", b"")
    assert len(list(encoder_module._cut(long))) > 5 and encoder.encode_all([long])[0].tolist() == encoder.whole(long).tolist()


def test_other_tokenizers_are_asked_whole():
    encoder = Encoder(sstable.path_of("word_bpe_49k.json"))
    ids, bounds = encoder.encode_all([b"Some Words", b"", "é x".encode()])
    assert not encoder.plain and ids[: bounds[1]].tolist() == encoder.whole(b"Some Words").tolist() and bounds[1] == bounds[2]


def test_shard_round_trip(tmp_path):
    uri = f"file://{tmp_path}/a.sst"
    writer = sstable.Writer(uri, 2)
    rows = [(None, [2]), (-5, [1, 2]), *[(i, [i % 7] * (i % 50) + [2]) for i in range(3000)], (3000, [9, 2]), (3000, [8, 2])]
    for key, ids in rows:
        writer.add(sstable.key_of(key), np.array(ids, "<u2").tobytes())
    writer.close()
    shard = sstable.Shard(uri)
    assert [(sstable.id_of(k), np.frombuffer(v, "<u2").tolist()) for k, v in shard] == rows
    assert shard.docs == len(rows) and len(shard.keys) == 3
    assert [x.tolist() for x in shard.get(1234)] == [rows[1236][1]] and len(shard.get(3000)) == 2 and shard.get(None)[0].tolist() == [2]
    assert shard.get(99999) == [] and sum(shard.may_hold(sstable.key_of(i)) for i in range(10**6, 10**6 + 2000)) < 60


def test_pointer_jumping_keeps_the_chain():
    offsets = np.array([0, 10, 13, 20, 31])
    successors = np.array([10, 20, 31, 40, 99])
    assert warc.reachable(offsets, successors).tolist() == [True, True, False, True, False]
    assert warc.reachable(np.array([3]), np.array([9])).tolist() == [False]
    assert warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_main_text_of_pages():
    cases = {
        "": "",
        "<p>a<b>b</p>c": "ab\n\nc",
        "<div>x <span class='ad'>AD</span> y<br>z</div><ul><li>1<li>2</ul>": "x y z\n\n1\n\n2",
        "<nav>n</nav><article><div class=notice>N</div><h1>T&amp;x</h1><p>  &lt;b&gt;\n c</p><form>f</form><section id='comments'>C</section></article>tail<footer>f": "T&x\n\n<b> c",
        "<p>a < b and c > d</p>": "a < b and c > d",
        "<main><header><h1>T</h1></header><p>x</main><aside>s": "T\n\nx",
        "<script>var a='<p>';</script>z<style>": "z",
        "<!-- <p>no</p> -->ok": "ok",
        "<div class='site-header'>S</div><div class='post-header'><h1>T</h1></div><p>x": "T\n\nx",
    }
    for html, want in cases.items():
        assert templates.Page(html).text(()) == want, html


def test_names_that_only_hold_a_word_keep_their_text():
    inside = {
        '<section id="related-work">w</section>': "w",
        '<div class="share-price">w</div>': "w",
        '<div class="social-history">w</div>': "w",
        '<section class="menu-of-the-day">w</section>': "w",
        "<p>a <math><mi>x</mi></math></p>": "a x",
        "<p>a <label>l</label></p>": "a l",
        "<p>a <noscript>n</noscript></p>": "a n",
        "<p>a</p><xmp><b>raw &amp;</b></xmp><p>c</p>": "a\n\n<b>raw &amp;</b>\n\nc",
        '<p>a</p><div class="ad-slot top">w</div><div class="x comment-list">w</div><div id="cookie-banner">w</div>': "a",
    }
    for html, want in inside.items():
        for name in ("article", "main"):
            assert templates.Page(f"<nav>n</nav><{name}>{html}</{name}>").text(()) == want, html
    assert templates.Page("<noscript>Enable it</noscript><p>x</p>").text(()) == "x"


def test_open_head_ends_where_the_body_begins():
    cases = {
        "<html><head><title>t</title><meta charset=utf-8><body><article><p>x</article>": "x",
        "<head><link rel=a href=b><p>x<p>y": "x\n\ny",
        "<head><style>s</style>\n words <b>here</b>": "words here",
        "<head><template><p>no</p></template><title>t</title></head><body>x": "x",
    }
    for html, want in cases.items():
        assert templates.Page(html).text(()) == want, html


def test_sha1_of_records_is_of_the_payload():
    data = warc.record(7, "http://x/\r\ny", b"abc")
    assert b"WARC-Target-URI: http://x/%0D%0Ay\r\n" in data and hashlib.sha1(b"abc").hexdigest()
