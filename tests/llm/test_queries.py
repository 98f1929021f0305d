"""The operators as Spark plans: odd inputs, brute force, SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import common, decontam, langid, mixing, repetition, simhash, sstable, substrings, templates, urlrules, warc
from factloom.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, component string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "alpha beta gamma " + PASSAGE, "en", "a", 1, "x", 1, "c"),
    (2, PASSAGE + " delta", "en", "a", 1, None, None, None),
    (2, PASSAGE + " delta", "en", "a", 1, None, None, None),
    (3, None, None, None, None, None, None, None),
    (None, "only " + PASSAGE, "fr", "b", 3, "k", 2, "d"),
    (4, "", "fr", "b", 0, "k", 2, "d"),
    (5, LONG, "en", "c", 9, "k", 2, "d"),
    (6, LONG + " end", None, "c", 9, "k", 2, "d"),
    (7, "12 34 !!", "de", None, 9, "k", 2, "d"),
    (8, "le chat noir dort " * 3, "fr", "b", 9, "k", 2, "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repetition(docs, none):
    got = repetition.repetition(docs).withColumn("ok", repetition.passes()).collect()
    assert len(got) == len(ROWS) and sum(r.n_words for r in got) == sum(len(WORD.findall(r[1] or "")) for r in ROWS)
    assert not next(r for r in got if r.id == 5).ok
    assert repetition.repetition(none).collect() == []


def brute_removed(rows, least=13):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - least + 1):
            k = tuple(w[p : p + least])
            first[k] = min(first.get(k, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - least + 1):
            if first[tuple(w[p : p + least])] < (1 << 69 if i is None else i):
                gone.update(range(p, p + least))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=repr)


def test_substrings(docs, none):
    got = substrings.removed(docs).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_removed([r[:2] for r in ROWS])
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substrings.removed(none).collect() == []
    with pytest.raises(TypeError):
        substrings.removed(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_mixing(docs, none):
    got = mixing.taken(docs).collect()
    total = sum(r.size for r in got)
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - min(1.5 * total, 2 * total)) <= 4 * 128 + 0.02 * total
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(5)).collect()))
    assert mixing.taken(none).collect() == [] and mixing.repeated(none).collect() == []
    assert mixing.taken(docs.filter("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0
    again = mixing.repeated(docs)
    assert again.schema == docs.schema and again.filter("text is null").count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_own", "_id", "_tie", "_nth", "_row", "_again", "row", "id", "tie", "copies", "n", "nth", "a.b"]
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "c d e", None), (None, "f", "s"), (3, None, "s")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in names))
    got = mixing.repeated(docs)
    assert got.schema == docs.schema and all(tuple(r)[3:] == tuple(range(len(names))) for r in got.collect())
    assert {r.doc_id for r in got.collect()} <= {1, 2, None} and got.count() >= 3


def test_schedule_is_spread_evenly(spark):
    aims = spark.createDataFrame([("a", 1000, 0, 5000.0), ("b", 1000, 1, 2000.0), ("c", 1000, 2, 1000.0)], "source string, source_size long, nth int, target double")
    got = mixing.schedule(aims, 10).collect()
    assert len(got) == 800
    for nth, share in ((0, 5 / 8), (1, 2 / 8), (2, 1 / 8)):
        own = sorted(r.slot for r in got if r.nth == nth)
        assert sorted(r.rank for r in got if r.nth == nth) == list(range(len(own)))
        for cut in range(50, 801, 50):  # every stretch holds its share
            assert abs(sum(s < cut for s in own) - share * cut) <= 4


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_rejects_magic_inside_payloads(spark, gzip):
    fake = warc.record(99, "http://fake/", b"x" * 10).decode("latin-1")
    big = "z" * 1000
    rows = [(i, f"http://h/{i}", fake * 3 + f"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n{i}") for i in range(30)]
    rows += [(30, "u", big), (31, "u", big), (31, "u", big), (None, None, big), (32, None, None), (33, "u", ""), (34, "u", "é" * 600), (35, "v", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write(pages, common.run_folder(spark, "t"), gzip=gzip)
    got = warc.read(spark, archives, range_bytes=700).collect()
    assert len(got) == len(rows) == sum(a.records for a in archives)
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        want = {30: ("revisit", 31), None: ("revisit", 31), 34: ("revisit", 35)}.get(r.id, ("response", None))
        assert (r.record_type, r.refers_to) == want and (r.payload == html.encode() or r.payload is None and want[0] == "revisit")
    assert warc.read(spark, warc.write(pages.limit(0), common.run_folder(spark, "t"))).collect() == []


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_long_heads_and_corrupt_records(spark, gzip):
    rows = [(1, "http://h/" + "u" * (6 << 20), "<p>x"), (2, "http://h/2", "WARC/1.1\r\nno head\r\n\r\n" * 50), (3, None, "y" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (archive,) = warc.write(pages, common.run_folder(spark, "t"), gzip=gzip)
    got = {r.id: r for r in warc.read(spark, [archive], range_bytes=1 << 20).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].url == rows[0][1] and got[3].payload == rows[2][2].encode()
    fs, path = common.filesystem(archive.uri)
    data = bytearray(fs.open_input_file(path).read())
    at = data.find(b"\x1f\x8b\x08" if gzip else b"WARC/1.", 10)
    data[at : at + 3] = b"???"
    with fs.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="records on the chain"):
        warc.read(spark, [archive], range_bytes=1 << 20).collect()


def test_warc_duplicates_without_broadcast(spark):
    rows = [(i, "u", "z" * 1000 if i % 3 else f"{i}" * 500) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = lambda **kw: sorted((r.id, r.record_type, r.refers_to) for r in warc.read(spark, warc.write(pages, common.run_folder(spark, "t"), **kw)).collect())
    assert read() == read(broadcast_digests=-1) and sum(t == "revisit" for _, t, _ in read()) == 39


def test_simhash_components(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    fps = {r.id: np.uint64(r.fp & 0xFFFFFFFFFFFFFFFF) for r in got}
    ids = list(fps)
    a, b = np.nonzero([[np.bitwise_count(fps[x] ^ fps[y]) <= 2 for y in ids] for x in ids])
    root = simhash.components(a, b, len(ids))
    for r in got:
        own = [ids[k] for k in range(len(ids)) if root[k] == root[ids.index(r.id)]]
        assert r.component == min((i for i in own if i is not None), default=None)
    assert sorted(map(str, got)) == sorted(map(str, simhash.near_duplicates(docs, hot=1).collect()))
    assert simhash.near_duplicates(none).collect() == []


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100)], "a long, b long")
    got = dict(simhash.connected(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_whole_tables_against_brute_force(spark):
    """op1, op5 and op6 on every row of a table."""
    from test_unit import brute_fingerprint, brute_repetition

    folder = "/root/testdata/sf0.001"
    rows = q.table(spark, folder, "documents").collect()
    one = {r.doc_id: r for r in q.op1_repetition(spark, folder).collect()}
    five = {r.doc_id: r for r in q.op5_simhash(spark, folder).collect()}
    six = {r.doc_id: r for r in q.op6_language(spark, folder).collect()}
    assert len(one) == len(five) == len(six) == len(rows)
    for r in rows:
        if len(r.text or "") < 3000:
            n, chars, symbols, lines, repeated, *_ = brute_repetition(r.text or "")
            own = one[r.doc_id]
            assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (n, chars, symbols, lines, repeated)
            assert own.base_failed == (n < 20 or 100 * repeated > 30 * n) and (not own.kept or not own.base_failed)
        assert five[r.doc_id].fingerprint == f"{brute_fingerprint(r.text or ''):016x}"
    ids = sorted(five)
    fps = np.array([int(five[i].fingerprint, 16) for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    root = simhash.components(a, b, len(ids))
    assert [five[i].component_id for i in ids] == [ids[k] for k in root]
    held = [r for r in rows if r.lang and six[r.doc_id].held_out and re.search(r"[^\W\d_]", r.text or "")]
    assert len(held) > 20 and sum(six[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in six if six[i].held_out)


def test_language(docs, none):
    model = langid.fit(docs)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    assert model.languages == ["de", "en", "fr"] and got[8].lang_pred == "fr" and got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und"
    assert got[7].score == 0 and 0 < got[8].score <= 1
    kept = langid.accepted(docs, model)
    assert kept.schema == docs.schema and not {3, 4, 7} & {r.doc_id for r in kept.collect()}
    assert langid.predict(none, langid.fit(none)).collect() == [] and langid.accepted(docs, langid.fit(none)).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, None), (3, "  "), (4, PASSAGE), (None, "le chat")], "item_id long, text string")
    one = decontam.contamination(docs, bench)
    many = decontam.contamination(docs, bench, block_words=5, resident=2)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(one) == rows(many) and one.count() == len(ROWS)
    got = {r.id: r for r in one.collect()}
    assert got[2].n_hit == 60 and got[2].items == [1, 4] and got[8].n_hit == 6 and got[3].n_words == 0
    text = ROWS[0][1]
    assert [text[s.start : s.end] for s in got[1].spans] == [PASSAGE]
    assert rows(decontam.clean(docs, bench)) == rows(decontam.clean(docs, bench, block_words=5, resident=1))
    kept = decontam.clean(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7}
    assert decontam.clean(docs, bench.limit(0)).count() == len(ROWS) and decontam.contamination(none, bench).collect() == []


def test_url_rules_against_suffixes(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "RANGE_ROWS", 20)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", None, "block"), ("b.example.net", "/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("x.org", "/", "block")]
    urls = [None, "", "nourl", "http://net", "http://net/", "https://A.NET/x?y#z", "http://example.net/en/1", "http://b.example.net/en/", "http://cnet/", "http://a.org/fr/", "http://x.org/fr/", "http://a..net/", "http://net./", "ftp://user@example.net/en/?q=/de/"] * 40
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = {r.id: r for r in urlrules.judged(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    fixed = {}
    for h, p, a in rules:
        if h is not None:
            fixed[(h, p or "/")] = "block" if "block" in (a, fixed.get((h, p or "/"))) else a
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), h + p, a) for (h, p), a in fixed.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best[2:]), u
    assert urlrules.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).collect() == []
    assert urlrules.judged(pages, spark.createDataFrame([], "host string, path string, action string")).filter("rule is not null").count() == 0


def digest(text, library=[]):
    """(number of ids with the end id, their CRC-32) by the library alone."""
    if not library:
        library.append(Tokenizer.from_file(sstable.path_of()))
    ids = library[0].encode(text or "", add_special_tokens=False).ids + [2]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_many_nested_paths_of_a_host(spark, monkeypatch):
    import random

    monkeypatch.setattr(urlrules, "RANGE_ROWS", 10)
    r = random.Random(5)
    step = lambda n: "".join(r.choice(["/", "a", "b", "é", "\U0010ffff"]) for _ in range(r.randint(0, n)))
    hosts = ["net", "h.net", "x.h.net", "org"]
    rules = {(r.choice(hosts), "/" + step(5)): r.choice(["allow", "block"]) for _ in range(400)}
    urls = [f"s://{r.choice(['h.net', 'x.h.net', 'q.x.h.net', 'net', 'other', 'org'])}/{step(8)}" for _ in range(300)]
    df = spark.createDataFrame([(h, p, a) for (h, p), a in rules.items()], "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {x.id: (x.rule, x.verdict) for x in urlrules.judged(pages, df).collect()}
    for i, u in enumerate(urls):
        host, _, path = u[4:].partition("/")
        fits = [(len(h + p), len(h), h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == max(fits, default=(0, 0, None, "allow"))[2:], u


def test_token_shards_of_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = q.table(spark, folder, "documents").collect()
    got = {r.doc_id: r for r in q.op9_token_shards(spark, folder).collect()}
    at = 0
    for row in sorted(rows, key=lambda r: r.doc_id):
        assert (got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32, got[row.doc_id].start) == (*digest(row.text), at)
        at += got[row.doc_id].n_tokens


def test_token_shards(spark, docs, none):
    manifest = sstable.write(docs, common.run_folder(spark, "t"), sstable.path_of())
    got = sstable.read(spark, manifest).orderBy("start").collect()
    assert [r.id for r in got] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    own = [(r[0], *digest(r[1])) for r in ROWS]
    assert sorted(((r.id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(own, key=repr)
    few = sstable.write(docs.withColumn("doc_id", F.col("doc_id").cast("string")), common.run_folder(spark, "t"), sstable.path_of(), shard_docs=2)
    assert len(few) > 3 and sorted(((r.id, r.n_tokens) for r in sstable.read(spark, few, "string").collect()), key=repr) == sorted(((None if i is None else str(i), n) for i, n, _ in own), key=repr)
    assert sstable.lookup(manifest, 4)[0].tolist() == [2] and len(sstable.lookup(manifest, 2)) == 2 and sstable.lookup(manifest, 77) == []
    assert sstable.write(none, common.run_folder(spark, "t"), sstable.path_of()) == [] and sstable.read(spark, []).collect() == []


def test_templates_are_counted_per_host(spark):
    page = lambda i, extra: f"<body><div>Site of things, welcome</div><div><p>Story {i} " + "word " * 30 + f"{i}</p></div>{extra}</body>"
    rows = [(i, f"http://h.example/{i}", page(i, "<div>Share this</div>")) for i in range(20)]
    rows += [(100 + i, f"http://one.example/{i}", page(i, "")) for i in range(3)] + [(200, None, None), (None, "x", "<p>q</p>"), (201, "http://h.example/a", page(7, "<p>new</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    shared = templates.main_text(pages)
    joined = templates.main_text(pages, broadcast_hashes=-1)
    got = {r.id: r.text for r in shared.collect()}
    assert sorted(map(str, shared.collect())) == sorted(map(str, joined.collect())) and len(got) == len(rows)
    assert got[3] == " ".join(f"Story 3 {'word ' * 30}3".split()) and got[100].startswith("Site of things") and got[200] == "" and got[None] == "q" and got[201].endswith("\n\nnew")
    assert templates.main_text(pages.limit(0)).collect() == []


def page_of_shop(i, shared):
    return f"<body><nav><ul>{''.join(f'<li><a>m{i}{k}</a></li>' for k in range(i % 4 + 2))}</ul></nav><div class=ad>ad {i}</div><article><h1>T {i}</h1><p>story {i}</p><div class=box>{shared}</div><p>{'word ' * 20}{i}</p></article><footer>foot {i}</footer>"


def test_the_count_alone_finds_menus_whose_words_change(spark):
    rows = [(i, f"http://s.example/{i}", page_of_shop(i, "Buy now" if i % 2 else f"own {i}")) for i in range(30)]
    rows += [(100 + i, f"http://few.example/{i}", page_of_shop(i, "x")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    alone = {r.id: r for r in templates.main_text(pages, rules=False).collect()}
    none = {r.id: r for r in templates.main_text(pages, rules=False, least_pages=1000).collect()}
    both = {r.id: r for r in templates.main_text(pages).collect()}
    for i in range(30):  # enough pages: rules change nothing that the count has not deleted
        assert alone[i].text == both[i].text and "foot" not in alone[i].text and "Buy now" not in alone[i].text and f"story {i}" in alone[i].text
        assert none[i].text != alone[i].text and none[i].text.startswith("m") and alone[i].n_counted > 0
        assert (f"own {i}" in alone[i].text) == (i % 2 == 0)
    assert "foot 1" in alone[101].text and "foot" not in both[101].text  # a host of few pages is left to the rules


def test_counts_of_subtrees_against_brute_force(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page_of_shop(i, ["x", "y", f"z{i}"][i % 3])) for i in range(60)] + [(None, None, None), (1, "http://a.example/", "<p>q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    total, on, above, shapes = {}, {}, {}, {}
    for _, url, html in rows:
        host = templates.host_of(url)
        pieces, own = templates.Page(html or "").subtrees()
        total[host] = total.get(host, 0) + 1
        for h in {h for h, _ in pieces}:
            on[host, h] = on.get((host, h), 0) + 1
        for h, a in pieces:
            above.setdefault((host, h), set()).add(a)
        for h in own:
            shapes[host, h] = shapes.get((host, h), 0) + 1
    enough = lambda host, n: n >= 5 and n >= 0.2 * total[host]
    want = {k for k, n in on.items() if enough(k[0], n) and len(above[k]) >= 5} | {k for k, n in shapes.items() if enough(k[0], n)}
    got = {(r.host, r.hash) for r in templates.templates(pages, least_pages=5, share=0.2).collect()}
    assert got == want and len(want) > 8


def test_templates_are_counted_by_pages(spark):
    table = "<table>" + "".join(f"<tr><td>row {i}</td><td>Yes</td></tr>" for i in range(12)) + "</table>"
    rows = [(0, "http://t.example/0", f"<body>{table}<p>the end</p></body>")]
    rows += [(i, f"http://t.example/{i}", f"<body><div>Site of things</div><p>story {i}</p>{'<h2>Results</h2>' if i <= 12 else ''}<p>{'word ' * 20}{i}</p></body>") for i in range(1, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.id: r.text for r in templates.main_text(pages).collect()}
    assert got[0].split("\n\n").count("Yes") == 12  # many places of one page
    assert "Results" in got[5].split("\n\n")  # 12 of 200 pages are not many
    assert "Site of things" not in got[5] and got[5].startswith("story 5")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(q.ORACLES[name]).df()
    got = q.QUERIES[name](spark, folder).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(df):
        return sorted(tuple("" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None))

    floats = [c for c in cols if "float" in str(want[c].dtype) or "float" in str(got[c].dtype)]
    assert rows(got.astype({c: float for c in floats})) == rows(want.astype({c: float for c in floats}))


def test_very_long_pages_and_urls_and_repeated_rows(spark):
    long = "<article>" + "<p>word </p>" * 60_000 + "</article>"
    url = "http://h.example.net/" + "p/" * 100_000 + "?q"
    rows = [(1, url, long), (1, url, long), (None, url, "<p>x"), (None, None, None), (2, "http://net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    text = sorted(((r.id, len(r.text)) for r in templates.main_text(pages).collect()), key=repr)
    assert text == sorted([(1, 60_000 * 6 - 2), (1, 60_000 * 6 - 2), (None, 1), (None, 0), (2, 0)], key=repr)
    rules = spark.createDataFrame([("net", "/p/p/", "block")], "host string, path string, action string")
    got = sorted(((r.id, r.verdict, len(r.path)) for r in urlrules.judged(pages, rules).collect()), key=repr)
    assert got == sorted([(1, "block", 200_001), (1, "block", 200_001), (None, "block", 200_001), (None, "allow", 0), (2, "allow", 1)], key=repr)


def test_pipeline_of_an_empty_table(spark, none):
    import corpus_pipeline

    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.collect() == []


def test_pipeline_of_nulls_and_clashing_columns(spark):
    import corpus_pipeline

    rows = [(None, None, None, None, None, 1), (1, "", None, None, 0, 2), (2, "The words of this text are English, and that is what they are for.", None, None, 1, 3), (None, "The words of this text are English, and that is what they are for.", "en", "s", 1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tie long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if i < 4:
            assert docs.columns[-1] == "tie"
            docs = common.materialise(docs, "t")
    assert {r.doc_id for r in docs.collect()} <= {2, None} and docs.count() >= 1


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = first = q.table(spark, folder, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
            docs = common.materialise(docs, "t")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() > 100


@pytest.mark.parametrize("name", ["op3_mixing", "op8_url_rules"])
def test_native_operators_run_no_python(spark, name):
    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
