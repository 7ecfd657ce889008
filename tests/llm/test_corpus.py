"""Corpus operators against brute force, exact round trips and defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarryflow.llm import bpe_lexicon, exact_dedup, fingerprints, mixing, ngram_join, substring_dedup, tag_paths, token_rollups, toxicity, warc  # noqa: E402
from quarryflow.llm.common import row_key, scratch  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(60, 220))] for _ in range(n)]
    shared = [r.choice(words) for _ in range(70)]
    out = []
    for k in range(n):
        w = list(base[k])
        if k % 4 == 0:
            w[10:10] = shared
        if k % 6 == 5:
            w = list(base[k - 1])
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    for v in range(25):  # a group of near copies, some of which link by way of others only
        w = list(base[0])
        for _ in range(v % 5 * 2):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out + ["", None, "  \n ", "one", "ONE", "one two three", out[3], out[3].upper(), "short " * 200]


def test_substring_dedup_equals_brute_force(spark):
    texts = corpus()
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == expected and any(x[1] for x in got.values())


def components_of(texts, level=85):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    moved = True
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("few", "halved"), [(8.0, 0), (0.0, 0), (8.0, 3)])  # 3: so few parts that sets need their single members
def test_ngram_join_equals_brute_force(spark, few, halved, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMPARED", 1000 if few else 0)
    monkeypatch.setattr(ngram_join, "LEADS", 8 if few else 1)
    monkeypatch.setattr(ngram_join._link, "__defaults__", (few,))
    monkeypatch.setattr(ngram_join, "BLOCK", 16384 if few else 64)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs_of(spark, texts), halved=halved).collect()}
    expected = components_of(texts)
    assert got == expected and len({c for _, c in got.values()}) < len(texts) - 10


def test_ngram_join_finds_every_pair_of_random_sets():
    """Linked sets of all sizes meet in more keys than a set without links may have."""
    r = np.random.default_rng(4)
    for size in (*range(1, 12), 30, 54, 60, 63, 64, 70, 110, 127, 128, 200, 255, 256, 300, 1000):
        for _ in range(12):
            common = r.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = int(r.integers(0, size * 15 // 100 + 1))
            more = max(0, (size - gone) * 100 // 85 - size)
            pair = [common, np.concatenate((common[gone:], r.integers(0, 1 << 63, int(r.integers(0, more + 1)), dtype=np.uint64)))]
            pair = [np.unique(x << np.uint64(1)) for x in pair]
            x, y = (len(p) for p in pair)
            shared = len(np.intersect1d(*pair))
            assert 100 * shared >= 85 * (x + y - shared)
            met = 0
            for cls in range(5, 12):
                keys = []
                for p in pair:
                    n = np.array([len(p)])
                    if ngram_join.size_class(n)[0] <= cls <= ngram_join.size_class(n * 100 // 85)[0]:
                        found, _, few = ngram_join.parts_of(p, np.zeros(len(p), dtype=int), n, np.array([cls]), 85)
                        keys.append(set(found.tolist()) if not few[0] else None)
                if len(keys) == 2:
                    met = max(met, 1 if None in keys else int(len(keys[0] & keys[1]) > ngram_join.spare(np.array([cls]))[0]))
            assert met, (x, y, shared)


def test_exact_dedup_equals_brute_force_also_when_digests_clash(spark):
    texts = corpus() + ["a b", "ab", "a  b ", "ba", None]
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    expected = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        expected |= {i: (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids}
    for digest in (exact_dedup.digest_of, lambda t: F.substring(F.sha2(t, 256), 1, 1)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.assign(docs_of(spark, texts), digest).collect()}
        assert got == expected
    kept = exact_dedup.drop_copies(docs_of(spark, texts).union(docs_of(spark, texts[:3])).withColumn("row", F.lit(1)).withColumn("kept", F.lit(False)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in expected.items() if x[2])


def test_exact_dedup_state_outlives_a_call(spark):
    """Several micro-batches, a restart with the same state, and arrivals of a second day that meet those of the first."""
    state = scratch(spark, "kept")
    first, second = docs_of(spark, ["a b", "c", "a  b", "c", None], [1, 2, 3, 4, 5]).repartition(5), docs_of(spark, ["a   b", "d", "c", ""], [11, 12, 13, None]).repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(first, max_files=1, state=state).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 2, True), 4: (2, 2, False), 5: (5, 1, True)}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(second, max_files=1, state=state, earlier=first).collect()}
    assert got == {11: (11, 3, True), 12: (12, 1, True), 13: (2, 3, False), None: (5, 2, False)}


def test_prefix_hashes_find_common_extensions():
    a, b = (fingerprints.PrefixHash(fingerprints.code_points(x)) for x in ("xxabcdefé😀z", "abcdefé😀y"))
    assert a.common_extension(2, b, 0) == 8 and a.common_extension(0, b, 0) == 0 and a.equal(2, b, 0, 8) and not a.equal(2, b, 0, 9)


def test_fingerprints_of_edited_texts(spark):
    texts = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        c = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()
    assert len({r.fingerprint for r in got.values()}) <= len(set(t or "" for t in texts))
    long = [i for i, t in enumerate(texts[:50]) if i % 6 not in (4, 5)]
    assert np.mean([got[i].near_edited > got[i].near_next for i in long]) > 0.95
    assert fingerprints.fingerprint_with_next(docs_of(spark, ["only"], [9])).first().near_next == 1.0


def test_fingerprints_follow_exact_shares(spark):
    """near_edited and near_next against the exact share of word spans, and common beginnings letter by letter."""
    texts = corpus()
    spans = lambda t: {" ".join(w[k : k + 5]) for w in [(t or "").split(" ")] for k in range(len(w) - 4)}
    share = lambda a, b: len(a & b) / max(1, len(a | b))
    begin = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    off = []
    for r in fingerprints.fingerprint_with_next(docs_of(spark, texts)).collect():
        t, n = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert (r.same_edited, r.same_next) == (begin(t, edited), begin(t, n))
        if min(len(spans(x)) for x in (t, n, edited)) > 50:
            off += [abs(r.near_edited - share(spans(t), spans(edited))), abs(r.near_next - share(spans(t), spans(n)))]
    assert len(off) > 100 and np.mean(off) < 0.05 and max(off) < 0.25


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = fingerprints.fingerprint_with_next(docs_of(spark, ["x y"] * 3000 + ["a" * 200000, None], [None] * 2500 + [7] * 500 + [8, 8]))
    assert rows.where("doc_id is null").count() == 2500 and rows.where("doc_id = 7").count() == 500
    assert sorted(r.n_chars for r in rows.where("doc_id = 8").collect()) == [0, 200000]


def test_likeness_across_the_limit_of_short_texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(60)]
    mark = lambda w: fingerprints.fingerprint(fingerprints.code_points(" ".join(w)))
    for n in range(17, 24):  # 20 words have the least spans that are compared by words
        assert fingerprints.likeness(mark(words[:n]), mark(words[: n - 1])) > 0.6
        assert fingerprints.likeness(mark(words[:n]), mark(words[30 : 30 + n])) < 0.1
        own, long = (fingerprints.code_points(" ".join(x)) for x in (words[:n], ["x" * 400]))
        assert fingerprints.likeness(fingerprints.fingerprint(own), fingerprints.fingerprint(fingerprints.edited(own, long))) > 0.4
    near = [fingerprints.likeness(mark(words[:n]), mark([*words[: n - 2], "other", "words"])) for n in range(8, 40)]
    assert all(abs(x - y) < 0.2 for x, y in zip(near, near[1:]))  # no step at any size


def test_warc_round_trip(spark):
    long = "é" * 700
    pages = [(1, "http://a/x", long), (2, "http://b", long), (3, None, None), (4, "u", "WARC/1.1\r\n\r\nshort\r\n\r\n"), (5, "u", "WARC/1.1\r\n\r\nshort\r\n\r\n"), (6, "u", "x" * 2000), (6, "u", "x" * 2000), (None, "n", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    nested = warc.assemble(warc.read_archives(spark, warc.write_archives(df, scratch(spark, "warc"))))
    table = warc.capture_table(nested).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = [(str(i), len((t or "").encode()), sha(t), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, t in pages]
    expected[6] = ("6", 2000, sha("x" * 2000), "revisit", 6)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in nested.collect())


def test_warc_headers_and_lost_responses(spark):
    df = spark.createDataFrame([(1, "http://a/\r\n\r\nx y", "z" * 1500), (2, "u\tv", "z" * 1500)], "page_id long, url string, html string")
    found = warc.read_archives(spark, warc.write_archives(df, scratch(spark, "warc")))
    assert {r.uri for r in found.collect()} == {"http://a/%0D%0A%0D%0Ax y", "u%09v"}
    alone = warc.capture_table(warc.assemble(found.where("kind != 'response'"))).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in alone] == [(1, 0, hashlib.sha1(b"z" * 1500).hexdigest(), "revisit", None)]
    record = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <r>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [x[3] for x in warc.parse(record * 2)] == [["<a>", "<b>"]] * 2


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(5)
    pool = "abcXYZ éÉßΣς'’́ͅİı12½²🙂<|>\t \x1d.,-_#"
    texts = corpus()[:40] + ["<|endoftext|>abc <|STARTOFTEXT|> x<|startoftext|>", "word" * 400, None, "", "  ", "don't I'LL"] + ["".join(r.choice(pool) for _ in range(50)) for _ in range(300)]
    rows = bpe_lexicon.encode(docs_of(spark, texts), path, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert list(row.ids) == ids and row.decoded == text and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_ends_with_ids_that_decode(spark):
    import corpus_pipeline

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, don't split <|endoftext|> éß", "", None, "word" * 50]
    out = corpus_pipeline.encode(spark, docs_of(spark, texts), "")
    rows = bpe_lexicon.decode(out.withColumnRenamed("decoded", "was"), path).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.n_tokens == len(row.ids) and row.decoded == row.was
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    foreign = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    names = bpe_lexicon.Merges(path).names
    assert [r.decoded for r in bpe_lexicon.decode(foreign, path).collect()] == [None, "", f"{names[0]} {names[1]}"]


def test_lexicon_shares_suffixes_and_maps_ids(tmp_path):
    words = {f"{a}{b}ing": [i, j] for i, a in enumerate(("play", "work", "read", "")) for j, b in enumerate(("", "s", "er"))}
    path = str(tmp_path / "lexicon.bin")
    bpe_lexicon.compile_lexicon(words, path)
    lexicon = bpe_lexicon.Lexicon(path)
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert lexicon.get("playin") is None and lexicon.get("xing") is None and lexicon.get("") is None
    assert len(lexicon.first) - 1 < sum(map(len, words)) / 3
    bpe_lexicon.compile_lexicon({}, path)
    assert bpe_lexicon.Lexicon(path).get("a") is None


ARTICLE = "<h1>Title here</h1><p>First paragraph, with a &amp; and <b>bold</b>\n text. It goes on, and on.</p><p>Second one, of some length; it too has commas, and stops.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a>Menu</a></nav><article>{ARTICLE}</article><footer>Foot, note.</footer></body></html>",
        f"<body><header>Site, name.</header><div id=main>{ARTICLE}</div><aside>More, here.</aside><div class='comments'><p>Nice post, really, thanks.</p></div></body>",
        f"<body><div class=cookie-notice>We use cookies, ok.</div><main>{ARTICLE}<form>Your mail, please <input></form></main><script>var a='<p>no</p>';</script></body>",
        f"<body><div class=ad>Buy, now.</div><article>{ARTICLE}<section class=comments>A reader, says.</section></article><style>p{{}}</style>",
    ],
)
def test_html_extraction(page):
    assert tag_paths.main_text(page) == "Title here\nFirst paragraph, with a & and bold text. It goes on, and on.\nSecond one, of some length; it too has commas, and stops."


SENTENCES = ["One part has words, and stops. " * n for n in (11, 9, 16, 4)]


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        ("<body><main><article><p>{0}</p></article><section><h2>More</h2><p>{1}</p></section></main></body>", "{0}|More|{1}"),
        ("<body><article><p>{0}</p></article><article><p>{1}</p></article><div>Site map</div></body>", "{0}|{1}"),
        ("<body><div><section><p>{2}</p></section><section><p>{3}</p></section></div></body>", "{2}|{3}"),
        ("<body><article><p>{0}</p></article><h2>More</h2><p>{1}</p><footer>Foot, note.</footer></body>", "{0}|More|{1}"),
        ("<body><h2>More</h2><p>{0}</p><p>{1}</p></body>", "More|{0}|{1}"),
        ("<body><article><p>{0}</p></article><article><p>{0}</p></article><section><p>{1}</p></section></body>", "{0}|{0}|{1}"),
    ],
)
def test_html_content_in_several_containers(page, parts):
    assert tag_paths.main_text(page.format(*SENTENCES)) == "\n".join(x.strip() for x in parts.format(*SENTENCES).split("|"))


NEUTRAL = "<body><div class=a><div class=b><a href=/>Home</a><a href=/x>About us</a></div><div class=c><h1>Title</h1><p>{0}</p><ul><li>One</li></ul><p>{1}</p><p><a href=/n>Next</a></p></div><div class=d>Rights reserved</div></div></body>"


def test_html_scores_choose_the_content(monkeypatch):
    """Neutral names and no article: what is content comes from the scores, and is another with constant ones."""
    want = "\n".join(("Title", SENTENCES[0].strip(), "One", SENTENCES[1].strip(), "Next"))
    page = NEUTRAL.format(*SENTENCES)
    got = tag_paths.main_text(page)
    assert [x for x in got.split("\n") if x != "Next"] == want.split("\n")[:-1]
    monkeypatch.setattr(tag_paths, "path_scores", lambda elements, above, found: {elements[x.element].path: 1.0 for x in found})
    assert "Rights reserved" in tag_paths.main_text(page) and "Home" in tag_paths.main_text(page)


def test_html_honest_parts_stay_and_depth_is_linear():
    import time

    assert tag_paths.main_text("just text, with no tags") == "just text, with no tags"
    page = "<body><article><header><h1>Head</h1></header><section id=related-work><p>{0}</p></section><p class=note-side-effects>{1}</p><div class=related-posts><p>{3}</p></div></article></body>"
    assert tag_paths.main_text(page.format(*SENTENCES)) == "\n".join(("Head", SENTENCES[0].strip(), SENTENCES[1].strip()))
    for page in ("<div>" * 20000 + "deep, text.", "<i>" * 20000 + "deep, text.", "<p><span>" * 10000 + "deep, text." + "</b></p>" * 10000):
        began = time.perf_counter()
        assert tag_paths.main_text(page) == "deep, text." and time.perf_counter() - began < 2


def test_html_edges(spark):
    for page in (None, "", "<html></html>", "<p", "<!-- x", "<script>x", "<" * 2000):
        assert isinstance(tag_paths.main_text(page), str)
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>Hi, there.</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in tag_paths.extract(df).collect()) == ["", "Hi, there."]


def test_toxicity_on_held_out_texts():
    r = random.Random(1)
    words = ["".join(r.choice("aeioust") + r.choice("nlrmk") for _ in range(r.randint(1, 4))) for _ in range(800)]
    bad = ["grobzwix", "vlaxnurf", "pizquog"]

    def make(toxic):
        w = [r.choice(words) for _ in range(r.randint(20, 150))]
        for _ in range(max(1, len(w) // 25) if toxic else 0):
            b = r.choice(bad)
            w[r.randrange(len(w))] = b[:-1] + r.choice("xyz") if r.random() < 0.3 else b  # misspelt now and then
        return " ".join(w)

    labels = np.array([k % 5 == 0 for k in range(900)]).astype(int)
    texts = [make(y) for y in labels]
    model = toxicity.train(texts[:600], labels[:600], 0.2)
    score = 1 / (1 + np.exp(-model.logits([*texts[600:], ""])))
    assert np.mean((score[:-1] >= toxicity.CUT) == labels[600:]) > 0.95 and 0 <= score[-1] < toxicity.CUT
    assert model.logits([""])[0] == model.logits([" \t.,"])[0] == model.base
    assert toxicity.train([], np.zeros(0), 0.0).logits(["x"]).shape == (1,)


def test_mixing_redistributes_among_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100, 1), ("web", "en", "b", 1000, 1), ("web", "fr", "c", 1000, 1), ("code", "en", "d", 5000, 1)], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.quota for r in mixing.quotas(leaves, {("web",): 1.0, ("code",): 1.0}, share=0.25, max_epochs=1).collect()}
    # 1775 in all: 887 to each domain; 443 to each language of web; of en, a is full at 100 and b takes the rest
    assert got == {"a": 100, "b": 343, "c": 443, "d": 887}
    # a weight of 0 beside one that is full gets nothing
    none = {r.source: r.quota for r in mixing.quotas(leaves, {("web",): 1.0, ("code",): 0.0}, share=0.9, max_epochs=1).collect()}
    assert none == {"a": 100, "b": 1000, "c": 1000, "d": 0}


def test_mixing_takes_prefixes_of_epochs(spark):
    docs = docs_of(spark, [" ".join(["w"] * (5 + i % 7)) for i in range(300)] + [None, ""])
    for epochs, share in ((1, 0.5), (3, 2.5)):
        taken = mixing.mix(docs, {}, share, epochs).collect()
        by = {}
        for r in taken:
            by.setdefault((r.domain, r.lang, r.source), []).append(r)
        for own in by.values():
            total = sum(r.n_tokens for r in own)
            assert own[0].quota <= total < own[0].quota + 12
        assert max(r.epoch for r in taken) == epochs
        again = mixing.mix(docs.repartition(7), {}, share, epochs).collect()
        assert sorted(map(str, taken)) == sorted(map(str, again))


def deal(budget, weights, capacity):
    """Budgets of siblings, by filling the small ones round by round."""
    w = dict(weights) if max(weights.values()) > 0 else dict.fromkeys(weights, 1.0)
    full: set = set()
    while True:
        given, open_ = budget - sum(capacity[k] for k in full), [k for k in w if k not in full]
        total = sum(w[k] for k in open_)
        more = {k for k in open_ if w[k] > 0 and capacity[k] * total <= w[k] * given}
        if not more:
            level = given / total if total else 0.0
            return {k: capacity[k] if k in full else int(w[k] * level // 1) for k in w}
        full |= more


def deal_tree(leaves, weights, budget, above=()):
    """Quotas of leaves (path -> capacity), a family at a time from the root."""
    if len(above) == 3:
        return {above: budget}
    children: dict = {}
    for p, c in leaves.items():
        if p[: len(above)] == above:
            children[p[: len(above) + 1]] = children.get(p[: len(above) + 1], 0) + c
    out: dict = {}
    for child, share in deal(budget, {k: weights.get(k, 1.0) for k in children}, children).items():
        out |= deal_tree(leaves, weights, share, child)
    return out


def test_mixing_quotas_equal_brute_force_on_random_trees(spark):
    r = random.Random(11)
    for _ in range(4):
        tokens = {(f"d{a}", f"l{b}", f"s{c}"): r.choice([0, 1, r.randint(2, 90), r.randint(500, 20000)]) for a in range(3) for b in range(r.randint(1, 3)) for c in range(r.randint(1, 4))}
        nodes = {p[:n] for p in tokens for n in (1, 2, 3)}
        weights = {p: r.choice([0.0, 0.25, 1.0, 2.0, 8.0]) for p in nodes if r.random() < 0.6}
        share, epochs = r.choice([(0.3, 1), (0.9, 1), (1.7, 2), (5.0, 3)])
        leaves = spark.createDataFrame([(*p, n, 1) for p, n in tokens.items()], "domain string, lang string, source string, tokens long, docs long")
        got = {(x.domain, x.lang, x.source): x.quota for x in mixing.quotas(leaves, weights, share, epochs).collect()}
        assert got == deal_tree({p: n * epochs for p, n in tokens.items()}, weights, int(sum(tokens.values()) * share // 1))


def mixed(docs, weights, share, epochs):
    """The (doc_id, epoch) that a mix takes, leaf by leaf in the seeded order, and the ids of rows without tokens."""
    spark = docs.sparkSession
    rows = [x.asDict() for x in docs.select("doc_id", "source", "lang", row_key().alias("row_key"), mixing.domain_of(F.col("source")).alias("domain"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")).collect()]
    leaf_of = lambda x: (x["domain"], x["lang"], x["source"])
    tokens: dict = {}
    for x in rows:
        tokens[leaf_of(x)] = tokens.get(leaf_of(x), 0) + x["n"]
    quota = deal_tree({p: n * epochs for p, n in tokens.items()}, weights, int(sum(tokens.values()) * share // 1))
    order = spark.createDataFrame([(x["doc_id"], x["row_key"], quota[leaf_of(x)] // tokens[leaf_of(x)]) for x in rows], docs.select("doc_id", row_key().alias("row_key"), F.lit(0).alias("whole")).schema)
    place = {x.doc_id: x.at for x in order.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "whole", "doc_id", "row_key").alias("at")).collect()}
    want = []
    for leaf, q in quota.items():
        whole, rest, before = q // tokens[leaf], q % tokens[leaf], 0
        for x in sorted((x for x in rows if leaf_of(x) == leaf), key=lambda x: place[x["doc_id"]] % 2**64):
            want += [(x["doc_id"], e) for e in range(1, whole + (before < rest) + 1)]
            before += x["n"]
    return want, {x["doc_id"] for x in rows if x["n"] == 0}  # rows without tokens go with their bin


def test_mixing_takes_the_same_rows_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 8)
    r = random.Random(5)
    docs = docs_of(spark, [" ".join(["w"] * r.randint(0, 40)) for _ in range(240)] + [None, "", "same text", "same text"])
    weights, share, epochs = {("books",): 4.0, ("web", "en", "src0"): 2.0}, 1.3, 2
    want, free = mixed(docs, weights, share, epochs)
    got = [(x.doc_id, x.epoch) for x in mixing.mix(docs, weights, share, epochs).collect()]
    assert sorted(x for x in got if x[0] not in free) == sorted(x for x in want if x[0] not in free)


def test_pipeline_equals_brute_force_stage_by_stage(spark, monkeypatch):
    """Each stage of a whole run against brute force on all that its predecessor kept."""
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from quarryflow.llm import common

    r = random.Random(8)
    words = ["".join(r.choice("aeioust") + r.choice("nlrmk") for _ in range(r.randint(1, 4))) for _ in range(600)]
    bad = ["grobzwix", "vlaxnurf", "pizquog"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) for _ in range(260)]
    for k in range(0, 260, 4):
        w = texts[k].split(" ")
        for _ in range(2 + len(w) // 15):
            w[r.randrange(len(w))] = r.choice(bad)
        texts[k] = " ".join(w)
    toxic = set(range(0, 260, 4))
    for k in range(1, 200, 4):
        near = texts[k].split(" ")
        near[-1] = "changed"
        texts += [texts[k].replace(" ", "  ", k % 3), texts[k], " ".join(near)]
    texts += ["", None, " ", "one two"]
    folder = scratch(spark, "sf")
    docs_of(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages, write = {}, common.materialise

    def note(df, name):
        stages[name] = write(df, name)
        return stages[name]

    monkeypatch.setattr(common, "materialise", note)
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES[:-1]] and all(x.columns == docs.columns for x in stages.values())
    rows = {name: {x.doc_id: x.text for x in df.collect()} for name, df in stages.items()}
    assert all(df.count() == len(rows[name]) for name, df in stages.items())

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    cut = np.log(toxicity.CUT / (1 - toxicity.CUT))
    clean = {i for i, t in enumerate(texts) if model.logits([t or ""])[0] < cut}
    assert set(rows["toxicity"]) == clean and len(clean & toxic) <= 3 and len(clean) >= len(texts) - len(toxic) - 3

    groups: dict = {}
    for i, t in rows["toxicity"].items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    assert set(rows["exact_dedup"]) == {min(ids, key=lambda i: (-len(texts[i] or ""), i)) for ids in groups.values()}

    ids = sorted(rows["exact_dedup"])
    found = components_of([rows["exact_dedup"][i] for i in ids])
    assert set(rows["near_dedup"]) == {ids[k] for k, (n, c) in found.items() if n == 0 or c == k} and len(rows["near_dedup"]) < len(ids) - 20

    want, free = mixed(stages["near_dedup"], mixing.WEIGHTS, mixing.SHARE, 1)
    assert set(rows["mixing"]) - free == {i for i, _ in want} - free and len(rows["mixing"]) < len(rows["near_dedup"])

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(x.doc_id for x in out) == sorted(rows["mixing"])
    for x in out:
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert list(x.ids) == ids and x.decoded == library.decode(ids, skip_special_tokens=False)


def test_rollups_commit_once(spark):
    root = scratch(spark, "rollups")
    rows = spark.createDataFrame([(1, "s", None, "v", 5), (2, "s", None, "v", 7), (3, None, "en", "v", None)], "doc_id long, source string, lang string, version string, n long")
    batch = token_rollups.changes("insert", rows, new="n")
    assert token_rollups.commit(spark, root, 1, batch) and not token_rollups.commit(spark, root, 1, batch)
    token_rollups.commit(spark, root, 2, token_rollups.changes("delete", rows.where("doc_id = 1"), old="n"))
    token_rollups.commit(spark, root, 3, token_rollups.changes("revise", rows.where("doc_id = 2").withColumn("m", F.lit(10)), old="n", new="m"))
    token_rollups.delta(batch).write.parquet(f"{root}/deltas/batch=9")  # an attempt without its marker does not count
    want = [("None", "en", "v", 1, 0), ("s", "None", "v", 1, 10)]
    assert sorted((str(r.source), str(r.lang), r.version, r.docs, r.tokens) for r in token_rollups.totals(spark, root).collect()) == want
    to = token_rollups.compact(spark, root, scratch(spark, "compact"))
    assert sorted((str(r.source), str(r.lang), r.version, r.docs, r.tokens) for r in token_rollups.totals(spark, to).collect()) == want


def test_rollups_of_documents_equal_brute_force(spark):
    """Every row counts, also those with null or repeated ids; tokens are those of the library."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = corpus()[:30] + ["short one", "", None, "x " * 30, "x " * 30]
    ids = [None if i % 7 == 0 else i // 2 for i in range(len(texts))]
    folder = scratch(spark, "rows")
    for rows, name in ((docs_of(spark, texts, ids).withColumn("version", F.lit("clash")).withColumn("n_tokens", F.lit(1)), "some"), (docs_of(spark, []), "none")):
        rows.write.parquet(f"{folder}/{name}/documents.parquet")
    want: dict = {}
    for i, t in enumerate(texts):
        n = len(WORD.findall(t or ""))
        for version, tokens in (("words-1", n), ("word_bpe_49k", len(library.encode(t or "", add_special_tokens=False).ids))):
            have = want.setdefault((f"src{i % 5}", version), [0, 0])
            have[0] += n >= token_rollups.SHORT
            have[1] += tokens if n >= token_rollups.SHORT else 0
    got = {(r.source, r.version): [r.docs, r.tokens] for r in token_rollups.op10_token_rollups(spark, f"{folder}/some").collect()}
    assert got == want
    assert token_rollups.op10_token_rollups(spark, f"{folder}/none").count() == 0


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert ngram_join.components(docs).count() == 0
    assert exact_dedup.assign(docs).count() == 0
    assert fingerprints.fingerprint_with_next(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert bpe_lexicon.encode(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert tag_paths.extract(pages).count() == 0
    assert warc.capture_table(warc.assemble(warc.read_archives(spark, warc.write_archives(pages, scratch(spark, "warc"))))).count() == 0


def test_null_ids_and_extra_columns(spark):
    texts = [" ".join(["w"] * 5 + [str(k)]) for k in range(4)] + [None]
    docs = docs_of(spark, texts, [None, None, 2, 3, 4])
    for c in ("row_key", "n", "sig", "digest", "token", "kept", "row", "score", "bucket"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert substring_dedup.remove_repeats(docs).count() == 5
    assert ngram_join.components(docs).count() == 5
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert fingerprints.fingerprint_with_next(docs).count() == 5
    assert mixing.keep_mixed(docs).columns == docs.columns
    labels = spark.createDataFrame([(2, 1, 1), (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 5
    assert zlib.crc32(b"2") % 4 in range(4)


ARTICLE = "<h1>Title</h1><p>Prose of the article, which is long enough. It has several sentences, and they go on.</p><p>More of it follows here, and then it ends.</p>"
ARTICLE_TEXT = "Title\nProse of the article, which is long enough. It has several sentences, and they go on.\nMore of it follows here, and then it ends."
OTHER = "<p>Something else that somebody wrote below, at some length. It is no part of the article.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=f><div><nav><a href=x>Menu</a></nav>{ARTICLE}<div class='comments'>{OTHER}</div></div></form></body>",
        f"<body><div class='content has-sidebar'>{ARTICLE}</div><div class=sidebar>{OTHER}</div></body>",
        f"<body><div class='post no-comments'>{ARTICLE}</div><footer>{OTHER}</footer></body>",
        f"<body><div id=page-with-menu>{ARTICLE}</div></body>",
        f"<body><aside><form><section>{ARTICLE}</section><form class=search>{OTHER}</form></form></aside></body>",
        f"<body><article>{ARTICLE}</article><form>{OTHER * 4}</form><div class='reader-comments'>{OTHER * 4}</div></body>",
    ],
)
def test_wrappers_keep_their_article(page):
    assert tag_paths.main_text(page) == ARTICLE_TEXT


def test_what_is_set_aside_stays_out_of_short_pages():
    assert tag_paths.main_text(f"<body><p>Short.</p><div class=comments>{OTHER * 9}</div><form>{OTHER * 9}</form></body>") == "Short."
    assert tag_paths.main_text(f"<body><h1>Title</h1><footer>{OTHER * 3}</footer></body>") == "Title"


def alternating(k):
    """Two words of 2**k letters that every polynomial hash modulo a power of two takes for equal, from k = 10 or so on."""
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("k", [10, 12])
def test_words_built_to_clash_differ(spark, k):
    x, y = alternating(k)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join([x, *common[:49]]), " ".join([y, *common[:49]]), " ".join(common[:49] + [x]), " ".join(common[:49] + [y]), x, y, " ".join([x] * 60), " ".join([y] * 60)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert not any(got.values())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs_of(spark, texts)).collect()}
    assert got == components_of(texts) and got[5][1] == 5 and got[7][1] == 7


def test_archives_are_bounded_whatever_the_sizes_of_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    monkeypatch.setattr(warc, "PIECE", 20_000)
    rows = [(i, f"http://a/{i}", f"{i} " * 5) for i in range(3000)] + [(10_000 + i, f"http://b/{i}", chr(97 + i % 26) * 50_000 + str(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, scratch(spark, "archives"))
    sizes = [len(warc._gunzip(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert len(sizes) > 10 and max(sizes) < 10 * 60_000
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.capture_table(warc.assemble(warc.read_archives(spark, path))).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


def test_exact_dedup_of_long_hot_texts_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    texts = ["x " * 500] * 40 + ["x" * 500] * 20 + ["y", "y ", None, ""] + [f"own {i}" for i in range(30)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.assign(docs_of(spark, texts)).collect()}
    assert got[45] == (0, 60) and got[60] == (61, 2) and got[62] == (62, 2) and len(got) == len(texts)
    clash = {r.doc_id: r.group_size for r in exact_dedup.assign(docs_of(spark, texts), lambda t: F.lit("same")).collect()}
    assert clash[45] == 60 and clash[70] == 1


def test_bpe_of_long_pieces_keeps_little():
    encoder = bpe_lexicon.Encoder(bpe_lexicon.Merges(public_tokenizers.path("word_bpe_49k.json")), None)
    kept = bpe_lexicon.Kept(encoder)
    r = random.Random(4)
    piece = lambda n: "".join(r.choice("abcdefghij0123456789+/") for _ in range(n))
    for _ in range(20):
        p = piece(4000)
        assert kept[p] == bpe_lexicon._raw(encoder.piece(p))
    assert all(len(x) <= bpe_lexicon.KEPT_PIECE for x in kept)


def test_frequent_words_leave_long_pieces_out(spark):
    texts = ["common " * 50 + "rest"] * 3 + ["z" * 3000] * 30
    assert bpe_lexicon.frequent_words(docs_of(spark, texts), most=20) == {"common"}


@pytest.mark.parametrize("tile", [256, 4])
def test_ngram_join_multiplies_buckets_out(spark, tile, monkeypatch):
    """The dense products alone find every component."""
    for name, value in (("ROUNDS", 0), ("APART", 0.0), ("TILE", tile), ("COMPARED", 0), ("COLUMNS", 4096 if tile > 4 else 8)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join._link, "__defaults__", (0.0,))
    used = []
    monkeypatch.setattr(ngram_join, "_multiplied", lambda *a, real=ngram_join._multiplied: used.append(1) or real(*a))
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs_of(spark, texts)).collect()}
    assert got == components_of(texts) and used


def test_ngram_join_of_texts_of_common_passages_ends(spark, monkeypatch):
    """Many texts made of few passages, none linked, need few rounds."""
    r = random.Random(7)
    passages = [" ".join(f"w{r.randrange(3000)}" for _ in range(30)) for _ in range(20)]
    texts = sorted({" ".join(passages[i] for i in sorted(r.sample(range(20), 4))) for _ in range(1500)})
    rounds = []
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name, real=ngram_join.materialise: rounds.append(name) or real(df, name))
    monkeypatch.setattr(ngram_join, "COMPARED", 0)
    got = ngram_join.components(docs_of(spark, texts)).collect()
    assert rounds.count("placed") <= 10 and len({x.component_id for x in got}) == len(texts)


def test_bitmaps_of_few_keys_are_small_and_miss_none(spark):
    from quarryflow.llm.common import BITMAP_BITS, bitmap_of, in_bitmap

    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    bitmap, held = bitmap_of(keys, "key"), keys.toArrow()["key"].to_numpy()
    assert len(bitmap) * 64 <= 1 << 19 < 1 << BITMAP_BITS and in_bitmap(bitmap, held).all()
    others = spark.range(1000, 21000).select(F.xxhash64("id").alias("key")).toArrow()["key"].to_numpy()
    assert in_bitmap(bitmap, others).mean() < 0.02
    assert not in_bitmap(bitmap_of(keys.limit(0), "key"), held).any()
    few = bitmap_of(keys, "key", 14)  # never more slots than asked for
    assert len(few) * 64 == 1 << 14 and in_bitmap(few, held).all()
