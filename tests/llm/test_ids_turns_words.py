"""Token shards, conversation repair and spelling variants against brute force and defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarryflow.llm import conversation_repair as turns  # noqa: E402
from quarryflow.llm import spelling, token_shards  # noqa: E402
from quarryflow.llm.common import scratch  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


# --- op11 ---------------------------------------------------------------------------------------

TEXTS = [
    "a b", "", None, " ", "\n", "  two  blanks ", "a \nb", "a\n b", "\n\nlines\n\n\nmore\n", "tab\tand\x0bfeed \x1c. x", "it's we'll 'tis ' s", "x<|endoftext|> y <|endoftext|>", "<|endoftext|",
    "é ü ß 日本語 한국어 ​zero line ᠎. a b  c", "😀 😀😀 ﻿", "12 345 6,7.8", "word.\nWord, word; \"word\"!", "x" * 5000, "tail ", "tail\n", "tail \n ", " lead", "\nlead", "a\r\nb \r c",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_pieces_give_the_ids_of_whole_texts(library):
    import pyarrow as pa

    r = random.Random(8)
    made = ["".join(r.choice(["a", "B", "é", " ", "  ", "\n", "\t", ".", "'s", "1", "<|endoftext|>", "日", " ", " "]) for _ in range(r.randint(0, 40))) for _ in range(800)]
    encoder = token_shards.PieceEncoder(VOCABULARY)
    for again in range(3):  # with pieces that are known, and after some were dropped
        got = [x.tolist() for x in encoder.texts(pa.array(TEXTS + made))]
        assert got == [e.ids for e in library.encode_batch([t or "" for t in TEXTS + made], add_special_tokens=False)]
        if again == 1:
            encoder.used[::2] = 5
            token_shards.KEPT_BYTES, kept = 0, token_shards.KEPT_BYTES
            encoder._shrink()
            token_shards.KEPT_BYTES = kept
            assert 0 <= len(encoder.words) < 10000


@pytest.mark.parametrize("small", [False, True])
def test_token_shards_round_trip(spark, library, small, monkeypatch):
    if small:
        monkeypatch.setattr(token_shards, "FILE_BLOCKS", 2)
        monkeypatch.setattr(token_shards, "BUCKET", 4)
    rows = [(i * 3 - 7, t) for i, t in enumerate(TEXTS)] + [(5000, f"copy {i % 4}") for i in range(9)] + [(None, "no id"), (None, None), (-(2**62), "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"value": F.lit(1), "file": F.lit("clash"), "n": F.lit(0)}).repartition(3)
    root = scratch(spark, "tokens")
    width = token_shards.write_shards(docs, VOCABULARY, root, block=64 if small else token_shards.BLOCK, shard_text=400 if small else token_shards.SHARD_TEXT)
    token_shards.build_index(spark, root, width)
    assert width == 2
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.read_tokens(spark, root, docs.select("doc_id").distinct()).collect())
    assert [g[1] for g in got] == [None, None, *sorted(x[0] for x in rows if x[0] is not None)]
    ends = np.cumsum([g[2] for g in got])
    assert [g[0] for g in got] == [0, *ends[:-1].tolist()]
    crc = lambda t: (len(library.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()))
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == sorted((str(i), *crc(t)) for i, t in rows)
    assert token_shards.get_ids(spark, root, 5) == library.encode(TEXTS[4], add_special_tokens=False).ids + [0]
    assert token_shards.get_ids(spark, root, 6) is None and token_shards.get_ids(spark, root, 5000, 9) is None and token_shards.get_ids(spark, root, 5000, 8) is not None
    assert token_shards.get_ids(spark, root, None, 1) is not None
    assert token_shards.lookup(spark, root, spark.createDataFrame([(6,), (77777,)], "doc_id long")).count() == 0


def test_token_shards_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    root = token_shards.write_tokens(docs, VOCABULARY)
    assert token_shards.read_tokens(spark, root, docs.select("doc_id")).count() == 0 and token_shards.get_ids(spark, root, 1) is None


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        ids, copies = r.integers(-(1 << 62), 1 << 62, n), r.integers(0, 3, n)
        known = r.random(n) > 0.01
        keys = list(dict.fromkeys(zip(np.where(known, ids, 0).tolist(), known.tolist(), copies.tolist())))
        ids, known, copies = (np.array([k[i] for k in keys], t) for i, t in enumerate((np.int64, bool, np.int64)))
        blob = token_shards.build_bucket(ids, known, copies, [np.arange(len(keys))])
        found, values = token_shards.find_in_bucket(blob, ids, known, copies)
        assert found.all() and values[0].tolist() == list(range(len(keys)))
        strangers = r.integers(-(1 << 62), 1 << 62, 500)
        assert not token_shards.find_in_bucket(blob, strangers, np.ones(500, bool), np.full(500, 7))[0].any()
    with pytest.raises(ValueError):
        token_shards.build_bucket(np.array([1, 1]), np.ones(2, bool), np.zeros(2, np.int64), [])


# --- op12 ---------------------------------------------------------------------------------------


def damaged(rows):
    """Rows of conversations after damage, by conversation and in order, in plain Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = out[conv]
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def cheapest(initials, lost, unfinished):
    """(cost, letters) by trying every sequence of edits, with as many inserts as can pay."""
    best, limit = [None], 4 * len(initials)

    def go(i, state, cost, audit, put):
        if cost > limit or best[0] is not None and cost > best[0][0]:
            return
        if i == len(initials) and state in (0, 3):
            best[0] = min(x for x in (best[0], (cost, audit)) if x is not None)
        nexts = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        if put < 2:
            for c in nexts.replace("s", ""):
                go(i, to[c], cost + 3, audit + "I", put + 1)
        if i < len(initials):
            more = 3 if unfinished[i] else 0
            if not lost[i]:
                if initials[i] and initials[i] in nexts:
                    go(i + 1, to[initials[i]], cost + more, audit + "K", 0)
                for c in nexts.replace("s", ""):
                    go(i + 1, to[c], cost + 3 + more, audit + "R", 0)
            go(i + 1, state, cost + 4, audit + "D", 0)

    go(0, 0, 0, "", 0)
    return best[0]


def test_least_edits_equal_exhaustive_search():
    r = random.Random(1)
    for _ in range(1500):
        n = r.randrange(0, 6)
        initials = [r.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        lost = bytes(r.random() < 0.2 for _ in range(n))
        unfinished = bytes(not x and r.random() < 0.3 for x in lost)
        assert turns.least_edits(initials, lost, unfinished) == cheapest(initials, lost, unfinished)


def repaired(rows, audit):
    out, state, at = [], 0, 0
    to = {"s": 1, "u": 2, "a": 3}
    for edit in audit:
        role, text = ("user" if state != 2 else "assistant"), ""
        if edit in "DKR":
            own, at = rows[at], at + 1
            if edit == "D":
                continue
            role, text = (own[1] if edit == "K" else role), own[2]
        out.append(f"{role}:{text}")
        state = to[role[0]]
    assert at == len(rows) and state in (0, 3)
    return "\n".join(out)


def brute(rows, search=True):
    got = {}
    for conv, own in damaged(rows).items():
        seen, first = set(), []
        for _, role, text in own:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            first.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        args = initials, bytes(f in ("blank", "duplicate") for f in first), bytes(f == "truncated" for f in first)
        cost, audit = cheapest(*args) if search and len(own) < 9 else turns.least_edits(*args)
        got[conv] = (gaps, *(first.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired(own, audit).encode()).hexdigest())
    return got


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversation_repair_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turns.op12_conversation_repair(spark, SF).collect()}
    assert got == brute(rows) and any(g[5] for g in got.values())


def test_conversation_repair_of_odd_rows(spark):
    r = random.Random(6)
    texts = ["Yes.", "No", "", None, " \t", "what? ", "long " * 20000 + "end.", "é😀", "a ", "Yes."]
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, 5, 9, None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)) for _ in range(30)]
    rows += [(100 + c, t, "user", "hi") for c in range(25) for t in range(1)] + [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit(1), "kind": F.lit("x"), "copy": F.lit("clash"), "digest": F.lit(0)}).repartition(5)
    got = {x.conv_id: tuple(x[c] for c in COLUMNS) for x in turns.repair(turns.damage(df)).collect()}
    expected = brute(rows, search=False)
    assert got == expected and set(got) == {x[0] for x in rows}
    gone = [c for c, own in damaged(rows).items() if not own]
    assert gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert turns.repair(turns.damage(df.limit(0))).count() == 0


# --- op13 ---------------------------------------------------------------------------------------


def variants_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def words_corpus():
    r = random.Random(3)
    base = ["colours", "letters", "aaaaaaa", "abababab", "strängeß", "wordword", "x" * 40, "×÷abcde"]
    texts = []
    for b in base:
        texts += [f"{b} " * 300, f"{b[:3]}{b[4:]}, " * 20, f"{b}s-" * 12, f"{b.upper()};" * 2]
        for _ in range(25):
            w = list(b)
            for _ in range(r.randint(1, 2)):
                at = r.randrange(len(w))
                kind = r.random()
                w[at : at + (kind < 0.7)] = [r.choice("abcdeéz")] if kind > 0.3 else []
            texts.append(f"{''.join(w)} " * r.randint(1, 40))
    for c in ("chain", "thread", "string"):  # forms of forms
        texts += [f"{c}aa " * 600] * 10 + [f"{c}ab " * 40] * 10 + [f"{c}bb " * 3] * 10 + [f"{c}cb "] * 2
    texts += ["", None, "short wo rds", "q" * 3000 + " " + "q" * 3001 + " " + "q" * 3000 + "\n" + "q" * 3001]
    return [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(1, texts[1])]


@pytest.mark.parametrize("hot", [spelling.HOT, 2])
def test_spelling_variants_equal_brute_force(spark, hot):
    rows = words_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)}).repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, hot).collect()}
    expected = variants_of(rows)
    assert got == expected
    assert any(x[0] and x[0] != x[1] for x in got.values()) and sum(x[3] for x in got.values()) > 100


def test_spelling_variants_on_tables_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()} == variants_of(rows)


def test_spelling_variants_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gram_distances_are_those_of_letter_counts():
    r = random.Random(2)
    words = ["".join(r.choice("abéÿ") for _ in range(r.randint(7, 9))) for _ in range(700)]
    sizes = np.array([len(w) for w in words])
    block = np.arange(700) // 350
    got = set(spelling.close_pairs(spelling.letter_counts(words), sizes, block))
    expected = set()
    for i in range(700):
        for j in range(i + 1, 700):
            a, b = Counter(words[i]), Counter(words[j])
            apart = sum((a[c] - b[c]) ** 2 for c in set(a) | set(b))
            if block[i] == block[j] and (sizes[i] == sizes[j] and apart == 2 or abs(sizes[i] - sizes[j]) == 1 and apart == 1):
                expected.add((i, j))
    assert got == expected
