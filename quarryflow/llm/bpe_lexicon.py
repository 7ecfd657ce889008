"""BPE encoding and decoding with a transducer lexicon.

Frequent words, counted over all documents in Spark, are encoded once and compiled into a
minimal acyclic transducer: an automaton in which words share suffixes, whose edge outputs add
up to the word's number, which indexes a table of token ids.  The automaton is flat arrays in
one file that Spark sends to every executor and the workers map into memory.  Words that it does
not hold are merged exactly, by the rank of each pair.

A word is frequent if it makes up at least 1 / ``LEXICON`` of all words, so the lexicon has
``LEXICON`` words at most, whatever the input.  Which words it holds changes only the speed.

Text is cut at white space first; each distinct piece is encoded once per task and kept in a
table of bounded bytes.  A text is never held as a list of all its ids unless ``ids`` is asked for.

Defined cases: null text is empty and has no tokens; a special token's string in a text is that
token; white space is dropped, so decoding gives the tokens joined by one blank, as the public
library does for this file; rows that are alike each get a row; a null doc_id stays null; columns
that are not asked for play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEXICON = 1 << 16
#: Pieces a task keeps before it starts a new table; and pieces that it counts before it sends their counts on.
KEEP, COUNTED = 3 << 18, 1 << 19
#: Letters of the longest piece that is kept or counted, and bytes of pieces and ids that are kept.
KEPT_PIECE, KEPT_BYTES = 256, 64 << 20
#: Letters from which on a word is merged by a heap.
LONG = 64
_WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: str.split() also cuts at these four, which are not white space here.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{_WHITE}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        # a pair of ids as one number -> its rank (from 1) and the id that it becomes, as one number, so that the least is the best
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"], 1):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.vocab[left] << 20 | self.vocab[right]] = rank << 20 | self.vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: the best-ranked pair is merged first, the leftmost of equals."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, get = self.inner, self.pairs.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        if len(ids) > LONG:
            return self._merge_long(ids)
        found = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]
        while best := min(filter(None, found), default=0):
            i = found.index(best)
            ids[i] = merged = best & 0xFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | merged)
            if i < len(found):
                found[i] = get(merged << 20 | ids[i + 1])
        return ids

    def _merge_long(self, ids: list) -> list[int]:
        """The same by a heap over a linked list, for words of many letters."""
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i] = merged = best & 0xFFFFF
            ids[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := get(merged << 20 | ids[k]):
                    heapq.heappush(heap, (r, i, merged, ids[k]))
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 20 | merged)):
                heapq.heappush(heap, (r, h, ids[h], merged))
        return [x for x in ids if x is not None]


def pretokens(piece: str) -> list[str]:
    """Words of a piece of text without white space, after NFC and lower case (letter by letter, as the file asks)."""
    text = unicodedata.normalize("NFC", piece)
    lowered = text.lower()
    if lowered.isalpha() and (text.isascii() or "Σ" not in text):  # letters alone are one word
        return [lowered]
    if not text.isascii():
        text = text.replace("Σ", "σ")  # a final sigma is not a case of its own here
    return _PIECES.findall(text.lower())


# --- the transducer ---------------------------------------------------------------------------


def compile_lexicon(entries: dict[str, list[int]], path: str) -> None:
    """Write the minimal acyclic transducer from words to ids as one file of flat arrays."""
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []

    def settle(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
        return register[key]

    # words come sorted, so what lies beyond the prefix shared with the next word never changes again
    stack: list[list] = [[False, [], None]]  # final, settled edges, label of the open edge

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            final, edges, _ = stack.pop()
            stack[-1][1].append((stack[-1][2], settle(final, edges)))

    last = b""
    for word, _ in words:
        shared = len(os.path.commonprefix((last, word)))
        close(shared)
        for byte in word[shared:]:
            stack[-1][2] = byte
            stack.append([False, [], None])
        stack[-1][0] = True
        last = word
    close(0)
    root = settle(stack[0][0], stack[0][1])
    below = [0] * len(nodes)
    for i, (final, edges) in enumerate(nodes):  # children are settled before their parents
        below[i] = int(final) + sum(below[t] for _, t in edges)
    first, label, target, add = [0], [], [], []
    for final, edges in nodes:
        skipped = int(final)
        for byte, to in edges:
            label.append(byte)
            target.append(to)
            add.append(skipped)
            skipped += below[to]
        first.append(len(label))
    ids = [i for _, own in words for i in own]
    offsets = np.cumsum([0, *(len(own) for _, own in words)])
    arrays = [np.array(first), np.array(target), np.array(add), np.array([f for f, _ in nodes]), offsets, np.array(ids)]
    head = np.array([root, max((len(w.decode("utf-8", "surrogatepass")) for w, _ in words), default=0), *(len(a) for a in arrays)], dtype=np.int32)
    with open(path, "wb") as out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(a.astype(np.int32).tobytes())
        out.write(bytes(label))


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.bytes = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        words = memoryview(self.bytes)
        self.root, self.longest, *sizes = words[:32].cast("i")
        at, parts = 32, []
        for n in sizes:
            parts.append(words[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.add, self.final, self.offsets, self.ids = parts
        self.labels = at

    def get(self, word: str) -> list[int] | None:
        """Ids of the word, or None if the lexicon does not hold it."""
        node, number, base = self.root, 0, self.labels
        first, target, add, find = self.first, self.target, self.add, self.bytes.find
        raw = word.encode("utf-8", "surrogatepass")
        for k in range(len(raw)):
            edge = find(raw[k : k + 1], base + first[node], base + first[node + 1]) - base
            if edge < 0:
                return None
            number += add[edge]
            node = target[edge]
        if not self.final[node]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


# --- the jobs ---------------------------------------------------------------------------------


def token_table(names: dict[int, str]) -> np.ndarray:
    """Token names by id; ids without a token have an empty name."""
    return np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)


def text_of(ids: np.ndarray, table: np.ndarray) -> str:
    """The tokens of the ids joined by one blank."""
    if len(ids) and ids.min() < 0:
        raise IndexError("token ids are not negative")
    return " ".join(table[ids].tolist())


class Encoder:
    """Encodes pieces of text by lexicon, then by merges."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.table = token_table(merges.names)
        self.numbers = np.array([str(i) for i in range(len(self.table))], dtype=object)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(merges.special, key=len, reverse=True)) + ")") if merges.special else None

    def word(self, word: str) -> list[int]:
        if self.lexicon and len(word) <= self.lexicon.longest:
            found = self.lexicon.get(word)
            if found is not None:
                return found
        return self.merges.merge(word)

    def piece(self, piece: str) -> list[int]:
        """Token ids of a piece of text without white space."""
        if "<" not in piece or not self.special:
            words = pretokens(piece)
            if len(words) == 1:
                return self.word(words[0])
            return [i for w in words for i in self.word(w)]
        ids: list[int] = []
        for part in self.special.split(piece):
            if part in self.merges.special:
                ids.append(self.merges.special[part])
            elif part:
                for w in pretokens(part):
                    ids += self.word(w)
        return ids


class Kept(dict):
    """piece -> its ids as bytes, each encoded when it is first asked for; starts anew beyond ``KEEP`` pieces or ``KEPT_BYTES``.  Long pieces are encoded each time."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KEEP or self.held > KEPT_BYTES:
            self.clear()
            self.held = 0
        encoder = self.encoder
        if "<" in piece:
            found = _raw(encoder.piece(piece))
        else:
            # words are kept like pieces, so that one is merged once however it is written and whatever mark follows it
            found = b"".join([self[w] if w != piece and w.isascii() else _raw(encoder.word(w)) for w in pretokens(piece)])
        if len(piece) <= KEPT_PIECE:
            self[piece] = found
            self.held += len(piece) + len(found)
        return found


def _raw(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def pieces_of(text: str) -> list[str]:
    return _SPLIT.split(text) if _SEPARATORS.search(text) else text.split()


_encoders: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    """One encoder per worker process; the files come with Spark, by name."""
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Merges(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def _count_pieces(batches):
    seen: Counter = Counter()
    for batch in _then_none(batches):
        if batch is not None:
            for text in batch.column("text"):
                text = text.as_py() or ""
                pieces = pieces_of(text)
                # long pieces have no place in the lexicon; a text that could hold many has few pieces for its length
                seen.update([p for p in pieces if len(p) <= KEPT_PIECE] if len(text) > 32 * len(pieces) else pieces)
        if seen and (batch is None or len(seen) > COUNTED):
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()


def _then_none(batches):
    yield from batches
    yield None


def frequent_words(docs: DataFrame, most: int = LEXICON) -> set[str]:
    """The words of the pieces of text that make up at least 1 / ``most`` of all pieces; no more than ``most`` pieces can."""
    counts = docs.select("text").mapInArrow(_count_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {w for r in counts.where(F.col("n") * most >= total).select("piece").collect() for w in pretokens(r.piece)}


def _encode(vocabulary: str, lexicon: str, keep_ids: bool):
    def run(batches):
        encoder = _encoder(vocabulary, lexicon)
        kept = Kept(encoder)  # as long as the task, so that an idle worker holds little
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column("text"):
                    ids = np.frombuffer(b"".join(map(kept.__getitem__, pieces_of(text.as_py() or ""))), np.int32)
                    tokens = text_of(ids, encoder.table)
                    rows.append((len(ids), hashlib.sha256(" ".join(encoder.numbers[ids].tolist()).encode()).hexdigest(), hashlib.sha256(tokens.encode("utf-8")).hexdigest(), *((ids, tokens) if keep_ids else ())))
                columns = list(zip(*rows))
                arrays = [part.column("row"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Encode and decode every text.

    Gives the ``carry`` columns (doc_id) and n_tokens, ids_sha256, decoded_sha256; with
    ``keep_ids`` also ids (array<int>) and decoded (string).
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary_path)
    vocabulary = os.path.basename(vocabulary_path)
    merges = Merges(vocabulary_path)
    entries = {w: merges.merge(w) for w in frequent_words(docs)}
    folder = tempfile.mkdtemp(prefix="spark-lexicon-")
    path = os.path.join(folder, f"{os.path.basename(folder)}.bin")
    compile_lexicon(entries, path)
    spark.sparkContext.addFile(path)
    carry = carry or ["doc_id"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_encode(vocabulary, os.path.basename(path), keep_ids), f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else ""))
    return out.select("row.*", *out.columns[1:])


def decode(encoded: DataFrame, vocabulary_path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens of the id array joined by one blank."""
    table = token_table(Merges(vocabulary_path).names)

    def run(batches):
        for batch in batches:
            ids = batch.column(column)
            texts = [text_of(x.values.to_numpy(zero_copy_only=False), table) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def count_tokens(vocabulary: str):
    """A column function: the number of tokens of each text, by the vocabulary file of this name that Spark has sent."""

    @F.arrow_udf("long")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = Kept(_encoder(vocabulary, None)).__getitem__
        for texts in columns:
            yield pa.array([sum(map(len, map(kept, pieces_of(x.as_py() or "")))) // 4 for x in texts], pa.int64())

    return run


def op6_bpe(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path)
