"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's texts are cut into words; each word not met before is encoded together with all the
others: their symbols lie in one flat array, the rank of every adjacent pair is looked up by
binary search over the sorted pair keys, and a round merges, in every word that still has a
pair, all occurrences of its lowest-ranked pair. Only pairs next to a merge are looked up
again, and finished words leave the array. Words met before come from a table that is
emptied when it is full, and rows are encoded and handed on by parts of a batch, so memory is
bounded by the table's size and the part, or by one text where that is longer.

The vocabulary is read once, on the driver, and travels with the function: its size does not
depend on the data. Documents are independent; nothing is shuffled.

Cases: null text counts as empty; an empty text has no tokens; texts of any length are cut in
blocks; the strings of special tokens are found in texts, as the tokenizers library does;
repeated rows and null doc_id are encoded like any others; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: The pre-tokenizer's pattern, a fixed value of this tokenizer family (\s: Unicode white space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.iinfo(np.int64).max
#: Words in the table before it is emptied; words and characters of a block.
TABLE_WORDS, BLOCK_WORDS, BLOCK_CHARS = 150_000, 100_000, 500_000
#: Bytes of texts, or ids, of the rows that are worked on at a time.
PART = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file of the tokenizers library holds, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, pre = said["model"], said["pre_tokenizer"] or {}
        odd = said["normalizer"] or said["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
        odd = odd or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        letters, vocab = _byte_letters(), model["vocab"]
        raw = {i: bytes(letters[c] for c in word) for word, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        raw |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(raw) + 1
        self.start_of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.start_of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.token_len = np.array([len(raw.get(i, b"")) for i in range(self.size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


def _take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[s : s + n]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, how many each has)."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    sym = vocab.start_of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(n), lengths)
    rank = np.full(len(sym), NONE)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = vocab.ranks(sym[inside], sym[inside + 1])
    done_sym, done_word = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.concatenate([first, [len(sym)]]))
        lowest = np.minimum.reduceat(rank, first)
        if (over := lowest == NONE).any():  # finished words leave
            gone = np.repeat(over, size)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            sym, word, rank = sym[~gone], word[~gone], rank[~gone]
            lowest, size = lowest[~over], size[~over]
            if not len(sym):
                break
        here = rank == np.repeat(lowest, size)
        at = np.flatnonzero(here)
        # of touching hits (aaa) every other one, from the left
        run = np.concatenate([[True], np.diff(at) != 1])
        if not run.all():
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
        sym[at] = vocab.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, word, rank = sym[keep], word[keep], rank[keep]
        near = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[near] = NONE
        near = near[near + 1 < len(sym)]
        near = near[word[near] == word[near + 1]]
        rank[near] = vocab.ranks(sym[near], sym[near + 1])
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)


class _Words(dict):
    def __missing__(self, word):
        self[word] = at = len(self)
        return at


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        import regex

        self.vocab, self.words = vocab, regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self._empty()

    def _empty(self) -> None:
        self.table = _Words()
        self.at = self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        for id_ in self.vocab.special.values():
            self.table[id_]  # an int stands for a special token
        self._learn([])

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of words that have just come into the table."""
        special = np.array([] if len(self.n) else list(self.vocab.special.values()), np.int32)
        ids, n = merge_words(self.vocab, [w.encode("utf-8", "replace") for w in words])
        n = np.concatenate([np.ones(len(special), np.int64), n])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, special, ids.astype(np.int32)])

    def _found(self, text: str) -> Iterator:
        """The words of a text, and ids of special tokens."""
        pieces = self.cut.split(text) if self.cut and any(s in text for s in self.vocab.special) else [text]
        for piece in pieces:
            if piece in self.vocab.special:
                yield [self.vocab.special[piece]]
            elif len(piece) <= BLOCK_CHARS:
                yield self.words.findall(piece)
            else:
                found = (m.group() for m in self.words.finditer(piece))
                while block := list(islice(found, BLOCK_WORDS)):
                    yield block

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        pending: list = []  # words
        ends: list[tuple[int, bool]] = []  # how many words belong to a text, and if it ends there
        held: list[np.ndarray] = []
        for text in texts:
            n = 0
            for block in self._found(text):
                pending += block
                n += len(block)
                if len(pending) >= BLOCK_WORDS:
                    yield from self._flush(pending, [*ends, (n, False)], held)
                    pending, ends, n = [], [], 0
            ends.append((n, True))
        yield from self._flush(pending, ends, held)

    def _flush(self, words: list, ends: list[tuple[int, bool]], held: list[np.ndarray]) -> Iterator[np.ndarray]:
        known = len(self.table)
        which = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if len(self.table) > known:
            self._learn(list(islice(self.table, known, None)))
        n = self.n[which]
        ids, upto = _take(self.ids, self.at[which], n), np.concatenate([[0], np.cumsum(n)])
        word = at = 0
        for count, ended in ends:
            word += count
            part, at = ids[at : upto[word]], upto[word]
            held.append(part)
            if ended:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held.clear()
        if len(self.table) > TABLE_WORDS:
            self._empty()


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return _take(vocab.token_bytes, vocab.token_at[ids], vocab.token_len[ids]).tobytes().decode("utf-8", "replace")


def _parts(batches: Iterable[pa.RecordBatch], column: str, length) -> Iterator[pa.RecordBatch]:
    """The rows of batches, by about PART of the column's lengths."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        new = np.flatnonzero(np.diff(upto // PART)) + 1
        for start, end in pairwise([0, *new.tolist(), b.num_rows]):
            yield b.slice(start, end - start)


def _encoded(encoder: Encoder, part: pa.RecordBatch) -> Iterator[np.ndarray]:
    return encoder.encode(t.as_py().decode("utf-8", "replace") for t in part.column("text"))


def _listed(ids: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Lists of ids, and their lengths."""
    n = np.array([len(x) for x in ids], np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n)


def _source(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row."""
    vocab = Vocabulary(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for b in _parts(batches, "text", pc.binary_length):
            yield pa.record_batch([b.column("doc_id"), *_listed(list(_encoded(encoder, b)))], ["doc_id", "ids", "n_tokens"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids."""
    vocab = Vocabulary(path)
    small_batches(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "ids", pc.list_value_length):
            texts = [decode_ids(vocab, x.values.to_numpy()) if x.is_valid else "" for x in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, text) of each row, in one pass; text is what the ids decode to."""
    vocab = Vocabulary(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for b in _parts(batches, "text", pc.binary_length):
            ids = list(_encoded(encoder, b))
            back = pa.array([decode_ids(vocab, x) for x in ids], pa.string())
            yield pa.record_batch([b.column("doc_id"), *_listed(ids), back], ["doc_id", "ids", "n_tokens", "text"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encoding, then decoding, gives."""
    vocab = Vocabulary(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for b in _parts(batches, "text", pc.binary_length):
            n, of_ids, of_text = [], [], []
            for ids in _encoded(encoder, b):
                n.append(len(ids))
                of_ids.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(sha256(decode_ids(vocab, ids).encode("utf-8")).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
