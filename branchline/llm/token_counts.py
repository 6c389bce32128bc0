"""Whole-token shortcut counting for word-end BPE vocabularies (operator 10).

Offline, every vocabulary string that ends a word is encoded alone; those that come back as exactly their own id are
proven whole. At run time a text falls into pre-tokens; proven ones count directly, and merges run only for the rest.
Results are kept in a table of bounded size, so that a word costs one lookup after its first occurrence in a worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare

#: Bytes, about, of what a worker remembers of words in one table, and what a word takes besides its characters.
KEPT_BYTES, ENTRY = 80 << 20, 180
#: Letters that one lower-case mapping and no composition touches, and with them the printable ASCII characters.
LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
EASY = re.compile(f"[!-~{LETTERS}]+").fullmatch
#: Whole texts of these and the white space of ASCII.
EASY_TEXT = re.compile(f"[\t-\r -~{LETTERS}]*").fullmatch
#: Byte-level form: the bytes that have no printable Latin-1 character of their own, in order, stand from U+0100 on.
BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Characters that str.split() takes for white space and the tokenizers' patterns do not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[ \t-\r\x85\xa0  -     　]+")


def prove_whole(path: str) -> dict[str, int]:
    """Vocabulary strings (byte-level form, without the word end) that the tokenizer encodes alone as their own id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model = json.loads(tok.to_str())["model"]
    end = model.get("end_of_word_suffix") or ""
    proven = {}
    for piece, number in model["vocab"].items():
        if end and piece.endswith(end) and len(piece) > len(end):
            word = piece[: -len(end)]
            found = tok.model.tokenize(word)
            if len(found) == 1 and found[0].id == number:
                proven[word] = number
    return proven


class Kept(dict):
    """Values of words in two generations; a full one becomes the older one, from which words that are met again move up.

    A known word costs one lookup that runs no Python code.
    """

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.size = 0

    def of(self, words: list[str], make: Callable) -> list:
        """The value of each word, ``make`` of those that are not known."""
        self.make = make
        return list(map(self.__getitem__, words))

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            size = ENTRY + 2 * len(word)
            if self.size + size > KEPT_BYTES // 2:
                self.old, self.size = self.copy(), 0
                self.clear()
            self.size += size
            self[word] = value
        return value


class WordTokenizer:
    """Token ids of whole texts, equal to the library's, by the whole-token shortcut."""

    def __init__(self, path: str, whole: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        self.whole = prove_whole(path) if whole is None else whole
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip, need whole words or are normalized are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the same pattern over the characters of EASY_TEXT alone
        plain = split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", LETTERS + "0-9")
        self.plain = re.compile(plain).findall
        self.largest = self.tok.get_vocab_size() - 1
        self.merged = 0

    def pre_token(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token in byte-level form: itself if it is proven whole, else by merges."""
        one = self.whole.get(word)
        if one is not None:
            return (one,)
        self.merged += 1
        return tuple([t.id for t in self.model.tokenize(word)])

    def easy_word(self, word: str) -> tuple[int, ...]:
        """Ids of a lower-case pre-token of EASY_TEXT."""
        return self.pre_token(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a piece of text without white space or added tokens."""
        words = map(self.easy_word, self.plain(chunk.lower())) if EASY(chunk) else (self.pre_token(w) for w, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(chunk)))
        return tuple([i for ids in words for i in ids])

    def values(self, text: str, kept: tuple[Kept, Kept], value: Callable) -> list:
        """``value`` of the ids of each word or chunk of the whole text, added tokens included, in order."""
        if self.mark is not None and "<|" in text and self.mark.search(text):
            out = []
            for part in self.mark.split(text):
                out += [value((self.added[part],))] if part in self.added else self.values_plain(part, kept, value)
            return out
        return self.values_plain(text, kept, value)

    def values_plain(self, text: str, kept: tuple[Kept, Kept], value: Callable) -> list:
        if EASY_TEXT(text):
            return kept[0].of(self.plain(text.lower()), lambda w: value(self.easy_word(w)))
        chunks = [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()
        return kept[1].of(chunks, lambda c: value(self.chunk(c)))


_workers: dict = {}


def worker_tokenizer(path: str, whole: dict[str, int]) -> tuple[WordTokenizer, tuple[Kept, Kept], tuple[Kept, Kept]]:
    """One tokenizer in a worker process, with its tables (of words, of chunks) of counts and of packed ids."""
    if path not in _workers:
        _workers[path] = (WordTokenizer(path, whole), (Kept(), Kept()), (Kept(), Kept()))
    return _workers[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, in one pass without a shuffle.

    A null text counts as empty: no bytes, no tokens. Null ids, repeated rows and empty tables pass through as they are;
    only doc_id and text are read, so that further columns of any name do not matter.
    """
    prepare(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))  # at most the vocabulary

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, kept, _ = worker_tokenizer(path, whole.value)
        texts = batch.column(1).to_pylist()
        n = pa.array([sum(tok.values(t, kept, len)) if t else 0 for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = map_batches(rows, count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
