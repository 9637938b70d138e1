"""Byte-pair encoding by a depth-first walk of a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewater.llm.common import release_memory
from tidewater.session import load

#: Fixed value: how byte-level tokenizers split a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a task keeps, and nodes of its trie; beyond either the task starts that anew.
MOST_WORDS, MOST_NODES = 300_000, 400_000
#: Bytes of a word that have nodes in the trie. What lies deeper is the tail of few words and kept for the word alone.
DEPTH = 64
#: After the rank of every merge; what a token of one byte is made of.
NEVER, SINGLE = 1 << 60, (-1, -1, -1)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes batches of words.

    A sequence of tokens is what the merges make of a string if and only if each neighbouring pair is what
    they make of the pair's own bytes. So every string has exactly one last token: the one that is a suffix
    and follows validly on the last token of the rest. That last token is a trie node's state; it depends on
    the path to the node alone, and so words with a common prefix share the states along it. The trie grows
    with the distinct words of a task. A word's encoding is read off backwards, from its last token's start
    to the token that ends there; so memory is linear in the length of a word.
    """

    def __init__(self, spec: str) -> None:
        """spec: the text of a tokenizer's JSON file (model BPE, byte level)."""
        told = json.loads(spec)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        vocab = {token: i for token, i in told["model"]["vocab"].items() if token not in special}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: token.encode() for token, i in special.items()}
        self.longest = max(map(len, self.ids))
        self.merges: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.ids[left], self.ids[right]
            self.merges[pair] = rank
            self.made_from[self.ids[left + right]] = rank, *pair
        self.special = special
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(WORD_PATTERN)
        self.valid: dict[tuple[int, int], bool] = {}
        self.encoded: dict[str, bytes] = {}
        self.plant()

    def plant(self) -> None:
        """A trie of the root alone: children by node and byte, and each node's last token and where it starts."""
        self.children: dict[int, int] = {}
        self.last_token, self.last_start = [-1], [0]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Goes back in time: while both stand, a merge of the two would happen. Before the later made of the
        two was made, its parts stood there; a merge across the border would have come first if its rank is
        lower, or the same and further left. No such merge back to single bytes: they stay apart.
        """
        key = left, right
        known = self.valid.get(key)
        if known is not None:
            return known
        merges, made_from = self.merges, self.made_from
        known, before = True, NEVER
        while True:
            if merges.get((left, right), NEVER) < before:
                known = False
                break
            rank_left, _, tail = made_from.get(left, SINGLE)
            rank_right, head, _ = made_from.get(right, SINGLE)
            if rank_left > rank_right:
                before, left = rank_left, tail
            elif rank_right >= 0:
                before, right = rank_right + 1, head
            else:
                break
        if len(self.valid) >= 500_000:
            self.valid.clear()
        self.valid[key] = known
        return known

    def last_of(self, data: bytes, end: int, states: list[int], last: int) -> tuple[int, int]:
        """The last token of data[:end] and its start; states: the last tokens of shorter prefixes, last: the
        start of the one before. One start fits, so any order will do: the last token with one more byte,
        shorter ones, longer ones."""
        get, known, follows = self.ids.get, self.valid.get, self.follows
        start, step, stop = last, 1, end
        while True:
            token = get(data[start:end])
            if token is not None:
                if not start:
                    return token, 0
                fits = known((states[start], token))
                if fits or (fits is None and follows(states[start], token)):
                    return token, start
            start += step
            if start == stop:
                lowest = max(0, end - self.longest) - 1
                if step < 0 or last - 1 <= lowest:
                    raise ValueError("the vocabulary lacks a token for a byte")
                start, step, stop = last - 1, -1, lowest

    def encode_words(self, words: Iterable[str]) -> None:
        """Inserts `words` into the trie and adds their encodings to `self.encoded`, as little-endian 32-bit ids.

        Words come in byte order, so the trie is walked depth first: the path holds the states from the root
        to the current node, and goes back up to where the next word parts from the one before.
        """
        before, nodes, states, starts = b"", [0], [-1], [0]
        get, known, last_of = self.ids.get, self.valid.get, self.last_of
        for data, word in sorted((w.encode(), w) for w in words):
            if len(self.last_token) > MOST_NODES:
                self.plant()
                before = b""
            children, last_token, last_start = self.children, self.last_token, self.last_start
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del states[shared + 1 :], starts[shared + 1 :], nodes[shared + 1 :]
            node = nodes[-1]
            for end in range(shared + 1, len(data) + 1):
                shallow = end <= DEPTH
                if shallow:
                    edge = node << 8 | data[end - 1]
                    child = children.get(edge)
                    if child is not None:
                        node = child
                        nodes.append(node)
                        states.append(last_token[node])
                        starts.append(last_start[node])
                        continue
                # Mostly the last token goes on by this byte.
                start = starts[-1]
                token = get(data[start:end])
                if token is None or (start and not known((states[start], token))):
                    token, start = last_of(data, end, states, start)
                states.append(token)
                starts.append(start)
                if shallow:
                    node = children[edge] = len(last_token)
                    last_token.append(token)
                    last_start.append(start)
                    nodes.append(node)
            found = []
            at = len(data)
            while at:
                found.append(states[at])
                at = starts[at]
            found.reverse()
            self.encoded[word] = struct.pack(f"<{len(found)}i", *found)
            before = data

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32-bit; special tokens' strings are those tokens."""
        find = self.pattern.findall
        pieces: list[list[str]] = []
        for text in texts:
            if self.specials is not None and self.specials.search(text):
                parts = self.specials.split(text)
                pieces.append([x for i, part in enumerate(parts) for x in ([part] if i % 2 else find(part))])
            else:
                pieces.append(find(text))
        fresh = set().union(*pieces) - self.encoded.keys()
        if len(self.encoded) + len(fresh) > MOST_WORDS:
            self.encoded.clear()
            fresh = set().union(*pieces)
        for content in fresh & self.special.keys():
            self.encoded[content] = self.special[content].to_bytes(4, "little")
        self.encode_words(fresh - self.special.keys())
        look = self.encoded.__getitem__
        return [b"".join(map(look, words)) for words in pieces]

    def forget(self) -> None:
        """Drops what grew with the words seen."""
        self.encoded.clear()
        self.valid.clear()
        self.plant()

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(spec: str) -> TrieEncoder:
    """One encoder for each worker and vocabulary."""
    return TrieEncoder(spec)


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver; about 1.5 MB go to the executors."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def in_chunks(texts: list[str], most_chars: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters, one text at least."""
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text)
        if n >= most_chars:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def map_encoded(docs: DataFrame, path: str, schema: str, make: Callable[[TrieEncoder, list[bytes], list[str]], dict]) -> DataFrame:
    """doc_id of each row, and what `make` gives for the ids of its text and the text; null text is the empty one."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("").to_pylist()
            for part in in_chunks(texts):
                made = make(bpe, bpe.encode(texts[part]), texts[part])
                yield pa.RecordBatch.from_pydict({"doc_id": ids[part.start : part.stop], **made}, to_arrow_schema(wanted))
        bpe.forget()
        release_memory()

    wanted = StructType.fromDDL(f"doc_id long, {schema}")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, wanted)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, `token_ids` (array of int) and `same`, whether they decode to the text, of each row.

    Null and empty texts have no ids. Every row is encoded on its own, repeated rows and null doc_ids
    included; further columns are ignored, whatever their names. Long texts and long words are encoded whole.
    """

    def make(bpe: TrieEncoder, ids: list[bytes], texts: list[str]) -> dict:
        return {"token_ids": [np.frombuffer(x, "<i4") for x in ids], "same": [bpe.decode(x) == t for x, t in zip(ids, texts)]}

    return map_encoded(docs, path, "token_ids array<int>, same boolean", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the text decoded from them, of each row."""

    def make(bpe: TrieEncoder, ids: list[bytes], _: list[str]) -> dict:
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [digest(x) for x in ids],
            "decoded_sha256": [digest(bpe.decode(x).encode()) for x in ids],
        }

    return map_encoded(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op8_bpe_trie(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(load(spark, sf_dir, "documents"), path or default_vocabulary())
