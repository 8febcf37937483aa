"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique. An automaton of all tokens (``Automaton``)
has the tokens that end at each position, longest first; the one that is compatible with the last token of the
prefix before it is stored, and following these back from the end gives the exact ids. Two tokens are compatible if
encoding their joined text gives back just these two, which shows at the seam; the answers are remembered.

The vocabulary is that of a public tokenizer file (JSON): normalisation to NFC, white space dropped, lower case,
words split by the pattern below, bytes shown as printable characters, ``</w>`` at a word's end. The special tokens'
strings in a text are tokens themselves. ``decode`` joins the tokens' strings with blanks, as that file, which names
no decoder, asks for. Null counts as the empty text: no ids, empty decoded text. Memory is bounded whatever the text's
length but for the text and its ids: caches of words and of token pairs are emptied when full, and what a task has
built goes with it. Repeated rows get equal ids; other columns play no part.

The matcher is an Aho-Corasick automaton over the vocabulary: like a suffix automaton of the vocabulary it gives all
tokens that end at a position, but it holds whole tokens only. Its states are the tokens' prefixes; a step from one is
found, by dropping first characters, when a text first takes it, and remembered, so that no task builds the whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import releasing

END = "\U0010fffe"
#: The words of this vocabulary's text, in a stretch without white space.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
#: The white space that the tokenizer drops; str.split takes four control characters more.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_BLANK = re.compile("[\x1c-\x1f]")
#: Entries and characters that a cache holds at most; longer keys are not kept.
CACHE, CACHE_CHARACTERS, LONG = 150_000, 2_000_000, 200


def shown_bytes() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Remembered(dict):
    """A memory of a function's values, bounded in keys and, where these are strings, in their characters together."""

    def __init__(self, make, most: int = CACHE, size=len) -> None:
        self.make, self.most, self.size, self.held = make, most, size, 0

    def __missing__(self, key):
        value = self.make(key)
        size = self.size(key)
        if size > LONG:
            return value
        self.held += size
        if len(self) >= self.most or self.held > CACHE_CHARACTERS:
            self.clear()
            self.held = size
        self[key] = value
        return value


#: Characters have 21 bits.
_CHARACTER = 21


class Automaton:
    """Of tokens (text to id): states are numbers, 0 the one without a prefix; ``step`` leads from a state (shifted by
    _CHARACTER) and a character to the next, ``ending`` has the (length, id) of the tokens that end there, longest first."""

    def __init__(self, tokens: dict[str, int]) -> None:
        self.tokens = tokens
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t) + 1)}
        self.texts, self.numbers, self.ending = [""], {"": 0}, [()]
        self.step = _Remembered(self._step, 2 * CACHE, lambda _: 1)

    def _step(self, key: int) -> int:
        text = self.texts[key >> _CHARACTER] + chr(key & ((1 << _CHARACTER) - 1))
        while text and text not in self.prefixes:
            text = text[1:]
        if text not in self.numbers:
            self.numbers[text] = len(self.texts)
            self.texts.append(text)
            ends = (text[k:] for k in range(len(text)))
            self.ending.append(tuple((len(t), self.tokens[t]) for t in ends if t in self.tokens))
        return self.numbers[text]


class Bpe:
    def __init__(self, spec: str) -> None:
        """spec: the tokenizer file's JSON text."""
        made = json.loads(spec)
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.strings = strings_of(spec)
        self.merged = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.rank, self.parts = [-1] * len(self.strings), {}
        for pair, (rank, i) in self.merged.items():
            self.rank[i], self.parts[i] = rank, pair
        self.bytes = dict(enumerate(shown_bytes()))
        self.ended = made["model"].get("end_of_word_suffix") or ""
        self.size = [0] * len(self.strings)
        made_of, texts = {i for i in vocab.values() if self.rank[i] < 0}, {}
        for token, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            if i not in made_of:  # tokens whose own text is encoded otherwise never occur
                a, b = self.parts[i]
                if a not in made_of or b not in made_of or not self._quiet(a, b, self.rank[i]):
                    continue
                made_of.add(i)
            ends = bool(self.ended) and token.endswith(self.ended) and token != self.ended
            text = token[: -len(self.ended)] + END if ends else token
            self.size[i] = len(text)
            texts[text] = i
        self.automaton = Automaton(texts)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.start = len(self.strings)  # stands for no token before
        self.fits = _Remembered(self._fits, 2 * CACHE, lambda _: 1)
        self.word = _Remembered(self._word)
        self.stretch = _Remembered(lambda s: b"".join(map(self.word.__getitem__, WORD.findall(s))))

    def _quiet(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` ever joins the end of token a to the start of token b.

        The merges next to the seam are undone, the latest first; what met at the seam until then must not have had
        a merge of its own before that. Of equal ranks the left one comes first.
        """
        while True:
            if self.merged.get((a, b), (limit, 0))[0] < limit:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.parts[a][1]
            else:
                limit, b = self.rank[b] + 1, self.parts[b][0]

    def _fits(self, pair: int) -> bool:
        """Of two tokens, packed in one number."""
        a, b = divmod(pair, self.start)
        return a == self.start or self._quiet(a, b, len(self.merged))

    def _word(self, word: str) -> bytes:
        shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes) + (END if self.ended else "")
        fits, size, start, step, ending = self.fits, self.size, self.start, self.automaton.step, self.automaton.ending
        last, state = [start], 0  # of each prefix, the empty one first
        for at, character in enumerate(map(ord, shown), 1):
            state = step[state << _CHARACTER | character]
            for length, token in ending[state]:
                before = last[at - length]
                if before >= 0 and fits[before * start + token]:
                    last.append(token)
                    break
            else:
                last.append(-1)
        ids, at = [], len(shown)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return pack(f"<{len(ids)}I", *ids[::-1])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        stretches = filter(None, BLANK.split(text)) if NOT_BLANK.search(text) else text.split()
        return b"".join(map(self.stretch.__getitem__, stretches))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, unsigned 32-bit, little-endian."""
        if not text:
            return np.zeros(0, "<u4")
        if self.special_pattern is None or not self.special_pattern.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.special_pattern.split(text)
        return np.frombuffer(b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return decoded(self.strings, ids)


def strings_of(spec: str) -> list[str]:
    """The string of each id: all that decoding takes."""
    made = json.loads(spec)
    tokens = [*made["model"]["vocab"].items(), *((x["content"], x["id"]) for x in made["added_tokens"])]
    strings = [""] * (max(i for _, i in tokens) + 1)
    for token, i in tokens:
        strings[i] = token
    return strings


def decoded(strings: list[str], ids: np.ndarray) -> str:
    return " ".join(map(strings.__getitem__, ids.tolist()))


class _Shipped:
    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as f:  # a file of the driver's machine, of fixed size
            self.broadcast = spark.sparkContext.broadcast(f.read())

    def built(self) -> Bpe:
        """The tokenizer, for one task: a worker process, which runs other tasks later, does not keep it."""
        return Bpe(self.broadcast.value)

    def strings(self) -> list[str]:
        return strings_of(self.broadcast.value)


def _text_udf(of, kind: str):
    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(of), kind)


def _listed(ids: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))


def encode_column(text: Column, path: str, spark) -> Column:
    """The ids of each text, as array<int>."""
    shipped = _Shipped(spark, path)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shipped.built()
        for b in batches:
            yield _listed([bpe.encode(t.as_py()) for t in b])

    return _text_udf(encoded, "array<int>")(text)


def decode_column(ids: Column, path: str, spark) -> Column:
    """The decoded text of each array of ids; null stands for none."""
    shipped = _Shipped(spark, path)

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        strings = shipped.strings()
        for b in batches:
            yield pa.array([decoded(strings, np.asarray(x.values if x.is_valid else [], np.int64)) for x in b], pa.string())

    return _text_udf(texts, "string")(ids)


#: Rows whose ids and decoded texts are held at once.
ROWS = 500


def encode_digest_column(text: Column, path: str, spark) -> Column:
    """The ids of each text and the digest of the text decoded from them, by one tokenizer in one pass."""
    shipped = _Shipped(spark, path)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shipped.built()
        for b in batches:
            parts = []
            for lo in range(0, len(b), ROWS):
                ids = [bpe.encode(t.as_py()) for t in b[lo : lo + ROWS]]
                digests = pa.array([sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())
                parts.append(pa.StructArray.from_arrays([_listed(ids), digests], ["ids", "decoded_sha256"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]))

    return _text_udf(both, "struct<ids:array<int>,decoded_sha256:string>")(text)


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_column(text: Column, path: str, spark) -> Column:
    """Number of ids, digest of the ids and digest of the text decoded from them, without moving either to the JVM."""
    shipped = _Shipped(spark, path)

    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shipped.built()
        for b in batches:
            rows = []
            for t in b:
                ids = bpe.encode(t.as_py())
                rows.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(DIGEST)], fields=list(DIGEST))

    return _text_udf(digested, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")(text)
