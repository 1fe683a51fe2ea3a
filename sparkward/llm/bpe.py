"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The last token of a prefix's encoding is unique. An automaton reports, for every
prefix of a word, the tokens that are its suffixes. The last token is the one whose
own beginning is an encoded prefix with a last token that stays apart from it: two
neighbours stay apart if, while each grows by its merges in order of rank, no pair of
their touching parts is merged first. Following the tokens back from the end gives
the ids, the same as merging by rank.

The vocabulary is a tokenizer file of the `tokenizers` library (JSON), read on the
driver, of one kind: BPE with word ends over the byte alphabet, lower case, white space
dropped. Strings of its special tokens in a text are those tokens. Words are found
between ASCII white space, which no rule of the file looks across, and a task
remembers words it has met (up to a bound that changes no result).

A null text has no tokens. Rows are encoded one by one; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sparkward.llm.frames import ids_and_texts, ids_schema, map_batches

REMEMBERED = 150_000
#: Tokens decoded at a time, but for a single text.
DECODED = 1 << 24
_END = "\0"
_WHITE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NEVER = float("inf")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Tokenizer:
    """Encodes and decodes as the `tokenizers` library does with the same file."""

    def __init__(self, config: dict):
        model = config["model"]
        kinds = [n["type"] for n in config["normalizer"]["normalizers"]], [p["type"] for p in config["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or config["decoder"]:
            raise ValueError("this kind of tokenizer file is not supported")
        suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}"))
        strings = {i: t for t, i in (self.vocabulary | special).items()}
        self.strings = pa.array([strings.get(i, "") for i in range(max(strings) + 1)], pa.string())
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, ab = (self.vocabulary[x] for x in (left, right, left + right))
            self.rank[a, b] = rank
            made.setdefault(ab, (rank, a, b))
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._apart = Recent(lambda pair: self._meet(pair >> 20, pair & 0xFFFFF), 8 * REMEMBERED)
        self.automaton = ahocorasick.Automaton()
        sound: set[int] = set()
        by_rank = sorted((made[i][0] if i in made else -1, i, t) for t, i in self.vocabulary.items())
        for rank, token, string in by_rank:
            a, b = made[token][1:] if token in made else (token, token)
            # spines: what touches the token's edge, from one symbol up, and the rank that consumes it
            self._right[token] = [*self._right[b][:-1], (b, rank), (token, _NEVER)] if token in made else [(token, _NEVER)]
            self._left[token] = [*self._left[a][:-1], (a, rank), (token, _NEVER)] if token in made else [(token, _NEVER)]
            if token in made and not (a in sound and b in sound and self._meet(a, b, inside=True)):
                continue  # merging by rank never yields this token
            sound.add(token)
            symbols = string[: -len(suffix)] + _END if string.endswith(suffix) and len(string) > len(suffix) else string
            self.automaton.add_word(symbols, (len(symbols), token))
        self.automaton.make_automaton()
        self._width = [0] * len(self.strings)
        for length, token in self.automaton.values():
            self._width[token] = length
        self._pieces = Recent(self.encode_piece)

    def _meet(self, a: int, b: int, inside: bool = False) -> bool:
        """Whether no parts of neighbours a and b are merged across their border; `inside`: but for a and b as wholes."""
        right, left = self._right[a], self._left[b]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            top = x_until == y_until == _NEVER
            if top and inside:
                return True
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if top:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, by its prefixes."""
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes) + _END
        last = [-1] * len(word) + [-1]
        apart = self._apart
        for end, (length, token) in self.automaton.iter(word):
            # last[i + 1] is the last token of the prefix that ends with symbol i
            if last[end + 1] < 0:
                if length <= end:
                    prev = last[end + 1 - length]
                    if prev < 0 or not apart[prev << 20 | token]:
                        continue
                last[end + 1] = token
        ids, at = [], len(word)
        width = self._width
        while at:
            ids.append(last[at])
            at -= width[last[at]]
        return tuple(ids[::-1])

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a text without ASCII white space."""
        if word.isalpha() and word.isascii():
            return self._pieces[word.lower()]
        if self.split_special and (hit := self.split_special.search(word)):
            before, after = word[: hit.start()], word[hit.end() :]
            return (*self.encode_word(before), self.special[hit.group()], *self.encode_word(after))
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        ids: tuple[int, ...] = ()
        for piece in self.pieces.findall(word.lower()):
            ids += self._pieces[piece]
        return ids

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' strings with a space between."""
        if len(ids) > 1 and len(ids.flatten()) > DECODED:
            half = len(ids) // 2
            return pa.concat_arrays([self.decode(ids[:half]), self.decode(ids[half:])])
        at = ids.offsets.to_numpy()
        tokens = pa.ListArray.from_arrays(at - at[0], self.strings.take(ids.flatten()))
        return pc.binary_join(tokens, " ")


class Recent(dict):
    """What `make` gave for the keys met lately; of two generations the older one is dropped."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most = make, most
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def encode_column(column: pa.Array, words: Recent) -> pa.ListArray:
    """The ids of each text."""
    ids, ends = [], [0]
    for value in column:
        found = filter(None, (value.as_py() or "").translate(_SPACES).split(" "))
        own = np.fromiter(chain.from_iterable(map(words.__getitem__, found)), np.int32)
        ids.append(own)
        ends.append(ends[-1] + len(own))
    return pa.ListArray.from_arrays(np.array(ends, np.int32), np.concatenate(ids) if ids else np.zeros(0, np.int32))


_BUILT: dict[str, tuple[Tokenizer, Recent]] = {}


def tokenizer_of(raw: str) -> tuple[Tokenizer, Recent]:
    """Built once in each Python worker."""
    if raw not in _BUILT:
        _BUILT.clear()
        made = Tokenizer(json.loads(raw))
        _BUILT[raw] = made, Recent(made.encode_word)
    return _BUILT[raw]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of `docs`; decoded is made from ids."""
    with open(path, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tokenizer, words = tokenizer_of(raw.value)

        def run(batch: pa.RecordBatch) -> list:
            ids = encode_column(batch.column(1), words)
            return [batch.column(0), ids, tokenizer.decode(ids)]

        return run

    return map_batches(ids_and_texts(docs), make, ids_schema("ids array<int>, decoded string"))
