"""Encoding by a tokenizer file whose pre-tokens never cross white space.

The distinct words of a bounded slice of texts are encoded together and kept in a bounded table, since the ids of a
text are those of its words in order: normalisation, splitting and merges of such a tokenizer stay within a word.
The tokenizer must lower-case, as A-Z are lowered before the words are looked up.
Where the file splits as ``SPLIT`` does, plain words are cut into runs of letters and runs of marks first, so that a word is known
with any marks around it. Texts without spaces are one word and are encoded as such. A text that holds the string of one of the file's added tokens is encoded
whole by the library, which takes those out before it looks at white space.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa

from platewise.llm.text import SPACE, words_of

CACHE_BYTES = 96 << 20  # of the words known to a worker and their ids
ENTRY_BYTES = 180  # of a word and its ids besides their letters
BATCH = 20_000
# fixed values: the split of the word tokenizer's file, and what it finds in lower-cased plain words
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# of a lowered byte: whether it is a mark, a letter, the first byte of a plain letter, or one that leaves its word whole
MARK, LETTER, LEAD, WHOLE = range(4)
KIND = np.full(256, WHOLE, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(ord("0"), ord("9") + 1), ord("'")]] = WHOLE
KIND[ord("a"):ord("z") + 1] = LETTER
KIND[0xC3] = LEAD


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _added(path: str) -> re.Pattern:
    """The strings of the added tokens."""
    with open(path, encoding="utf-8") as lines:
        strings = [t["content"].encode() for t in json.load(lines)["added_tokens"]]
    return re.compile(b"|".join(map(re.escape, strings)) or b"(?!)")


class _Table:
    """Words and their ids in two generations of half of ``CACHE_BYTES``.

    When the younger one is full it becomes the older one, whose words are taken over as they are met again, so that
    common words stay and only rare ones are encoded anew. The words of one call may exceed the bound until the next.
    """

    def __init__(self):
        self.ids, self.old = {}, {}
        self.young_bytes = self.old_bytes = 0

    @property
    def held(self) -> int:
        return self.young_bytes + self.old_bytes

    def look_up(self, path: str, words: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct words."""
        found = list(map(self.ids.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if not new:
            return found
        if self.young_bytes + _bytes(new) > CACHE_BYTES // 2:
            self.old, self.old_bytes, self.ids, self.young_bytes = self.ids, self.young_bytes, {}, 0
            new, found = words, [None] * len(words)
        rare = new
        if self.old:
            before = list(map(self.old.get, new))
            self.ids.update((w, ids) for w, ids in zip(new, before) if ids is not None)
            rare = [w for w, ids in zip(new, before) if ids is None]
        self.young_bytes += _bytes(new) + _encode_words(path, rare, self.ids)
        if self.held > CACHE_BYTES:
            self.old, self.old_bytes = {}, 0
        fresh = map(self.ids.__getitem__, new)
        return [next(fresh) if ids is None else ids for ids in found]


def _bytes(words: list[bytes]) -> int:
    return len(words) * ENTRY_BYTES + 5 * sum(map(len, words))  # an id has four bytes and at least one of the word


@functools.lru_cache(maxsize=2)
def _table(path: str) -> _Table:
    return _Table()


def encode_texts(path: str, texts: list[bytes], end: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text of a bounded slice, followed by the id ``end``.

    The words, or the parts of plain words, are numbered by an Arrow dictionary, so that the table is asked once for each
    distinct one of the slice and the ids of all in order are gathered from those.
    """
    mark = array("I", [end]).tobytes()
    whole = {i: array("I", _tokenizer(path).encode(text.decode(), add_special_tokens=False).ids).tobytes()
             for i, text in enumerate(texts) if _added(path).search(text)}
    lowered = [b"" if i in whole else text.lower() for i, text in enumerate(texts)]
    offsets = np.cumsum([0, *map(len, lowered)], dtype=np.int64)
    data = np.frombuffer(b"".join(lowered), np.uint8)
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return [whole.get(i, b"") + mark for i in range(len(texts))]
    letters = data[~SPACE[data]]
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    cuts = places[np.searchsorted(rows, np.arange(len(texts) + 1))]
    places = _cut_plain(letters, places) if _plain(path) else places
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    found = _table(path).look_up(path, _pieces(words.dictionary))
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    number = words.indices.to_numpy()
    own = sizes[number]
    after = np.cumsum(own)
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - (after - own), own) + np.arange(after[-1])].tobytes()
    cuts = (4 * np.concatenate(([0], after))[np.searchsorted(places, cuts)]).tolist()
    return [whole.get(i, ids[a:b]) + mark for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _cut_plain(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where words begin and end, and where runs of letters or marks do in words that ``SPLIT`` cuts nowhere else.

    Words with a digit, an apostrophe or a byte that is neither ASCII nor of a plain letter stay whole.
    """
    kind = KIND[letters]
    lead = np.flatnonzero(kind == LEAD)
    if len(lead):
        after = letters[np.minimum(lead + 1, len(letters) - 1)]
        lead = lead[(after >= 0x80) & (after != 0x97) & (after != 0xB7)]  # not the signs of times and division
        kind[kind == LEAD] = WHOLE
        kind[lead] = kind[lead + 1] = LETTER
    first = np.empty(len(letters), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    odd = np.flatnonzero(kind == WHOLE)
    if len(odd):
        whole = np.zeros(len(places) - 1, bool)
        whole[np.searchsorted(places, odd, side="right") - 1] = True
        first &= ~np.repeat(whole, np.diff(places))
    first[places[:-1]] = True
    return np.append(np.flatnonzero(first), len(letters))


def _pieces(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls, cut from its buffer."""
    _, where, data = column.buffers()
    places = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    every = data.to_pybytes()
    return [every[a:b] for a, b in zip(places[:-1], places[1:])]


def _encode_words(path: str, words: list[bytes], known: dict[bytes, bytes]) -> int:
    """Add the ids of lower-cased words, and of the parts of words; returns the bytes that the parts take.

    Letters of the first two Unicode blocks and printable ASCII characters need no normalisation but lower-casing: where
    the file says that it splits as ``SPLIT`` does, the merges of the tokenizer's model are applied to the parts of such
    words directly. A part is itself a word with the same ids.
    """
    tokenizer = _tokenizer(path)
    rest, fresh = words, []
    if _plain(path):
        tokenize, rest, letters, number = tokenizer.model.tokenize, [], _byte_letters(), attrgetter("id")

        def merged(part: str) -> bytes:
            if not part.isascii():
                part = part.encode().decode("latin-1")
                for byte, letter in letters:
                    part = part.replace(byte, letter)
            return array("I", map(number, tokenize(part))).tobytes()

        for word in words:
            text = word.decode()
            if word.isalpha():  # of bytes: letters of ASCII alone
                if word not in known:
                    known[word] = array("I", map(number, tokenize(text))).tobytes()
                continue
            if LETTERS.fullmatch(text):
                if word not in known:
                    known[word] = merged(text.lower())
                continue
            if not PLAIN.fullmatch(text):
                rest.append(word)
                continue
            parts = PARTS.findall(text.lower())
            if len(parts) == 1:
                if word not in known:
                    known[word] = merged(parts[0])
                continue
            ids = []
            for part in parts:
                key = part.encode()
                own = known.get(key)
                if own is None:
                    own = known[key] = merged(part)
                    fresh.append(key)
                ids.append(own)
            known[word] = b"".join(ids)
    for start in range(0, len(rest), BATCH):
        part = rest[start:start + BATCH]
        encoded = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        known.update(zip(part, [array("I", e.ids).tobytes() for e in encoded]))
    return _bytes(fresh)


@functools.lru_cache(maxsize=1)
def _byte_letters() -> list[tuple[str, str]]:
    """The bytes of lower-case plain letters, as Latin-1 characters, that the library writes by another character, and that one."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    written = {pair for code in (0xDF, *range(0xE0, 0x100)) if code != 0xF7
               for pair in zip(chr(code).encode().decode("latin-1"), level.pre_tokenize_str(chr(code))[0][0])}
    return sorted((byte, letter) for byte, letter in written if byte != letter)


@functools.lru_cache(maxsize=2)
def _plain(path: str) -> bool:
    with open(path, encoding="utf-8") as lines:
        found = json.load(lines)
    steps = found["pre_tokenizer"].get("pretokenizers", [])
    kinds = [n["type"] for n in (found["normalizer"] or {}).get("normalizers", [])]
    return (kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": SPLIT} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, NULL as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
