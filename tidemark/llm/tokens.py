"""Token ids of whole texts from the tokenizers library, through a bounded cache of the library's own answers.

The library encodes about one megabyte a second and core. Its result for a text is the concatenation of its results for
the pieces that it splits the text into before merging, and no piece of either vocabulary reaches across the cuts made
here, so each distinct word is encoded by the library once while it stays in the cache:

* byte-level vocabulary (a space belongs to the word after it): cut before a single space or line feed that stands between
  two characters that are not white space;
* word-end vocabulary (white space is dropped, case is lost): cut at white space;
* both: a full stop or comma at the end of a word is a piece of its own where a Latin letter stands before it.

Words of Latin letters that the cache lacks go to the library's model directly, since the splitting before it has nothing to do there;
other words go to the whole library many at a time, as one text, whose ids are cut again at the words.

A text that holds a special token's string, such as an end-of-text mark, goes to the library whole. A batch of the others is cut and its words are numbered by Arrow, so that Python looks up each distinct word of a batch once.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that Python splits at and the library does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Lower case is the same in Python and in the library for all other letters, one at a time.
NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: White space other than a space or line feed, for Python or for the library.
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SIDE_BY_SIDE = ("  ", " \n", "\n ", "\n\n")
CUT = re.compile(r"(?<=\S)(?:(?= \S)|(?=\n\S))")
#: The cache is emptied, but for the current texts' words, when it has more entries; longer words aren't kept.
CACHE_ENTRIES, CACHED_CHARS = 1_200_000, 32
#: A word that is one token of its own in the word-end vocabulary and never joins its neighbours.
SEPARATOR = "0"


def byte_signs() -> dict[int, str]:
    """The sign that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


SIGNS = byte_signs()


def simple_space(raw: bytes) -> bool:
    """Whether ``raw`` has surely no white space but spaces and line feeds, and no NUL."""
    b = np.frombuffer(raw, np.uint8)
    if ((b < 32) & (b != 10)).any() or ((b >= 0xE1) & (b <= 0xE3)).any():
        return False
    after = b[1:][b[:-1] == 0xC2]
    return not ((after == 0x85) | (after == 0xA0)).any()


class Encoder:
    """``ids(texts)`` gives each text's ids as the bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # a text that holds the string of a token outside the vocabulary's own pieces is the library's alone
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.drops_space = drops_space
        self.cache: dict[str, bytes] = {}
        self.ends = {x: self.direct([x])[0] for x in ".,"}
        self.before = "" if drops_space else SIGNS[32]
        self.leads = {} if drops_space else {"\0": b"", "\n": self.direct(["\n"])[0]}
        if drops_space:
            (self.separator,) = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        else:
            vocabulary = self.library.get_vocab(with_added_tokens=False)
            self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token's name is a byte
            self.id_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """The library's ids of each word, from one text of all."""
        if self.drops_space:
            (made,) = self.direct([f" {SEPARATOR} ".join(words)])
            marks = np.flatnonzero(np.frombuffer(made, np.uint32) == self.separator)
            starts, ends = [0, *(marks + 1).tolist()], [*marks.tolist(), len(made) // 4]
        else:
            (made,) = self.direct(["".join(words)])
            reach = np.cumsum(self.id_bytes[np.frombuffer(made, np.uint32)])
            sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
            ends = (np.searchsorted(reach, np.cumsum(sizes)) + 1).tolist()
            starts = [0, *ends[:-1]]
        if len(starts) != len(words):
            raise AssertionError("the library joined words that stand apart")
        return [made[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Add ``words`` to the cache. A word stands for itself after a space, after its line feed where it has one, or at the
        start of a text where it begins with a NUL added for that."""
        known, ended, cores = self.cache, [], set()
        for w in words:
            core, tail = w, b""
            if len(w) > 2 and w[-1] in self.ends and w[-2] < "\u0100" and w[-2].isalpha():
                core, tail = w[:-1], self.ends[w[-1]]
            if self.drops_space and core.isascii():
                core = core.lower()
            if core not in known:
                # what stands for the space before the word, if one does, and the ids of the line feed before it
                before, lead, letters = self.before, b"", core
                if core[:1] in self.leads:
                    before, lead, letters = "", self.leads[core[0]], core[1:]
                if len(core) <= CACHED_CHARS and letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
                    if self.drops_space:
                        core = letters = core.lower()
                    signs = letters if letters.isascii() else letters.encode().decode("latin-1").translate(SIGNS)
                    known[core] = lead + array("I", [t.id for t in self.tokenize(before + signs)]).tobytes()
                else:
                    cores.add(core)
                    ended.append((w, core, tail))
                    continue
            known[w] = known[core] + tail
        together, alone = [], []
        for w in cores:
            if self.drops_space:
                fits, text = SEPARATOR not in w, w
            elif w[:1] == "\0":
                fits, text = False, w[1:]
            elif w[:1] == "\n":
                fits, text = not (w[1:2].isspace() or w[-1].isspace()), w
            else:
                fits, text = bool(w) and not (w[0].isspace() or w[-1].isspace()), f" {w}"
            (together if fits and len(w) <= CACHED_CHARS else alone).append((w, text))
        for at in range(0, len(together), 512):
            block = together[at : at + 512]
            known.update(zip([w for w, _ in block], self.joined([x for _, x in block]), strict=True))
        known.update(zip([w for w, _ in alone], self.direct([x for _, x in alone]), strict=True))
        known.update([(w, known[core] + tail) for w, core, tail in ended])

    def cut(self, text: str, simple: bool = False) -> str | list[str]:
        """The words of ``text``: as one string with a single space between two words, or as a list where words hold spaces.
        A ``simple`` text is known to have no white space but spaces and line feeds, and no NUL."""
        if self.drops_space:
            if not simple and ODD_SPACE.search(text):
                return [text]
            text = text.lower() if text.isascii() or not NOT_LATIN.search(text) else text
            return text.replace("\n", " ") if simple or not OTHER_SPACE.search(text) else " ".join(text.split())
        if not simple and "\0" in text:
            return [f"\0{text}"]
        uneven = any(x in text for x in SIDE_BY_SIDE) or text[0] in " \n" or text[-1] in " \n" or not simple and OTHER_SPACE.search(text)
        if uneven:
            parts = [x[1:] if x[0] == " " and k else x for k, x in enumerate(CUT.split(text))]
            parts[0] = f"\0{parts[0]}"
            return parts
        return "\0" + text.replace("\n", " \n")

    def words(self, texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """All words of ``texts``, numbered, and where each text's words begin and end."""
        plain, rest, plain_at, rest_at = [], [], [], []
        sizes = np.zeros(len(texts), np.int64)
        simple = simple_space("".join([x for x in texts if x]).encode())
        for i, text in enumerate(texts):
            if text:
                made = self.cut(text, simple)
                if isinstance(made, str):
                    plain.append(made)
                    plain_at.append(i)
                    sizes[i] = made.count(" ") + 1
                else:
                    rest += made
                    rest_at.append(i)
                    sizes[i] = len(made)
        split = pc.split_pattern(pa.array([" ".join(plain)] if plain else [], pa.large_string()), " ").flatten()
        order = np.array(plain_at + rest_at, np.int64)
        stops = np.zeros(len(texts), np.int64)
        stops[order] = np.cumsum(sizes[order])
        return pa.concat_arrays([split, pa.array(rest, pa.large_string())]).dictionary_encode(), stops - sizes, stops

    def holds_added(self, text: str) -> bool:
        return any(x in text or x.lower() in text.lower() for x in self.added if x[0] in text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        alone = [k for k, x in enumerate(texts) if x and self.holds_added(x)]
        if alone:
            left, made = set(alone), self.direct([texts[k] for k in alone])
            rest = self.ids([None if k in left else x for k, x in enumerate(texts)])
            for k, x in zip(alone, made, strict=True):
                rest[k] = x
            return rest
        numbered, begun, ended = self.words(texts)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.cache
        if self.drops_space:
            known[""] = b""
        found = list(map(known.get, distinct))
        at = [k for k, x in enumerate(found) if x is None]
        new = [distinct[k] for k in at]
        self.learn(new)
        for k, w in zip(at, new, strict=True):
            found[k] = known[w]
        if len(known) > CACHE_ENTRIES:
            self.cache = {w: x for w, x in zip(distinct, found, strict=True) if len(w) <= CACHED_CHARS}
        else:
            for w in new:
                if len(w) > CACHED_CHARS:
                    del known[w]
        # every word's ids out of the distinct words' ids, side by side
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, number = np.frombuffer(b"".join(found), np.uint32), numbered.indices.to_numpy()
        each = sizes[number]
        reach = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat((np.cumsum(sizes) - sizes)[number] - reach[:-1], each)
        place += np.arange(len(place))
        made = pool[place]
        return [made[a:b].tobytes() for a, b in zip(reach[begun].tolist(), reach[ended].tolist(), strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder for each worker process; its cache lives on from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space)
    return _encoders[path, drops_space]


def batched(texts: list, limit: int = 4 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, a single longer text alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
