"""Ids of whole texts by the `tokenizers` library, with a bounded cache of words.

Byte-pair encoders split a text first and encode each part alone. A text is therefore cut at
places where such a split is certain, the parts are looked up in a cache that lives as long as
the Python worker, and only unknown parts go through the library. Ids are kept as little-endian
unsigned 32-bit bytes, so a document's ids are one join of byte strings.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker process's two caches, of parts and of words in them (about 200 bytes each),
#: and characters of the longest part kept.
CACHE_PARTS = 60_000
CACHE_WORDS = 400_000
CACHE_CHARS = 48

_SPACE_THEN_SPACE = re.compile(r" (?!\S)")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
# U+0130 has a mark of its own in lower case, at which words are split.
_NOT_LATIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]"

# Texts in which a space stands before white space, or controls that libraries class differently.
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = {"space-led": rf" (?:[{_SPACES}]|\z)", "white-space": r"[\x1c-\x1f]"}
_TAIL = ".,;:!?$&%#*|"

# Fixed value: the splitting rule of the byte-level vocabulary.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Encoder:
    """Encodes texts with the tokenizer at `path`; special tokens are never added. Added tokens that
    occur in a text become their ids, as in the library, or with `specials` off plain text.

    Cuts. Texts are cut at added tokens first, each part being a text of its own to the library. A byte-level encoder cuts before each space that a visible character follows: its
    splitting rule gives the last space before a word to that word, whatever stands before. An
    encoder that drops white space cuts at all white space. Any other encoder gets whole texts.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, specials: bool = True):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        added = {t["content"]: t for t in rules.get("added_tokens") or [] if specials}
        self.added_ids = {c: int(t["id"]).to_bytes(4, "little") for c, t in added.items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.whole_added = any(t[f] for t in added.values() for f in ("single_word", "lstrip", "rstrip", "normalized"))
        self.library = Tokenizer.from_file(path) if self.whole_added else None
        self.tokenizer.encode_special_tokens = True
        self.kind = self._kind(rules)
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.pattern, self.part_tokenizer = None, self.tokenizer
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        if self.kind != "whole":
            self.pattern = regex.compile(BYTE_LEVEL_SPLIT if self.kind == "space-led" else rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.part_tokenizer = Tokenizer.from_file(path)
            self.part_tokenizer.encode_special_tokens = True
            self.part_tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    @staticmethod
    def _kind(rules: dict) -> str:
        split, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and normal is None:
            return "space-led"
        parts = split.get("pretokenizers") or []
        if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[1].get("type") == "ByteLevel" and "[^\\s" in parts[0].get("pattern", {}).get("Regex", ""):
            return "white-space"
        return "whole"

    def cut(self, text: str) -> list[str]:
        if self.kind == "whole" or not text:
            return [text] if text else []
        if self.kind == "white-space":
            return [text] if _ODD_SPACE.search(text) else text.split()
        parts = text.split(" ")
        if _SPACE_THEN_SPACE.search(text):
            kept = [parts[0]]
            for p in parts[1:]:
                if not p or p[0].isspace():
                    kept[-1] += " " + p
                else:
                    kept.append(" " + p)
            return kept if kept[0] else kept[1:]
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out if out[0] else out[1:]

    def _learn(self, tokenizer, unknown: list[str]) -> list[bytes]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(unknown, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
        out, at = [], 0
        for x in ids:
            out.append(flat[at : (at := at + 4 * len(x))])
        return out

    def _parts(self, unknown: list[str]) -> list[bytes]:
        """Ids of parts that the cache lacks. Parts of Latin script are split once more by the
        tokenizer's own rule, so that a word is learned once whatever punctuation follows."""
        if self.pattern is None:
            return self._learn(self.tokenizer, unknown)
        far = pc.match_substring_regex(pa.array(unknown, pa.large_string()), _NOT_LATIN).to_pylist()
        other = dict.fromkeys(p for p, f in zip(unknown, far, strict=True) if f)
        if other:
            other = dict(zip(other, self._learn(self.tokenizer, list(other)), strict=True))
        # In Latin script without white space, lower case is all that the normalizer does.
        low = [p.lower() for p in unknown] if self.normalize is not None else unknown
        trimmed = pc.utf8_rtrim(pa.array(low, pa.large_string()), _TAIL)
        one_word = pc.match_substring_regex(trimmed, r"\A ?\pL+\z").to_pylist()
        split = [None if f else self.pattern(p) if not o else [h] if len(h) == len(p) else [h, p[len(h) :]] for p, h, f, o in zip(low, trimmed.to_pylist(), far, one_word, strict=True)]
        units = list(set(chain.from_iterable(x for x in split if x)))
        ids = dict(zip(units, self._units(units), strict=True))
        return [other[p] if x is None else b"".join([ids[w] for w in x]) for p, x in zip(unknown, split, strict=True)]

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of different texts that the tokenizer's rule doesn't split and its normalizer leaves alone."""
        out = list(map(self.words.get, units))
        missing = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(missing, self._learn(self.part_tokenizer, [units[i] for i in missing]), strict=True):
            out[i] = ids
            if len(units[i]) <= CACHE_CHARS and len(self.words) < self.cache_words:
                self.words[units[i]] = ids
        return out

    def lookup(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; new ones are kept while there is room."""
        out = list(map(self.cache.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for i, ids in zip(some, self._parts([parts[i] for i in some]), strict=True):
                out[i] = ids
                if len(self.cache) < CACHE_PARTS and len(parts[i]) <= CACHE_CHARS:
                    self.cache[parts[i]] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; None counts as empty."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists, no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()
            pa.default_memory_pool().release_unused()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if self.added is None:
            return self._plain(texts)
        has = pc.match_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), "|".join(map(re.escape, self.added_ids))).to_pylist()
        if not any(has):
            return self._plain(texts)
        if self.whole_added:
            marked = iter(self._learn(self.library, [t for t, h in zip(texts, has, strict=True) if h]))
            plain = iter(self._plain([t for t, h in zip(texts, has, strict=True) if not h]))
            return [next(marked if h else plain) for h in has]
        parts = [self.added.split(t) if h else [t] for t, h in zip(texts, has, strict=True)]
        ids = iter(self._plain([p for x in parts for p in x[::2]]))
        return [b"".join([next(ids) if i % 2 == 0 else self.added_ids[p] for i, p in enumerate(x)]) for x in parts]

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        if self.kind == "whole":
            return self._learn(self.tokenizer, [t or "" for t in texts])
        array = pa.array([t or "" for t in texts], pa.large_string())
        odd = pc.match_substring_regex(array, _ODD[self.kind]).to_pylist()
        if any(odd):
            array = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), array)
        lists = pc.split_pattern(array, " ") if self.kind == "space-led" else pc.utf8_split_whitespace(array)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten()
        first = offsets[:-1]
        space = " " if self.kind == "space-led" else ""
        # A word of Latin letters is one unit and signs after it another; any other piece is looked up whole.
        trimmed = pc.utf8_rtrim(pieces, _TAIL)
        coded = trimmed.dictionary_encode()
        known = coded.dictionary
        word = pc.and_(pc.match_substring_regex(known, r"\A\pL+\z"), pc.invert(pc.match_substring_regex(known, _NOT_LATIN))).to_numpy(zero_copy_only=False).astype(bool)
        names = known.filter(pa.array(word)).to_pylist()
        place = np.cumsum(word) - 1
        order = np.arange(len(names))
        if self.normalize is not None:  # several spellings may be one word
            names = [n.lower() for n in names]
            distinct = dict(zip(names, order.tolist(), strict=True))
            ids = self._units(list(distinct))
            for i, n in enumerate(distinct):
                distinct[n] = i
            order = np.fromiter(map(distinct.__getitem__, names), np.int64, len(names))
        else:
            ids = self._units([space + n for n in names])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        plain = word[codes]
        both = np.empty((len(codes), 2), np.int32)  # of each piece: its word or whole, and what follows the word
        both[plain, 0] = order[place[codes[plain]]]
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(trimmed)).to_numpy(zero_copy_only=False) * plain
        if space:
            plain[first] = True  # and replaced below
            tail[first] = 0

        def add(where: np.ndarray, column: int, texts: pa.Array, look) -> None:
            own = texts.dictionary_encode()
            both[where, column] = own.indices.to_numpy(zero_copy_only=False) + len(ids)
            ids.extend(look(own.dictionary.to_pylist()))

        whole = np.flatnonzero(~plain)
        add(whole, 0, pieces.take(pa.array(whole)), lambda x: self.lookup([space + p for p in x]))
        one, more = np.flatnonzero(tail == 1), np.flatnonzero(tail > 1)
        add(one, 1, pc.utf8_slice_codeunits(pieces.take(pa.array(one)), -1), self._units)
        ends_with = [p[-n:] for p, n in zip(pieces.take(pa.array(more)).to_pylist(), tail[more].tolist(), strict=True)]
        add(more, 1, pa.array(ends_with, pa.large_string()), self._units)
        if space:
            add(first, 0, pieces.take(pa.array(first)), self.lookup)
        both[tail == 0, 1] = len(ids)
        ids.append(b"")
        codes = both.ravel()
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        start = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.arange(ends[-1], dtype=np.int32 if ends[-1] < 1 << 31 else np.int64)
        out += np.repeat((start[codes] - ends[:-1]).astype(out.dtype), counts)
        out = flat[out]
        bounds = ends[2 * offsets]
        return [b"".join(self.lookup(self.cut(t))) if o else out[a:b].tobytes() for t, o, a, b in zip(texts, odd, bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = True) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if (path, specials) not in _encoders:
        _encoders[path, specials] = Encoder(path, specials=specials)
    return _encoders[path, specials]
