"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

Both vocabularies in use cut a text into pieces before they merge, and where a piece may be cut
out is known: white space is dropped by the one (``word_bpe``), and a single blank between two
other characters starts a piece in the other (``byte_bpe``). So a text is cut at such places,
every distinct piece is encoded once per Python worker, and the ids of the pieces are joined.
The result equals encoding the whole text; texts where that isn't certain are encoded whole.

A file whose merges are in the order of their ids is also a table of ranks. Then tiktoken merges
whole texts, with the same ids and at a fraction of the cost. Where the file marks word ends, each word is
followed by a NUL, which is merged with the word's last byte before anything else. The way by pieces is left for texts
with characters that the libraries' tables of letters and white space might class apart, or with a NUL.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Collection, Sequence

import numpy as np

MAX_PIECES = 600_000  # pieces held by a worker; further ones are encoded each time
MAX_PARTS = 100_000  # parts of pieces held besides
MAX_PIECE = 64  # longer pieces are not held
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
# Beside a line break or another blank, a blank is cut otherwise.
ODD_BLANK = re.compile(r"[\t\r\x0b\x0c]|[ \n][ \n]|^[ \n]|[ \n]$")

# A piece of letters with at most one stop behind it (and a blank or line break before it) is cut by both
# vocabularies into just these parts, so they can go to the merges directly, without a pass over the whole text.
SIMPLE = re.compile("(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,]?)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()
BYTE_OF_LETTER = {letter: b for b, letter in BYTE_LETTERS.items()}
ASCII_LETTERS = {b: letter for b, letter in BYTE_LETTERS.items() if letter != chr(b) and b < 128}
FIRST, WHOLE = "\r", "\t"  # neither occurs in a text that is cut at blanks

# Fixed value: how byte-level vocabularies cut texts before merging.
BYTE_LEVEL_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Beyond the Latin blocks, or white space of only some tables.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
LATIN = [c for c in map(chr, range(0x250)) if not UNSURE.search(c)]
# Where words end in a NUL, none may stand in the text; the dotted capital I is two characters in lower case.
UNSURE_WORDS = re.compile("[\0\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]")
WORD_END, WORD_END_BYTE = "</w>", b"\0"

_workers: dict[str, "CachedTokenizer"] = {}


def _ranked(known: dict) -> bool:
    """Whether the merges of a tokenizer file are in the order of their ids."""
    model = known["model"]
    merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    ids = [model["vocab"][m] for m in merges]
    return ids == sorted(ids)


def _bytes_of(entry: str) -> bytes:
    return bytes([BYTE_OF_LETTER[c] for c in entry])


def rank_merger(known: dict) -> Callable[[str], bytes] | None:
    """A function from a text without UNSURE characters to its ids by a byte-level tokenizer file, or None where its merges
    are in another order."""
    import tiktoken

    special = {token["content"] for token in known["added_tokens"]}
    if not _ranked(known) or known["normalizer"] is not None or known["pre_tokenizer"].get("add_prefix_space"):
        return None
    ranks = {_bytes_of(entry): i for entry, i in known["model"]["vocab"].items() if entry not in special}
    merge = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: array("H", merge(text)).tobytes()


def _latin_class(kind: str) -> str:
    """The trusted characters of a kind, and what they become in lower case."""
    chars = {*LATIN, *(c.lower() for c in LATIN if not UNSURE_WORDS.search(c))}
    return "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == kind)


def word_merger(known: dict) -> Callable[[str], bytes] | None:
    """A function from a text without UNSURE_WORDS characters to its ids by a file that lower-cases, drops white space and
    marks word ends, or None where the file does anything else."""
    import tiktoken

    steps = [n["type"] for n in (known["normalizer"] or {}).get("normalizers", [])]
    cut = known["pre_tokenizer"].get("pretokenizers", [{}])[0]
    by_matches = cut.get("type") == "Split" and cut["behavior"] == "Removed" and cut["invert"]
    model, special = known["model"], {token["content"] for token in known["added_tokens"]}
    if not _ranked(known) or model["end_of_word_suffix"] != WORD_END or steps != ["NFC", "Replace", "Lowercase"] or not by_matches:
        return None
    # The last byte and its mark are merged first: such entries change ranks with the single bytes.
    vocab = {entry: i for entry, i in model["vocab"].items() if entry not in special}
    ends = {i for entry, i in vocab.items() if len(entry.removesuffix(WORD_END)) == 1 and entry.endswith(WORD_END)}
    singles = {i for entry, i in vocab.items() if len(entry) == 1}
    if ends | singles != set(range(512)) or len(ends) != 256:
        return None
    id_of = np.arange(max(vocab.values()) + 1, dtype="<u2")
    id_of[:512] = [*sorted(ends), *sorted(singles)]
    rank_of = np.argsort(id_of)
    ranks = {
        _bytes_of(entry.removesuffix(WORD_END)) + (WORD_END_BYTE if entry.endswith(WORD_END) else b""): int(rank_of[i])
        for entry, i in vocab.items()
    }
    if len(ranks) != len(vocab):
        return None
    mark = WORD_END_BYTE.decode()
    merge = tiktoken.Encoding("words", pat_str=f"[^{mark}]+{mark}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    pattern = cut["pattern"]["Regex"].replace(r"\p{L}", _latin_class("L")).replace(r"\p{N}", _latin_class("N"))
    words_of = re.compile(pattern).findall

    def ids(text: str) -> bytes:
        words = words_of(text.lower())
        words.append("")  # the last word too is followed by a mark
        return id_of[np.frombuffer(array("H", merge(mark.join(words))), np.uint16)].tobytes()

    return ids


class CachedTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ids: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        pre = self.tokenizer.pre_tokenizer.__getstate__().decode()
        self.drops_space = '"Split"' in pre
        if not self.drops_space and '"use_regex":true' not in pre:
            raise ValueError(f"{path}: no way known to cut texts for this tokenizer")
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        self.merge = word_merger(known) if self.drops_space else rank_merger(known)
        self.unsure = UNSURE_WORDS if self.drops_space else UNSURE

    def _pieces(self, text: str) -> list[str]:
        """Keys of the pieces of a text. Where white space counts, a key is what stands behind its blank; one that
        has none begins with FIRST, a line break, or WHOLE for a text that is not cut."""
        if self.drops_space:
            return text.split() if not ODD_SPACE.search(text) else [text]
        if ODD_SPACE.search(text) or ODD_BLANK.search(text):
            return [WHOLE + text]
        return (FIRST + text.replace("\n", " \n")).split(" ")

    def _text(self, key: str) -> str:
        if self.drops_space or key[0] == "\n":
            return key
        return key[1:] if key[0] in (FIRST, WHOLE) else " " + key

    def _merged(self, part: str) -> bytes:
        """Ids of a part that the vocabulary never cuts before merging."""
        ids = self.parts.get(part)
        if ids is None:
            if part.isascii():  # letters stand for themselves
                letters = part.translate(ASCII_LETTERS) if part[0] in " \n" else part
            else:
                letters = part.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = array("H", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
            if len(self.parts) < MAX_PARTS:
                self.parts[part] = ids
        return ids

    def _encode(self, keys: Collection[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for key in keys:
            simple = SIMPLE.fullmatch(self._text(key))
            if simple is None:
                rest.append(key)
                continue
            before, word, stop = simple.groups()
            if self.drops_space:
                before, word = "", word.lower()
            ids = self._merged(word)
            if before or stop:
                ids = (self._merged(before) if before else b"") + ids + (self._merged(stop) if stop else b"")
            out[key] = ids
        found = self.tokenizer.encode_batch_fast([self._text(k) for k in rest], add_special_tokens=False)
        out.update((key, array("H", e.ids).tobytes()) for key, e in zip(rest, found))
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Per text its ids as little-endian 16-bit numbers (both vocabularies have fewer than 65,536)."""
        if self.merge is None:
            return self._by_pieces(texts)
        sure = [not self.unsure.search(t) for t in texts]
        unsure = iter(self._by_pieces([t for t, plain in zip(texts, sure) if not plain]))
        return [self.merge(t) if plain else next(unsure) for t, plain in zip(texts, sure)]

    def _by_pieces(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        get = self.ids.get
        parts = [list(map(get, pieces)) for pieces in cut]
        missing = {p for pieces, own in zip(cut, parts) if None in own for p, x in zip(pieces, own) if x is None}
        if missing:
            new = self._encode(missing)
            for pieces, own in zip(cut, parts):
                if None in own:
                    own[:] = [new[p] if x is None else x for p, x in zip(pieces, own)]
            room = MAX_PIECES - len(self.ids)
            if room > 0:
                short = [p for p in new if len(p) <= MAX_PIECE][:room]
                self.ids.update((p, new[p]) for p in short)
        return [b"".join(own) for own in parts]


def worker_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this Python worker; its cache outlives the task."""
    if path not in _workers:
        _workers[path] = CachedTokenizer(path)
    return _workers[path]


def encoder(path: str) -> Callable[[Sequence[str]], list[bytes]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_tokenizer(path).encode
