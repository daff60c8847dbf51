"""Ids of texts by a lower-casing word vocabulary of the tokenizers library.

Arrow lowers the texts of a batch and cuts them into the vocabulary's pieces; each distinct piece goes
through the library's own model once and is remembered, and the ids of a batch are one gather from those
of all known pieces. What a character is (its lower case, and whether it is a blank, a letter, a digit or
other) is asked of the library the first time the character is seen. A text goes to the library whole
where it has a character that is treated otherwise here or can compose with others, or a special token.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Pieces that are encoded as one text.
JOINED = 256
#: Pieces that are remembered; then all are forgotten.
KNOWN = 1 << 20
#: Fixed value: the pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Its pieces but for runs of letters, which are what stands between these and blanks.
CUTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"


def _cut(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), CUTS, r" \1 ")))


def _gathered(ids: np.ndarray, ends: np.ndarray, of: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these entries in a row, and where each list of them ends, from 0; entry k is ``ids[ends[k]:ends[k + 1]]``."""
    size = ends[of + 1] - ends[of]
    before = np.concatenate([[0], np.cumsum(size)])
    return ids[np.arange(before[-1]) + np.repeat(ends[of] - before[:-1], size)], before[lists - lists[0]]


def _composes(c: str) -> bool:
    """Whether the character can be joined with one before it: marks, and the later parts of Hangul syllables."""
    return unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ"


class WordIds:
    def __init__(self, name: str = VOCABULARY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        spec = json.loads(self.library.to_str())
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if split["pattern"] != {"Regex": PATTERN} or self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name} is no vocabulary of this kind")
        self.special = [t["content"] for t in spec["added_tokens"]]
        blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        cutter = {"type": "Sequence", "pretokenizers": [blanks, byte_level]}
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": cutter}))
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 << 16, bool)
        self.last[[k for token, k in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        # Blanks at an end of a text leave an empty piece.
        self.number: dict[str, int] = {"": 0}
        self.flat, self.ends = np.empty(0, "<u2"), np.zeros(2, np.int64)

    def _learn(self, chars: set[str]) -> None:
        new = sorted(chars - self.alike - self.unlike)
        if not new:
            return
        # Beside letters, digits and others, and doubled, every class of character gives other pieces.
        probes = [f"a{c}a1{c}1-{c}-{c}{c}" for c in new]
        for c, probe, ours in zip(new, probes, _cut(pa.array(probes)).to_pylist()):
            plain = self.library.normalizer.normalize_str(probe)
            theirs = [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            (self.alike if ours == theirs and not _composes(c) else self.unlike).add(c)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2")

    def _add(self, pieces: list[str]) -> None:
        """Make pieces known. Many are encoded as one text: the last id of a piece is one that ends a word."""
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        joined = [" ".join(pieces[lo : lo + JOINED]) for lo in range(0, len(pieces), JOINED)]
        found = [np.array(x.ids, "<u2") for x in self.model.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<u2")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark ends of words")
        self.ends = np.concatenate([self.ends, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as little-endian 16-bit integers, and how many each has; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        plain = texts.to_pylist()
        chars = set().union(*plain)
        self._learn(chars)
        odd = not self.unlike.isdisjoint(chars)
        hard = [k for k, t in enumerate(plain) if (odd and not self.unlike.isdisjoint(t)) or any(s in t for s in self.special)]
        if not hard:
            return self._ids(texts)
        easy = np.ones(len(plain), bool)
        easy[hard] = False
        ids, sizes = self._ids(pc.if_else(pa.array(easy), texts, ""))
        each = np.split(ids, np.cumsum(sizes)[:-1])
        for k in hard:
            each[k] = self._whole(plain[k])
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > KNOWN:
            self._forget()
        runs = pc.utf8_split_whitespace(texts)
        of_text = runs.flatten().dictionary_encode()
        pieces = _cut(of_text.dictionary)
        of_run = pieces.flatten().dictionary_encode()
        distinct = of_run.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = number < 0
        number[new] = np.arange(len(self.number), len(self.number) + new.sum())
        self._add(distinct[new].tolist())
        ids, ends = _gathered(self.flat, self.ends, number[of_run.indices.to_numpy()], pieces.offsets.to_numpy())
        ids, ends = _gathered(ids, ends, of_text.indices.to_numpy(), runs.offsets.to_numpy())
        return ids, np.diff(ends)


@cache
def word_ids(name: str = VOCABULARY) -> WordIds:
    """The encoder of a worker, with what it remembers."""
    return WordIds(name)
