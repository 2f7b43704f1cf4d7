"""Public tokenizers: three vocabularies whose files lie on every machine at the paths given. Nothing is trained."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FOLDER = "/opt/tokenizers"
BYTE_LEVEL = f"{FOLDER}/byte_bpe_50k.json"
PIECES = f"{FOLDER}/piece_bpe_32k.model"
WORD_LEVEL = f"{FOLDER}/word_bpe_49k.json"
#: The fast encoder takes quadratic time over a run of letters or blanks; texts with longer ones go the other way.
LONG_RUN = re.compile(r"\S{400}|\s{400}")
#: How byte-level vocabularies split a text before merging (fixed values).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task remembers before they become the old ones, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 300_000, 24 << 20
#: A mark behind a letter is a word of its own in the word-level vocabulary, so a blank may go between.
_MARKS = r"(\p{L})([.,;:!?&#$%*()\"])"


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies spell bytes: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary. Special tokens in a text are plain text."""

    def __init__(self, path: str = BYTE_LEVEL) -> None:
        from tiktoken import Encoding

        self.path = path
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        alphabet = _byte_alphabet()
        # Special tokens are spelled plainly; they never come out of a text.
        special = {t["id"]: t["content"] for t in told["added_tokens"]}
        vocabulary = {i: token for token, i in told["model"]["vocab"].items()} | special
        self.spelling = [b""] * (max(vocabulary) + 1)
        for i, token in vocabulary.items():
            self.spelling[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        ranks = {s: i for i, s in enumerate(self.spelling) if s and i not in special}
        self.fast = Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        """The file's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int32)
        return self.encode_short(text)

    def encode_short(self, text: str) -> np.ndarray:
        """For texts without long runs of letters or blanks."""
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=())).astype(np.int32)


class SentencePieces:
    """A SentencePiece vocabulary; the model puts a space before a text."""

    def __init__(self, path: str = PIECES) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.spelling = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


class WordLevel:
    """Ids by a vocabulary whose tokens never cross ASCII blanks, so a word has the same ids everywhere.

    The distinct words of a batch are encoded once and remembered, in two
    generations with a bound on words and bytes. Special tokens in a text are
    found as the vocabulary file says.
    """

    def __init__(self, path: str = WORD_LEVEL) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        if len(self.memory) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.old, self.memory, self.held = self.memory, {}, 0
        found = list(map(self.memory.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        asked = [words[i] for i in missing]
        known = list(map(self.old.get, asked))
        new = [w for w, ids in zip(asked, known, strict=True) if ids is None]
        fresh = iter(self._new(new))
        known = [next(fresh) if ids is None else ids for ids in known]
        for i, ids in zip(missing, known, strict=True):
            found[i] = ids
        self.memory.update(pair for pair in zip(asked, known, strict=True) if len(pair[0]) <= 64)
        self.held += 4 * sum(map(len, known)) + sum(n for n in map(len, asked) if n <= 64)
        return found

    def _new(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words not seen before. Words of letters go together: each ends with the first token that ends a word."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(self.final[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) == len(some):
                start = 0
                for i, end in zip(some, ends, strict=True):
                    out[i] = tuple(ids[start:end])
                    start = end
            else:  # letters to one side, marks to the other: tables of characters differ
                rest += some
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = tuple(e.ids)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, and where each text ends. A null text has none."""
        column = column.cast(pa.large_string()).fill_null("")
        if not pc.any(pc.match_substring(column, "<|")).as_py():
            # The vocabulary is lower case, but for special tokens, which are found before letters are lowered.
            column = pc.ascii_lower(pc.replace_substring_regex(column, _MARKS, r"\1 \2"))
        split = pc.ascii_split_whitespace(column)
        offsets = np.asarray(split.offsets)
        words = split.flatten().dictionary_encode()
        known = self._words(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int32, len(known))
        values = np.fromiter(chain.from_iterable(known), np.uint32, int(sizes.sum()))
        at = np.asarray(words.indices)
        n = sizes[at]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        # Each word's ids stand together: where they begin, less where they go, plus the place.
        place = np.repeat((first[at] - ends[:-1]).astype(np.int32), n)
        place += np.arange(ends[-1], dtype=np.int32)
        return values[place], ends[offsets[1:] - offsets[0]]


@lru_cache(maxsize=4)
def loaded(kind: type, path: str):
    """One vocabulary per worker process."""
    return kind(path)
