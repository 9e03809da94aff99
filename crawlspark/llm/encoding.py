"""Whole-text encoding that encodes every distinct word of a task once.

The two public byte-pair files split texts before encoding, so a text's ids are
the ids of its words in order wherever a cut agrees with that split. Cuts used
here: before a space that a non-space follows (`spaced`), or at spaces, which are
dropped (`dropped`); in a word also before one trailing mark after a letter and
around a single newline between non-spaces. Everything else stays in one piece,
so results equal those of encoding the whole text.

A batch of texts is cut and its words numbered in Arrow; Python sees distinct
words alone, without marks, and ids are gathered by offsets. Words of letters go to
the tokenizer's model as the one piece that they are, other words through the whole
tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task keeps (about 200 bytes each); beyond it, they are learned anew.
CACHE_WORDS = 400_000
#: Bytes of texts that are cut at once.
BATCH_BYTES = 1 << 22
#: Characters that count as spaces for some library and not for others.
_UNSURE = "᠎​﻿"
_MARKS = ".,;:!?"
_ODD_SPACE = re.compile(f"[\\s{_UNSURE}][\\s{_UNSURE}]|[\\s{_UNSURE}]\\Z")
_SPACES = "".join(f"\\x{{{c:x}}}" for c in range(1 << 16) if chr(c).isspace() or chr(c) in _UNSURE)
_ODD_SPACE_RE2 = f"[{_SPACES}][{_SPACES}]|[{_SPACES}]\\z"
#: A text's beginning, and a line break before a word; all other words of the style `spaced`
#: have a space before them. Texts that hold these characters are encoded as a whole.
_FIRST, _LINE = "\x01", "\x03"
#: How the two files split words of printing ASCII characters; the letter for a space comes first.
_SPLIT = {"spaced": "'s|'t|'re|'ve|'m|'ll|'d|\u0120?[A-Za-z]+|\u0120?[0-9]+|\u0120?[^\u0120A-Za-z0-9]+",
          "dropped": "'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"}
#: Letters before it are letters for every library.
_SURE = "\u0250"
_MARKED = f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][{_MARKS}]\\z"  # U+0130 lowers to two


@lru_cache(maxsize=2)
def _tokenizer(path: str, special: bool):
    """A process keeps two tokenizers, whose sizes are their files'."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def _byte_letters() -> list[str]:
    """The letter that stands for every byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    of = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [of[b] for b in range(256)]


def encoder(path: str, style: str) -> "WordEncoder":
    """An encoder for one task; its words go when the task does."""
    return WordEncoder(path, style)


def row_runs(column: pa.Array, limit: int = BATCH_BYTES):
    """Yield (first row, rows) of runs of about `limit` bytes of texts, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes + 16)])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(before, before[at] + limit, "right")) - 1)
        yield at, to - at
        at = to


def _strings(words: pa.Array) -> list[str]:
    """The strings of an array; no word has a line break's mark in it."""
    if not len(words):
        return []
    joint = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), _LINE)
    return joint[0].as_py().split(_LINE)


class WordEncoder:
    """`style`: spaced (a space belongs to the word after it) or dropped (spaces vanish, case too).

    `special`: whether strings of special tokens in a text become those tokens,
    as they do with the library's defaults.
    """

    def __init__(self, path: str, style: str, special: bool = True):
        if style not in ("spaced", "dropped"):
            raise ValueError(style)
        self.tokenizer = _tokenizer(path, special)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.spaced = style == "spaced"
        self.letters = _byte_letters()
        self.split = re.compile(_SPLIT[style])
        self.extra = [e.ids for e in self.tokenizer.encode_batch(["\n", *_MARKS], add_special_tokens=False)]
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.mark = marks[0] if marks else ""
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self._clear()

    def _clear(self) -> None:
        """Forget all words but the line break (0) and the marks (from 1)."""
        self.number: dict[str, int] = {}
        self.ids = array("I", [i for ids in self.extra for i in ids])
        self.ends = array("q", np.cumsum([0, *map(len, self.extra)]).tolist())

    # --- cutting ---------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Pieces of a text whose ids can be joined."""
        if self.marks is not None and "<" in text and self.marks.search(text):
            first = _FIRST if self.spaced else ""
            return [w for i, part in enumerate(self.marks.split(text))
                    for w in ([first + part] if i % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if not _ODD_SPACE.search(text):
            return (_FIRST + text.replace("\n", " " + _LINE)).split(" ")
        parts, begun = [""], False
        for part in text.split(" "):
            if begun and (not part or part[0].isspace() or part[0] in _UNSURE):
                parts[-1] += " " + part
            elif begun:
                parts.append(part)
            else:
                parts[0] += part
                begun = True
        return [_FIRST + parts[0], *parts[1:]]

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The words of texts without odd spaces and special tokens."""
        if self.spaced:
            texts = pc.replace_substring(texts, "\n", " " + _LINE)
            texts = pc.binary_join_element_wise(pa.scalar(_FIRST), texts, pa.scalar(""))
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        return pc.split_pattern(texts, " ")

    # --- learning --------------------------------------------------------

    def _pieces(self, word: str) -> list[str] | None:
        """What the model gets for a word; None if the tokenizer has to look at it."""
        bare = self.spaced and word[:1] == _FIRST
        word = word[1:] if bare else word
        space = self.letters[32] if self.spaced and not bare else ""
        if word.isascii():
            if word.isalpha():
                return [space + word]
            if word.isprintable() and " " not in word and "<|" not in word:
                pieces = self.split.findall(space + word)
                return pieces if self.spaced or word == word.lower() else None
            return None
        if not word.isalpha() or max(word) >= _SURE:
            return None
        if self.normalizer is not None:
            word = self.normalizer.normalize_str(word)
            if not word.isalpha():
                return None
        return [space + "".join(map(self.letters.__getitem__, word.encode()))]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """The ids of short texts; where a special token can stand between them, all in one call."""
        joint = "" if self.marks is None else self.mark.join(texts)
        if not joint or joint.count("<|") != len(texts) - 1:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([joint], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.tokenizer.token_to_id(self.mark))
        return [ids[a:b].tolist() for a, b in zip(np.append(0, cut + 1), np.append(cut, len(ids)))]

    def _learn(self, new: list[str]) -> None:
        """Encode words, without marks and line breaks, and number them."""
        tokenize = self.model.tokenize
        found = [None if pieces is None else [t.id for p in pieces for t in tokenize(p)]
                 for pieces in map(self._pieces, new)]
        rest = [i for i, ids in enumerate(found) if ids is None]
        texts = [new[i][1:] if new[i][:1] == _FIRST else " " + new[i] for i in rest] if self.spaced else [
            new[i] for i in rest]
        full = [k for k, text in enumerate(texts) if text]
        for at in range(0, len(full), 200):
            part = full[at:at + 200]
            for k, ids in zip(part, self._encoded([texts[k] for k in part])):
                found[rest[k]] = ids
        begin = len(self.ends) - 1
        self.number.update(zip(new, range(begin, begin + len(new))))
        found = [ids or () for ids in found]
        self.ids.extend(chain.from_iterable(found))
        self.ends.extend(accumulate(map(len, found[1:]), initial=self.ends[-1] + len(found[0])) if found else ())

    # --- encoding --------------------------------------------------------

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words: the numbers of what they are made of, and how many those are."""
        broken = pc.starts_with(words, _LINE) if self.spaced else pa.array(np.zeros(len(words), bool))
        marked = pc.match_substring_regex(words, _MARKED)
        mark = np.zeros(len(words), np.int64)
        for i, sign in enumerate(_MARKS):
            mark[pc.ends_with(words, sign).to_numpy(zero_copy_only=False)] = i + 1
        broken, marked = (x.to_numpy(zero_copy_only=False) for x in (broken, marked))
        cores = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(words, 0, -1), words)
        if self.spaced:
            cores = pc.if_else(pa.array(broken), pc.binary_join_element_wise(
                pa.scalar(_FIRST), pc.utf8_slice_codeunits(cores, 1), pa.scalar("")), cores)
        else:
            cores = pc.if_else(pc.match_substring(cores, "<|"), cores, pc.ascii_lower(cores))
        coded = cores.dictionary_encode()
        distinct = _strings(coded.dictionary)
        new = [w for w in distinct if w not in self.number]
        if len(self.number) + len(new) > CACHE_WORDS:
            self._clear()
            new = distinct
        self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        count = 1 + broken.astype(np.int64) + marked
        end = np.cumsum(count)
        made = np.zeros(count.sum(), np.int64)  # a line break is number 0
        made[end - count + broken] = number[coded.indices.to_numpy()]
        made[end[marked] - 1] = mark[marked]
        return made, count

    @staticmethod
    def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of runs that begin at `begin`, one run after the other."""
        after = np.cumsum(size)
        return np.arange(after[-1] if len(after) else 0) + np.repeat(begin - (after - size), size)

    def _joined(self, words: pa.Array, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, whose words lie between offsets."""
        coded = words.dictionary_encode()
        made, count = self._numbers(coded.dictionary)
        ids, ends = np.array(self.ids, np.uint32), np.array(self.ends)
        begin, size = ends[:-1][made], np.diff(ends)[made]
        own = ids[self._spread(begin, size)]  # of the distinct words
        stop = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        code = coded.indices.to_numpy()
        size = np.diff(stop)[code]
        out = own[self._spread(stop[:-1][code], size)]
        cut = np.concatenate([[0], np.cumsum(size)])[offsets]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of every text; null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        out = []
        for at, n in row_runs(texts):
            out += self._encode_run(texts.slice(at, n))
        return out

    def _encode_run(self, texts: pa.Array) -> list[np.ndarray]:
        def chosen(flags):
            return flags.to_numpy(zero_copy_only=False)

        whole = chosen(pc.match_substring_regex(texts, f"[{_FIRST}{_LINE}]"))
        slow = chosen(pc.match_substring_regex(texts, _ODD_SPACE_RE2)) if self.spaced else np.zeros(len(texts), bool)
        if self.marks is not None:
            slow = slow | chosen(pc.match_substring(texts, "<|"))
        found: list = [None] * len(texts)

        def put(where, ids):
            for i, one in zip(np.flatnonzero(where), ids):
                found[i] = one

        fast, slow = ~slow & ~whole, slow & ~whole
        if fast.any():
            words = self._cut(texts.filter(pa.array(fast)))
            put(fast, self._joined(words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()))
        if slow.any():
            lists = [self.words(t) for t in texts.filter(pa.array(slow)).to_pylist()]
            put(slow, self._joined(pa.array([w for x in lists for w in x], pa.string()),
                                   np.concatenate([[0], np.cumsum([len(x) for x in lists])])))
        if whole.any():
            put(whole, [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(
                texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)])
        return found
