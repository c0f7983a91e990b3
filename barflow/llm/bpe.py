"""Byte-level BPE over Arrow batches: texts are cut into pieces by the pattern, each distinct piece is encoded once by the
``tokenizers`` library, and the ids of a text are gathered from its pieces with numpy. BPE never merges across pieces, so the ids
are the library's own."""
from __future__ import annotations

import base64
import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark runs the tasks side by side

#: The pieces a worker remembers, and the characters in them, before it drops those it rarely met.
MAX_PIECES, MAX_PIECE_CHARS = 500_000, 16_000_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def ranks_to_json(path: str, pattern: str) -> str:
    """A ``tokenizers`` definition for a file of ranks (base64 bytes, rank). Two tokens merge where their concatenation is a token,
    lowest rank first; every way to part a token in two is listed as a merge, in the order of ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    chars = byte_chars()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    own = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return own.to_str()


# Classes of the pattern: in full, on ASCII texts, and in the terms of the standard engine, which matches several times faster.
_CLASSES = [(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]", r"(?:[^\s\w]|_)"), (r"\p{L}", "[A-Za-z]", r"[^\W\d_]"), (r"\p{N}", "[0-9]", r"\d")]


def standard(pattern: str):
    """(splitter for ASCII texts, splitter for texts of usual characters), both None where the pattern has other classes."""
    ascii_, usual = pattern, pattern
    for full, narrow, same in _CLASSES:
        ascii_, usual = ascii_.replace(full, narrow), usual.replace(full, same)
    return (None, None) if r"\p" in ascii_ else (re.compile(ascii_, re.ASCII).findall, re.compile(usual).findall)


class Usual:
    """Tells texts of usual characters: those that Unicode has assigned and that both engines put into the same classes. Characters are
    judged when they are first met."""

    def __init__(self):
        self.known: set[str] = set()
        self.pairs = [(regex.compile(full).match, re.compile(same).match) for full, same in [(r"\s", r"\s"), *((full, same) for full, _, same in _CLASSES)]]

    def __call__(self, text: str) -> bool:
        new = set(text) - self.known
        self.known.update(c for c in new if unicodedata.category(c) != "Cn" and all(bool(a(c)) == bool(b(c)) for a, b in self.pairs))
        return new <= self.known


def roomy(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, or where it is shorter than ``size`` a copy with room for half as much again."""
    return x if len(x) >= size else np.concatenate([x, np.zeros(size + size // 2 - len(x), x.dtype)])


class Coder:
    """Encoder of one worker. ``definition``: text of a ``tokenizers`` file whose pieces are the matches of ``pattern``. Added tokens
    that occur in a text stand for themselves, as the library treats them by default."""

    def __init__(self, definition: str, pattern: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(definition)
        own = Tokenizer.from_str(definition)
        own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        own.encode_special_tokens = True
        self.one_piece, self.split_any = own, regex.compile(pattern).findall
        self.split_ascii, self.split_usual = standard(pattern)
        self.usual, before = Usual(), self.library.pre_tokenizer
        if isinstance(before, pre_tokenizers.ByteLevel):        # the library's own splitter judges texts of other characters
            self.split_any = lambda text: [text[a:b] for _, (a, b) in before.pre_tokenize_str(text)]
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.part = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.dtype = np.dtype("<u2" if max([self.library.get_vocab_size(), *self.added.values()]) < 65536 else "<u4")
        vocabulary = self.library.get_vocab()
        self.widths = np.zeros(max([*vocabulary.values(), *self.added.values()]) + 1, np.int64)      # bytes of each token, which a character stands for each
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = self.total = 0                 # in all pieces; ids of all pieces
        self.n_ids = np.zeros(1024, np.int64)       # per piece; these arrays have room to spare
        self.first = np.zeros(1024, np.int64)       # of a piece in the list of ids
        self.ids = np.zeros(1024, self.dtype)
        self.met = np.zeros(1024, np.int64)         # how often a piece was looked up

    def _keep_common(self) -> None:
        """Keep what was met most, a quarter of the room at most; codes handed out before are void."""
        often = np.flatnonzero(self.met >= 4)
        often = often[np.argsort(-self.met[often], kind="stable")[:MAX_PIECES // 4]]
        names = list(self.code)
        pieces = [p for p in (names[i] for i in often.tolist()) if len(p) <= 16]
        self._forget()
        self._add(pieces)

    def _apart(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many of each). The library is asked for ids only, which costs a third less than ids with their pieces; the widths of the tokens tell
        where a piece ends. Where they don't add up (a byte without a token), it is asked for both."""
        if not plain:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        ids = np.array(self.one_piece.encode_batch_fast([plain], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)     # one call, pieces apart
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(np.fromiter((len(p.encode()) for p in plain), np.int64, len(plain)))
        last = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            return ids, np.diff(last, prepend=-1)
        got = self.one_piece.encode(plain, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, self.dtype), np.bincount(np.array(got.word_ids, np.int64), minlength=len(plain))

    def _add(self, new: list[str]) -> None:
        if not new:
            return
        had = len(self.code)
        self.code.update(zip(new, range(had, had + len(new))))
        self.chars += sum(map(len, new))
        plain = [p for p in new if p not in self.added]
        ids, n = self._apart(plain)
        if len(plain) < len(new):
            where, at = np.cumsum(n) - n, np.array([i for i, p in enumerate(new) if p in self.added])
            before = at - np.arange(len(at))        # plain pieces ahead of each added token
            ids = np.insert(ids, np.append(where, len(ids))[before], [self.added[new[i]] for i in at])
            n = np.insert(n, before, 1)
        self.n_ids, self.first, self.met = (roomy(x, had + len(n)) for x in (self.n_ids, self.first, self.met))
        self.ids = roomy(self.ids, self.total + len(ids))
        self.n_ids[had:had + len(n)], self.first[had:had + len(n)] = n, self.total + np.cumsum(n) - n
        self.ids[self.total:self.total + len(ids)] = ids
        self.total += len(ids)

    def split(self, text: str) -> list[str]:
        if self.split_ascii and text.isascii():
            return self.split_ascii(text)
        return self.split_usual(text) if self.split_usual and self.usual(text) else self.split_any(text)

    def pieces(self, text: str) -> list[str]:
        if self.part and any(t in text for t in self.added):
            out = []
            for i, span in enumerate(self.part(text)):
                out += [span] if i % 2 else self.split(span)
            return out
        return self.split(text)

    def codes(self, pieces: list[str]) -> np.ndarray:
        """The worker's number of each piece, good until the next call; new pieces are encoded in one call."""
        if len(self.code) > MAX_PIECES or self.chars > MAX_PIECE_CHARS:
            self._keep_common()
        codes = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(unknown)))
            codes[missing] = np.fromiter(map(self.code.__getitem__, unknown), np.int64, len(unknown))
        if len(codes) > 1000:
            np.add.at(self.met, codes, 1)
        return codes

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of a run of pieces."""
        n = self.n_ids[codes]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[codes] - (ends - n), n)]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece."""
        codes = self.codes(pieces)          # may add pieces: look up the counts afterwards
        return self.n_ids[codes]

    def encode(self, text: str) -> np.ndarray:
        return self.gather(self.codes(self.pieces(text)))


_coders: dict[int, Coder] = {}


def coder(definition: str, pattern: str) -> Coder:
    """One coder per worker process and definition; workers are reused across tasks."""
    key = hash((definition, pattern))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(definition, pattern)
    return _coders[key]
