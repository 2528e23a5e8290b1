"""Token ids of whole texts by the tokenizers library, with a memo of words per Python process.

A text is cut where a byte-level BPE with the usual word pattern never joins: before a single space or at a single line
end between two characters that are not white space. Texts are worked on in groups: Arrow numbers the different pieces of
a group, what the memo lacks of them is encoded by the library, each once, and NumPy puts the texts' ids together. Words of
Latin letters (the punctuation after them apart, which such a BPE never joins either) go to the library's model many at a
time, with a byte between them that is in none of its merges: no merge crosses it, so each gets the ids that it has alone.
A text with longer runs of white space is cut before each run; one with white space beyond ASCII next to a cut
is encoded whole, and so is one that contains an added token such as <|endoftext|>, which the library finds before words.
Very long texts are first cut at such a space into parts of about PART characters, which bounds the lists of words. The
memo is bounded in bytes, whatever the words are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the memo of one process holds, in two generations.
MEMO = 128 << 20
#: Characters of a long text that are worked on at once.
PART = 1 << 20
#: Characters of texts whose words are looked up together.
GROUP = 4 << 20
#: Words that the library's model gets at once.
JOINED = 100
#: Marks, by hash, of words that came once; only what comes again is kept, as most different words come once.
_SEEN = 1 << 21
#: What an entry takes in a dict of changing size.
_SLOT = 110

_WS = r"[ \t-\r]"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_pieces = re.compile(rf"{_WS}*+[{_LATIN}]++(?=[.,!?;:|]*+(?![^ \t-\r]))|{_WS}*+[^ \t-\r]++|{_WS}+").findall
_odd_space = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
#: ASCII punctuation at a word's end, but no apostrophe, with which endings such as 's begin.
_MARK = r"[!-&(-/:-@\[-`{-~]"
_marks = re.compile(rf"{_MARK}(?<=[{_LATIN}].){_MARK}*+(?= |\Z)").sub
#: What stands before a piece that has no space before it: nothing else has two line ends.
_BARE = "\n\n"
_word = re.compile(rf"(?:\n\n)?[{_LATIN}]++").fullmatch
#: In place of the ids of a piece that is no safe cut.
_UNSAFE = b"-"


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level BPE writes each byte: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of pieces. `before` is the generation before this one, from which what is asked for moves on; `held` counts bytes."""

    def __init__(self, before: dict):
        super().__init__()
        self.before, self.held, self.seen = before, 0, bytearray(_SEEN)

    def keep(self, word: str, own: bytes) -> None:
        self[word] = own
        self.held += _SLOT + getsizeof(word) + getsizeof(own)

    def came(self, word: str) -> bool:
        """Whether the word, or one with its mark, came before."""
        place = hash(word) & _SEEN - 1
        if self.seen[place]:
            return True
        self.seen[place] = 1
        return False

    def next(self) -> _Words:
        self.before, self.seen = {}, bytearray()
        return _Words(self)


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or () if t["content"]]
        self.has_added = re.compile("|".join(added)).search if added else lambda text: None
        self.letters = _byte_letters()
        self.between = self._between(spec["model"])
        self.limit = memo
        self.inner = _Words({})  # of pieces after a space
        self.first = _Words({})  # of pieces with no space before them, and of the line end
        self.memo = _Words({})  # of punctuation and of pieces with their white space

    def _between(self, model: dict) -> str | None:
        """A control character whose byte no merge has, so that words can be joined with it; None: this model's words are encoded alone."""
        changes = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in changes):
            return None
        merged = {c for m in model["merges"] for c in ("".join(m) if isinstance(m, list) else m)}
        return next((chr(b) for b in range(9) if chr(self.letters[b]) not in merged and chr(self.letters[b]) in model["vocab"]), None)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that _word fits."""
        out, tokenize, b = [], self.tokenizer.model.tokenize, self.between
        sign = b and self.tokenizer.token_to_id(chr(self.letters[ord(b)]))
        for k in range(0, len(pieces), JOINED):
            joined = f"{b} " + f"{b} ".join(pieces[k : k + JOINED])
            joined = joined.replace(" " + _BARE, "").encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in tokenize(joined)], "<u4")
            data, begins = ids.tobytes(), (4 * np.flatnonzero(ids == sign)).tolist()
            out += [data[i + 4 : j] for i, j in zip(begins, [*begins[1:], len(data)], strict=True)]
        return out

    def _turn(self) -> None:
        """Forgets the generation before if this one has its half of the memo."""
        if 2 * (self.inner.held + self.first.held + self.memo.held) > self.limit:
            self.inner, self.first, self.memo = self.inner.next(), self.first.next(), self.memo.next()

    @staticmethod
    def _marked(text: str) -> str:
        """The text with a space before each piece but the first."""
        return _BARE + _marks(rf" {_BARE}\g<0>", text.replace("\n", f" \n {_BARE}"))

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that the memo doesn't have."""
        out: list[bytes | None] = [None] * len(pieces)
        other = [k for k, p in enumerate(pieces) if not _word(p)] if self.between else range(len(pieces))
        texts, own = [], []
        for k in other:
            body = pieces[k].removeprefix(_BARE)
            if body == "\n" or body and not body[0].isspace() and not body[-1].isspace():
                own.append(k)
                texts.append(" " + body if body == pieces[k] != "\n" else body)
                out[k] = b""
            else:
                out[k] = _UNSAFE if body == pieces[k] or body else b""
        for k, ids in zip(own, self._whole(texts), strict=True):
            out[k] = ids
        words = iter(self._joined([p for p, ids in zip(pieces, out, strict=True) if ids is None]))
        return [next(words) if ids is None else ids for ids in out]

    def _by_words(self, texts: list[str]) -> list[bytes | None]:
        """None: the text has white space that this doesn't cut."""
        marked = [self._marked(t) for t in texts]
        ends = np.cumsum([t.count(" ") + 1 for t in marked])
        numbered = pc.split_pattern(pa.array([" ".join(marked)], pa.large_string()), " ").flatten().dictionary_encode()
        at, pieces = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.inner.get, pieces))
        lacking = [k for k, ids in enumerate(own) if ids is None]
        for known, now in ((self.first, None), (self.inner.before, self.inner), (self.first.before, self.first)):
            if known:
                for k, ids in zip(lacking, [known.get(pieces[k]) for k in lacking], strict=True):
                    if ids is not None:
                        own[k] = ids
                        if now is not None:
                            now.keep(pieces[k], ids)
                lacking = [k for k in lacking if own[k] is None]
        often = (np.bincount(at, minlength=len(pieces)) > 1).tolist()
        lacking_pieces = [pieces[k] for k in lacking]
        for k, piece, ids in zip(lacking, lacking_pieces, self._learn(lacking_pieces), strict=True):
            own[k] = ids
            known = self.first if piece[:1] == "\n" else self.inner
            if often[k] or known.came(piece):
                known.keep(piece, ids)
                self._turn()
        sizes = np.fromiter(map(len, own), "int64", len(own))
        unsafe = sizes % 4 > 0
        if unsafe.any():
            own, sizes = [b"" if ids == _UNSAFE else ids for ids in own], np.where(unsafe, 0, sizes)
            bad = set(np.searchsorted(ends, np.flatnonzero(unsafe[at]), side="right").tolist())
        else:
            bad = ()
        flat, sizes = np.frombuffer(b"".join(own), "<u4"), sizes // 4
        size = sizes[at]
        stops = np.cumsum(size)
        data = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - stops + size, size) + np.arange(int(stops[-1]))].tobytes()
        stops = (4 * stops[ends - 1]).tolist()
        return [None if k in bad else data[a:z] for k, (a, z) in enumerate(zip([0, *stops], stops, strict=False))]

    def _by_runs(self, text: str) -> bytes:
        if _odd_space(text):
            return self._whole([text])[0]
        pieces = _pieces(text)
        missing = [w for w in dict.fromkeys(pieces) if w not in self.memo]
        for w, own in zip(missing, self._whole(missing), strict=True):
            self.memo.keep(w, own)
        return b"".join(map(self.memo.__getitem__, pieces))

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """The text, cut before single spaces between characters that are not white space."""
        at = 0
        while len(text) - at > PART:
            cut = text.find(" ", at + PART)
            while cut > 0 and (cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[list[bytes], int, str]] = []  # where a part's ids go
        held = 0

        def end() -> None:
            for (own, k, part), ids in zip(group, self._by_words([part for *_, part in group]) if group else (), strict=True):
                own[k] = self._by_runs(part) if ids is None else ids
                self._turn()
            group.clear()

        for text, own in zip(texts, out, strict=True):
            if self.has_added(text):
                own += self._whole([text])
                continue
            for part in self._parts(text):
                if "\n\n" in part or "  " in part:
                    own.append(self._by_runs(part))
                    self._turn()
                    continue
                group.append((own, len(own), part))
                own.append(b"")
                held += len(part)
                if held >= GROUP:
                    end()
                    held = 0
        end()
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if (path, memo) not in _encoders:
        _encoders[path, memo] = Encoder(path, memo)
    return _encoders[path, memo]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
