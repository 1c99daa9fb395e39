"""Tokenizer libraries behind one interface, with bounded caches of what short pieces encode to.

``PieceEncoder`` is for byte-level BPE. Its pre-tokens never cross a step from a character that is
not white space to a space or line break, so a text may be cut there and the parts encoded one by
one, whatever stands around them. Texts of characters that all Unicode versions class alike are
encoded by ranks of the same vocabulary, which gives the same ids faster; those with the special
string or any other character by the tokenizer file itself.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from itertools import accumulate

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

BYTE_BPE, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces kept by each Python worker; the cache is emptied when it is full.
CACHE_PIECES = 200_000

_run_of_space = re.compile(r"\s[ \n]")
_cut = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters that every Unicode version puts into the same class of the pattern.
_plain = re.compile("[\t\n\r\x20-\x7eÀ-ɏΑ-ΡΣ-ώА-я‐-‧ぁ-ゔ一-龥가-힣]*")
#: Longest stretch that is encoded at once where only the ids are asked for.
STRETCH = 1 << 16


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def stable(text: str, at: int) -> bool:
    """Whether a step from no white space to a space or line break is at ``at``: no pre-token of
    the byte-level pattern spans it, whatever the context, so every encoding has a boundary there."""
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def pieces(text: str) -> list[str]:
    """Cut before each space or line break that follows a character other than white space."""
    if _run_of_space.search(text) or "\0" in text:
        return _cut.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """Cut at stable places into stretches of about ``size`` characters."""
    out, a = [], 0
    while len(text) - a > size:
        at = _cut.search(text, a + size)
        if not at:
            break
        out.append(text[a : at.start()])
        a = at.start()
    return [*out, text[a:]] if a < len(text) else out


class _Ids(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = self.encode(piece)
        if len(piece) < 64:
            self[piece] = out
        return out


class PieceEncoder:
    """Byte-level BPE. Ids are little-endian unsigned 32-bit, as bytes."""

    def __init__(self, path: str, ranks: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = _Ids(self._encode)

    def _encode(self, text: str) -> bytes:
        if _plain.fullmatch(text) and not any(s in text for s in self.special):
            return array("I", self.by_ranks.encode_ordinary(text)).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._encode, stretches(text)))

    def marks(self, text: str) -> tuple[list[int], list[int]]:
        """Where pieces start, in characters, and the tokens before each; the ends close both."""
        at, n, starts, counts = 0, 0, [], []
        for p in pieces(text):
            starts.append(at)
            counts.append(n)
            at += len(p)
            n += len(self.cache[p]) // 4
        return [*starts, at], [*counts, n]


class LibraryEncoder:
    """Any other file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = None
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    def ids(self, text: str) -> bytes:
        if self.library:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.pieces.encode(text, num_threads=1)).tobytes()

    def marks(self, text: str) -> tuple[list[int], list[int]]:
        if self.library:
            starts = [a for a, _ in self.library.encode(text, add_special_tokens=False).offsets]
        else:
            starts = [p.begin for p in self.pieces.encode(text, return_type="proto", num_threads=1).pieces]  # in bytes
            if not text.isascii():
                chars = list(accumulate((b & 0xC0 != 0x80 for b in text.encode()), initial=0))
                starts = [chars[s] for s in starts]
        return [*starts, len(text)], [*range(len(starts)), len(starts)]


_encoders: dict[tuple[str, str], PieceEncoder | LibraryEncoder] = {}


def encoder(name: str = BYTE_BPE, ranks: str = BYTE_BPE_RANKS) -> PieceEncoder | LibraryEncoder:
    """One per Python process and file."""
    if (name, ranks) not in _encoders:
        path = tokenizer_path(name)
        _encoders[name, ranks] = PieceEncoder(path, tokenizer_path(ranks)) if os.path.basename(path) == BYTE_BPE else LibraryEncoder(path)
    return _encoders[name, ranks]
