"""Splitting texts as the tokenizers do, and where the fast split is known to agree with them."""

from __future__ import annotations

import regex

#: Code points below U+0378, general punctuation, kana, unified ideographs and Hangul syllables were
#: assigned long ago, so all Unicode versions class them alike.
SETTLED = regex.compile(r"[\u0000-\u0377\u2000-\u2064\u3000\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Latin letters and punctuation only, without U+001C to U+001F, which not all call white space: lower case is the same letter by letter and for the whole text.
LATIN = regex.compile(r"[\u0000-\u001b\u0020-\u012f\u0131-\u036f\u2000-\u2064]*")


def tokenizer(blob: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(blob.decode("utf-8"))


def stand_ins() -> dict[int, str]:
    """Code points that `regex` and the byte-level BPE library class differently (their Unicode versions differ), each with a character of the class that the library gives it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    ours, theirs = {}, {}
    for kind, one in ((r"\p{L}", "\u00e6"), (r"\p{N}", "0"), (r"\s", "\u2003")):
        found = bytes(tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode("utf-8")
        theirs |= dict.fromkeys(found, one)
        ours |= dict.fromkeys(regex.findall(kind, every), one)
    return {ord(c): theirs.get(c, "\u2021") for c in ours.keys() | theirs.keys() if ours.get(c) != theirs.get(c)}


class Splitter:
    """Texts to pre-tokens as the byte-level BPE libraries cut them."""

    def __init__(self, pattern: str):
        self.split, self.stand_ins = regex.compile(pattern).findall, None

    def __call__(self, text: str | None) -> list[str]:
        """Where the text has code points that libraries may class differently, the pre-tokens of the text with stand-ins say where to cut."""
        if not text:
            return []
        if SETTLED.fullmatch(text):
            return self.split(text)
        if self.stand_ins is None:
            self.stand_ins = stand_ins()
        alike = text.translate(self.stand_ins)
        if alike == text:
            return self.split(text)
        out, at = [], 0
        for piece in self.split(alike):
            at = alike.index(piece, at)
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out
