"""Tables of distinct words: texts are split into the words a tokenizer sees, and each word is encoded once."""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

#: Characters whose Unicode properties all libraries agree on: Latin, its marks and common punctuation.
#: (U+0130 isn't among them: lower-cased it is two characters.)
_PLAIN = [*map(chr, range(0x130)), *map(chr, range(0x131, 0x300)), *map(chr, range(0x2010, 0x2028)), "€"]
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u02ff\u2010-\u2027\u20ac]")
#: White space as the libraries see it; the first line are those among the plain characters.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_WHITE = _SPACE + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where all pre-tokenizers cut whatever the characters are: before a space in front of a word, and around other white space.
_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]").findall


def _ranges(chars: list[str]) -> str:
    """The characters as the inside of a regular expression's class."""
    out = []
    for _, run in itertools.groupby(enumerate(map(ord, chars)), lambda x: x[1] - x[0]):
        codes = [c for _, c in run]
        out.append(f"\\u{codes[0]:04x}" + (f"-\\u{codes[-1]:04x}" if len(codes) > 1 else ""))
    return "".join(out)


_L = _ranges([c for c in _PLAIN if unicodedata.category(c)[0] == "L"])
_N = _ranges([c for c in _PLAIN if unicodedata.category(c)[0] == "N"])
_S = _ranges(sorted(_SPACE))
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed values: the endings both vocabularies split off
_ANY_CASE = "'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"  # the same where the text is lower-cased first


class WordTable:
    """The words of texts and their ids by a tokenizers file, each distinct one encoded once.

    A text is cut into chunks at white space; a chunk's ids don't depend on what stands around it. Strings of
    special tokens are chunks of their own and become their ids, as the library does. Chunks of plain characters
    are split into words by a regular expression, others by the library's own normalizer and pre-tokenizer.

    Encodings are kept in a table: those given stay; others go once there are more than most of them or their
    strings hold most_bytes, so memory is bounded whatever the documents are.
    """

    def __init__(self, path: str, given: dict[str, bytes] | None = None, most: int = 200_000, most_bytes: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.given, self.most, self.most_bytes = given or {}, most, most_bytes
        self.table, self.held = dict(self.given), 0
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.drops_space = self.tokenizer.normalizer is not None
        body = rf"[{_L}]+|{_ANY_CASE}|[{_N}]|[^{_S}{_L}{_N}]+" if self.drops_space else rf" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
        self._words = re.compile(rf"[{_S}]*(?:{body})" if self.drops_space else body).findall

    def plain(self, text: str) -> bool:
        return text.isascii() or (not _NOT_PLAIN.search(text) and (not self.drops_space or unicodedata.is_normalized("NFC", text)))

    def chunks(self, text: str) -> list[str]:
        """The text in pieces whose ids, joined, are the text's."""
        if not any(map(text.__contains__, self.special)):
            return _CHUNKS(text)
        return [c for part in self._special.split(text) if part for c in ((part,) if part in self.special else _CHUNKS(part))]

    def words_of(self, chunk: str) -> list[str]:
        """The words of one chunk; none where the chunk is white space that is dropped."""
        if chunk in self.special:
            return [chunk]
        return self._words(chunk) if self.plain(chunk) else self._split(chunk)

    def words(self, text: str) -> list[str]:
        """The text's words; joined they give the text, but for white space at its end where that is dropped."""
        out, before = [], ""
        for chunk in self.chunks(text):
            if own := self.words_of(chunk):
                out += [before + own[0], *own[1:]]
                before = ""
            else:
                before += chunk
        return out

    def _split(self, text: str) -> list[str]:
        from tokenizers import PreTokenizedString

        seen = PreTokenizedString(text)
        if self.tokenizer.normalizer is not None:
            seen.normalize(self.tokenizer.normalizer.normalize)
        self.tokenizer.pre_tokenizer.pre_tokenize(seen)
        words, at = [], 0
        found = [span for _, span, _ in seen.get_splits(offset_referential="original", offset_type="char")]
        for k, (_, end) in enumerate(found):
            #: No cut inside what one character became, nor before what the normalizer may join to the character before it.
            if end <= at or (k + 1 < len(found) and (found[k + 1][0] < end or unicodedata.combining(text[end]) or "\u1160" <= text[end] <= "\u11ff")):
                continue
            words.append(text[at:end])
            at = end
        words += [text[at:]] if text[at:] and not (self.drops_space and not found) else []
        whole, *parts = self.tokenizer.encode_batch_fast([text, *words], add_special_tokens=False)
        return words if whole.ids == [i for p in parts for i in p.ids] else [text]

    def ids(self, texts_words: list[list[str]]) -> dict[str, bytes]:
        """The table, now with each of the words or chunks: its ids as little-endian unsigned 32-bit numbers."""
        if len(self.table) > self.most + len(self.given) or self.held > self.most_bytes:
            self.table, self.held = dict(self.given), 0
        table = self.table
        new = list(set().union(*texts_words).difference(table)) if texts_words else []
        for at in range(0, len(new), 4_096):
            some = new[at : at + 4_096]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                table[word] = b"".join([i.to_bytes(4, "little") for i in found.ids])
            self.held += sum(map(len, some))
        return table


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


def pieces_of(tokenizer) -> list[bytes]:
    """The bytes of each id: what the decoder joins."""
    chars = byte_of_char()
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = special[i].encode() if i in special else bytes(map(chars.__getitem__, piece))
    return out

