"""Ids of whole texts by the tokenizers library, each different piece of text encoded once."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tripleweave.llm.common import list_offsets, offsets_of, take_lists

#: Different words whose ids a worker remembers.
CACHE_WORDS = 300_000

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The vocabulary's own rules drop white space and never look across it, so a text's ids are those of its words.
    Words repeat; each is encoded once by the library and put in its places. Before that, Latin words are put in
    lower case and their closing punctuation is set apart, which leaves the ids as they are: Latin letters up to
    U+017F don't change by composition, and a letter never shares a token with punctuation. Words of such letters
    alone go straight to the library's model, all others through all of its steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # byte-level vocabularies write the bytes that don't print as the characters from 256 on, in order
        odd = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
        self.letters = {byte: 256 + k for k, byte in enumerate(odd)}

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` and their offsets by text."""
        words = pc.ascii_split_whitespace(texts)
        chosen = words.flatten().dictionary_encode()
        ids, offsets = self._words(chosen.dictionary)
        flat, by_word = take_lists(ids, offsets, chosen.indices.to_numpy().astype(np.int64))
        return flat, by_word[list_offsets(words)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_not(
            pc.match_substring_regex(words, r"^[\x00-\x{12F}\x{131}-\x{17F}]*$"), pc.match_substring(words, "<|")
        )
        lower = pc.replace_substring_regex(pc.utf8_lower(words), r"([a-zß-öø-ſ])([.,!?;:%$#*&]+)", r"\1 \2")
        parts = pc.ascii_split_whitespace(pc.if_else(plain, lower, words))
        chosen = parts.flatten().dictionary_encode()
        ids, offsets = self._parts(chosen.dictionary.to_pylist())
        flat, by_part = take_lists(ids, offsets, chosen.indices.to_numpy().astype(np.int64))
        return flat, by_part[list_offsets(parts)]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        new = [part for part in parts if part not in known]
        fresh: dict[str, bytes] = {}
        tokenize = self.library.model.tokenize
        for part in new:
            if part.isalpha() and max(part) <= "\u017f" and part == part.lower():  # one word, as the rules leave it
                tokens = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
                ids = [token.id for token in tokens]
            else:
                ids = self.library.encode(part, add_special_tokens=False).ids
            (known if len(known) < CACHE_WORDS else fresh)[part] = struct.pack(f"<{len(ids)}I", *ids)
        got = [known[part] if part in known else fresh[part] for part in parts]
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), np.uint32), offsets_of(lengths)
