"""Byte-pair encoding by forced-boundary splitting, and decoding.

A vocabulary says which two bytes ever stand side by side inside one of its tokens. Wherever a word has a pair that
never does, no merge can reach across, so the word is cut there for certain. The fragments between cuts are encoded
independently (and remembered, as few distinct ones make up most texts), and their ids are concatenated.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack
from sys import getsizeof

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fresh, small_batches

#: White space as Unicode defines it. Python's own notion also has U+001C to U+001F.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Room for an id in a pair of ids.
SHIFT = 24
#: Bytes of the words remembered; forgetting never changes a result. A Python worker keeps them when its task is over,
#: so they also count while later stages of a session run.
REMEMBERED = 64 << 20
#: Bytes of a dictionary for each of its entries, with the room left free for more.
SLOT = 40


class Memory:
    """Strings by string, of a bounded number of bytes. When it is full all are old; what is used again becomes young.

    Each new one then drives out an old one, until none is left and all are old again.
    """

    def __init__(self, most: int = REMEMBERED, longest: int = 48) -> None:
        self.most, self.longest, self.size = most, longest, 0
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def get(self, key: str) -> str | None:
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.young[key] = found
        return found

    def put(self, key: str, value: str) -> None:
        """Remember a value that a key has for good."""
        if len(key) > self.longest or self.get(key) is not None:
            return
        self.size += getsizeof(key) + getsizeof(value) + SLOT
        while self.size > self.most and (self.old or self.young):
            if not self.old:
                self.old, self.young = self.young, {}
            gone = self.old.popitem()
            self.size -= getsizeof(gone[0]) + getsizeof(gone[1]) + SLOT
        self.young[key] = value


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}
    return [chars[b] for b in range(256)]


#: How texts are made into words here; a vocabulary that wants it otherwise is refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def refuse_others(spec: dict) -> None:
    """ValueError if a vocabulary's texts are normalised, cut, merged or decoded otherwise than here."""
    normalizer, cutter, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    first = (cutter.get("pretokenizers") or [{}])[0]
    wanted = {
        "model": model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        and not model.get("byte_fallback") and not model.get("ignore_merges"),
        "normalizer": normalizer.get("type") == "Sequence" and normalizer.get("normalizers") == NORMALIZERS,
        "pre_tokenizer": cutter.get("type") == "Sequence" and cutter["pretokenizers"][1:] == [BYTE_LEVEL]
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True),
        "post_processor": spec.get("post_processor") is None, "decoder": spec.get("decoder") is None,
        "added_tokens": not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]),
    }
    if wrong := [part for part, fine in wanted.items() if not fine]:
        raise ValueError(f"the vocabulary's {', '.join(wrong)} can't be followed")


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary with an end-of-word mark, read from its JSON text.

    Texts are composed (NFC), lower-cased character by character, and cut into words by the file's own pattern; white
    space vanishes. Special tokens written out in a text become their ids, as the vocabulary's library has it.
    """

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        refuse_others(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: No token that merges make holds a space, so joined by spaces they can be told apart again.
        self._ids = self.vocab | special
        self.tokens = {i: t for t, i in self._ids.items()}
        self.special = special
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pattern = regex.compile(pattern["pattern"]["Regex"])
        chars = byte_alphabet()
        self._byte = {c: n for n, c in enumerate(chars)}
        #: The ids of each byte inside of a word, and at its end.
        self._first = [self.vocab[c] for c in chars]
        self._last = [self.vocab[c + self.end] for c in chars]
        self._ranks: dict[int, int] = {}
        self._made: list[int] = []
        for n, (left, right) in enumerate(merges):
            self._ranks.setdefault(self.vocab[left] << SHIFT | self.vocab[right], n)
            self._made.append(self.vocab[left + right])
        self.inside = self._pairs_inside()
        self._inside = {divmod(pair, 256) for pair in self.inside}
        #: Words that aren't ASCII, and all others, which are pieces of texts as they stand.
        self._words, self._chunks = Memory(REMEMBERED // 5), Memory(4 * REMEMBERED // 5)

    def _pairs_inside(self) -> set[int]:
        """Pairs of bytes (first * 256 + second) that occur inside at least one token."""
        found: set[int] = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end and len(token) > len(self.end) else token
            found.update(self._byte[a] << 8 | self._byte[b] for a, b in zip(body, body[1:]))
        return found

    def cuts(self, word: bytes) -> list[bytes]:
        """A word cut where no token can reach across."""
        inside = self._inside
        if inside.issuperset(zip(word, word[1:])):
            return [word]
        out, start = [], 0
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _merge(self, fragment: bytes, last: bool) -> list[int]:
        """The ids of a fragment; ``last`` if it ends its word."""
        first = self._first
        ids = [first[b] for b in fragment]
        if last:
            ids[-1] = self._last[fragment[-1]]
        return self._merge_short(ids) if len(ids) <= 200 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank, again and again, with the ranks kept at hand."""
        rank, made, none = self._ranks.get, self._made, 1 << 60
        ranks = [rank(a << SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << SHIFT | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << SHIFT | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for very long fragments, with all places of a pair merged in one sweep.

        A pair that a merge makes always has a higher rank than the merge itself, so the order is the same.
        """
        rank, none = self._ranks.get, 1 << 60
        while len(ids) > 1:
            low, left, right = min((rank(a << SHIFT | b, none), a, b) for a, b in set(zip(ids, ids[1:])))
            if low == none:
                break
            merged, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == left and ids[i + 1] == right:
                    merged.append(self._made[low])
                    i += 2
                else:
                    merged.append(ids[i])
                    i += 1
            ids = merged
        return ids

    def _word(self, word: str) -> str:
        """The tokens of one word, joined by spaces: all that is remembered, as it takes less than half of ids and tokens."""
        memory = self._chunks if word.isascii() else self._words
        known = memory.get(word)
        if known is None:
            fragments = self.cuts(word.encode())
            ids = self._merge(fragments[-1], True)
            if len(fragments) > 1:
                ids = [i for f in fragments[:-1] for i in self._merge(f, False)] + ids
            tokens = self.tokens
            known = " ".join([tokens[i] for i in ids])
            memory.put(word, known)
        return known

    def _piece(self, piece: str) -> str:
        """The same for any text without special tokens."""
        if piece.isascii():
            if piece.isalpha():
                return self._word(piece.lower())
        else:
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        words = [self._word(w) for w in self._pattern.findall(piece.lower())]
        return words[0] if len(words) == 1 else " ".join(words)

    def _pieces(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):  # these are no white space here, though str.split() takes them for it
            return [self._piece(text)]
        memory, chunks = self._chunks, text.split()
        out = list(map(memory.young.get, chunks))
        for n, known in enumerate(out):
            if known is None:
                known = memory.get(chunks[n])
                if known is None:
                    known = self._piece(chunks[n])
                    memory.put(chunks[n], known)
                out[n] = known
        return out

    def _ordinary(self, text: str) -> tuple[bytes, str]:
        """The ids of a text without special tokens, and their tokens joined by spaces."""
        decoded = " ".join(filter(None, self._pieces(text)))
        ids = list(map(self._ids.__getitem__, decoded.split(" "))) if decoded else []
        return pack(f"<{len(ids)}I", *ids), decoded

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """The ids of a whole text as little-endian 32-bit integers, and the text they decode to."""
        if self._special is None or not self._special.search(text):
            return self._ordinary(text)
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts.append(self._ordinary(text[at : m.start()]))
            parts.append((pack("<I", self.special[m[0]]), m[0]))
            at = m.end()
        parts.append(self._ordinary(text[at:]))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_and_decode(text)[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: the vocabulary has no decoder of its own. Unknown ids are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def tokenizer(definition: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(definition)


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """Add the token ids of every whole text and the text that they decode to.

    ``vocabulary`` is the path of a byte-level BPE file (JSON) on the driver; its content travels to the executors as a
    broadcast of a fixed size. ``ids_col`` is binary: little-endian unsigned 32-bit integers. Null and empty texts have
    no ids and decode to an empty text. All columns of ``docs`` come back (the two new ones replace clashing ones);
    rows are independent, so nothing is shuffled and repeated rows just repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(shared.value)
        for batch in texts:
            rows = [bpe.encode_and_decode(t or "") for t in batch]
            yield pd.DataFrame({"ids": [r[0] for r in rows], "decoded": [r[1] for r in rows]})

    (made,) = fresh(docs, "bpe")
    keep = [col(docs, c) for c in docs.columns if c.lower() not in (ids_col.lower(), decoded_col.lower())]
    out = docs.select(*keep, both(col(docs, text_col)).alias(made))
    names = [c for c in out.columns if c != made]
    return out.select(
        *[col(out, c) for c in names],
        F.col(made)["ids"].alias(ids_col),
        F.col(made)["decoded"].alias(decoded_col),
    )
