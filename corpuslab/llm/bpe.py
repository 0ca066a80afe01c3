"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

A word is a string of symbols: one per UTF-8 byte, the last one marked as a
word end. For every prefix there is exactly one token that ends the merges'
result for it. An automaton over the vocabulary reports every token that ends
at a prefix; a reported token is the prefix's last token if it is the whole
prefix, or if the last token before it may stand next to it (no merge across
their border comes before the merges that built them). Back-pointers from the
whole word give its ids. No merge loop runs over the text.

Texts are read whole, row by row, in bounded Arrow batches; words found once
are kept in a bounded per-worker table. The vocabulary file is given by path
and travels with the tasks as its parsed content (about 2 MB).
"""

from __future__ import annotations

import hashlib
import json
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 400_000
CACHE_PAIRS = 2_000_000
#: A word longer than this is encoded but not kept.
CACHE_WORD_CHARS = 100
END = 0x10000  # added to a symbol that ends a word
NEVER = sys.maxsize


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    keep = set(printable)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """word -> (ids as little-endian 32-bit, decoded text), filled on demand and emptied when full."""

    def __init__(self, bpe: WordBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.bpe.word_ids(word)
        found = np.array(ids, "<u4").tobytes(), self.bpe.decode(ids)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class WordBPE:
    """Encoder and decoder for one vocabulary file with a word-end suffix and no unknown token."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        model = conf["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        split = next(p for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.normalize = Tokenizer.from_str(spec).normalizer.normalize_str
        self.symbols = byte_symbols()
        self.token = {i: t for t, i in (model["vocab"] | self.special).items()}

        inner = lambda t: t[:-len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + END) if t.endswith(suffix) and len(t) > len(suffix) else t
        self.size = {i: len(inner(t)) for t, i in model["vocab"].items()}
        # How a token was built (left, right), and when; single symbols were there at the start.
        self.made: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, k)
            if whole not in self.made:
                self.made[whole], self.rank[whole] = pair, k
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if (i in self.made or len(inner(t)) == 1) and self._stands(i):
                self.automaton.add_word(inner(t), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def _stands(self, token: int) -> bool:
        """Whether the merges' result for a token's own string is the token: its two halves may meet at its time."""
        if token not in self.made:
            return True
        return self._meet(*self.made[token], until=self.rank[token])

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, time at which it vanishes) along one edge of the token, outermost first."""
        out, gone = [(token, NEVER)], NEVER
        while token in self.made:
            gone = self.rank[token]
            token = self.made[token][side]
            out.append((token, gone))
        return out

    def _meet(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge across the border comes before ``until`` while both parts beside it exist."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            k = self.merge.get((a[i][0], b[j][0]))
            # Of equal times the leftmost merge goes first: it takes the left part before, the right part after.
            if k is not None and k < until and k < a[i][1] and k <= b[j][1]:
                return False
            birth_a, birth_b = self.rank.get(a[i][0], -1), self.rank.get(b[j][0], -1)
            if birth_a < 0 and birth_b < 0:
                return True
            if birth_a >= birth_b:  # go back in time: the younger part comes apart first
                i += 1
            else:
                j += 1

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._meet(left, right)
        return ok

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        raw = word.encode("utf-8")
        sym = self.symbols
        text = "".join([sym[b] for b in raw[:-1]]) + chr(ord(sym[raw[-1]]) + END)
        last: list[int] = [-1] * len(text)
        size, follow = self.size, self._may_follow
        for end, token in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - size[token]
            if before < 0 or (last[before] >= 0 and follow(last[before], token)):
                last[end] = token
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: normalised, then split by the file's pattern."""
        try:
            text.encode("latin-1")
            text = text.lower()  # composed already, and lower-cased one by one
        except UnicodeEncodeError:
            text = self.normalize(text)
        return self.pieces(text)

    def encode_words(self, text: str | None) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each word or special token of a whole text."""
        if not text:
            return []
        if not any(s in text for s in self.special):
            return list(map(self.words.__getitem__, self.split(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append((np.array([self.special[part]], "<u4").tobytes(), part))
            else:
                out.extend(map(self.words.__getitem__, self.split(part)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join([w[0] for w in self.encode_words(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def _encoder(spec: str) -> WordBPE:
    return WordBPE(spec)


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with the flags ids and decoded.

    ``vocabulary`` is the path of a tokenizer file on the driver. A null text
    encodes as an empty one: no ids, empty decoded text. Rows are independent,
    so repeated rows repeat; other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
              + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else ""))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        bpe = _encoder(spec.value)
        for b in batches:
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for text in b.column(1).to_pylist():
                words = bpe.encode_words(text)
                raw, joined = b"".join([w[0] for w in words]), " ".join([w[1] for w in words])
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(joined.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(raw, "<i4"))
                if keep_text:
                    decoded.append(joined)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            if keep_text:
                cols.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
