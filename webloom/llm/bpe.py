"""BPE encoding and decoding by a traversal of the trie of distinct words (operator 3).

For byte-pair merges the encoding of a prefix is the encoding of a shorter prefix plus one
last token: the only vocabulary suffix that BPE leaves apart from the last token before it.
So one state a trie node, its last token, holds the encoding of the node's whole prefix.  The
distinct words of a batch, sorted, are the trie in depth-first order; the stack of states is
cut back to the common prefix and grows from there, so each shared prefix is encoded once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.shared import ship_package

# Bounds of what a worker keeps between batches; reaching one only costs time.
_CACHED_WORDS = 100_000  # in each of two generations
_CACHED_PAIRS = 150_000
_BATCH_CHARS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table, extra = {b: chr(b) for b in shown}, iter(range(256, 512))
    return [table.get(b) or chr(next(extra)) for b in range(256)]


@lru_cache(maxsize=1)
def _settled() -> re.Pattern:
    """Texts of characters that Unicode 3.2 had assigned.

    Their normal forms are stable by Unicode's policy, so every library reads them alike, whatever
    version its tables have.
    """
    old, spans = unicodedata.ucd_3_2_0, []
    for c in range(0x110000):
        if old.category(chr(c)) not in ("Cn", "Cs", "Co"):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]*")


def _reach(tokens: set[str]) -> dict[str, int]:
    """The length of the longest token by its last three characters."""
    out: dict[str, int] = {}
    for t in tokens:
        out[t[-3:]] = max(out.get(t[-3:], 2), len(t))
    return out


class WordBpe:
    """Encoder for word-level BPE files: normalisation, word pattern, merges and word ends as the file states them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ", 1) if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # A token string that merges never build can't be a last token.
        made = {a + b for a, b in self.ranks}
        alphabet = byte_alphabet()
        self.alphabet = alphabet
        single = set(alphabet) | {c + self.end for c in alphabet}
        self.inner = {t for t in made if not t.endswith(self.end)} | set(alphabet)
        self.final = {t[: -len(self.end)] for t in made | single if t.endswith(self.end)} if self.end else self.inner
        # The longest token that ends in these three characters.
        self.inner_reach, self.final_reach = _reach(self.inner), _reach(self.final)
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # The library's own normaliser and splitter, for texts that the tables here may read otherwise.
        self.normalizer = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.apart = lru_cache(maxsize=_CACHED_PAIRS)(self._apart)
        self.always: dict[str, tuple[bytes, str]] = {t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        self.cache, self.older = dict(self.always), {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the merge of least rank, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(pairwise(symbols)))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str, last: bool) -> list[str]:
        return [*token[:-1], token[-1] + self.end] if last else list(token)

    def _apart(self, left: str, right: str, last: bool) -> bool:
        """Whether BPE over both tokens' characters gives these two tokens back."""
        return self.merged([*left, *self._symbols(right, last)]) == [left, right + self.end if last else right]

    def encode_words(self, words: list[str]) -> list[list[str]]:
        """Tokens of each word; ``words`` are distinct and sorted (byte alphabet)."""
        out, before = [], ""
        stack: list[str] = []  # the last token of every prefix of the current word
        for word in words:
            common = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            del stack[common:]
            for n in range(len(stack) + 1, len(word)):
                stack.append(self._last(word, n, stack, self.inner, self.inner_reach, False))
            before = word[: len(stack)]
            tail = self._last(word, len(word), stack, self.final, self.final_reach, True)
            tokens, n = [tail + self.end], len(word) - len(tail)
            while n:
                tokens.append(stack[n - 1])
                n -= len(tokens[-1])
            out.append(tokens[::-1])
        return out

    def _last(self, word: str, n: int, stack: list[str], known: set[str], reach: dict[str, int], last: bool) -> str:
        for size in range(min(n, reach.get(word[max(0, n - 3) : n], 2)), 0, -1):
            token = word[n - size : n]
            if token in known and (self.apart(stack[n - size - 1], token, last) if size < n else self.whole(token, last)):
                return token
        raise ValueError(f"no token for {word!r}")

    @lru_cache(maxsize=50_000)  # noqa: B019  one encoder lives as long as its worker
    def whole(self, token: str, last: bool) -> bool:
        return self.merged(self._symbols(token, last)) == [token + self.end if last else token]

    def words(self, text: str) -> list[str]:
        """The words of a text after normalisation, special tokens among them."""
        if not any(t in text for t in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and not _settled().fullmatch(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        # One character at a time: a final sigma is lower-cased like any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Token ids (little-endian 32 bits) and decoded text of each text."""
        split = [self.words(t or "") for t in texts]
        missing = set().union(*split) - self.cache.keys()
        for w in missing & self.older.keys():
            self.cache[w] = self.older[w]
        shown = {self._shown(w): w for w in missing - self.older.keys()}
        order = sorted(shown)
        for s, tokens in zip(order, self.encode_words(order), strict=True):
            self.cache[shown[s]] = (b"".join(map(self.packed.__getitem__, tokens)), " ".join(tokens))
        cache = self.cache
        if len(cache) > _CACHED_WORDS:  # what two generations of words don't use is forgotten
            self.cache, self.older = dict(self.always), cache
        for words in split:
            ids, decoded = zip(*map(cache.__getitem__, words), strict=True) if words else ((), ())
            yield b"".join(ids), " ".join(decoded)

    def _shown(self, word: str) -> str:
        """The word in the byte alphabet, which leaves ASCII letters and digits as they are."""
        return word if word.isascii() and word.isalnum() else "".join([self.alphabet[b] for b in word.encode()])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            begin = size = 0
            for i, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= _BATCH_CHARS or i == len(texts):
                    ids, decoded = zip(*bpe.encode(texts[begin:i]), strict=True)
                    columns = [batch.column(c)[begin:i] for c in range(batch.num_columns - 1)]
                    yield pa.record_batch([*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*batch.schema.names[:-1], "ids", "decoded"])
                    begin, size = i, 0

    return run


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes every whole text with the BPE file at ``path`` (the same path on all workers).

    ``docs``: doc_id, text; more columns are ignored unless named in ``keep``.  Returns a row
    per row of docs: doc_id, the kept columns, ids (binary: little-endian unsigned 32-bit
    integers) and decoded (the token strings joined by spaces, as the file has no decoder).
    Special-token strings in texts become their ids.  Null texts are empty: no ids, empty
    decoded text.  Repeated rows each give a row; an empty table gives an empty result.  A very
    long text is encoded whole, alone in its batch; merges of one rank go leftmost first.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in (keep or []) if c != "doc_id"]
    if {c.lower() for c in kept} & {"ids", "decoded"}:
        raise ValueError("ids and decoded are columns of the result")
    frame = docs.select("doc_id", *(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(_encode(path), f"{fields}, ids binary, decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
