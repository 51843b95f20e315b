"""Token counts: pre-tokens that are one whole token are counted directly, the rest is merged.

Before any text is read, the driver encodes every vocabulary string that ends a word alone; those that come out as one
token form a table, bounded by the vocabulary and broadcast. A pre-token in the table counts one. Any other is
merged by the tokenizer library once and remembered, in a memory of bounded size. What stands between spaces and has a character for which
this module's own splitting is not proven to agree with the library goes to the library as it is, and is remembered too: no token crosses white space.

A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows, null ids and
extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import batch

#: The splitting pattern of the vocabulary file, with white space as the library has it.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Characters beyond these go to the library, as do texts that need composing.
UNPROVEN = regex.compile(r"[^\x00-ɏ‐-‧€™]")
#: Between spaces, what has such a character. A character that might compose with a space before it keeps that.
ODD = regex.compile(rf"[^ \n\t]*{UNPROVEN.pattern}[^ \n\t]*")
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
REMEMBERED = 1 << 18


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The pre-tokens that the tokenizer encodes as exactly one token."""
    words = [s for t in tokenizer.get_vocab() if t.endswith("</w>") and (s := _plain(t))]
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded) if len(e.ids) == 1 and regex.fullmatch(PIECES, w) and w == _normal(w))


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


BYTES = _bytes_of()
CHARACTERS = {b: c for c, b in BYTES.items()}


def _plain(token: str) -> str:
    try:
        return bytes(BYTES[c] for c in token.removesuffix("</w>")).decode()
    except (KeyError, UnicodeDecodeError):
        return ""


def _byte_level(piece: str) -> str:
    return piece if piece.isascii() and piece.isalnum() else "".join([CHARACTERS[b] for b in piece.encode()])


def _normal(text: str) -> str:
    """As the library: composed, then each character lower-cased by itself."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower()


class _Counts(dict):
    """Tokens by pre-token; the library's merges fill it, and it starts again when it is full."""

    def __init__(self, whole: frozenset[str], tokenizer: Tokenizer):
        self.tokenizer, self.whole = tokenizer, whole
        super().__init__(dict.fromkeys(whole, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self[piece] = len(self.tokenizer.model.tokenize(_byte_level(piece)))
        return n


#: What a file must say for the rules above to hold of it.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def load(path: str) -> Tokenizer:
    """The tokenizer of a file. One that normalises, splits or merges in another way than this module counts is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    same = (
        (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and len(steps) == 2 and steps[0] == split and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>"
        and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges") and sorted(t["content"] for t in spec["added_tokens"]) == ["<|endoftext|>", "<|startoftext|>"]
    )
    if not same:
        raise ValueError(f"{path}: counts of this tokenizer would not be the library's")
    return Tokenizer.from_file(path)


class TokenCounter:
    def __init__(self, path: str, whole: frozenset[str] | None = None):
        """whole: what whole_tokens gives, if it is known."""
        self.tokenizer = load(path)
        self.counts = _Counts(whole_tokens(self.tokenizer) if whole is None else whole, self.tokenizer)
        self.pieces, self.odd = regex.compile(PIECES), {}

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if UNPROVEN.search(text):
            return sum(map(self._library_count, ODD.findall(text))) + self(ODD.sub(" ", text))
        n = 0
        if "<|" in text:
            n = len(SPECIAL.findall(text))
            return n + sum(self(part) for part in SPECIAL.split(text)) if n else self._plain_count(text)
        return self._plain_count(text)

    def _library_count(self, piece: str) -> int:
        if (n := self.odd.get(piece)) is None:
            if len(self.odd) >= REMEMBERED:
                self.odd.clear()
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= 64:
                self.odd[piece] = n
        return n

    def _plain_count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pieces.findall(_normal(text))))


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit for every row; path: the tokenizer's file on the driver and every executor."""

    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path, whole.value)
        count = _counters[path]
        for b in batches:
            texts = b.column(1)
            n = pa.array([count(x.as_py() or "") for x in texts], pa.int64())
            yield batch(id=b.column(0), n_tokens=n, n_bytes=b.column(2))

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
