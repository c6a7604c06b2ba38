"""Token counts of a byte-level BPE vocabulary, mostly without merging.

Method: a vocabulary entry that encodes alone as one token is proved once, on the
driver, by the tokenizer itself.  In the tasks a text is cut into pre-tokens; a pre-token
that is such an entry counts one, and only the others are merged, each distinct one once
per task while it stays in a bounded memo.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanveil.llm.common import kept, pick, restored

# Merged pre-tokens that a Python worker remembers, some 100 bytes each.
MEMO = 1_000_000
# Texts longer than this are cut into pre-tokens one by one and not as one list.
LONG = 1_000_000
# Characters are proved for the first two planes; texts with others are left to the library.
PROVED = 0x20000
BLOCK = 256


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The vocabulary strings that are a text and encode alone as one token."""
    letters, texts = byte_letters(), []
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(letters[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    texts = [t for t in texts if not any(s in t for s in special)]
    coded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, c in zip(texts, coded, strict=True) if len(c.ids) == 1]


def agrees(tokenizer: Tokenizer, pattern: regex.Pattern, text: str) -> bool:
    spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    return spans == [m.span() for m in pattern.finditer(text)]


@lru_cache(maxsize=4)
def unproved(definition: str, pre_pattern: str) -> frozenset[str]:
    """The characters below ``PROVED`` that the pattern and the library cut differently.

    The two can follow different Unicode versions.  Every character below ``PROVED`` is
    tried after a letter, a digit, a blank and a mark; blocks that differ are tried
    character by character.
    """
    tokenizer, pattern = Tokenizer.from_str(definition), regex.compile(pre_pattern)

    def probe(codes: range | list[int]) -> str:
        return "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}a" for c in codes)

    odd: list[int] = []
    for start in range(0, PROVED, BLOCK):
        codes = [c for c in range(start, start + BLOCK) if not 0xD800 <= c < 0xE000]
        if codes and not agrees(tokenizer, pattern, probe(codes)):
            odd += [c for c in codes if not agrees(tokenizer, pattern, probe([c]))]
    return frozenset(map(chr, odd))


class Pieces(dict):
    """Tokens of each pre-token: proved entries from the start, merged ones as they come."""

    def __init__(self, tokenizer: Tokenizer, whole: Sequence[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge = tokenizer.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.room, self.whole = len(self) + MEMO, whole

    def __missing__(self, piece: str) -> int:
        n = len(self.merge("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(self) >= self.room:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the library would list them."""

    def __init__(self, definition: str, pre_pattern: str, whole: Sequence[str], odd: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.pattern = regex.compile(pre_pattern)
        self.pieces = Pieces(self.tokenizer, whole)
        self.odd = odd
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> int:
        if len(text) > LONG:
            found = (m.group() for m in self.pattern.finditer(text))
        else:
            found = self.pattern.findall(text)
        return sum(map(self.pieces.__getitem__, found))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii():
            letters = set(text)
            if max(letters) >= chr(PROVED) or not self.odd.isdisjoint(letters):
                return self.library(text)
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))


# A Python worker serves many tasks: the counter of the last vocabulary stays.
_counters: dict[tuple[str, str], TokenCounter] = {}


def counter(definition: str, pre_pattern: str, whole: Sequence[str], odd: frozenset[str]) -> TokenCounter:
    key = (definition, pre_pattern)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(definition, pre_pattern, whole, odd)
    return _counters[key]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    pre_pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``n_bytes, n_tokens, over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Special strings
    inside a text count as the one token that the library makes of them.  Texts of any
    length are counted whole; repeated rows are counted each; an empty table gives an
    empty result.  The definition file is read on the driver (its size is that of the
    vocabulary) and sent to the tasks; nothing is shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    kind = json.loads(definition)
    if kind["pre_tokenizer"]["type"] != "ByteLevel" or kind["normalizer"] is not None:
        raise ValueError("a byte-level vocabulary without normalizer is needed")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((
        definition, pre_pattern, whole_tokens(Tokenizer.from_str(definition)),
        unproved(definition, pre_pattern),
    ))

    @F.pandas_udf("long")
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(*sent.value)
        for part in parts:
            yield pd.Series([tokens.count(t) for t in part], dtype="int64")

    rows = pick(docs, doc_id=id_col, text=text_col, **kept(keep))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").alias(id_col),
        *restored(keep),
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
