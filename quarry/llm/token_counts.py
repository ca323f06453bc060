"""Token counts of whole texts by a public tokenizer, with huge documents cut and spliced.

A huge text is encoded in chunks that overlap. Two neighbours are spliced at a boundary that is proven stable: a token
begins there in both encodings, just after white space, before a letter or digit (the tokenizer never merges or
normalises across such a place), and both agree on the next tokens. If the overlap has none, it is widened, in the end
to the rest of the text, which needs no splice. A text within one chunk is cut at its spaces, which are stable boundaries
too: white space never becomes part of a token and never combines with what follows. Each distinct piece is encoded
once while it is remembered.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows are independent of each other, so repeated rows and
rows with a null id give a row each; an empty table gives none; other columns, whatever their names, are ignored. Where a
tokenizer does not take white space apart (``cuts_at_spaces``), texts aren't cut at spaces, and each is encoded as one.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, held

#: Characters of a chunk and of the first overlap; tokens that must agree after a splice.
CHUNK, OVERLAP, AGREE = 1 << 16, 512, 3

#: Pieces that a worker remembers in each of two generations.
PIECES = 400_000

def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def spaces(tokenizer) -> list[str]:
    """The white space that never becomes part of a token and never changes its neighbours, of blank and line end, tried on pairs of
    all kinds of characters; without the blank none."""
    kinds = ["a", "Z", "7", "é", "ß", "'", ".", "_", "日", "\u0301", "\u200d", "'s", "\t", "\n", "\r\n", "\x0b", "\u00a0", "\u3000", "▁", " "]
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    own = {k: ids(k) for k in kinds}

    def apart(space: str) -> bool:
        return not own[space] and all(ids(f"{a}{space}{b}") == own[a] + own[b] for a in kinds for b in kinds)

    return [s for s in (" ", "\n") if apart(s)] if apart(" ") else []


def cuts_at_spaces(tokenizer) -> bool:
    return bool(spaces(tokenizer))


class PieceCounts:
    """Numbers of tokens of the pieces between spaces, remembered for two generations."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.known, self.older = tokenizer, {}, {}
        self.spaces = spaces(tokenizer)

    def of(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.spaces:
            return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > PIECES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        cut = [(t.replace("\n", " ") if "\n" in self.spaces else t).split(" ") for t in texts]
        missing = set(itertools.chain.from_iterable(itertools.filterfalse(known.__contains__, pieces) for pieces in cut))
        known.update((p, older[p]) for p in missing if p in older)
        new = [p for p in missing if p not in older]
        if new:  # as one text: offsets tell whose a token is
            begins = np.cumsum([0, *(len(p) + 1 for p in new)])
            offsets = self.tokenizer.encode(" ".join(new), add_special_tokens=False).offsets
            owner = np.searchsorted(begins, np.fromiter((a for a, _ in offsets), np.int64, len(offsets)), side="right") - 1
            known.update(zip(new, np.bincount(owner, minlength=len(new)).tolist()))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def stable_splice(text: str, left: tuple[list, list], right: tuple[list, list], lo: int, hi: int) -> tuple[int, int] | None:
    """Indices (in the left encoding, in the right one) of a token that begins a stable boundary between lo and hi.

    An encoding is (ids, character spans); spans are of the whole text."""
    at: dict[int, int] = {}
    for j, (start, _) in enumerate(right[1]):
        at.setdefault(start, j)  # several tokens can come from one character
    for i, (start, _) in enumerate(left[1]):
        j = at.get(start)
        if j is None or i and left[1][i - 1][0] == start or not lo < start < hi or not text[start - 1].isspace() or not text[start].isalnum():
            continue
        n = min(AGREE, len(left[0]) - i - 1, len(right[0]) - j)
        if n > 0 and left[0][i : i + n] == right[0][j : j + n] and left[1][i : i + n] == right[1][j : j + n]:
            return i, j
    return None


def spliced_ids(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of a text from overlapping chunks; ``encode`` gives (ids, spans) of a piece of text."""

    def part(a: int, b: int) -> tuple[list, list]:
        ids, spans = encode(text[a:b])
        return list(ids), [(x + a, y + a) for x, y in spans]

    ids: list[int] = []
    begin, drop = 0, 0  # of the current chunk: its first character, and tokens that the one before it gave
    end = min(len(text), chunk + overlap)
    here = part(begin, end)
    while end < len(text):
        lo = begin + chunk
        width = end - lo
        while True:
            stop = min(len(text), lo + chunk + overlap)
            there = part(lo, stop)
            found = stable_splice(text, here, there, lo, end)
            if found and found[0] >= drop:
                break
            width *= 2  # they never came into step: look at more of the text with both
            end = min(len(text), lo + width)
            here = part(begin, end)
            if end == len(text):
                found = None
                break
        if found is None:
            break
        ids += here[0][drop : found[0]]
        begin, end, here, drop = lo, stop, there, found[1]
    return ids + here[0][drop:]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("tokens", path), lambda: PieceCounts(_tokenizer(path)))
        tokenizer = pieces.tokenizer

        def encode(text: str) -> tuple[list, list]:
            e = tokenizer.encode(text, add_special_tokens=False)
            return e.ids, e.offsets

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = []
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                short = iter(pieces.of([t for t in some if len(t) <= chunk]))
                counts += [next(short) if len(t) <= chunk else len(spliced_ids(t, encode, chunk)) for t in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
