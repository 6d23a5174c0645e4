"""Token counts of whole texts by a two-tier lookup of pre-tokens, without exchanging any.

No piece of the vocabulary holds the space mark behind another character, so a text's
tokens are those of its pre-tokens: a run of space marks with the characters up to the next one,
line breaks standing alone.  First tier: a compact table of frequent pre-tokens and
their lengths, broadcast once (at most FREQUENT entries, from a bounded sample of documents; it decides
speed only, never a count).  Second tier: every worker's own cache, which the encoder fills.

Null and empty texts have no tokens.  Long texts are split like others.  One row comes out for each row;
an empty table gives an empty table, and other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Entries of the broadcast table; documents of its sample and characters looked at of each; pre-tokens that a worker keeps; longest one kept.
FREQUENT, SAMPLE, SHOWN, CACHED, LONGEST = 65_536, 2_000, 16_384, 400_000, 64
LIMIT = 4096
_CACHES: dict[str, Lengths] = {}


def model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


class Lengths(dict):
    """Pre-token -> number of tokens; a miss is encoded and kept."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK) or "\n" in p]
        if inside:
            raise ValueError(f"pieces cross pre-tokens: {inside[:3]}")
        self.lead = len(self.model.encode("\n"))

    def __missing__(self, unit: str) -> int:
        # behind a line break, so that the encoder's own leading mark can't join the unit
        n = len(self.model.encode("\n" + unit)) - self.lead
        if len(unit) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, units(text))) if text else 0


def units(text: str) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK))


def lengths(path: str, frequent: list[tuple[str, int]] = ()) -> Lengths:
    """This worker's cache, which outlives tasks."""
    if path not in _CACHES:
        _CACHES[path] = Lengths(path)
    cache = _CACHES[path]
    if frequent and frequent[0][0] not in cache:
        cache.update(frequent)
    return cache


def frequent_lengths(docs: DataFrame, text: str, path: str | None, sample: int = SAMPLE, most: int = FREQUENT) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of `sample` rows, as Spark comes to them: no pass over the table, at most sample x SHOWN characters."""
    seen: Counter = Counter()
    for r in docs.select(F.substring(F.col(text), 1, SHOWN).alias("t")).limit(sample).collect():
        seen.update(u for u in units(r.t or "") if len(u) <= LONGEST)
    table = lengths(model_path(path))
    return [(u, table[u]) for u, _ in seen.most_common(most)]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = lengths(model_path(path), table.value)
        for batch in slices(batches, 1):
            n = pa.array([cache.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield pa.record_batch([batch.column(0), n_bytes, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
