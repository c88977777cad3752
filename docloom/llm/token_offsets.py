"""Token counts by section: offset-mapped attribution.

A document is encoded once, whole. Each token's bytes give its span of characters, and spans are
joined to the document's sections: as both are sorted, finding every section's first token is a
binary search. Tokens that cross a boundary are counted for one section by an explicit rule.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, text_or_empty

RULES = ("start", "majority")
SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"
ROWS_A_BATCH = 50_000


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last. A character whose bytes are
    split over tokens belongs to all of them."""
    encoding, sizes = _encoding(path, pattern)
    ids = np.array(encoding.encode_ordinary(text), dtype=np.int64)
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def section_ends(text: str, mark: str = "\n") -> np.ndarray:
    """Ends of the sections: each goes up to and with the next mark, the last to the text's end.
    An empty text is one empty section."""
    ends, at = [], 0
    while (at := text.find(mark, at)) >= 0:
        at += len(mark)
        ends.append(at)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, dtype=np.int64)


def attribute(starts: np.ndarray, stops: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that start in it and cross its end.

    Rule ``start``: a token counts where its first character is; ``majority``: where most of its
    characters are, of equal parts the first."""
    home = np.searchsorted(ends, starts, side="right")
    cross = stops > ends[home] if len(home) else np.empty(0, bool)
    crossing = np.bincount(home[cross], minlength=len(ends))
    if rule == "majority":
        for t in np.flatnonzero(cross):
            last = int(np.searchsorted(ends, stops[t] - 1, side="right"))
            parts = range(int(home[t]), last + 1)
            home[t] = max(parts, key=lambda s: (min(ends[s], stops[t]) - max(ends[s - 1] if s else 0, starts[t]), -s))  # noqa: B023
    return np.bincount(home, minlength=len(ends)), crossing


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "start", mark: str = "\n") -> DataFrame:
    """A row for each section of every ``doc_id, text`` row, within the row's own task: no shuffle.

    A null or empty text is one section without tokens; a null doc_id stays null; repeated rows
    give their sections each; extra columns are left out. Counts of a document's sections sum to
    ``doc_tokens`` under either rule."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for doc, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                starts, stops = spans(text, path, pattern)
                ends = section_ends(text, mark)
                counts, crossing = attribute(starts, stops, ends, rule)
                parts.append((doc.as_py(), ends, counts, crossing, len(starts)))
                held += len(ends)
                if held >= ROWS_A_BATCH:
                    yield _batch(parts)
                    parts, held = [], 0
            yield _batch(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    sizes = [len(p[1]) for p in parts]
    join = lambda arrays: np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64)
    ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes), pa.int64()))
    number = join(np.arange(n) for n in sizes).astype(np.int32)
    first = join(np.r_[0, p[1][:-1]] for p in parts)
    total = np.repeat(np.array([p[4] for p in parts], dtype=np.int64), sizes)
    columns = [ids, pa.array(number), *(pa.array(x) for x in (first, join(p[1] for p in parts), join(p[2] for p in parts), join(p[3] for p in parts), total))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
