"""Token counts without token ids.

A tokenizer never joins what white space parts, so a text's count is the sum over its distinct pre-tokens of (frequency
in the text) x (pieces of the pre-token). Pieces are counted once per distinct pre-token and joined to the documents'
frequency tables. The join is split by how common a pre-token is: a dictionary of bounded size, the most frequent ones
of a bounded sample, goes to every task and takes most of the frequencies where they are made; all other pre-tokens are
shuffled with their documents' frequencies, so that each is counted in one place, and come back as sums by document.
The choice of the dictionary moves work only, counts do not depend on it.

Special strings are cut out first and count one piece each, as the library does by default; they are matched on the
raw text and may touch other letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small_batches

#: Only ASCII blanks part pre-tokens here; the library sees any other white space inside a pre-token and drops it itself.
PRE_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Entries of the dictionary (about 40 MB in a worker), their longest in bytes, and documents of the sample behind it.
DICTIONARY, LONGEST, SAMPLE_DOCUMENTS = 300_000, 64, 6_000


class Library:
    """The library's tokenizer of a vocabulary file, with its special strings apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often the text has each pre-token, and its special strings."""
        specials = 0
        if self.special is not None and self.special.search(text):
            text, specials = self.special.subn(" ", text)
        return Counter(PRE_TOKEN.findall(text)), specials


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]


def _pre_tokens(path: str):
    """(text) -> (t, f): frequencies of pre-tokens, summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column(0):
                total.update(library(path).frequencies(text.as_py())[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], names=["t", "f"])

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [library(path).pieces(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["t", "n"])

    return run


def _split(path: str, sent):
    """(key, row, n_bytes, text) -> key, row, n_bytes, pieces of what the dictionary holds, and the other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = dict(zip(*(c.to_pylist() for c in sent.value.columns)))
        for batch in batches:
            known, ends, rest, times = [], [0], [], []
            for text in batch.column(3):
                found, total = library(path).frequencies(text.as_py())
                for t, f in found.items():
                    n = pieces.get(t)
                    if n is None:
                        rest.append(t)
                        times.append(f)
                    else:
                        total += n * f
                known.append(total)
                ends.append(len(rest))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((rest, pa.string()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(known, pa.int64()), *lists], names=["key", "row", "n_bytes", "known", "rest", "times"])

    return run


def _joined(path: str):
    """(t, row, f) in order of t -> (row, n): pieces counted once per t and joined to its frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            counts = []
            for t in coded.dictionary.to_pylist():
                if t != last:
                    last, n = t, library(path).pieces(t)
                counts.append(n)
            times = np.array(counts, np.int64)[coded.indices.to_numpy()] * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(times, pa.int64())], names=["row", "n"])

    return run


def token_counts(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", limit: int = 2048, dictionary: int = DICTIONARY, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit of every row, for the vocabulary file at `path` (one that every worker can read).

    A null text counts as empty: 0 bytes, 0 tokens. A null key stays null. Repeated rows give repeated rows, an empty
    table an empty one; other columns are not carried, so their names cannot clash. Texts of any length are counted
    whole.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    share = int(1_000_000 * min(1.0, sample / max(docs.count(), 1)))
    drawn = texts.select("t").where(F.pmod(F.xxhash64("t", F.lit("dictionary sample")), F.lit(1_000_000)) < share)
    common = drawn.mapInArrow(_pre_tokens(path), "t string, f long").groupBy("t").agg(F.sum("f").alias("f")).where(F.octet_length("t") <= LONGEST)
    table = common.orderBy(F.col("f").desc(), "t").limit(dictionary).select("t").mapInArrow(_pieces(path), "t string, n long").toArrow()  # `dictionary` rows
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = texts.select("key", F.monotonically_increasing_id().alias("row"), F.octet_length("t").cast("long").alias("n_bytes"), "t")
    split = cut(rows.mapInArrow(_split(path, sent), f"key {kind}, row long, n_bytes long, known long, rest array<string>, times array<long>"))  # written, so that a row keeps its number
    pairs = split.select("row", F.explode(F.arrays_zip("rest", "times")).alias("p")).select("p.rest", "row", "p.times")
    sums = pairs.repartition("rest").sortWithinPartitions("rest").mapInArrow(_joined(path), "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    counted = split.select("key", "row", "n_bytes", "known").join(sums, "row", "left")
    n_tokens = F.col("known") + F.coalesce("n", F.lit(0))
    return counted.select(F.col("key").alias(key), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
