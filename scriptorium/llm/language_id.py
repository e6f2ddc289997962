"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all ways to cut it into pieces (a forward pass); a text's is the product over its words. The piece
probabilities are learned by expectation maximisation on word counts, so training marginalises over segmentations too.

Pieces do not cross words, so a word's scores depend on the word alone: a task computes them once per distinct word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small_batches

LETTERS = regex.compile(r"\p{L}+")
MARK = "\u2581"
#: Training is on a bounded sample: about so many documents and at most so many distinct words a language.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 1_000, 20_000
ITERATIONS = 3
#: Probability mass of a letter that the vocabulary lacks, and of a piece that a language's sample lacks.
UNKNOWN, UNSEEN = 1e-7, 1e-8
#: Words above this length are scored one by one with rescaling, so that nothing underflows.
LONG = 40
#: Distinct words whose scores a worker keeps before it starts anew.
CACHE = 300_000


def pieces_of(path: str) -> list[str]:
    """Lower-case pieces of letters in a sentencepiece vocabulary, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [p for p in found if (bare := p.removeprefix(MARK)) == bare.lower() and LETTERS.fullmatch(bare or "a")]


def learn(counts: dict[str, int], pieces: list[str], iterations: int = ITERATIONS) -> dict[str, float]:
    """Piece probabilities by forward and backward passes over the words; starts from how often words hold each piece."""
    longest = max(map(len, pieces), default=1)
    known = set(pieces)
    spans = []  # of each word: length, count, [(start, end, piece)]
    start: Counter = Counter()
    for word, n in counts.items():
        w = MARK + word
        found = [(i, j, w[i:j]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in known]
        spans.append((len(w), n, found))
        for _, _, p in found:
            start[p] += n
    total = sum(start.values())
    prob = {p: n / total for p, n in start.items()}
    for _ in range(iterations):
        expected: Counter = Counter()
        for size, n, found in spans:
            ahead, back = [0.0] * (size + 1), [0.0] * (size + 1)
            ahead[0] = back[size] = 1.0
            by_end: list[list] = [[] for _ in range(size + 1)]
            for i, j, p in found:
                by_end[j].append((i, prob[p]))
            for j in range(1, size + 1):
                ahead[j] = ahead[j - 1] * UNKNOWN + sum(ahead[i] * q for i, q in by_end[j])
            for j in range(size, 0, -1):
                back[j - 1] += back[j] * UNKNOWN
                for i, q in by_end[j]:
                    back[i] += back[j] * q
            if ahead[size] > 0:
                scale = n / ahead[size]
                for i, j, p in found:
                    expected[p] += ahead[i] * prob[p] * back[j] * scale
        total = sum(expected.values())
        if total:
            prob = {p: max(e / total, 1e-12) for p, e in expected.items()}
            prob = {p: prob.get(p, 1e-12) for p in start}
    return prob


class Scorer:
    """Log probabilities of words in every language, one forward pass over all languages at once."""

    def __init__(self, languages: list[str], pieces: dict[str, int], table: np.ndarray):
        self.languages, self.pieces, self.table = languages, pieces, table
        self.longest = max(map(len, pieces), default=1)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def _short(self, words: list[str]) -> np.ndarray:
        """Words of one length, together."""
        size, get, none = len(words[0]), self.pieces.get, len(self.table) - 1
        ahead = np.zeros((size + 1, len(words), len(self.languages)))
        ahead[0] = 1.0
        for j in range(1, size + 1):
            ahead[j] = ahead[j - 1] * UNKNOWN
            for i in range(max(0, j - self.longest), j):
                at = np.fromiter((get(w[i:j], none) for w in words), np.int64, len(words))
                hit = at != none
                if hit.any():
                    ahead[j, hit] += ahead[i, hit] * self.table[at[hit]]
        return np.log(ahead[size])

    def _long(self, word: str) -> np.ndarray:
        recent, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for j in range(1, len(word) + 1):
            now = recent[-1] * UNKNOWN
            for back in range(1, min(len(recent), self.longest) + 1):
                at = self.pieces.get(word[j - back : j])
                if at is not None:
                    now = now + recent[-back] * self.table[at]
            recent = [*recent[-self.longest + 1 :], now] if self.longest > 1 else [now]
            recent, scale = [x / now for x in recent], scale + np.log(now)
        return scale

    def add(self, words: list[str]) -> None:
        marked: dict[int, list[str]] = {}
        for w in words:
            marked.setdefault(len(w), []).append(w)
        got, rows = [], []
        for size, same in marked.items():
            got += same
            rows.append(self._short([MARK + w for w in same]) if size <= LONG else np.array([self._long(MARK + w) for w in same]))
        base = len(self.rows)
        self.rows |= {w: base + k for k, w in enumerate(got)}
        self.scores = np.concatenate((self.scores, *rows))

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts = [Counter(LETTERS.findall(t.lower())) for t in texts]
        if len(self.rows) > CACHE:
            self.rows, self.scores = {}, self.scores[:0]
        new = {w for c in counts for w in c if w not in self.rows}
        if new:
            self.add(sorted(new))
        names, sure = [], []
        for c in counts:
            if not c or not self.languages:
                names.append("und")
                sure.append(0.0)
                continue
            at = np.fromiter(map(self.rows.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), float, len(c)) @ self.scores[at]
            best = int(np.argmax(total))
            names.append(self.languages[best])
            sure.append(float(1 / np.exp(total - total[best]).sum()))
        return names, sure


def train(labelled: DataFrame, path: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id", documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> Scorer:
    """Learns from rows with a text and a lang. One task a language, on at most `words` word counts."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    per = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not per:
        return Scorer([], {}, np.zeros((1, 0)))
    share = F.create_map(*[F.lit(x) for l, n in per.items() for x in (l, min(1.0, documents / n))])
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    counted = rows.where(draw < share[F.col("l")]).select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(F.col("n").desc(), "w"))).where(F.col("place") <= words)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        prob = learn(dict(zip(group.w, group.n.astype(int))), pieces_of(path))
        return pd.DataFrame({"l": group.l.iloc[0], "p": list(prob), "q": list(prob.values())})

    learned = top.select("l", "w", "n").groupBy("l").applyInPandas(fit, "l string, p string, q double").collect()  # pieces x languages at most
    languages = sorted({r.l for r in learned}, key=lambda x: x.encode())
    pieces = {p: i for i, p in enumerate(sorted({r.p for r in learned}))}
    table = np.full((len(pieces) + 1, len(languages)), UNSEEN)
    of = {l: k for k, l in enumerate(languages)}
    for r in learned:
        table[pieces[r.p], of[r.l]] = max(r.q, UNSEEN)
    return Scorer(languages, pieces, table)


def identify(docs: DataFrame, scorer: Scorer, *, text: str = "text"):
    """A Column struct<lang_pred, score> for the given frame's text column."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((scorer.languages, scorer.pieces, scorer.table))  # pieces x languages

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(*sent.value)
        for texts in batches:
            names, sure = own.texts(list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": sure})

    return run(F.coalesce(F.col(text), F.lit("")))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, path: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Key, held_out, lang_pred and score (posterior with equal priors) of every row.

    Learned from the rows that are not held out; without any such row every prediction is `und`. Null texts and texts
    without a letter are `und` with score 0. Of equal scores the first language by code point wins. Null keys are not
    held out. Repeated rows are predicted alike; empty tables give empty results; other columns are not carried.
    """
    scorer = train(docs.where(~held_out(key)), path, text=text, lang=lang, key=key)
    got = docs.select(F.col(key), held_out(key).alias("held_out"), identify(docs, scorer, text=text).alias("_p"))
    return got.select(key, "held_out", "_p.lang_pred", "_p.score")
