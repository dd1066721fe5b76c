"""A quality and toxicity classifier without labels: heuristic labellers, expectation-maximisation over their votes, hashed linear scorers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _EXACT_TABLE, IS_TOKEN, keyed_text, materialize, mix, rows_of, runs, span_hashes, text_slices, words
from .quality_rules import STOP_WORDS, SYMBOLS

#: Signal, share up to which it is good, share from which it is bad.  Of the last two, a low share is bad.
SIGNALS = (
    ("symbols", 0.005, 0.02),
    ("shouting", 0.15, 0.3),
    ("repeats", 0.02, 0.08),
    ("repeated_lines", 0.2, 0.6),
    ("letters", 0.95, 0.85),
    ("stop_words", 0.1, 0.04),
)
#: Overlapping labellers, by their signals' places: bad where any signal is bad, good where all are good, else no vote.
LABELLERS = (("marks", (0, 1)), ("words", (4, 2)), ("noise", (0, 2)), ("tone", (1, 5)), ("typing", (1, 2, 3)), ("tables", (0, 4, 5)))
#: Words of abuse by kind, in the four languages: of persons, of contempt, swearing, of hate.
LEXICON = (
    "idiot idiots moron morons loser losers clown clowns imbecile imbeciles dimwit dumbass jerk halfwit trottel vollidiot schwachkopf dummkopf versager crétin abruti débile imbécile imbéciles imbécil tarado payaso idiota idiotas",
    "pathetic worthless disgusting stupid scum trash filth vermin despicable erbärmlich wertlos widerlich abschaum ekelhaft minable pathétique dégoûtant ordure racaille stupide patético despreciable asqueroso escoria estúpido estúpida",
    "fuck fucking fucker shit bullshit bitch bastard asshole arschloch scheiße scheisse wichser hurensohn merde putain connard salaud enculé mierda puta cabrón gilipollas joder",
    "subhuman untermensch hate despise loathe kys verrecke crève déteste odio muérete",
)
#: Overlapping labellers of toxicity, by their kinds of words: bad from two hits and this share of the words, good without a hit, else no vote.
TOXIC_LABELLERS = (("persons", (0, 1)), ("contempt", (1, 2)), ("swearing", (2, 3)), ("hate", (0, 3)), ("any", (0, 1, 2, 3)))
TOXIC_HITS, TOXIC_SHARE = 2, 0.002
GOOD, BAD = 1, 2
#: Documents that the scorer is trained on, those of the least hashes.
TRAINING_DOCUMENTS = 6_000
DIMENSIONS = 1 << 16

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97
_JOINED = " ".join(sorted(set(STOP_WORDS))).encode()


def _stop_hashes() -> np.ndarray:
    buf = np.frombuffer(_JOINED, np.uint8)
    return np.sort(words(buf, np.array([0, len(buf)]))[0])


_STOP = _stop_hashes()


def _lexicon_hashes(listed: str) -> np.ndarray:
    """Of each word also in capitals, as only ASCII letters' case is ignored."""
    joined = " ".join(x for w in listed.split() for x in (w, w.upper())).encode()
    buf = np.frombuffer(joined, np.uint8)
    return np.unique(words(buf, np.array([0, len(buf)]))[0])


_ABUSE = tuple(map(_lexicon_hashes, LEXICON))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return count / np.maximum(whole, 1)


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which tokens equal the one before them in their text."""
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    return same


def votes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8[texts, labellers] of 0 (abstains), GOOD and BAD, and the number of each text's tokens; a text without tokens gets no votes."""
    start, end, first = runs(IS_TOKEN[buf], off)
    n = np.diff(first)
    exact = span_hashes(buf, start, end, _EXACT_TABLE)
    size = np.diff(off)
    line_start, line_end, line_first = runs(buf != 10, off)
    line_row = rows_of(line_first)
    lines = span_hashes(buf, line_start, line_end, _EXACT_TABLE)
    order = np.lexsort((lines, line_row))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    h, _, _, word_first = words(buf, off)
    at = np.minimum(np.searchsorted(_STOP, h), len(_STOP) - 1)
    shares = (
        _share(_sums(_SYMBOL[buf], off), size),
        _share(_sums(_UPPER[buf], off), _sums(_LETTER[buf], off)),
        _share(_sums(_repeats(exact, first), first), n),
        _share(_sums(again, line_first), np.diff(line_first)),
        _share(_sums(letters[end] > letters[start], first), n),
        _share(_sums(_STOP[at] == h, word_first), np.diff(word_first)),
    )
    signal = np.zeros((len(n), len(SIGNALS)), np.int8)
    for k, ((_, good, bad), share) in enumerate(zip(SIGNALS, shares, strict=True)):
        signal[:, k] = np.where(share <= good, GOOD, np.where(share >= bad, BAD, 0)) if good < bad else np.where(share >= good, GOOD, np.where(share <= bad, BAD, 0))
    signal[np.diff(word_first) < 50, -1] = 0
    out = np.zeros((len(n), len(LABELLERS)), np.int8)
    for k, (_, places) in enumerate(LABELLERS):
        own = signal[:, list(places)]
        out[:, k] = np.where((own == BAD).any(axis=1), BAD, np.where((own == GOOD).all(axis=1), GOOD, 0))
    out[n == 0] = 0
    return out, n


def toxic_votes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """int8[texts, labellers of toxicity] of 0 (abstains), GOOD and BAD; a text without words gets no votes."""
    h, _, _, first = words(buf, off)
    n = np.diff(first)
    hits = [_sums(np.isin(h, kind), first) for kind in _ABUSE]
    out = np.zeros((len(n), len(TOXIC_LABELLERS)), np.int8)
    for k, (_, places) in enumerate(TOXIC_LABELLERS):
        own = sum(hits[j] for j in places)
        out[:, k] = np.where((own >= TOXIC_HITS) & (own >= TOXIC_SHARE * n), BAD, np.where(own == 0, GOOD, 0))
    out[n == 0] = 0
    return out


_BASE3 = 3 ** np.arange(max(len(LABELLERS), len(TOXIC_LABELLERS)))


def _decoded(codes: np.ndarray, labellers: tuple) -> np.ndarray:
    return (codes[:, None] // _BASE3[: len(labellers)]) % 3


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in text_slices(batch.column(1)):
            pattern, toxic = votes(buf, off)[0] @ _BASE3[: len(LABELLERS)], toxic_votes(buf, off) @ _BASE3[: len(TOXIC_LABELLERS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pattern.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["id", "pattern", "toxic"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: each pattern's probability of good, P(vote | class) and the share of good.

    ``patterns``: int[patterns, labellers]; the accuracies start from "right more often than not".
    """
    table = np.empty((2, patterns.shape[1], 3))  # class (0 bad, 1 good), labeller, vote
    table[1] = (0.2, 0.75, 0.05)
    table[0] = (0.2, 0.4, 0.4)
    prior, weight = 0.8, counts / max(counts.sum(), 1)
    posterior = np.full(len(patterns), prior)
    places = np.arange(patterns.shape[1])
    for _ in range(rounds):
        log = np.log(table[:, places, patterns]).sum(axis=2) + np.log([[1 - prior], [prior]])
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        settled, posterior = np.abs(after - posterior).max(initial=0) < 1e-9, after
        if settled:
            break
        prior = float(np.clip((weight * posterior).sum(), 1e-6, 1 - 1e-6))
        for c, p in enumerate((1 - posterior, posterior)):
            for v in range(3):
                table[c, :, v] = ((weight * p)[:, None] * (patterns == v)).sum(axis=0) + 1e-6
            table[c] /= table[c].sum(axis=1, keepdims=True)
    return posterior, table, prior


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the tokens, three for each (its word, its shape, whether it repeats the one before), and the texts' first tokens."""
    start, end, first = runs(IS_TOKEN[buf], off)
    word = span_hashes(buf, start, end)
    shape = _SHAPE[buf]
    kept = np.ones(len(buf), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[start] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    form = span_hashes(shape[kept], place[start], place[end], _EXACT_TABLE)
    repeat = _repeats(span_hashes(buf, start, end, _EXACT_TABLE), first).astype(np.uint64)
    out = np.stack([mix(word + np.uint64(1)), mix(form + np.uint64(2)), mix(repeat + np.uint64(3))], axis=1) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
    return out.astype(np.int64), first


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in text_slices(batch.column(1)):
            f, first = features(buf, off)
            row = rows_of(first)
            flat, count = np.unique((row[:, None] * DIMENSIONS + f).ravel(), return_counts=True)
            ends = np.searchsorted(flat, np.arange(hi - lo + 1) * DIMENSIONS).astype(np.int32)
            values = (count / np.maximum(np.diff(first), 1)[flat // DIMENSIONS]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array((flat % DIMENSIONS).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))], names=["id", "places", "shares"]
            )


def word_roots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed words of each text, each once, as texts' rows, places and square roots of their shares, by which few words count in a long text."""
    h, _, _, first = words(buf, off)
    place = (mix(h + np.uint64(1)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
    flat, count = np.unique(rows_of(first) * DIMENSIONS + place, return_counts=True)
    row = flat // DIMENSIONS
    return row, flat % DIMENSIONS, np.sqrt(count / np.diff(first)[row]).astype(np.float32)


def _featurise_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in text_slices(batch.column(1)):
            row, place, value = word_roots(buf, off)
            ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))], names=["id", "places", "shares"])


def fit(row: np.ndarray, place: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on soft targets (full-batch Adam)."""
    w = np.zeros(DIMENSIONS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = max(len(target), 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[place] * value, minlength=len(target)) + w[-1], -50, 50)))
        g = np.append(np.bincount(place, (p - target)[row] * value, minlength=DIMENSIONS), (p - target).sum()) / n + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def _learn(rows: DataFrame, chosen: DataFrame, featurise, label: dict[int, float]) -> tuple[np.ndarray, float]:
    """A scorer fitted to the labels of the chosen documents' patterns."""
    sample = rows.join(F.broadcast(chosen), "id").select("id", "text")
    table = sample.mapInArrow(featurise, f"id {rows.schema['id'].dataType.simpleString()}, places array<int>, shares array<float>").join(F.broadcast(chosen), "id").toArrow()
    places, shares = (table.column(k).combine_chunks() for k in ("places", "shares"))
    size = np.diff(places.offsets.to_numpy())
    target = np.array([label[p] for p in table.column("pattern").to_pylist()])
    return fit(np.repeat(np.arange(len(target)), size), places.flatten().to_numpy(), shares.flatten().to_numpy().astype(float), target)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_DOCUMENTS) -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """Weights and intercept of the scorer of good quality, and of the one of toxicity.

    All documents vote; their patterns (at most three to the number of labellers)
    are counted in Spark, and the accuracies are estimated from the counts.  A
    scorer learns the posterior labels of the ``most`` documents whose ids have
    the least hashes; that of toxicity also learns those of up to a quarter as
    many that a labeller calls toxic, as these are rare.  A table without tokens
    gives a quality scorer of zeros; one without a toxic vote calls nothing toxic.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    both = materialize(rows.mapInArrow(_vote, f"id {kind}, pattern long, toxic long").filter("pattern > 0 or toxic > 0"), "votes")
    once = lambda df: df.groupBy("id").agg(F.min("pattern").alias("pattern"))
    least = lambda df, n: once(df.orderBy(F.xxhash64("id"), "id", "pattern").limit(n))

    def labels(voted: DataFrame, labellers: tuple) -> tuple[np.ndarray, dict[int, float]]:
        found = voted.groupBy("pattern").count().orderBy("pattern").toPandas()
        codes = found["pattern"].to_numpy()
        posterior = estimate(_decoded(codes, labellers), found["count"].to_numpy().astype(float))[0] if len(codes) else []
        return codes, dict(zip(codes.tolist(), map(float, posterior), strict=True))

    voted = both.filter("pattern > 0").select("id", "pattern")
    _, good = labels(voted, LABELLERS)
    quality = _learn(rows, least(voted.filter("id is not null"), most), _featurise, good) if good else (np.zeros(DIMENSIONS, np.float32), 0.0)
    voted = both.filter("toxic > 0").select("id", F.col("toxic").alias("pattern"))
    codes, clean = labels(voted, TOXIC_LABELLERS)
    bad = codes[(_decoded(codes, TOXIC_LABELLERS) == BAD).any(axis=1)].tolist() if clean else []
    if not bad:
        return quality, (np.zeros(DIMENSIONS, np.float32), -50.0)
    named = voted.filter("id is not null")
    chosen = once(least(named, most).union(least(named.filter(F.col("pattern").isin(bad)), most // 4)))
    return quality, _learn(rows, chosen, _featurise_words, {p: 1 - x for p, x in clean.items()})


def _probability(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6), 0.0)


def score_documents(docs: DataFrame, quality: tuple[np.ndarray, float], toxicity: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, score, keep, toxicity, toxic) for every row: the probabilities of good quality and of toxicity; toxic is whether the latter is at least ``least``, keep whether the former is and the text isn't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((*quality, *toxicity))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, v, c = shared.value
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column(1)):
                f, first = features(buf, off)
                total = np.concatenate([[0], np.cumsum(w[f].sum(axis=1, dtype=np.float64))])
                n = np.diff(first)
                p = _probability((total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1) + b, n)
                row, place, value = word_roots(buf, off)
                t = _probability(np.bincount(row, v[place].astype(np.float64) * value, minlength=hi - lo) + c, n)
                toxic = t >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array((p >= least) & ~toxic), pa.array(t), pa.array(toxic)], names=["doc_id", "score", "keep", "toxicity", "toxic"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, keep boolean, toxicity double, toxic boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(doc_id, score, keep, toxicity, toxic) of every row, by scorers trained on the same documents.

    A null, empty or blank text has scores of 0 and isn't kept; it has no part in
    the training, nor have null ids, but these are scored.  Repeated rows vote as
    often as they occur and are scored alike; of an id with several texts that vote
    apart, the least pattern is what the scorer learns.  Ids keep their type.  A very
    long text is read whole.
    An empty table gives an empty result; other columns are ignored.
    """
    return score_documents(docs, *train(docs, id_col, text_col, most), id_col, text_col)
