"""Long passages that documents share, marked with a run-length compressed Burrows-Wheeler index.

Texts are sequences of word hashes.  Winnowing picks anchors (hashes of a few
words) so that every passage of ``LEAST_WORDS`` words holds one, and the same
ones wherever it occurs; anchors of a single text are dropped.  The words around
the others, as far as a passage of that length with the anchor in it can reach,
meet by anchor.  Over these repetitive collections the index is built: the runs
of the Burrows-Wheeler transform, and for the suffix at each run's first and last
place its neighbour in the suffixes' order with their longest common prefix (LCP).
The suffix array that made them is given up.  One pass over the text streams the
matching statistics from these samples: between two samples a suffix's neighbour
moves along by one word for each word, and the LCP falls by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, mix, rows_of, text_slices, words

LEAST_WORDS, ANCHOR_WORDS = 50, 8
#: Words that one index holds.
BLOCK_WORDS = 1_500_000
#: Places up to which an anchor's surroundings fit one index; those of a more frequent one are counted by their passages.
ANCHOR_PLACES = BLOCK_WORDS // (2 * LEAST_WORDS)
_FACTORS = mix(np.arange(2000, 2064, dtype=np.uint64)) | np.uint64(1)


# --- anchors -----------------------------------------------------------------


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    n = max(len(h) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _FACTORS[k]
    return mix(total)


def _window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    width = 1
    while width < size:
        step = min(width, size - width)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        width += step
    return x


def anchors(h: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, size: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``h``, hash) of the anchors: of each window of ``least`` words within a text, the least hash of ``size`` words, the first of equals."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _grams(h, size)
    bits = max(int(len(g)).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    best = _window_minima((g & ~low) | np.arange(len(g), dtype=np.uint64), least - size + 1)
    row = rows_of(first)
    whole = row[: len(best)] == row[least - 1 : least - 1 + len(best)]
    place = np.unique(best[whole] & low).astype(np.int64)
    return place, g[place]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sames = batch.column(0), column(batch, "same")
        for lo, hi, buf, off in text_slices(batch.column(2)):
            h, _, _, first = words(buf, off)
            place, value = anchors(h, first)
            ends = np.searchsorted(place, first).astype(np.int32)
            row = rows_of(first)[place] if len(place) else place
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(sames[lo:hi], pa.int64()),
                    pa.array(np.diff(first).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array((place - first[row]).astype(np.int32))),
                ],
                names=["id", "same", "n_words", "anchors", "places"],
            )


def _surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each listed anchor: as far as a passage of ``LEAST_WORDS`` words with the anchor in it can reach."""
    reach = LEAST_WORDS - ANCHOR_WORDS
    for batch in batches:
        sames = column(batch, "same")
        places, values = batch.column(2), batch.column(3)
        for lo, hi, buf, off in text_slices(batch.column(0)):
            h, _, _, first = words(buf, off)
            at, value = places.slice(lo, hi - lo), values.slice(lo, hi - lo)
            count = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(hi - lo), count)
            place = at.flatten().to_numpy().astype(np.int64)
            here = first[row] + place
            start, stop = np.maximum(here - reach, first[row]), np.minimum(here + ANCHOR_WORDS + reach, first[row + 1])
            size = stop - start
            ends = np.concatenate([[0], np.cumsum(size)])
            all_words = (h >> np.uint64(32)).astype(np.uint32)[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            power = mix(np.arange(ends[-1], dtype=np.uint64) - np.repeat(ends[:-1], size).astype(np.uint64) + np.uint64(7)) | np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(all_words.astype(np.uint64) + np.uint64(11)) * power)])
            context = mix(total[ends[1:]] - total[ends[:-1]] + _FACTORS[0] * (here - start).astype(np.uint64) + _FACTORS[1] * size.astype(np.uint64))
            for a in range(0, len(row), 4096):
                b = min(a + 4096, len(row))
                part = np.ascontiguousarray(all_words[ends[a] : ends[b]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value.flatten().slice(a, b - a)),
                        pa.array(context[a:b].view(np.int64)),
                        pa.array(sames[lo:hi][row[a:b]], pa.int64()),
                        pa.array((start - first[row])[a:b].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * (ends[a : b + 1] - ends[a])).astype(np.int32)), pa.py_buffer(part)]),
                    ],
                    names=["anchor", "context", "same", "start", "words"],
                )


# --- the index ---------------------------------------------------------------


class RunIndex:
    """The run-length compressed index of a collection of word sequences.

    ``symbols`` and ``starts``: the runs of the transform.  ``heads`` and ``tails``:
    the suffixes at the runs' first and last places, by place in the text, with
    the suffix before (after) each of them in order, ``before`` (``after``), and
    the heads' LCP with the former, ``common``.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray):
        """``text``: the sequences one after the other; ``size``: their lengths, each at least 1."""
        n = len(text) + len(size)
        end = np.cumsum(size + 1) - 1  # places of the end marks
        self.mark = np.zeros(n, bool)
        self.mark[end] = True
        self.symbol = np.zeros(n, np.int64)
        self.symbol[~self.mark] = np.unique(text, return_inverse=True)[1] + 1
        self.segment = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        self.stop, self.n = end[self.segment], n
        order = self._suffixes(int(size.max(initial=0)) + 1)
        last = np.where(order > 0, self.symbol[order - 1], 0)  # the transform; 0 stands for an end mark, each a run of its own
        head = np.ones(n, bool)
        head[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        self.starts = np.flatnonzero(head)
        self.symbols = last[self.starts]
        border = self.starts[1:]
        at, previous = order[border], order[border - 1]
        common = self._common(at, previous)
        by = np.argsort(at)
        self.heads, self.before, self.common = np.append(at[by], order[0]), np.append(previous[by], -1), np.append(common[by], 0)
        by = np.argsort(self.heads)  # the first suffix of all is a head without one before it
        self.heads, self.before, self.common = self.heads[by], self.before[by], self.common[by]
        self.tails, self.after = np.append(previous, order[-1]), np.append(at, -1)
        by = np.argsort(self.tails)
        self.tails, self.after = self.tails[by], self.after[by]

    def _suffixes(self, longest: int) -> np.ndarray:
        """The suffixes in order of their words up to the end mark, equal ones by place: ranks of doubling lengths."""
        rank, width = self.symbol.copy(), 1
        order = np.argsort(rank, kind="stable")
        place = np.arange(self.n)
        open_ = place  # suffixes not yet apart from all others
        rank = self._ranks(order, rank[order])
        while width < longest:
            ahead = np.minimum(open_ + width, self.n - 1)
            second = np.where(open_ + width <= self.stop[open_], rank[ahead] + 1, 0)
            key = rank[open_] * np.int64(self.n + 2) + second
            at = np.argsort(key, kind="stable")
            moved = open_[at]
            sorted_key, first = key[at], rank[moved]
            new = np.ones(len(at), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            group = np.ones(len(at), bool)
            group[1:] = first[1:] != first[:-1]
            # a rank is the number of suffixes before the group; groups keep their places
            within = np.arange(len(at)) - np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
            rank[moved] = first + np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) - (np.arange(len(at)) - within)
            width *= 2
            alone = new & np.append(new[1:], True)
            open_ = np.sort(moved[~alone])
            if not len(open_):
                break
        return np.lexsort((place, rank)) if len(open_) else np.argsort(rank)

    @staticmethod
    def _ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = values[1:] != values[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes a and b share, up to their end marks."""
        length = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(self.symbol[a] == self.symbol[b])
        open_ = open_[~self.mark[a[open_]]]
        while len(open_):
            length[open_] += 1
            x, y = a[open_] + length[open_], b[open_] + length[open_]
            open_ = open_[(self.symbol[x] == self.symbol[y]) & ~self.mark[x]]
        return length

    def preceding(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix before each one in order (-1: none), and their LCP, from the nearest head at or before it in the text."""
        k = np.searchsorted(self.heads, place, side="right") - 1
        gone = place - self.heads[k]
        return np.where(self.before[k] >= 0, self.before[k] + gone, -1), np.maximum(self.common[k] - gone, 0)

    def following(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix after each one in order (-1: none), and their LCP."""
        k = np.searchsorted(self.tails, place, side="right") - 1
        there = np.where(self.after[k] >= 0, self.after[k] + place - self.tails[k], -1)
        return there, np.where(there >= 0, self.preceding(np.maximum(there, 0))[1], 0)

    def matching_statistics(self, owner: np.ndarray, least: int = 1) -> np.ndarray:
        """For each place the number of words from there on that occur in a sequence of another owner, 0 where they are fewer than ``least``.

        ``owner``: by sequence.  The nearest suffixes of other owners before and
        after share the least LCP on the way to them; ways over suffixes of one's
        own are doubled in each round.
        """
        out = np.zeros(self.n, np.int64)
        ahead = np.flatnonzero(self.stop - np.arange(self.n) >= least)
        row = np.full(self.n, -1)
        row[ahead] = np.arange(len(ahead))
        own = owner[self.segment[ahead]]
        for step in (self.preceding, self.following):
            there, length = step(ahead)
            length = np.where(there >= 0, length, 0)
            own_still = np.zeros(len(ahead), bool)
            live = np.flatnonzero(length >= least)  # a neighbour that shares so many words has as many ahead
            own_still[live] = owner[self.segment[there[live]]] == own[live]
            while own_still.any():
                at = np.flatnonzero(own_still)
                over = row[there[at]]
                moved, shared = there[over], np.minimum(length[at], length[over])
                there[at], length[at] = moved, shared
                own_still[at] = False
                live = at[shared >= least]
                own_still[live] = owner[self.segment[there[live]]] == own[live]
            out[ahead] = np.maximum(out[ahead], np.where(length >= least, length, 0))
        return out


def shared_spans(text: np.ndarray, size: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence the first and the end place of its words in matches of ``least`` words or more with other owners; (0, 0) if none."""
    index = RunIndex(text, size)
    found = index.matching_statistics(owner, least)
    base = np.cumsum(size + 1) - size - 1
    at = np.flatnonzero(found)
    segment = index.segment[at]
    place = at - base[segment]
    lo = np.full(len(size), np.iinfo(np.int64).max)
    hi = np.zeros(len(size), np.int64)
    np.minimum.at(lo, segment, place)
    np.maximum.at(hi, segment, place + found[at])
    return np.where(hi > 0, lo, 0), hi


def _blocks(anchor: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows to index together: whole anchors, of at most ``most`` words where more than one."""
    edge = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor))
    total = np.concatenate([[0], np.cumsum(size)])
    begin = 0
    while begin < len(edge) - 1:
        stop = max(int(np.searchsorted(total[edge], total[edge[begin]] + most, side="right")) - 1, begin + 1)
        yield np.arange(edge[begin], edge[stop])
        begin = stop


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each passage of ``LEAST_WORDS`` words that holds a listed anchor, with its text and its first word."""
    for batch in batches:
        sames, places = column(batch, "same"), batch.column(2)
        for lo, hi, buf, off in text_slices(batch.column(0)):
            h, _, _, first = words(buf, off)
            at = places.slice(lo, hi - lo)
            count = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(hi - lo), count)
            here = first[row] + at.flatten().to_numpy().astype(np.int64)
            start = (here[:, None] + np.arange(ANCHOR_WORDS - LEAST_WORDS, 1)).ravel()
            row = np.repeat(row, LEAST_WORDS - ANCHOR_WORDS + 1)
            ok = (start >= first[row]) & (start + LEAST_WORDS <= first[row + 1])
            start, keep = np.unique(start[ok], return_index=True)
            row = row[ok][keep]
            power = mix(np.arange(len(h), dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
            value = np.zeros(len(start), np.uint64)
            for k in range(LEAST_WORDS):
                value += h[start + k] * power[k]
            yield pa.RecordBatch.from_arrays([pa.array(mix(value).view(np.int64)), pa.array(sames[lo:hi][row]), pa.array((start - first[row]).astype(np.int32))], names=["passage", "same", "lo"])


def _match(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            anchor, context, low, high = (table.column(k).to_numpy() for k in ("anchor", "context", "low", "high"))
            data = table.column("words").chunk(0)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 4
            text = np.frombuffer(data.buffers()[2], np.uint32)
            size = np.diff(ends)
            # a context of several texts is repeated as it is, and another text than any other
            owner = np.where(low == high, low, np.int64(-1))
            _, owner = np.unique(owner, return_inverse=True)
            several = low != high
            owner[several] = owner.max(initial=0) + 1 + np.arange(int(several.sum()))
            lo, hi = np.where(several, 0, np.iinfo(np.int64).max), np.where(several, size, 0)
            for rows in _blocks(anchor, size, most):
                part = text[np.repeat(ends[rows] - np.cumsum(size[rows]) + size[rows], size[rows]) + np.arange(int(size[rows].sum()))]
                a, b = shared_spans(part, size[rows], owner[rows], least)
                hit = b > 0
                lo[rows[hit]] = np.minimum(lo[rows[hit]], a[hit])
                hi[rows[hit]] = np.maximum(hi[rows[hit]], b[hit])
            keep = hi - lo >= least
            return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(context[keep]), pa.array(lo[keep].astype(np.int32)), pa.array(hi[keep].astype(np.int32))], names=["anchor", "context", "lo", "hi"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = column(batch, "anchor")
            if count * (LEAST_WORDS * 2) > most and held:
                cut = int(np.searchsorted(anchor, column(held[-1], "anchor")[-1], side="right"))
                if cut < len(anchor):
                    yield flush([*held, batch.slice(0, cut)])
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield flush(held)

    return run


def _copies_and_lone(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(same, n_words) of the texts that several ids have: they are repeated whole; and (id, same, anchors, places) of each text once, by its least id."""
    texts = materialize(found.groupBy("same").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.first("n_words").alias("n_words")), "texts")
    # rows that repeat id and text have the same anchors, which the counts below take once
    return texts.filter("id <> other").select("same", "n_words"), found.join(texts.select("same", "id"), ["same", "id"]).select("id", "same", "anchors", "places")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_places: int = ANCHOR_PLACES) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the passages of each document whose every word is in a run of ``LEAST_WORDS``
    words or more that another document has too.

    Words are numbered from 0, ``end_word`` is one beyond the last; they are runs of
    ASCII letters, digits and other characters than ASCII's, compared without the
    case of ASCII letters.  Passages of a document don't touch.  An anchor at more
    than ``anchor_places`` places of different texts, which no single index should
    hold, has its passages counted by their hashes instead, with the same result.

    * A null, empty or shorter text has none; rows with a null id are left out.
    * Rows that repeat id and text count once; rows of one id with several texts
      are compared with each other too, and give their passages under that id.
    * Documents with the same text of at least that length are repeated whole.
    * A repetition within one document doesn't count.  Ids keep their type.  A very
      long text is read whole.  An empty table gives an empty result; other columns
      are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null and text is not null").withColumn("same", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = materialize(rows.select("id", "same", "text").mapInArrow(_find, f"id {kind}, same long, n_words int, anchors array<long>, places array<int>").filter(F.col("n_words") >= LEAST_WORDS), "anchors")
    whole, lone = _copies_and_lone(found)
    placed = lone.select("id", "same", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("id", "same", "x.anchors", "x.places")
    shared = placed.groupBy("anchors").agg(F.min("same").alias("l"), F.max("same").alias("h"), F.count("*").alias("n")).filter("l <> h").select("anchors", (F.col("n") > anchor_places).alias("hot"))
    wanted = placed.join(shared, "anchors").distinct().groupBy("id", "same", "hot").agg(F.collect_list(F.struct("places", "anchors")).alias("x"))
    wanted = materialize(wanted.select("id", "same", "hot", F.col("x.places").alias("places"), F.col("x.anchors").alias("anchors")), "wanted")
    source = rows.join(wanted, ["id", "same"]).select("text", "same", "places", "anchors", "hot")
    around = source.filter("not hot").drop("hot").mapInArrow(_surround, "anchor long, context long, same long, start int, words binary")
    unique = around.groupBy("anchor", "context").agg(F.min("same").alias("low"), F.max("same").alias("high"), F.first("words").alias("words"))
    unique = unique.repartition("anchor").sortWithinPartitions("anchor", "context").select("anchor", "context", "low", "high", "words")
    spans = unique.mapInArrow(_match(LEAST_WORDS, BLOCK_WORDS), "anchor long, context long, lo int, hi int")
    marks = around.select("anchor", "context", "same", "start").join(spans, ["anchor", "context"]).select("same", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    if not wanted.filter("hot").isEmpty():
        passages = materialize(source.filter("hot").select("text", "same", "places").mapInArrow(_passages, "passage long, same long, lo int"), "passages")
        again = passages.groupBy("passage").agg(F.min("same").alias("l"), F.max("same").alias("h")).filter("l <> h").select("passage")
        marks = marks.union(passages.join(again, "passage").select("same", "lo", (F.col("lo") + LEAST_WORDS).alias("hi")))
    marks = marks.union(whole.select("same", F.lit(0).alias("lo"), F.col("n_words").alias("hi")))
    order = Window.partitionBy("same").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = marks.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("same", "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
    owners = found.select("same", F.col("id").alias("doc_id")).distinct()
    return owners.join(merged, "same").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")).distinct()
