"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of a language in order of frequency. A text's own list is
compared with it: every n-gram adds the distance between its two ranks, or the longest distance where the
profile lacks it. The language with the smallest sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, forget, materialize, text_buffer, worker_state

#: n-grams of one to three characters fit 21 bits each into a 64-bit number.
LONGEST = 3
PROFILE = 300
#: Different labelled texts that each language's profile is learned from, about; languages with fewer give all.
SAMPLE = 4000
#: Bytes from which a text is taken apart, so that memory does not grow with its length.
LONG_TEXT = 1 << 21
#: Bytes of short texts whose n-grams are taken at once; a worker needs about 200 times as much memory for them.
TOGETHER = 1 << 18
UNKNOWN = "und"


def folding() -> np.ndarray:
    """For each code point: that of its lower-case letter, or 0 for what is no letter."""
    state = worker_state()
    if "folding" not in state:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        state["folding"] = table
    return state["folding"]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as numbers, text after text, and the n + 1 places where each text's begin.

    A run of other characters counts as one space, and a space stands before and after every text. Grams
    hold at most their first and last character as a space, and at least one letter.
    """
    data, offsets = text_buffer(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    # The space before a text is also the one after the text before it.
    low = np.insert(folding()[codes], starts, 0)
    text = np.r_[np.repeat(np.arange(len(column)), np.diff(starts) + 1), len(column)]
    some = np.r_[True, (low[1:] != 0) | (low[:-1] != 0)] | np.r_[True, text[1:] != text[:-1]]
    low, text = low[some].astype(np.uint64), text[some]
    found, of = [], []
    for key, inside in windows(low):
        found.append(key[inside])
        of.append(text[: len(key)][inside])
    key, text = np.concatenate(found), np.concatenate(of)
    order = np.argsort(text, kind="stable")
    return key[order], np.searchsorted(text[order], np.arange(len(column) + 1))


def windows(low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the number of the gram at every place of folded characters, and whether it counts."""
    for n in range(1, LONGEST + 1):
        size = max(0, len(low) - n + 1)
        key, letters = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int8)
        for i in range(n):
            part = low[i : size + i]
            key = (key << np.uint64(21)) | part
            letters += part != 0 if i in (0, n - 1) else 3 * (part != 0)
        inside = letters >= max(1, 3 * (n - 2))
        if n > 2:
            inside &= letters > 0
        yield key, inside


def counted(data: memoryview, step: int = LONG_TEXT) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of one text's UTF-8 bytes and how often each comes, `step` bytes at a time."""
    values, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    tail, at = np.zeros(1, np.uint64), 0
    while at <= len(data):
        end = min(len(data), at + step)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        codes = np.frombuffer(bytes(data[at:end]).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        last = end == len(data)
        low = np.r_[tail, folding()[codes].astype(np.uint64), np.zeros(int(last), np.uint64)]
        low = low[np.r_[True, (low[1:] != 0) | (low[:-1] != 0)]]
        # Grams that begin in the last places wait for the characters after them.
        until = len(low) if last else max(0, len(low) - LONGEST + 1)
        keys = np.concatenate([key[:until][inside[:until]] for key, inside in windows(low)])
        some, n = np.unique(keys, return_counts=True)
        values, counts = added(np.r_[values, some], np.r_[counts, n])
        tail, at = low[until:], end + last
    return values, counts


def added(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, with the sum of their counts."""
    different, at = np.unique(values, return_inverse=True)
    total = np.zeros(len(different), np.int64)
    np.add.at(total, at, counts)
    return different, total


def counted_texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What counted() gives for every text of a batch; short texts are taken together."""
    for part in by_bytes(batch, name, TOGETHER):
        data, offsets = text_buffer(part.column(name))
        if part.num_rows == 1 and len(data) > LONG_TEXT:
            yield counted(memoryview(data))
            continue
        keys, starts = grams(part.column(name))
        for i in range(part.num_rows):
            yield np.unique(keys[starts[i] : starts[i + 1]], return_counts=True)


def most_frequent(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent of different numbers in ascending order, by frequency, ties by number."""
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        few = counts >= least
        values, counts = values[few], counts[few]
    return values[np.argsort(-counts, kind="stable")[:most]]


def labelled(docs: DataFrame, lang: str, sample: int) -> DataFrame:
    """__lang, text: about `sample` different texts of each language, the same in every run.

    Texts are counted and drawn by their hash, each once however often it comes, so a language whose rows
    are copies of few texts gives all of these.
    """
    rows = docs.select(F.col(lang).cast("string").alias("__lang"), docs["text"].alias("text")).filter("__lang is not null and text is not null")
    rows = rows.withColumn("__key", F.xxhash64("text"))
    counts = materialize(rows.groupBy("__lang").agg(F.approx_count_distinct("__key", 0.02).alias("__n")).withColumnRenamed("__lang", "__l"))
    draw = F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(counts, rows["__lang"] == counts["__l"]).filter(draw * F.col("__n") < sample)
    return some.groupBy("__lang", "__key").agg(F.max("text").alias("text")).select("__lang", "text")


def learn(training: DataFrame, lang: str = "lang", sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of every language of the labelled rows.

    Tasks count the n-grams of their rows for each language and pass on sums; the driver gets `profile`
    n-grams for each language and nothing else, and every task the same table: it grows with the languages alone.
    """
    rows = labelled(training, lang, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            waiting: dict[str, list] = {}
            held = 0
            for one, found in zip(batch.column("__lang").to_pylist(), counted_texts(batch, "text"), strict=True):
                waiting.setdefault(one, []).append(found)
                held += len(found[0])
                if held > 1 << 20:
                    merge(sums, waiting)
                    waiting, held = {}, 0
            merge(sums, waiting)
            for one, (values, n) in sorted(sums.items()):
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def merge(sums: dict, waiting: dict) -> None:
        for one, parts in waiting.items():
            values, n = zip(*([sums[one]] if one in sums else []), *parts, strict=True)
            sums[one] = added(np.concatenate(values), np.concatenate(n))

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    found: dict[str, list[int]] = {}
    for r in sums.withColumn("place", place).filter(F.col("place") <= profile).orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, dtype=np.int64).view(np.uint64) for lang, g in found.items()}


class Ranks:
    """The profiles as one sorted table of n-grams with their rank in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs, self.profile = sorted(profiles), profile
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def distance(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The out-of-place distance to each language over the longest possible one, 0 to 1."""
        own = most_frequent(values, counts, self.profile)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[at]
        known = (ranks >= 0) & (self.grams[at] == own)[:, None]
        apart = np.where(known, np.abs(ranks - np.arange(len(own))[:, None]), self.profile)
        return apart.sum(axis=0) / (self.profile * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",), profile: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `columns`, lang_pred and score of every row, from its whole text alone.

    score is one minus the smallest distance's share of the longest. A text that is null or has no letter is
    `und` with score 0, as is any text where no language was learned. Ties go to the first language by name.
    Repeated rows fare alike, no rows give no rows, a text of any length is taken apart, and other columns may
    have any name; `names` are those of the two results, where `columns` has a lang_pred or score of its own.
    """
    # The text travels once, whether it is kept or not.
    own = [F.col(f"`{c}`") for c in columns]
    source = docs.select(F.struct(*own).alias("row"), F.col("text").alias("text")) if "text" not in columns else docs.select(F.struct(*own).alias("row"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema["row"].dataType.fields)
    ranks = Ranks(profiles, profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            row = batch.column("row")
            kept = [row.field(c) for c in columns]
            texts = pa.RecordBatch.from_arrays([kept[columns.index("text")] if "text" in columns else batch.column("text")], names=["text"])
            langs, scores = [], []
            for values, counts in counted_texts(texts, "text"):
                if not len(values) or not ranks.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    apart = ranks.distance(values, counts)
                    best = int(apart.argmin())
                    langs.append(ranks.langs[best])
                    scores.append(float(1 - apart[best]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *names])

    return source.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")
