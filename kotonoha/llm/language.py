"""Language by compression.

Each language has a zstandard dictionary of raw content: words of its training
texts.  A text is reduced to its distinct words in order of first use, so that
repeats inside the text do not hide what the dictionaries know; all of it is
compressed in chunks with each dictionary, and the smallest total wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table, written
from kotonoha.llm.rows import below

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bytes of a dictionary's entries; a longer word, as in scripts without spaces, makes several.
LONGEST = 256


def coded(text: str) -> bytes:
    """Distinct lower-cased words in order of first use."""
    return " ".join(dict.fromkeys(_WORD.findall(text.lower()))).encode("utf-8", "replace")


def pieces(word: bytes, most: int) -> list[bytes]:
    return [word[i : i + most] for i in range(0, len(word), most)]


@dataclass
class LanguageModel:
    """Dictionaries by language, those of most training documents first."""

    dictionaries: dict[str, bytes]
    level: int = 5
    chunk: int = 2048
    #: A text of any length is rejected if the best total is not so many bytes smaller than the second: of 2,000 held-out texts
    #: and their beginnings, of those below 256 bytes, 51 of 173 equal totals were wrong, 1 of 8 one byte apart, 3 of 4,033 further apart.
    least_apart: int = 2
    #: It is also rejected if the best total is not this share smaller, which is more from 1,000 compressed bytes on.
    least_margin: float = 0.002
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def sizes(self, content: bytes) -> list[tuple[int, str]]:
        if not self._made:
            import zstandard

            for name, words in self.dictionaries.items():
                known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=self.level)
                self._made[name] = zstandard.ZstdCompressor(
                    level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
        chunks = [content[i : i + self.chunk] for i in range(0, len(content), self.chunk)]
        return [(sum(len(press(c)) for c in chunks), name) for name, press in self._made.items()]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence from 0 to 1, and whether the text is accepted.

        Without a letter, or with nothing learned, the language is unknown and the text rejected.  Equal totals go to the
        language of more training documents, then to the name that sorts first.
        """
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        content = coded(text)
        sizes = self.sizes(content)
        best, name = min(sizes, key=lambda s: s[0])
        second = min((s for s, n in sizes if n != name), default=2 * best + 1)
        confidence = 1.0 / sum(2.0 ** -min(s - best, 1000) for s, _ in sizes)
        narrow = second - best < max(self.least_apart, self.least_margin * second)
        return name, confidence, not narrow


def train(docs: DataFrame, per_language: int = 400, dictionary_bytes: int = 65_536, most_bytes: int = 64 << 20, **settings) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)``; the caller leaves out the rows not to be learned from.

    A language's dictionary holds the words that are in most of at most ``per_language`` of its documents, those whose id's
    hash is smallest, the most frequent last; words of equally many documents go by hash.  Whole texts are counted.
    The documents are chosen without their texts.  The dictionaries go to every task: ``most_bytes`` bounds them in sum, and
    more languages than fit are an error, never left out.  Rows with a null text or language are not learned from.
    """
    spark = docs.sparkSession
    rows = docs.filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = [(r["lang"], r["n"]) for r in counts.limit(most_bytes // dictionary_bytes + 1).collect()]
    if len(languages) * dictionary_bytes > most_bytes:
        raise ValueError(f"more than {most_bytes // dictionary_bytes} languages; raise most_bytes or lower dictionary_bytes")
    # a language's smallest hashes only: what is ranked does not grow with the language
    totals = small_table(spark, languages, "lang string, total long")
    near = rows.select("lang", "doc_id").join(F.broadcast(totals), "lang").filter(below(F.xxhash64("doc_id"), per_language, F.col("total")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = near.select("lang", "doc_id").distinct().withColumn("place", place).filter(F.col("place") <= per_language)
    longest = max(1, min(LONGEST, dictionary_bytes - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(dict.fromkeys(p for w in coded(text).split(b" ") for p in pieces(w, longest)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.binary())], names=["lang", "word"])

    # at most ``per_language`` ids for each of the languages, whose number is bounded above
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    found = sample.mapInArrow(run, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n"))
    found = written(found.withColumn("bytes", F.octet_length("word") + 1), "language-words")
    # one row for each number of documents
    levels = defaultdict(list)
    for r in found.groupBy("lang", "n").agg(F.sum("bytes").alias("bytes")).collect():
        levels[r["lang"]].append((r["n"], r["bytes"]))
    least = []
    for name, of in levels.items():
        room = dictionary_bytes
        for n, size in sorted(of, reverse=True):
            if size >= room:
                break
            room -= size
        # of the last number's words so many that those of smallest hash fill the room
        least.append((name, n, min(1.0, (4 * room + 64 * longest) / size)))
    least = small_table(spark, least, "lang string, least long, share double")
    picked = found.join(F.broadcast(least), "lang").withColumn("place", F.xxhash64("word"))
    picked = picked.filter((F.col("n") > F.col("least")) | (F.col("n") == F.col("least")) & (F.col("place").cast("double") <= -(2.0**63) + F.col("share") * 2.0**64))
    # bounded: a few times the dictionaries
    parts = defaultdict(list)
    for r in picked.select("lang", "word", "n", "place").collect():
        parts[r["lang"]].append((-r["n"], r["place"], bytes(r["word"])))
    made = {}
    for name, _ in sorted(languages, key=lambda x: (-x[1], x[0])):
        room, held = dictionary_bytes, []
        for *_, word in sorted(parts[name]):
            if len(word) < room:
                held.append(word)
                room -= len(word) + 1
        made[name] = b"".join(w + b" " for w in reversed(held))
    return LanguageModel({n: w for n, w in made.items() if len(w) >= 8}, **settings)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``accepted`` for every row of ``docs(doc_id, text)``.

    A null text, or one without a letter, is ``und`` with score 0, not accepted.  Whole texts are used.
    Repeated rows and null ids are judged like others.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.judge(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*got)) if got else [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "lang_pred", "score", "accepted"]
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is accepted."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.fromiter((sent.value.judge(t)[2] for t in batch.column(at).to_pylist()), bool, batch.num_rows)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
