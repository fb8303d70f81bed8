"""Language identification by compression.

Texts count as their lower-cased words. Each language gets a zstandard dictionary of raw content: whole training texts in the order of a hash of their id,
cut at DICTIONARY bytes. A text is compressed once with each dictionary; the language whose dictionary gives the smallest result
is chosen. Where the best two results differ by less than NARROW of the text's bytes, the text is compressed again by a
slower level, which finds shorter matches. The score is the softmax of the saved bits at a fixed temperature. If the
margin is then under MARGIN of the text's bytes, the choice is marked as rejected.

Training rows: a known id, whose hash is not in the held-out class, and a known language. The dictionaries are a
bounded sample of them: about SAMPLE rows of each language. Every language is learned; with more than TOTAL / DICTIONARY of them each has a smaller dictionary.

Defined cases: null text or text without letters: `und`, score 0, rejected; without training rows every text is
`und`; equal results: the language with more training rows, then the first in order; a null id is never trained on and not held out; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, parts, schema_of

DICTIONARY = 110 * 1024
SAMPLE = 64
#: Bytes of all dictionaries, if none is under LEAST for it; languages whose compressors are in memory together.
TOTAL, LEAST, TOGETHER = 64 << 20, 4096, 128
LEVELS = (1, 9)
NARROW = 0.02
MARGIN = 0.002
TEMPERATURE = 64.0
NO_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """What is compressed, of texts and dictionaries: lower-cased words of letters and their marks between single spaces; nothing if there is no letter."""
    return NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if LETTER.search(text) else b""


def training_texts(docs: DataFrame, train, sample: int = SAMPLE) -> dict[str, list[bytes]]:
    """About `sample` texts of each language, by a hash of the id, the most frequent language first; of a text at most what fills a dictionary twice."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_of"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # There are few languages; a language with a third of all rows is read where it lies.
    placed = rows.withColumn("_place", place).join(F.broadcast(counts), "lang").where(F.col("_place") * F.col("_of") < sample)
    picked = placed.select("lang", "_of", "_place", F.substr("text", F.lit(1), F.lit(2 * DICTIONARY)).alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (-r._of, r.lang, r._place, r.text)):
        out.setdefault(r.lang, []).append(letters(r.text))
    return out


def dictionaries(texts: dict[str, list[bytes]], size: int = DICTIONARY, total: int = TOTAL) -> dict[str, bytes]:
    """Raw content for each language; texts are taken whole until it is full, the last one is cut. Many languages have smaller dictionaries."""
    size = max(LEAST, min(size, total // max(1, len(texts))))
    return {lang: b" ".join(t)[:size].rjust(8) for lang, t in texts.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes], levels: tuple[int, ...] = LEVELS):
        self.langs, self.content, self.levels = list(content), content, levels
        self.made: dict[tuple[int, int], list] = {}

    def compressors(self, level: int, first: int) -> list:
        """Those of TOGETHER languages; they are kept only if there are no more."""
        import zstandard as z

        if (level, first) in self.made:
            return self.made[level, first]
        made = []
        for lang in self.langs[first : first + TOGETHER]:
            d = z.ZstdCompressionDict(self.content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        if len(self.langs) <= TOGETHER:
            self.made[level, first] = made
        return made

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, rejected of each text."""
        raws = [letters(t or "") for t in texts]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(raws)
        left = [k for k, raw in enumerate(raws) if raw] if self.langs else []
        for level in self.levels:
            sizes: dict[int, list[int]] = {k: [] for k in left}
            for first in range(0, len(self.langs), TOGETHER):
                made = self.compressors(level, first)
                for k in left:
                    sizes[k] += [len(c.compress(raws[k])) for c in made]
            narrow = []
            for k, found in sizes.items():
                order = sorted(range(len(found)), key=lambda i, found=found: (found[i], i))
                margin = found[order[1]] - found[order[0]] if len(order) > 1 else len(raws[k])
                score = 1 / sum(math.exp(max(-700.0, (found[order[0]] - s) * 8 / TEMPERATURE)) for s in found)
                out[k] = (self.langs[order[0]], score, margin < max(1, MARGIN * len(raws[k])))
                if margin < NARROW * len(raws[k]):
                    narrow.append(k)
            left = narrow
        return out


def identify(docs: DataFrame, content: dict[str, bytes], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc_id, lang_pred, score, rejected. The dictionaries have a bounded size: TOTAL, or LEAST for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, levels)
        for batch in parts(batches):
            found = model.classify(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, schema_of([docs.schema["doc_id"]], "lang_pred string, score double, rejected boolean"))


def identify_held_out(docs: DataFrame, mod: int = 3, rest: int = 1) -> DataFrame:
    """Trains on the rows whose id is not in the held-out class, identifies all."""
    train = F.coalesce(bucket(F.col("doc_id"), mod) != rest, F.lit(False))
    content = dictionaries(training_texts(docs, train))
    return identify(docs, content).select("doc_id", F.coalesce(bucket(F.col("doc_id"), mod) == rest, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
