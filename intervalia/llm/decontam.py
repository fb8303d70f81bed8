"""Benchmark decontamination with one Aho-Corasick automaton over all test items.

Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased. Every run of `size` words of an
item is a pattern (an item with fewer words, but not none, is one pattern). A text is normalised to its words
between single spaces and scanned once; a match that starts and ends at word ends marks the words it covers.

The automaton is built from the whole benchmark if that has at most `limit` characters; a larger benchmark is dealt
by item into groups of about that size, each with its own automaton and scan, and each scan adds to the rows that
the one before wrote. So what is sent to the workers stays bounded.

Defined cases: null texts and texts without words have no words, hits or items; items without words match nothing;
items with equal text are all reported; items with a null id match, but are reported under no id; repeated rows give
repeated results; an empty table on either side works; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts, schema_of

SIZE = 8
LIMIT = 16_000_000

#: A-Z to a-z, everything else in ASCII that is no digit or letter to a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """The automaton and what each of its patterns belongs to."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = SIZE):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).update([item] if item is not None else [])
        self.automaton = ahocorasick.Automaton()
        for w, own in owners.items():
            # Bytes as Latin-1 characters: one character a byte, so that positions are byte positions.
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 2, tuple(own)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """First and one past the last word of each maximal hit run; the items found."""
        found: set[str] = set()
        if not words or not self.any:
            return np.zeros((0, 2), np.int64), found
        text = f" {b' '.join(words).decode('latin-1')} "
        hits = []
        for end, (n, length, own) in self.automaton.iter(text):
            hits.append((end - length + 1, n))
            found.update(own)
        if not hits:
            return np.zeros((0, 2), np.int64), found
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        at, n = np.array(hits).T
        first = np.searchsorted(starts, at)
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + n, -1)
        inside = np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(inside))
        return edge.reshape(-1, 2), found


def original_spans(text: bytes, runs: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words as spans of the original text, in characters."""
    if not len(runs):
        return []
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[0], (np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    character = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(character[edge[a, 0]]), int(character[edge[b - 1, 1]])) for a, b in runs.tolist()]


SCHEMA = "n_words bigint, runs array<array<bigint>>, spans array<array<bigint>>, items array<string>"


def groups(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in groups whose texts have about `limit` characters, by a hash of their row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    k = max(1, -(-int(total) // limit))
    for g in range(k):
        part = items if k == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == g)
        yield [(r.i, r.t.encode()) for r in part.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, limit: int = LIMIT, spans: bool = True, key: str = "doc_id") -> DataFrame:
    """key, n_words, runs (of words), spans (of the original characters), items (ids as text, sorted)."""
    found = docs.select(key, docs["text"].cast("string").alias("text"))
    for k, group in enumerate(groups(benchmark, limit)):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        found = _scan(checkpointed(found) if k else found, shared, size, spans, key)
    return found.select(key, "n_words", "runs", "spans", "items")


def joined(runs: np.ndarray) -> np.ndarray:
    """Runs in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(runs.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _scan(docs: DataFrame, shared, size: int, spans: bool, key: str) -> DataFrame:
    """One scan; runs and items that an earlier scan left in docs are kept."""
    again = "runs" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, size)
        pairs = pa.list_(pa.list_(pa.int64()))
        for batch in parts(batches):
            n, runs, where, items = [], [], [], []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if again else None
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                r, found = scanner.scan(words)
                if before is not None:
                    old, names = next(before)
                    r, found = joined(np.concatenate([r, np.array(old, np.int64).reshape(-1, 2)])), found.union(names)
                n.append(len(words))
                runs.append(r.tolist())
                where.append([list(x) for x in original_spans(text or b"", r)] if spans else [])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(runs, pairs), pa.array(where, pairs), pa.array(items, pa.list_(pa.string()))],
                names=[key, "text", "n_words", "runs", "spans", "items"],
            )

    return docs.select(key, "text", *["runs", "items"] * again).mapInArrow(run, schema_of([docs.schema[key]], f"text string, {SCHEMA}"))


def report(scanned: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """Counts and a digest of what scan() found; contaminated: at least `least` items; spans: the hit runs as start:end in characters of the original text, end exclusive."""
    return scanned.select(
        key,
        "n_words",
        F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + r[1] - r[0]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= least).alias("contaminated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",").alias("spans"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """docs without the rows that hold a run of `size` hit words or windows of two items; all columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs["text"].alias("text"))
    found = scan(packed, benchmark, size, limit, spans=False, key="_row")
    return found.where(~F.exists("runs", lambda r: r[1] - r[0] >= size) & (F.size("items") < 2)).select("_row.*")


WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The same by joins of word windows, the spans by sums of the lengths before them.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT r, doc_id, regexp_extract_all(t, '{WORD}') AS w, string_split_regex(t, '{WORD}') AS g FROM d),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
wi AS (SELECT item, w, least(len(w), {SIZE}) AS k, unnest(generate_series(1, greatest(len(w) - {SIZE} + 1, 1))) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM wi),
ks AS (SELECT DISTINCT k FROM win),
dk AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw JOIN ks ON len(w) >= k),
hit AS (SELECT dk.r, dk.k, dk.i, win.item FROM dk JOIN win ON win.k = dk.k AND win.win = array_to_string(dk.w[dk.i:dk.i + dk.k - 1], ' ')),
pos AS (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS i FROM (SELECT DISTINCT r, k, i FROM hit)),
runs AS (SELECT r, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM pos) GROUP BY r, run),
spans AS (SELECT runs.r, sum(n) AS n_hit, string_agg(concat(
  list_sum(list_transform(g[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0), ':',
  list_sum(list_transform(g[1:b], lambda x: length(x))) + list_sum(list_transform(w[1:b], lambda x: length(x)))), ',' ORDER BY a) AS spans FROM runs JOIN dw ON dw.r = runs.r GROUP BY runs.r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(spans, '') AS spans
FROM dw LEFT JOIN spans ON spans.r = dw.r LEFT JOIN items ON items.r = dw.r
"""
