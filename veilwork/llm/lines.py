"""Removal of passages that repeat across documents, by content-defined chunks of lines.

A line ends at a line break or after a word with a punctuation mark, unless one of the three words before does so too. Lines are hashed, and
a rolling hash goes over the hashes of two neighbouring lines. Of any ``LINES`` neighbouring lines, the one with the least rolling hash
ends a chunk; a line of ``LONG`` words is one by itself. So all boundaries depend on a few words around them, whatever stands before: a passage falls into the same chunks
wherever it is, but for its edges. Where ``MIN_WORDS`` words hold no line's end, the run of ``SEED`` of them with the least hash counts as a chunk.

Chunks are counted by hash over the whole table. One that repeats points at its first occurrence, and so at an alignment of
the text with an earlier one. An alignment is compared byte by byte as far as it can reach: to the next chunk that doesn't repeat,
or whose first occurrence comes after where the alignment puts it, for the earlier text can't hold such a chunk there. Equal
stretches that touch are one passage. It goes if it has at least ``MIN_WORDS`` words; its first occurrence stays.

Texts travel compressed; only chunk hashes are shuffled for all documents. Joins on an origin or
a hash that most documents share have one row on the other side, so adaptive plans split them.

Defined results: a null text stays null and an empty one empty, with counts of 0. Of equal rows, as of equal passages, the first read keeps
its text: ties in nothing else can arise. An empty table gives no rows. Very long texts are hashed whole, and compared only
where they are aligned. All columns come back as they were; a column that clashes with one that is added keeps its name, and the
added one gets an underscore.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, free_name, lean, numbered, query, table
from veilwork.session import discard, shared_dir

MIN_WORDS = 20  # of a passage that goes
SEED_WORDS = 6  # of a chunk that is counted
SEED = 8  # words of a run that counts where lines have no end
WINDOW = MIN_WORDS - SEED + 1  # runs of words of which one counts
LONG = 12  # words of a line that is a chunk by itself
LINES = 2  # neighbouring lines of which one ends a chunk
APART = 3  # words before an end without another one
MARGIN = 64  # words beyond an alignment's outer chunks that may still be equal
TOUCH = 8  # words of an equal stretch that counts
SLICE = 1 << 18  # bytes of texts that are hashed at a time
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MARK = np.array([chr(i) in ".!?,;:" for i in range(256)])
_LETTER = np.random.default_rng(42).integers(1, 1 << 63, 256, np.uint64)
_BLANK = np.array([chr(i).isascii() and chr(i).isspace() for i in range(256)])
_WIDE_BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
# one context for a worker: each new one takes as long as a text
_expand = zstandard.ZstdDecompressor().decompress
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, ``size`` at least."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(size, SLICE + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words_at(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, as ``str.split`` has them, of UTF-8 texts that begin at ``begins``."""
    blank = _BLANK[data]
    if len(data) and data.max() >= 0xC2:
        raw = data.tobytes()
        for wide in _WIDE_BLANKS:
            at = raw.find(wide)
            while at >= 0:
                blank[at : at + len(wide)] = True
                at = raw.find(wide, at + len(wide))
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = blank[:-1]
    new[begins] = True
    last = np.ones(len(data), bool)
    last[:-1] = blank[1:]
    last[begins[(begins > 0)] - 1] = True
    return np.flatnonzero(~blank & new[:-1]), np.flatnonzero(~blank & last) + 1


def _spread(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over each ``size`` neighbours."""
    width, got = 1, values
    while 2 * width <= size:
        got, width = pick(got[:-width], got[width:]), 2 * width
    rest = size - width
    return pick(got[: len(got) - rest], got[rest:]) if rest else got


def _chosen(values: np.ndarray, size: int, free: np.ndarray) -> np.ndarray:
    """Which values are the least of some ``size`` neighbours that are ``free``, given where the neighbours begin."""
    least = np.where(free, _spread(values, size, np.minimum), 0)
    around = np.zeros(size - 1, np.uint64)
    return (_spread(np.concatenate([around, least, around]), size, np.maximum) == values) & (values > 0)


def _mixed(values: np.ndarray) -> np.ndarray:
    for shift in (33, 29):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(_BASE)
    return values ^ (values >> np.uint64(32))


def marks(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and hash of each chunk that counts, of the texts in ``data`` that begin at ``begins``."""
    starts, ends = words_at(data, begins[begins < len(data)])
    if len(starts) < SEED_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.searchsorted(begins, starts, "right") - 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])

    def hashed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (sums[ends[last]] - sums[starts[first]]) * inverse[starts[first]]

    stop = _MARK[data[ends - 1]]
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    stop[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    close = np.zeros(len(stop), bool)
    for back in range(1, APART + 1):
        close[back:] |= stop[:-back] & (text[back:] == text[:-back])
    stop &= ~close
    stop[:-1] |= text[1:] != text[:-1]
    stop[-1] = True

    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    own = hashed(first, last)
    of = text[last]
    rolled = own.copy()
    rolled[1:] += np.where(of[1:] == of[:-1], own[:-1], 0) * np.uint64(_BASE)
    cut = np.ones(len(last), bool)
    cut[:-1] = of[1:] != of[:-1]
    if len(last) >= LINES:
        cut |= _chosen(_mixed(rolled), LINES, of[: 1 - LINES] == of[LINES - 1 :])
    long = last - first >= LONG - 1
    cut |= long
    cut[:-1] |= long[1:]
    end = np.flatnonzero(cut)
    first, last = first[np.concatenate([[0], end[:-1] + 1])], last[end]
    counted = last - first >= SEED_WORDS - 1
    first, last = first[counted], last[counted]
    hashes = hashed(first, last)

    if len(starts) >= MIN_WORDS:
        before = np.concatenate([[0], np.cumsum(stop)])
        free = before[MIN_WORDS - 1 : -1] - before[: -MIN_WORDS] == 0
        run = np.arange(len(starts) - SEED + 1)
        runs_of = _mixed(hashed(run, run + SEED - 1) + np.uint64(1))
        chosen = np.flatnonzero(_chosen(runs_of, WINDOW, free))
        # of neighbours with one hash the first two and the last count
        same = (runs_of[chosen[1:]] == runs_of[chosen[:-1]]) & (text[chosen[1:]] == text[chosen[:-1]])
        inner = np.concatenate([[False], same]) & np.concatenate([[False, False], same])[: len(chosen)] & np.concatenate([same, [False]])
        chosen = chosen[~inner[: len(chosen)]]
        first, hashes = np.concatenate([first, chosen]), np.concatenate([hashes, runs_of[chosen]])
        order = np.argsort(first, kind="stable")
        first, hashes = first[order], hashes[order]
    return text[first], starts[first] - begins[text[first]], _mixed(hashes)


def chunks(text: str) -> list[tuple[int, int]]:
    """Start and end of each piece between chunks that count; together they cover the text. A blank text has none."""
    if not text or text.isspace():
        return []
    raw = text.encode()
    _, at, _ = marks(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
    cuts = sorted({0, len(text), *(len(raw[:a].decode()) for a in at.tolist())})
    return list(zip(cuts, cuts[1:]))


def chunk_hashes(rows: DataFrame) -> DataFrame:
    """``row, n, at, hash`` of every chunk of ``rows`` that counts (``row``, ``text``): n counts a text's, at is in bytes."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, places, content = texts.buffers()
            places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(content, np.uint8) if content and content.size else np.zeros(0, np.uint8)
            number = batch.column(0).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(places, places[i] + SLICE, "right")) - 1)
                text, at, digest = marks(data[places[i] : places[j]], places[i:j] - places[i])
                n = np.arange(len(text)) - np.searchsorted(text, text)
                columns = [number[i:j][text], n.astype(np.int32), at.astype(np.int32), digest.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "n", "at", "hash"])
                i = j

    return rows.mapInArrow(work, "row bigint, n int, at int, hash bigint")


def reaches(listed: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``from_row, from_first, from_last, shift`` of each alignment that repeated chunks (``n, at, from_row, from_at``) point at.

    A text's place ``x`` is aligned with ``x - shift`` of the earlier one; first and last are the outer chunks there.
    """
    out = []
    covered: dict[tuple[int, int], int] = {}
    for i, (_, at, from_row, from_at) in enumerate(listed):
        shift = at - from_at
        if covered.get((from_row, shift), -1) >= i:
            continue
        ends = [i, i]
        for side, step in ((0, -1), (1, 1)):
            k = i + step
            while 0 <= k < len(listed):
                n, at, row, own = listed[k]
                if n - listed[k - step][0] != step or at < shift or (row, own) > (from_row, at - shift):
                    break
                ends[side] = k
                k += step
        covered[from_row, shift] = ends[1]
        out.append((from_row, listed[ends[0]][1] - shift, listed[ends[1]][1] - shift, shift))
    return out


def runs(found: DataFrame) -> DataFrame:
    """``row, from_row, from_first, from_last, shift``: the alignments of each row of ``found`` (``row, n, at, from_row, from_at``)."""
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "at", "from_row", "from_at"))).alias("all"))
    names = ["row", "from_row", "from_first", "from_last", "shift"]

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (row, *x)
                for row, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for x in reaches([(s["n"], s["at"], s["from_row"], s["from_at"]) for s in listed])
            ]
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return by_row.mapInArrow(work, ", ".join(f"{n} bigint" for n in names))


def passages(text: str, origins: list[dict], row: int) -> list[tuple[int, int]]:
    """Places to remove, in order and apart. origins: ``body``, a stretch of ``from_row`` aligned with the byte ``first``."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words_at(data, np.zeros(1, np.int64) if raw else np.zeros(0, np.int64))
    found = []
    for o in origins:
        body = o["body"] if isinstance(o["body"], bytes) else o["body"].encode()
        if o.get("packed"):
            body = _expand(body)
        first = max(0, o["first"])
        other = np.frombuffer(body, np.uint8)[first - o["first"] :]
        size = min(len(other), len(data) - first)
        if size <= 0:
            continue
        apart = np.concatenate([[-1], np.flatnonzero(data[first : first + size] != other[:size]), [size]])
        for k in np.flatnonzero(np.diff(apart) >= 2 * TOUCH).tolist():
            a = int(np.searchsorted(starts, first + apart[k] + 1))
            b = int(np.searchsorted(ends, first + apart[k + 1], "right"))
            if o["from_row"] == row and a < b and ends[b - 1] - o["shift"] > starts[a]:
                a += MIN_WORDS  # a text repeating itself at once: what the passages begin with stays
            if b - a >= TOUCH:
                found.append((a, b))
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    places = [(int(starts[a]), int(ends[b - 1])) for a, b in merged if b - a >= MIN_WORDS]
    return places if len(raw) == len(text) else [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in places]


def without(text: str, places: list[tuple[int, int]]) -> str:
    """``text`` less the places; what stood around one is parted by a line break if it held one, else by a blank."""
    if not places:
        return text
    out, at = [], 0
    for a, b in places:
        out += [text[at:a].rstrip(), "\n" if "\n" in text[a:b] else " "]
        at = b + len(text[b:]) - len(text[b:].lstrip())
    return "".join([*out, text[at:]]).strip()


def _name_of(docs: DataFrame, column: str) -> str:
    """The column's name as ``docs`` spells it."""
    return next(c for c in docs.columns if c.lower() == column)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, texts without repeated passages, and ``words``, ``lost_words`` and ``lost_passages``.

    Words are those of the original text. See the module for edge cases. ``docs`` must be a scan or a checkpointed frame.
    """
    spark = docs.sparkSession
    name = _name_of(docs, "text")
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    lean = rows.select(F.col(row).alias("row"), F.col(f"`{name}`").cast("string").alias("text"))
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    chunk_hashes(lean).write.parquet(f"{folder}/hashes")
    hashed = spark.read.parquet(f"{folder}/hashes")
    firsts = hashed.groupBy("hash").agg(F.min("row").alias("from_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = checkpointed(hashed.join(firsts, "hash"))
    discard(spark, folder)
    origin = repeated.where("row = from_row").groupBy("hash").agg(F.min("at").alias("from_at"))
    later = repeated.join(origin, "hash").where("row <> from_row or at <> from_at")
    cuts = checkpointed(runs(later.select("row", "n", "at", "from_row", "from_at")))

    outer = cuts.select("from_row", "from_first", "from_last").distinct()
    wanted = outer.groupBy(F.col("from_row").alias("row")).agg(F.collect_list(F.struct("from_first", "from_last")).alias("wanted"))
    at = docs.columns.index(name)
    kinds = [("binary" if i == at else f.dataType.simpleString(), f.name) for i, f in enumerate(docs.schema)]
    packed = rows.mapInArrow(_pack(at), ", ".join(f"`{n}` {k}" for k, n in [*kinds, ("bigint", row)]))
    # both joins below take the whole rows, filtered alike, so that they are packed and shuffled once
    packed = packed.where(F.col(f"`{row}`").isNotNull())
    wanted_name = free_name(rows, "wanted")
    fetched = packed.join(wanted.toDF(row, wanted_name), row).select(*[F.col(f"`{c}`") for c in [*rows.columns, wanted_name]]).mapInArrow(
        _fetch(at, len(docs.columns)), "from_row bigint, from_first bigint, from_last bigint, begin bigint, body binary"
    )
    origins = (
        cuts.join(fetched, ["from_row", "from_first", "from_last"])
        .groupBy(F.col("row").alias(row))
        .agg(F.collect_list(F.struct("from_row", "shift", (F.col("begin") + F.col("shift")).alias("first"), "body", F.lit(True).alias("packed"))).alias("origins"))
    )
    origin_name = free_name(rows, "origins")
    both = packed.join(origins.withColumnRenamed("origins", origin_name), row, "left")
    ordered = both.select(*[F.col(f"`{c}`") for c in [*rows.columns, origin_name]])
    kept = [f"`{f.name}` {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
    added = count_names(docs)
    return ordered.mapInArrow(_cut(at, len(docs.columns), added), ", ".join([*kept, *(f"`{c}` bigint" for c in added)]))


def count_names(docs: DataFrame) -> list[str]:
    """What ``drop_repeats`` calls the counts it adds to ``docs``."""
    return [free_name(docs, c) for c in ("words", "lost_words", "lost_passages")]


def _pack(at: int):
    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=2).compress
        for batch in batches:
            texts = pa.array([None if t is None else shrink(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            columns = [texts if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return work


def _raw(data: bytes) -> bytes:
    return _expand(data)


def _unpacked(data: bytes | None) -> str | None:
    return None if data is None else _raw(data).decode()


def _fetch(at: int, width: int):
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["from_row", "from_first", "from_last", "begin", "body"]

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=2).compress
        for batch in batches:
            out = []
            for row, data, wanted in zip(*(batch.column(i).to_pylist() for i in (width, at, width + 1))):
                raw = _raw(data)
                starts, ends = words_at(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
                for w in wanted:
                    a = starts[max(0, np.searchsorted(starts, w["from_first"]) - MARGIN)]
                    b = ends[min(len(ends) - 1, np.searchsorted(starts, w["from_last"]) + MARGIN)]
                    out.append((row, w["from_first"], w["from_last"], int(a), shrink(raw[a:b])))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return work


def _cut(at: int, width: int, added: list[str]):
    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            rows, origins = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            for row, data, origin in zip(rows, batch.column(at).to_pylist(), origins):
                text = _unpacked(data)
                places = passages(text, origin, row) if origin else []
                texts.append(text if text is None else without(text, places))
                counts.append((len((text or "").split()), sum(len(text[a:b].split()) for a, b in places), len(places)))
            numbers = np.array(counts, np.int64).reshape(-1, 3).T
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, numbers)],
                names=[*batch.schema.names[:width], *added],
            )

    return work


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``drop_repeats``; rows that lose all of their words go, all columns stay."""
    words, lost, _ = (F.col(c) for c in count_names(docs))
    return drop_repeats(docs).where(lost < F.greatest(words, F.lit(1))).select(*[F.col(f"`{c}`") for c in docs.columns])


@query()
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs)
