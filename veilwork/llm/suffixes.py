"""Byte runs that an earlier document has, by sorted suffixes.

A string of ``LENGTH`` bytes goes wherever a document with a smaller id has it too. The strings are the suffixes of the texts, read to
that depth, and equal ones come to stand side by side when suffixes are sorted. Sorting is deep-shallow: a multikey quicksort splits
suffixes by eight bytes at a time to a shallow depth, which tells most of them apart; what is still tied has a long common prefix and
goes to blind tries, which look at a suffix only where it leaves its trie's spine.

Not all suffixes of a corpus can be sorted, nor need be. Of the ``STARTS`` runs of ``GRAM`` bytes in a string, the one with the least hash
(the first of equal ones) is its anchor: equal strings have equal anchors at the same place. The strings of one anchor lie side by
side in the text; together they are its stretch.

1. Equal texts are one text, with its least document; a later copy loses all.
2. Each text hands on the hashes of its anchors. Texts that meet in one batch know a common hash at once; only one
   row a batch and hash travels to learn of the others. Hashes that only one text has end here.
3. The stretches of anchors that several texts have are cut out. Equal ones count as one, with its least document.
4. Stretches of one anchor hash meet, and their suffixes are sorted: a string's least document is that of its class.
   An anchor hash with more than ``GROUP`` different stretches is not gathered: its strings are grouped one by one.
5. An occurrence of a stretch loses all strings if its document isn't the least, else those of a smaller class.

Every decision is about bytes; hashes only say what is compared, and name a text (SHA-256; 48 bits in step 2, where two texts of one name
would miss what nobody else has) and a stretch (112 bits) on its way back. Texts travel compressed.

Defined results: a null text is empty and loses nothing, as does one of fewer than ``LENGTH`` bytes. A null id counts as the largest long,
and documents with one id (repeated rows) aren't earlier than each other, so both keep what neither has from elsewhere. Repeats
inside a document stay. Overlapping strings go together. Cuts fall on bytes, so what is left needn't be UTF-8. An
empty table gives no rows, and columns besides the id and the text are not read. A very long text is hashed piece by piece and is
otherwise as any other. ``docs`` must be a scan or a checkpointed frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, free_finished, numbered, query, table
from veilwork.session import discard, shared_dir

LENGTH = 50  # bytes of a string that counts
GRAM = 16  # bytes of an anchor
STARTS = LENGTH - GRAM + 1  # of anchors in a string; a stretch has no more strings than that
SHALLOW = 16  # bytes that the quicksort reads
GROUP = 20_000  # different stretches of one anchor hash that are sorted together, some 1.5 MB
PLACES = 20  # bits for a place in a piece
PIECE = 1 << PLACES
BLOCK = 2 << 20  # bytes of stretches sorted at a time
_NAME = np.uint64((1 << 48) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(PIECE, _BASE)]))
_INVERSES = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))


# ------------------------------------------------------------------ sorting


def _tied(active: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Places that aren't alone between two heads."""
    alone = new & np.append(new[1:], True)
    return active[~alone]


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``data`` at ``starts``, read to ``length`` bytes, and whether each differs from the one before it.

    All of them must reach that far, and ``length`` must be ``shallow`` or more.
    """
    order = np.arange(len(starts))
    fresh = np.zeros(len(starts), bool)
    fresh[:1] = True
    active = order.copy()
    if not len(starts):
        return order, fresh
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    # shallow: whole segments are split by their next eight bytes
    for depth in range(0, shallow, 8):
        if not len(active):
            break
        inside = order[active]
        segment = np.cumsum(fresh)[active]
        keys = words[starts[inside] + depth].astype(np.uint64)
        by = np.lexsort((keys, segment)) if depth else np.argsort(keys, kind="stable")
        order[active], keys = inside[by], keys[by]
        new = np.ones(len(active), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (segment[1:] != segment[:-1])
        fresh[active] |= new
        active = _tied(active, new)
    # deep: blind tries
    while len(active):
        inside = order[active]
        segment = np.cumsum(fresh)[active]
        head = np.maximum.accumulate(np.where(fresh[active], np.arange(len(active)), 0))
        keys = _leaves(data, starts[inside], starts[inside[head]], shallow, length)
        by = np.lexsort((keys, segment))
        order[active], keys = inside[by], keys[by]
        new = np.ones(len(active), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (segment[1:] != segment[:-1])
        fresh[active] |= new
        # what goes along the whole spine is equal
        whole = keys == _ALONG
        active = _tied(active[~whole], new[~whole])
    return order, fresh


_ALONG = 1 << 32


def _leaves(data: np.ndarray, members: np.ndarray, spines: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Sort keys: by the depth and the byte at which a suffix leaves the spine of its trie; ``_ALONG`` if it doesn't.

    What leaves below the spine comes first, the shallower the earlier; what leaves above it comes last, the shallower the later.
    """
    out = np.full(len(members), _ALONG, np.int64)
    reach = np.arange(begin, end)
    step = max(1, BLOCK // max(1, end - begin))
    for at in range(0, len(members), step):
        own = data[members[at : at + step, None] + reach]
        spine = data[spines[at : at + step, None] + reach]
        apart = own != spine
        depth = apart.argmax(axis=1)
        row = np.arange(len(depth))
        byte = own[row, depth].astype(np.int64)
        below = byte < spine[row, depth]
        key = np.where(below, depth * 256 + byte, 2 * _ALONG - depth * 256 + byte)
        out[at : at + step] = np.where(apart[row, depth], key, _ALONG)
    return out


def least_of_classes(data: np.ndarray, starts: np.ndarray, values: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per suffix the least of ``values`` among all that are equal to it."""
    order, fresh = deep_shallow_sort(data, starts, length)
    heads = np.flatnonzero(fresh)
    if not len(heads):
        return values
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], heads), np.diff(np.append(heads, len(order))))
    return out


# ------------------------------------------------------------------ anchors


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the text, first and last string and hash of each stretch of texts in a piece of ``data``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _POWERS[: len(data)], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * _INVERSES[: len(data) - GRAM + 1]
    for shift in (33, 29):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * _BASE
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes >> np.uint64(PLACES) << np.uint64(PLACES)) | places
    width = 1
    while 2 * width <= STARTS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < STARTS:
        least = np.minimum(least[: len(least) - (STARTS - width)], least[STARTS - width :])
    at = (least & np.uint64(PIECE - 1)).astype(np.int64)
    text = np.searchsorted(begins, np.arange(len(at)), "right") - 1
    inside = np.flatnonzero((text >= 0) & (np.arange(len(at)) + LENGTH <= ends[text]))
    if not len(inside):
        return none
    at, text = at[inside], text[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    names = (hashes[at[first]] & _NAME).astype(np.int64)
    return text[first], inside[first], inside[last], names


def pieces(places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts ``i`` to ``j`` and bytes of them, at most ``PIECE``: whole texts, or overlapping parts of a long one."""
    i, n = 0, len(places) - 1
    while i < n:
        if places[i + 1] - places[i] > PIECE:
            for at in range(int(places[i]), int(places[i + 1]) - LENGTH + 1, PIECE - LENGTH + 1):
                yield i, i + 1, at, min(at + PIECE, int(places[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(places, places[i] + PIECE, "right")) - 1)
        yield i, j, int(places[i]), int(places[j])
        i = j


def stretches(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of all texts, which lie at ``places`` in ``data``, with places in ``data``."""
    for i, j, begin, end in pieces(places):
        bounds = np.clip(places[i : j + 1], begin, end) - begin
        text, first, last, names = anchors(data[begin:end], bounds[:-1], bounds[1:])
        yield text + i, first + begin, last + begin, names


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.cast(pa.large_binary())
    _, places, content = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(content, np.uint8) if content and content.size else np.zeros(0, np.uint8), places


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place, name, number``: see ``common_names``."""
    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        data, places = _bytes_of(batch.column(1))
        found = [(names, number[text]) for text, _, _, names in stretches(data, places)]
        if not found:
            continue
        names, numbers = _distinct(*(np.concatenate(x) for x in zip(*found)))
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        several = ~(new & np.append(new[1:], True))
        # one row for each hash, below zero if it has its answer
        yield _batch(names[new], None, np.where(several[new], -1 - numbers[new], numbers[new]))
        if several.any():
            names, numbers = names[several], numbers[several]
            mixed = ((numbers.astype(np.uint64) ^ (names.astype(np.uint64) << np.uint64(13))) * _BASE >> np.uint64(1)).astype(np.int64)
            yield _batch(mixed, names, numbers)


def _distinct(names: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((numbers, names))
    names, numbers = names[by], numbers[by]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])
    return names[new], numbers[new]


def _batch(place: np.ndarray, name: np.ndarray | None, number: np.ndarray) -> pa.RecordBatch:
    names = pa.nulls(len(place), pa.int64()) if name is None else pa.array(name)
    return pa.RecordBatch.from_arrays([pa.array(place), names, pa.array(number)], names=["place", "name", "number"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place and number: those with a name pass, of the others those whose place another number has."""
    held, first, known = None, None, False  # the last place, its only number so far, whether there are more
    for batch in batches:
        place = batch.column(0).to_numpy(zero_copy_only=False)
        number = batch.column(2).to_numpy(zero_copy_only=False)
        asks = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        passed = batch.filter(pa.array(~asks))
        numbers, names = [passed.column(2).to_numpy(zero_copy_only=False)], [passed.column(1).to_numpy(zero_copy_only=False).astype(np.int64)]
        place, number = place[asks], number[asks]
        if len(place):
            again = place[0] == held
            if again and first is not None:
                place, number = np.append(held, place), np.append(first, number)
            new = np.ones(len(place), bool)  # copies of a text in other batches are the same number
            new[1:] = (place[1:] != place[:-1]) | (number[1:] != number[:-1])
            place, number = place[new], number[new]
            head = np.ones(len(place), bool)
            head[1:] = place[1:] != place[:-1]
            heads = np.flatnonzero(head)
            sizes = np.diff(np.append(heads, len(place)))
            answered = (sizes > 1) | (number[heads] < 0)
            answered[0] |= again and known
            good = np.repeat(answered, sizes) & (number >= 0)
            numbers.append(number[good])
            names.append(place[good])
            held, known = place[-1], bool(answered[-1])
            first = None if known else number[-1]
        columns = [np.concatenate(numbers).astype(np.int64), np.concatenate(names).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "name"])


def common_names(texts: DataFrame) -> DataFrame:
    """``number, names``: for each number of ``texts`` (``number``, ``text``) the hashes of its anchors that others have too.

    In a batch, texts that share a hash know it. They go to any place, and one row per hash goes to the hash's place, where it
    meets those of other batches. So a hash that a third of all texts have sends one row a batch there.
    """
    asked = texts.mapInArrow(_anchored, "place bigint, name bigint, number bigint")
    met = asked.repartition("place").sortWithinPartitions("place", "number").mapInArrow(_answered, "number bigint, name bigint")
    return met.groupBy("number").agg(F.collect_set("name").alias("names"))


# ------------------------------------------------------------------ stretches


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shrink = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([None if t is None else shrink(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "packed"])


def _unpacked(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``name, stretch, row, doc, first`` of each stretch whose anchor is among the names of its text."""
    for batch in batches:
        number, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        raws = [_unpacked(p) for p in batch.column(2).to_pylist()]
        joined = b"".join(raws)
        places = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        names = batch.column(3)
        sizes = names.value_lengths().to_numpy(zero_copy_only=False)
        wanted = np.sort(_pairs(np.repeat(np.arange(len(raws)), sizes), names.flatten().to_numpy(zero_copy_only=False)))
        if not len(wanted):
            continue
        for text, first, last, name in stretches(np.frombuffer(joined, np.uint8), places):
            pair = _pairs(text, name)
            good = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
            text, first, last, name = text[good], first[good], last[good], name[good]
            cut = pa.array([joined[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())], pa.binary())
            columns = [pa.array(name), cut, pa.array(number[text]), pa.array(doc[text]), pa.array(first - places[text])]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "stretch", "row", "doc", "first"])


def _pairs(text: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One number for a text of a batch and a hash; two pairs that share one only make for needless comparisons."""
    return (name.astype(np.uint64) + text.astype(np.uint64) * np.uint64(1 << 48 | 1)) * _BASE


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``name, key, least, strings, smaller``: bits of the strings of a stretch that a smaller document has in another one."""
    names = ["name", "key", "least", "strings", "smaller"]
    for batch in batches:
        held = batch.column(1)
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        name = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
        members = held.flatten()
        data, places = _bytes_of(members.field("stretch"))
        key, least, n = (members.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("key", "least", "n"))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(places[cuts], places[cuts[i]] + BLOCK, "right")) - 1)
            a, b = cuts[i], cuts[j]
            smaller = smaller_strings(data[places[a] : places[b]], places[a : b + 1] - places[a], least[a:b])
            strings = np.diff(places[a : b + 1]) - LENGTH + 1
            useful = (smaller != 0) | (n[a:b] > 1)
            columns = [name[a:b], key[a:b], least[a:b], strings, smaller]
            yield pa.RecordBatch.from_arrays([pa.array(c[useful]) for c in columns], names=names)
            i = j


def smaller_strings(data: np.ndarray, places: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per stretch of ``data``, the bits of its strings that one with a smaller ``least`` has too."""
    counts = np.diff(places) - LENGTH + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = least[owner]
    hit = least_of_classes(data, places[owner] + at, own) < own
    out = np.zeros(len(counts), np.int64)
    np.add.at(out, owner[hit], np.int64(1) << at[hit])
    return out


def smaller_one_by_one(distinct: DataFrame) -> DataFrame:
    """What ``_sorted_groups`` returns, without any group: each string is a row."""
    whole = ["name", "key", "least", "n", (F.octet_length("stretch") - LENGTH + 1).cast("bigint").alias("strings")]
    strings = distinct.select(
        *whole, "stretch", F.explode(F.expr(f"sequence(0, octet_length(stretch) - {LENGTH})")).alias("at")
    ).select("name", "key", "least", "n", "strings", "at", F.expr(f"substring(stretch, at + 1, {LENGTH})").alias("string"))
    first = strings.groupBy("string").agg(F.min("least").alias("first"))
    hit = F.when(F.col("first") < F.col("least"), F.expr("shiftleft(1L, at)")).otherwise(F.lit(0))
    found = strings.join(first, "string").groupBy("name", "key", "least", "n", "strings").agg(F.bit_or(hit).alias("smaller"))
    return found.where("smaller <> 0 or n > 1").drop("n")


def repeated_strings(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """``row, found``: of each row of ``texts`` (``row, doc, packed, names``) the first string of a stretch and the bits of those that go."""
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        free_finished(spark)
        return back

    every = written(
        texts.select("row", "doc", "packed", "names").mapInArrow(
            _cut_out, "name bigint, stretch binary, row bigint, doc bigint, first bigint"
        ),
        "all",
    )
    distinct = written(every.groupBy("name", "stretch").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    large = written(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > group).select("name"), "large")
    key = F.xxhash64("stretch").alias("key")
    distinct = distinct.select("name", key, "stretch", "least", "n")
    together = (
        distinct.join(large, "name", "left_anti")
        .groupBy("name")
        .agg(F.collect_list(F.struct("stretch", "key", "least", "n")).alias("members"))
        .mapInArrow(_sorted_groups, "name bigint, key bigint, least bigint, strings bigint, smaller bigint")
    )
    verdicts = together.unionByName(smaller_one_by_one(distinct.join(large, "name", "left_semi")))
    bits = F.when(F.col("doc") > F.col("least"), F.expr("shiftleft(1L, cast(strings AS int)) - 1")).otherwise(F.col("smaller"))
    found = (
        every.select("name", key, "row", "doc", F.col("first").cast("int").alias("first"))
        .join(verdicts, ["name", "key"])
        .select("row", F.col("first").cast("bigint").alias("first"), bits.alias("bits"))
        .where("bits <> 0")
    )
    found = checkpointed(found.groupBy("row").agg(F.collect_list(F.struct("first", "bits")).alias("found")))
    discard(spark, folder)
    free_finished(spark)
    return found


def spans_of(first: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the strings cover."""
    on = np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    begins = np.unique(first[on // 64] + on % 64)
    if not len(begins):
        return begins, begins
    apart = np.flatnonzero(begins[1:] > begins[:-1] + LENGTH)
    return begins[np.concatenate([[0], apart + 1])], begins[np.append(apart, len(begins) - 1)] + LENGTH


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, spans, kept = [], [], []
        for packed, copied, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            raw = _unpacked(packed)
            sizes.append(len(raw))
            begins, ends = [], []
            if copied and len(raw) >= LENGTH:
                begins, ends = [0], [len(raw)]
            elif found.is_valid and not copied:
                first, bits = (found.values.field(f).to_numpy(zero_copy_only=False) for f in ("first", "bits"))
                begins, ends = (x.tolist() for x in spans_of(first, bits))
            spans.append([{"begin": a, "end": b} for a, b in zip(begins, ends)])
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row of ``docs`` (``doc_id`` a long, ``text``): places in bytes, and the bytes left.

    See the module for edge cases.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = numbered(docs.select(F.col("doc_id").cast("bigint"), text.alias("text")), "row")
    number = F.xxhash64("text").bitwiseAND(int(_NAME)).alias("number")
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc")
    marked = checkpointed(rows.select("row", "doc_id", doc, number, F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = marked.groupBy("digest", "number").agg(F.min("row").alias("head"), F.min("doc").alias("least"))
    packed = rows.select("row", "text").mapInArrow(_pack, "row bigint, packed binary")

    names = common_names(rows.select(number, "text"))
    wanted = firsts.join(names, "number").select(F.col("head").alias("row"), F.col("least").alias("doc"), "names")
    found = repeated_strings(packed.join(wanted, "row"), group)

    same = marked.join(firsts.drop("number"), "digest").select("row", "doc_id", "head", (F.col("doc") > F.col("least")).alias("copied"))
    of_row = same.join(found.withColumnRenamed("row", "head"), "head", "left").select(
        "row", "doc_id", "copied", F.when(~F.col("copied"), F.col("found")).alias("found")
    )
    return (
        packed.join(of_row, "row")
        .select("doc_id", "packed", "copied", "found")
        .mapInArrow(_without, "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")
    )


@query()
def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
