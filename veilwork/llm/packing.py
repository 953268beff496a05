"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

A genome is a partition of pieces into sequences. Crossover injects whole well-filled
sequences of one parent into the other, removes the sequences of the other that share a
piece with them, and puts the displaced pieces back by best fit. Every block of pieces is
evolved on several islands; between epochs the best genome of an island moves to the next
one of its block, by a join on (block, island).

Blocks have a set size and take pieces by hash, so more pieces mean more blocks and not
larger ones. Sequences that a block could not fill well are opened again: their pieces
meet those of all other blocks in the next round, until one block holds what is left or a
round no longer halves it.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, give_back, lean, numbered, query, table

LIMIT = 2048
BLOCK = 2000  # pieces of a block, in the mean
ISLANDS = 3
EPOCHS = 3
POPULATION = 5
CHILDREN = 6  # an epoch and island
WELL = 0.99  # of the limit: such a sequence is closed
SEED = 11
CACHE = 1_500_000  # characters of words, and of their parts, whose ids a process keeps
END = b"\0\0\0\0"


# Letters that have one code point each; with ASCII punctuation behind them they make a plain word.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def byte_signs() -> dict[int, int]:
    """Signs that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + n for n, b in enumerate(others)}


class Recent:
    """Ids of words met lately. ``now`` holds up to a bound of characters, then it becomes ``before`` and starts anew."""

    def __init__(self, bound: int) -> None:
        self.bound, self.held = bound, 0
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def make_room(self) -> None:
        if self.held > self.bound:
            self.now, self.before, self.held = {}, self.now, 0


class WordIds:
    """Token ids as little-endian bytes. The tokenizer drops white space, so words between blanks encode alone.

    Plain words go to the vocabulary's merges directly, lower-cased and byte for sign as the tokenizer
    does it, and their punctuation is encoded apart; all others through the whole tokenizer. Words and parts are
    remembered up to a bound, and parts for longer, as they cost more.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge, self.signs = self.tokenizer.model.tokenize, byte_signs()
        self.binary = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        self.words, self.parts = Recent(CACHE // 12), Recent(5 * CACHE // 12)

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False))

    def _part(self, part: str, letters: bool) -> bytes:
        """Ids of lower-cased letters, or of punctuation."""
        ids = self.parts.before.get(part)
        if ids is None:
            if letters:
                signs = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
                binary = self.binary
                ids = b"".join([binary[t.id] for t in self.merge(signs)])
            else:
                ids = next(self._whole([part]))
        self.parts.now[part] = ids
        self.parts.held += len(part)
        return ids

    def _learn(self, words: set[str]) -> None:
        odd = []
        now, before, parts = self.words.now, self.words.before.get, self.parts.now.get
        for word in words:
            ids = before(word)
            if ids is None:
                letters = word.rstrip(punctuation)
                if not (letters.isascii() and letters.isalpha()) and not _LATIN.fullmatch(letters):
                    odd.append(word)
                    continue
                low, tail = letters.lower(), word[len(letters) :]
                ids = b""
                if low:
                    ids = parts(low)
                    if ids is None:
                        ids = self._part(low, True)
                if tail:
                    own = parts(tail)
                    ids += self._part(tail, False) if own is None else own
            now[word] = ids
        now.update(zip(odd, self._whole(odd)))

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        self.words.make_room()
        self.parts.make_room()
        new = set(words).difference(self.words.now)
        if new:
            self.words.held += sum(map(len, new))
            self._learn(new)
        return b"".join(map(self.words.now.__getitem__, words))


_encoders: dict[int, WordIds] = {}  # of this process, so that tasks share what it has learned


def encoder(tokenizer_json: str) -> WordIds:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordIds(tokenizer_json)
    return _encoders[key]


def forget_words() -> None:
    """Give up this process's encoder: it would be kept through all later work of the worker."""
    if _encoders:
        _encoders.clear()
        give_back()


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` per piece of at most ``limit`` ids; an id 0 ends each document."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()  # a vocabulary of fixed size, shipped with the task

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + END
                for n, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# Genomes: group[i] is the sequence of piece i; sequences are numbered from 0 without gaps.


def best_fit(lengths: np.ndarray, order: np.ndarray, group: np.ndarray, fills: list[int], limit: int) -> np.ndarray:
    """Put the pieces of ``order`` each where least room stays; ``group`` is -1 for them on entry."""
    rooms = sorted((limit - f, g) for g, f in enumerate(fills) if f < limit)
    n = len(fills)
    sizes = lengths.tolist()
    for i in order.tolist():
        size = sizes[i]
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, g = rooms.pop(at)
        else:
            room, g = limit, n
            n += 1
        group[i] = g
        if room > size:
            bisect.insort(rooms, (room - size, g))
    return group


def fresh(lengths: np.ndarray, limit: int, rng: np.random.Generator, jitter: float) -> np.ndarray:
    order = np.argsort(-lengths * (1 + jitter * rng.standard_normal(len(lengths))), kind="stable")
    return best_fit(lengths, order, np.full(len(lengths), -1), [], limit)


def fitness(lengths: np.ndarray, group: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer sequences first, then the more uneven: full ones beside one that is nearly empty."""
    fills = np.bincount(group, lengths)
    return -len(fills), float(np.square(fills / limit).mean()) if len(fills) else 1.0


def crossover(lengths: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(two, lengths)
    ranked = np.argsort(-fills, kind="stable")
    injected = ranked[: max(1, len(ranked) // 3)]
    injected = injected[rng.random(len(injected)) < 0.5]
    chosen = np.zeros(len(fills), bool)
    chosen[injected] = True
    taken = chosen[two]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[taken]] = True
    # a mutation besides: the emptiest sequences of the receiver are opened too
    own = np.bincount(one, lengths)
    broken[np.argsort(own, kind="stable")[: max(1, len(own) // 50)]] = True
    stays = ~taken & ~broken[one]
    child = np.full(len(lengths), -1)
    _, child[stays] = np.unique(one[stays], return_inverse=True)
    base = int(child.max(initial=-1)) + 1
    _, places = np.unique(two[taken], return_inverse=True)
    child[taken] = base + places
    placed = child >= 0
    fills = np.bincount(child[placed], lengths[placed]).astype(int).tolist()
    loose = np.flatnonzero(~placed)
    return best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], child, fills, limit)


def evolve(lengths: np.ndarray, population: list[np.ndarray], limit: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One epoch of an island, the best genome first."""
    score = lambda g: fitness(lengths, g, limit)
    population = sorted(population, key=score, reverse=True)
    least = -(-int(lengths.sum()) // limit)
    for _ in range(CHILDREN):
        if -score(population[0])[0] <= least:
            break
        one, two = rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
        population.append(crossover(lengths, population[one], population[two], limit, rng))
        population = sorted(population, key=score, reverse=True)[:POPULATION]
    return population


_STATE = "block bigint, island int, lengths binary, population binary, elite binary, sequences int, fit double"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
    names = [c.split()[0] for c in _STATE.split(", ")]
    columns = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _sorted(found: pa.Table) -> pa.Table:
    return found.sort_by([("length", "descending"), ("item", "ascending")]).combine_chunks()


def _row(block: int, island: int, lengths: np.ndarray, population: list[np.ndarray], limit: int) -> tuple:
    count, fit = fitness(lengths, population[0], limit)
    pack = lambda a: np.asarray(a, "<i4").tobytes()
    return block, island, pack(lengths), pack(np.concatenate(population)), pack(population[0]), -count, fit


def _islands(items: DataFrame, limit: int) -> DataFrame:
    """State after the last epoch: a row per block and island."""

    def settle(key: tuple, found: pa.Table) -> pa.Table:
        forget_words()  # the pieces are made
        block, island = (k.as_py() for k in key)
        lengths = _sorted(found)["length"].to_numpy()
        rng = np.random.default_rng([SEED, block, island])
        first = [fresh(lengths, limit, rng, 0.0 if n + island == 0 else 0.02 * (n + island)) for n in range(POPULATION)]
        return pa.Table.from_batches([_rows([_row(block, island, lengths, evolve(lengths, first, limit, rng), limit)])])

    @lean
    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i4").astype(int)
                genomes = np.frombuffer(r["population"], "<i4").astype(int).reshape(-1, len(lengths))
                rng = np.random.default_rng([SEED, r["block"], r["island"], r["epoch"]])
                grown = evolve(lengths, [*genomes, np.frombuffer(r["migrant"], "<i4").astype(int)], limit, rng)
                out.append(_row(r["block"], r["island"], lengths, grown, limit))
            yield _rows(out)

    everywhere = items.select("block", "item", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = everywhere.groupBy("block", "island").applyInArrow(settle, _STATE)
    for epoch in range(1, EPOCHS):
        state = checkpointed(state)  # both sides of the join read it
        migrants = state.select(
            "block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("elite").alias("migrant")
        )
        state = (
            state.join(migrants, ["block", "island"])
            .withColumn("epoch", F.lit(epoch))
            .mapInArrow(go_on, _STATE)
        )
    return state


def _round(items: DataFrame, limit: int) -> DataFrame:
    """``items`` (``block, item, length``, ...) with ``seq`` within the block, ``place`` and ``fill`` of the sequence."""
    best = (
        _islands(items, limit)
        .groupBy("block")
        .agg(F.min_by("elite", F.struct("sequences", (-F.col("fit")).alias("worse"), "island")).alias("elite"))
    )

    def lay(found: pa.Table, chosen: pa.Table) -> pa.Table:
        found = _sorted(found)
        lengths = found["length"].to_numpy()
        seq = np.frombuffer(chosen["elite"][0].as_py(), "<i4").astype(np.int64)
        order = np.argsort(seq, kind="stable")
        ends = np.cumsum(lengths[order])
        place = np.empty(len(seq), np.int64)
        place[order] = ends - lengths[order] - np.concatenate([[0], np.cumsum(np.bincount(seq, lengths))])[seq[order]].astype(np.int64)
        fill = np.bincount(seq, lengths).astype(np.int64)[seq]
        for name, column in (("seq", seq), ("place", place), ("fill", fill)):
            found = found.append_column(name, pa.array(column))
        return found

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return (
        items.groupBy("block")
        .cogroup(best.groupBy("block"))
        .applyInArrow(lay, f"{schema}, seq bigint, place bigint, fill bigint")
    )


def pack(pieces: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """All rows of ``pieces`` (with a ``length`` from 1 to ``limit``) with ``sequence_id`` and ``offset``.

    A sequence's pieces lie gapless from offset 0 and take at most ``limit``. An empty table gives
    an empty result; repeated rows are pieces of their own. ``pieces`` is read once, into a
    checkpoint.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    all_items = checkpointed(numbered(pieces.select(F.struct(*kept).alias("piece"), F.col("length")), "item"))
    full = all_items.where(F.col("length") >= limit).select(
        "piece", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    loose, done, number = all_items.where(F.col("length") < limit), full, 0
    count = loose.count()
    while count:
        blocks = -(-count // block)
        items = loose.withColumn("block", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(blocks)))
        laid = checkpointed(_round(items.select("block", "item", "length"), limit))
        closed = F.col("fill") >= WELL * limit
        left = laid.where(~closed).count() if blocks > 1 else 0
        again = 2 * left < count and left > 0
        ready = laid.where(closed) if again else laid
        # a round has fewer than 2**34 blocks, a block fewer than 2**24 sequences
        seq = F.expr(f"({number}L << 58) | (block << 24) | seq")
        done = done.union(
            ready.select("item", seq.alias("sequence_id"), F.col("place").alias("offset"))
            .join(all_items, "item")
            .select("piece", "sequence_id", "offset")
        )
        if not again:
            break
        loose = laid.where(~closed).select("item", "length")
        count, number = left, number + 1
    return done.select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) with their place in a sequence.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    one id 0. Null and repeated ids are allowed: each row is a document. Other columns are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, limit), limit)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
