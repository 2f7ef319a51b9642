"""Documents in compressed blocks, and lookups from blocks to hash-dealt parts and back.

Operators that need corpus-wide facts about what stands in a text (is this string elsewhere, how often is this word)
use three steps: a block sends its *distinct* keys, dealt by hash into parts; each part, one group of a shuffle, merges
the keys of all blocks; the answers go back to the block, aligned with what it sent. A key that a third of all
documents share is sent once a block, and the text itself is shuffled by block only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

BLOCK = 4 << 20  # bytes of text that close a block; a block holds whole documents, one at least


def pack(obj) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(obj, protocol=5))


def unpack(data):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(data)))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes], int]]:
    """(doc ids with None for null, texts as UTF-8 bytes, their bytes) of each block; a null text is empty."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = (text.as_py() or "").encode()
            ids.append(doc)
            texts.append(body)
            n += len(body)
            if n >= size:
                yield ids, texts, n
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts, n


def shaped(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, n_bytes, data): data packs (doc ids, texts), see ``gathered``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, n in gathered(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pack((ids, texts))], pa.binary())],
                                             names=["n_bytes", "data"])

    packed = shaped(docs).mapInArrow(gather, "n_bytes long, data binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


LEAST_PARTS = 16


def parts_for(total: int, each: int) -> int:
    """Parts of about ``each`` bytes of text, some at least: their number follows the corpus, not the session."""
    return max(LEAST_PARTS, -(-total // each))


SENT = "part long, block long, sent binary"


def send(held: DataFrame, ask: Callable[[tuple, list], dict[int, object]], answers: list[DataFrame] = (),
         tasks: int | None = None) -> DataFrame:
    """(part, block, sent): ``ask(unpacked data, answers)`` gives each part's question of a block.

    ``answers`` are earlier rounds: each is passed as {part: answer} of that block. ``tasks``: see ``with_answers``.
    """
    if not answers:
        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for block, data in zip(frame["block"], frame["data"]):
                    asked = ask(unpack(data), [])
                    yield pd.DataFrame({"part": list(asked), "block": block, "sent": [pack(x) for x in asked.values()]})

        return held.select("block", "data").mapInPandas(scan, SENT)

    rounds = len(answers)

    def one(key, block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for data in block["data"]:
            asked = ask(unpack(data), by_round(back, rounds))
            frames.append(pd.DataFrame({"part": list(asked), "block": key[0], "sent": [pack(x) for x in asked.values()]}))
        return pd.concat(frames) if frames else pd.DataFrame({"part": [], "block": [], "sent": []})

    return with_answers(held, answers, one, SENT, tasks)


def by_round(back: pd.DataFrame, rounds: int) -> list[dict]:
    out: list[dict] = [{} for _ in range(rounds)]
    for r, part, answer in zip(back["round"], back["part"], back["answer"]):
        out[r][part] = unpack(answer)
    return out


def with_answers(held: DataFrame, answers: list[DataFrame], one: Callable, schema: str,
                 tasks: int | None = None) -> DataFrame:
    """``one(key, block rows, answer rows)`` for each block with the answers of all rounds.

    The exchange has ``tasks`` tasks, or as many as the session says.
    """
    back = None
    for r, a in enumerate(answers):
        a = a.where(f"block <> {OWN}").select("block", "part", "answer", F.lit(r).alias("round"))
        back = a if back is None else back.unionByName(a)
    held = held.select("block", "data")
    if tasks:
        held, back = held.repartition(tasks, "block"), back.repartition(tasks, "block")
    return held.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(one, schema)


def answer(sent: DataFrame, merge: Callable[[list], tuple[list, pd.DataFrame | None]], name: str,
           tasks: int | None = None) -> DataFrame:
    """(block, part, answer): ``merge`` maps the questions of one part, a block each, to their answers in order.

    The frame it returns beside them (or None) is what the part knows by itself, see ``facts``.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found, known = merge([unpack(x) for x in rows["sent"]])
        to = rows.iloc[:len(found)]  # a merge that answers no block returns no list
        out = pd.DataFrame({"block": to["block"], "part": to["part"], "answer": [pack(x) for x in found]})
        if known is not None:
            own = pd.DataFrame({"block": [OWN], "part": rows["part"][:1].tolist(), "answer": [pack(known)]})
            out = pd.concat([out, own], ignore_index=True)
        return out

    if tasks:
        sent = sent.repartition(tasks, "part")
    answered = sent.groupBy("part").applyInPandas(one, "block long, part long, answer binary")
    return cut_lineage(answered, name, free=True)  # a round's questions are not read again


OWN = -1  # stands for the block in rows that hold a part's own knowledge


def facts(answered: DataFrame, schema: str) -> DataFrame:
    """The frames that parts returned beside their answers."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from map(unpack, frame["answer"])

    return answered.where(f"block = {OWN}").select("answer").mapInPandas(rows, schema)


def split_by(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions) for every part present."""
    order = np.argsort(parts, kind="stable")
    if len(order):
        edges = np.nonzero(np.diff(parts[order]))[0] + 1
        for own in np.split(order, edges):
            yield int(parts[own[0]]), own
