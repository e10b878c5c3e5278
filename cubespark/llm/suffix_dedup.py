"""Repeated passages by distributed prefix doubling over sampled positions.

A byte goes if a 400-byte string that covers it also starts anywhere else. Sorting
every byte position once per doubling moves hundreds of bytes per byte of text, so
positions are sampled by content first, without losing a repeat:

* Each 400-byte window has an anchor, the 40-byte string with the least hash in it (the
  leftmost of equals). Equal windows have equal anchors at equal offsets, and windows in a
  row share theirs, so there is about one anchor per 180 bytes. Its rank is the name of
  its 40 bytes; anchors of unique rank end here.
* Windows are cut by their distance to the anchor into cells of 80; all windows of a cell
  hold the same 320 bytes from position x on. Spark sorts the pairs (rank of 80 bytes at
  x, the same at x + 80) into ranks of 160 bytes, then the pairs at offset 160 into ranks
  of 320 bytes. After each round positions of unique rank are left.
* The last steps reach the threshold: a cell's windows cover bytes around the 320. Cells
  of equal rank and equal surroundings repeat whole. Where cells of a rank differ, one cell
  of each kind is ranked again in parts of ten windows (391 bytes in common), and parts
  that share their rank but not their surroundings window by window (400 bytes).

That is for the threshold of 400 bytes; another ``length`` takes cells of a fifth of it.

A rank is the hash of what it ranks, so ranks need no global numbering and a task that runs
again gives the same ones. Ranks are 64 bits, and equal windows agree in seven of them.

Null and empty texts have no bytes. A text that is there twice, in rows of equal or
different ids, repeats itself and goes from both rows. Null ids are ids like others. Long
texts are scanned in segments. An empty table gives an empty one. Columns besides id and text
are not read, and ``rewrite`` keeps them, whatever their names.

``remove_repeats`` removes by bytes alone. ``rewrite`` can also go by words: with ``words`` it cuts
the stretches of repeated strings of ``length`` bytes that hold more words than that, or 400
bytes and more. With ``words``, ``remove_repeats`` counts these stretches, at 250 bytes, in columns
of their own and removes the same as without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import BYTE_CODES, mixed, pieces, text_bytes
from cubespark.llm.steps import Steps, small

LENGTH, SEED, PART = 400, 40, 10
PASSAGE = 250
SEGMENT = 1 << 19
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


class Names:
    """64-bit names of any substring of some bytes, from running sums."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        scale = np.full(n + 1, BASE, np.uint64)
        scale[0] = 1
        np.multiply.accumulate(scale, out=scale)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[raw] * scale[:n], out=self.sums[1:])
        self.back = np.full(n + 1, INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def all(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.back) - length])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of that width."""
    n = len(values)
    rows = -(-n // width)
    filled = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:n] = values
    table = filled.reshape(rows, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def cell_of(length: int) -> int:
    """Bytes in a cell for that threshold."""
    if length % 5 or not 2 * SEED <= length <= 5 * 127:
        raise ValueError(f"a length is a multiple of 5 from {2 * SEED} to {5 * 127}, not {length}")
    return length // 5


def segments(offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Parts of texts with room for windows: rows, their begins and ends in the flat bytes,
    and the part of the bytes. Parts of one long text overlap by a window less one byte."""
    for low, high in pieces(offsets, SEGMENT):
        begin, end = int(offsets[low]), int(offsets[high])
        if high - low > 1 or end - begin <= SEGMENT + length:
            rows = np.arange(low, high)
            rows = rows[offsets[rows + 1] - offsets[rows] >= length]
            if len(rows):
                yield rows, offsets[rows], offsets[rows + 1], begin, end
            continue
        for at in range(begin, end - length + 1, SEGMENT):
            stop = min(at + SEGMENT + length - 1, end)
            yield np.array([low]), np.array([at]), np.array([stop]), at, stop


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of all windows: row, seed rank, position, first and last window, ranks of the
    blocks of a cell's size around it, and a name per cell of what its windows cover besides the core."""
    cell_size = cell_of(length)
    for rows, begins, ends, low, high in segments(offsets, length):
        names = Names(flat[low:high])
        kgrams = names.all(SEED)
        top = (kgrams & ~np.uint64(0xFFFFFF)) | np.arange(len(kgrams), dtype=np.uint64)
        least = window_minima(top, length - SEED + 1)
        counts = ends - begins - length + 1
        before = np.cumsum(counts) - counts
        p = np.arange(int(counts.sum())) + np.repeat(begins - low - before, counts)
        row = np.repeat(np.arange(len(rows)), counts)
        a = (least[p] & np.uint64(0xFFFFFF)).astype(np.int64)
        cell = (a - p) // cell_size
        change = np.ones(len(p), bool)
        change[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(p)) - 1
        change[1:] |= cell[1:] != cell[:-1]
        cells = np.flatnonzero(change)
        cell_last = np.append(cells[1:], len(p)) - 1
        x = a[cells] - cell_size * cell[cells]
        around = mixed(
            names.of(p[cells], x) * np.uint64(3) + names.of(x + 4 * cell_size, p[cell_last] + length)
        )
        n_blocks = cell[first] - cell[last] + 4
        block_ends = np.cumsum(n_blocks)
        step = np.arange(int(block_ends[-1])) - np.repeat(block_ends - n_blocks, n_blocks)
        at = np.repeat(a[first] - cell_size * cell[first], n_blocks) + cell_size * step
        # positions count from the start of the text
        shift = low - offsets[rows[row[first]]]
        yield {
            "row": rows[row[first]],
            "seed": kgrams[a[first]].view(np.int64),
            "anchor": a[first] + shift,
            "first": p[first] + shift,
            "last": p[last] + shift,
            "blocks": names.of(at, at + cell_size).view(np.int64),
            "block_ends": block_ends,
            "around": around.view(np.int64),
            "cell_ends": np.searchsorted(cells, last, "right"),
        }


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            for found in anchors(flat, offsets, length):
                row = pa.array(found["row"])

                def lists(values: str, ends: str) -> pa.Array:
                    bounds = np.concatenate([[0], found[ends]]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(found[values]))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(row),
                        batch.column("body").take(row),
                        pa.array(found["seed"]),
                        *(pa.array(found[n].astype(np.int32)) for n in ("anchor", "first", "last")),
                        lists("blocks", "block_ends"),
                        lists("around", "cell_ends"),
                    ],
                    names=["id", "body", "seed", "anchor", "first", "last", "blocks", "around"],
                )

    return run


def _repeated(steps: Steps, rows: DataFrame, keys: list[str], only: str = "true", wide: bool = False) -> DataFrame:
    """The rows whose keys are there more than once; of them those that ``only`` names.

    Counts combine before the shuffle. The keys are a table of their own, so that both sides
    of the join come straight from a shuffle and Spark can split a hot key over tasks. ``wide``
    rows stay where they are if the keys are few.
    """
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    several = steps.kept(several, "keys")
    if wide:
        several = small(several, several.count())
    return rows.where(only).join(several, keys, "left_semi")


def _part_rows(length: int):
    """The listed cells of each text in parts of ``PART`` windows: a rank for what all windows of a
    part share, a name for what they cover besides, and a name for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            for i, cells in enumerate(batch.column("cells")):
                listed = np.array([(c["x"].as_py(), c["lo"].as_py(), c["hi"].as_py(), c["rank"].as_py(), c["single"].as_py()) for c in cells], np.int64)
                for low in range(0, len(listed), 1 << 12):
                    x, lo, hi, rank, single = listed[low : low + (1 << 12)].T
                    begin, end = int(lo.min()), int(hi.max()) + length
                    names = Names(flat[offsets[i] + begin : offsets[i] + end])
                    # parts are cut by the distance to x, so equal windows fall into equal parts
                    counts = hi - lo + 1
                    before = np.cumsum(counts) - counts
                    p = np.arange(int(counts.sum())) + np.repeat(lo - before, counts)
                    cell = np.repeat(np.arange(len(x)), counts)
                    part = (x[cell] - p) // PART
                    change = np.ones(len(p), bool)
                    change[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
                    first = np.flatnonzero(change)
                    last = np.append(first[1:], len(p)) - 1
                    of, k = cell[first], part[first]
                    core_low = x[of] - PART * k - begin
                    core_high = x[of] - PART * (k + 1) + 1 + length - begin
                    core = names.of(core_low, core_high)
                    around = mixed(
                        names.of(p[first] - begin, core_low) * np.uint64(3) + names.of(core_high, p[last] + length - begin)
                    )
                    every = names.of(p - begin, p - begin + length)
                    take = pa.array(np.full(len(first), i))
                    bounds = pa.array(np.append(first, len(p)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(take),
                            batch.column("body").take(take),
                            pa.array(mixed(rank[of].view(np.uint64) * np.uint64(PART) + k.astype(np.uint64)).view(np.int64)),
                            pa.array(core.view(np.int64)),
                            pa.array(around.view(np.int64)),
                            pa.array((x[of] - p[last]).astype(np.int32)),
                            pa.array((x[of] - p[first]).astype(np.int32)),
                            pa.array(p[first].astype(np.int32)),
                            pa.array(single[of].astype(bool)),
                            pa.ListArray.from_arrays(bounds, pa.array(every.view(np.int64))),
                        ],
                        names=["id", "body", "rank", "core", "u", "j0", "j1", "lo", "single", "names"],
                    )

    return run


def cut(raw: bytes, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH, words: int | None = None) -> tuple[bytes, int]:
    """What is left of a text without the windows from lo to hi, and the number of gaps.

    With ``words``, gaps shorter than ``LENGTH`` that hold no more words stay in the text.
    """
    if not len(lo):
        return raw, 0
    order = np.argsort(lo, kind="stable")
    lo, ends = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > ends[:-1]
    starts = lo[new]
    stops = ends[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
    kept, at, gaps = [], 0, 0
    for start, stop in zip(starts.tolist(), stops.tolist()):
        if words is not None and stop - start < LENGTH and len(raw[start:stop].split()) <= words:
            continue
        kept.append(raw[at:start])
        at = stop
        gaps += 1
    kept.append(raw[at:])
    return b"".join(kept), gaps


def _windows(raw: bytes, copied: bool, lo: list[int] | None, hi: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs listed for a text; of one that is there twice, all its windows."""
    if copied:
        lo, hi = ([0], [len(raw) - length]) if len(raw) >= length else ([], [])
    return np.array(lo or [], np.int64), np.array(hi or [], np.int64)


def _cut_rows(with_text: bool, words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple[int, int, int]] = []
            last, passages = [], []
            for text, copied, lo, hi in zip(*(batch.column(n) for n in ("text", "copied", "lo", "hi"))):
                raw = (text.as_py() or "").encode()
                kept, spans = cut(raw, *_windows(raw, copied.as_py(), lo.as_py(), hi.as_py(), LENGTH))
                counts.append((len(raw), len(raw) - len(kept), spans))
                # a cut between bytes may split a character, which then goes
                last.append(kept.decode(errors="ignore") if with_text else hashlib.sha256(kept).hexdigest())
            columns = [pa.array(x, pa.int64()) for x in zip(*counts)] or [pa.array([], pa.int64())] * 3
            columns = [batch.column("id"), *columns, pa.array(last, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
            if words is not None:
                for text, copied, lo, hi in zip(*(batch.column(n) for n in ("text", "copied", "passage_lo", "passage_hi"))):
                    raw = (text.as_py() or "").encode()
                    kept, found = cut(raw, *_windows(raw, copied.as_py(), lo.as_py(), hi.as_py(), PASSAGE), PASSAGE, words)
                    passages.append((found, len(raw) - len(kept)))
                columns += [pa.array(x, pa.int64()) for x in zip(*passages)] or [pa.array([], pa.int64())] * 2
                names += ["n_passages", "passage_bytes"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, body, lo, hi): runs of starts of windows of ``length`` bytes that repeat, of rows (id, body, text)."""
    cell = cell_of(length)
    steps = Steps(docs.sparkSession)
    id_kind = docs.schema["id"].dataType.simpleString()
    # ranks of 40 bytes
    found = docs.mapInArrow(
        _anchor_rows(length),
        f"id {id_kind}, body bigint, seed bigint, anchor int, first int, last int, blocks array<bigint>, around array<bigint>",
    )
    found = steps.kept(found, "anchors")
    cells = _repeated(steps, found, ["seed"], wide=True).select("*", F.posexplode("around").alias("i", "u"))
    x = F.expr(f"anchor - {cell} * (floor((anchor - first) / {cell}) - i)").cast("int")
    cells = cells.withColumn("x", x).select(
        "id",
        "body",
        "x",
        (F.col("x") - F.least("last", "x")).cast("tinyint").alias("j0"),
        (F.col("x") - F.greatest(F.col("first"), F.col("x") - (cell - 1))).cast("tinyint").alias("j1"),
        "u",
        *(F.get("blocks", F.col("i") + k).alias(f"b{k}") for k in range(4)),
    )
    # ranks of 160 bytes (two cells) from pairs at offset 80, at x and at x + 160
    cells = cells.select(
        "id", "body", "x", "j0", "j1", "u", F.xxhash64("b0", "b1").alias("rank"), F.xxhash64("b2", "b3").alias("next")
    )
    cells = steps.kept(cells, "ranks-160")
    steps.drop("anchors")
    # ranks of 320 bytes (four cells) from pairs at offset 160
    cells = _repeated(steps, cells, ["rank"]).withColumn("rank", F.xxhash64("rank", "next")).drop("next")
    cells = steps.kept(cells, "ranks-320")
    steps.drop("ranks-160")
    cells = steps.kept(_repeated(steps, cells, ["rank"]), "cells")
    steps.drop("ranks-320")

    # the threshold: cells that repeat whole
    kind = ["rank", "j0", "j1", "u"]
    kinds = cells.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "body", "x")).alias("at"))
    kinds = steps.kept(kinds, "kinds")
    whole = cells.join(kinds.where("n > 1").select(*kind), kind, "left_semi")  # both are tables
    whole = whole.select("id", "body", (F.col("x") - F.col("j1")).alias("lo"), (F.col("x") - F.col("j0")).alias("hi"))
    whole = steps.kept(whole, "whole")

    # where a rank has several kinds of cells, one of each kind by parts
    several = kinds.groupBy("rank").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    several = steps.kept(several, "mixed-ranks")
    asked = kinds.join(several.select("rank"), "rank", "left_semi").select(
        F.col("at.id").alias("id"),
        F.col("at.body").alias("body"),
        F.struct(
            F.col("at.x").alias("x"),
            (F.col("at.x") - F.col("j1")).alias("lo"),
            (F.col("at.x") - F.col("j0")).alias("hi"),
            "rank",
            (F.col("n") == 1).cast("int").alias("single"),
        ).alias("cell"),
    )
    asked = steps.kept(asked.groupBy("id", "body").agg(F.collect_list("cell").alias("cells")), "asked")
    steps.drop("cells", "kinds")
    ids = asked.select("id").distinct()
    texts = docs.join(small(ids, asked.count()), docs["id"].eqNullSafe(ids["id"]), "left_semi")
    same = (texts["body"] == asked["body"]) & texts["id"].eqNullSafe(asked["id"])
    texts = texts.join(asked, same).select(texts["id"], texts["body"], "text", "cells")
    parts = texts.mapInArrow(
        _part_rows(length),
        f"id {id_kind}, body bigint, rank bigint, core bigint, u bigint, j0 int, j1 int, lo int, single boolean, names array<bigint>",
    )
    parts = steps.kept(parts, "parts")
    steps.drop("asked")
    parts = steps.kept(_repeated(steps, parts, ["rank", "core"]), "parts-shared")
    steps.drop("parts")
    kind = ["rank", "core", "u", "j0", "j1"]
    several = steps.kept(parts.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")), "part-kinds")
    counted = parts.join(several, kind)
    own = F.col("single")
    whole_parts = counted.where(own & (F.col("n") > 1)).select(
        "id", "body", "lo", (F.col("lo") + F.col("j1") - F.col("j0")).alias("hi")
    )
    # windows one by one; of parts of one kind each has the same names
    windows = counted.select("id", "body", "rank", "lo", own.alias("single"), "n", F.posexplode("names").alias("i", "name"))
    singles = _repeated(steps, windows, ["rank", "name"], "single and n = 1").select("id", "body", (F.col("lo") + F.col("i")).alias("lo"))
    singles = singles.select("id", "body", "lo", F.col("lo").alias("hi"))
    return steps.kept(whole.union(whole_parts).union(singles), "runs")


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", with_text: bool = True, words: int | None = None
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans) of each row, and what is left: ``kept_text``, or without
    text ``kept_sha256``, the digest of the remaining bytes.

    With ``words`` also ``n_passages`` and ``passage_bytes``: the stretches of repeated strings of 250
    bytes that hold more words than that, or 400 bytes, and their bytes. They are removed only where
    strings of 400 bytes cover them.
    """
    docs = df.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), F.col(text).alias("text"))
    # of equal texts one goes through the rounds: all windows of the others repeat, and of that one
    steps = Steps(df.sparkSession)
    copies = docs.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id")).alias("first")).where("n > 1")
    copies = steps.kept(copies.select(F.col("body").alias("copy"), "first"), "copies")
    copies = small(copies, copies.count())
    once = docs.join(copies, F.col("body") == F.col("copy"), "left").where("copy is null or first.id <=> id").select("id", "body", "text")
    if words is None:
        runs = repeated_windows(once).select("*", F.lit(True).alias("removed"))
    else:
        passages = repeated_windows(once, PASSAGE)
        # whoever holds a repeat of 400 bytes holds one of 250 at each of its first 151 bytes
        held = passages.groupBy("id", "body").agg(F.sum(F.expr("hi - lo + 1")).alias("n")).where(f"n > {LENGTH - PASSAGE}")
        same = once["id"].eqNullSafe(held["id"]) & (once["body"] == held["body"])
        holders = steps.kept(once.join(held, same, "left_semi"), "holders")
        runs = repeated_windows(holders).select("*", F.lit(True).alias("removed"))
        runs = runs.union(passages.select("*", F.lit(False).alias("removed")))
    run = F.struct("lo", "hi")
    runs = runs.groupBy(F.col("id").alias("i"), F.col("body").alias("b")).agg(
        F.collect_set(F.when(F.col("removed"), run)).alias("runs"), F.collect_set(F.when(~F.col("removed"), run)).alias("passages")
    )
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b"))
    lists = [F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi")]
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept string"
    if words is not None:
        lists += [F.col("passages.lo").alias("passage_lo"), F.col("passages.hi").alias("passage_hi")]
        schema += ", n_passages bigint, passage_bytes bigint"
    joined = docs.join(runs, same, "left").join(copies, F.col("body") == F.col("copy"), "left")
    joined = joined.select("id", "text", F.col("copy").isNotNull().alias("copied"), *lists)
    out = joined.mapInArrow(_cut_rows(with_text, words), schema)
    return out.withColumnsRenamed({"id": id_column, "kept": "kept_text" if with_text else "kept_sha256"})


def rewrite(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, words: int | None = None
) -> DataFrame:
    """The rows with what is left as their text and ``n_chars`` to match, other columns as they are.

    Rows of one id are told apart by their text. With ``words``, see above, repeats of no more
    words stay if they are shorter than 400 bytes.
    """
    # the rows are one column, whatever their columns are called
    body = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body")
    keyed = df.select(F.col(f"`{id_column}`").alias("id"), body, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    runs = repeated_windows(keyed.select("id", "body", F.col("row")[text].alias("text")), length)
    runs = runs.groupBy("id", "body").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = runs.select(F.col("id").alias("i"), F.col("body").alias("b"), F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))
    joined = keyed.join(runs, F.col("id").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b")), "left")
    names = df.columns
    # by position, next to the runs
    plan = joined.select(*[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(names)], "lo", "hi")
    wanted, text_at, chars_at = df.schema, names.index(text), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for value, lo, hi in zip(batch.column(text_at), batch.column("lo"), batch.column("hi")):
                raw = value.as_py()
                runs_of = [np.array(x.as_py() or [], np.int64) for x in (lo, hi)]
                left.append(raw if raw is None else cut(raw.encode(), *runs_of, length, words)[0].decode(errors="ignore"))
            arrays = batch.columns[: len(names)]
            arrays[text_at] = pa.array(left, pa.string())
            if chars_at is not None:
                arrays[chars_at] = pa.array([None if x is None else len(x) for x in left], arrays[chars_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plan.mapInArrow(run, wanted)
